"""Registered queries of the record engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import canon, fixed, semantics
from palimpsest.functions.patterns import matches, nfkc
from palimpsest.operators import commit, graph, ingest, operations, queue, receipts, records, review, sessions, verify
from palimpsest.operators.validate import violations
from palimpsest.sources.lens import duck, lens

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Times at which validity is asked for.
EARLY, LATE = "2024-01-30 12:00:00", "2024-02-05 00:00:00"


def query(*names: str, sql: str | None = None, as_: str | None = None):
    """Registers a function of lenses under its name."""

    def put(f):
        name = as_ or f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(*(lens(spark, sf_dir, n) for n in names))
        if sql:
            ORACLES[name] = duck(sql, *names)
        return f

    return put


def at(time: str):
    return F.lit(time).cast("timestamp_ntz")


HEADS = "heads AS (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision DESC) = 1)"


# Records and their feed.


@query("revisions", sql="SELECT memory_id, ns, semantic_key, revision, commit_seq, status, event_id FROM revisions QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision DESC) = 1")
def current_heads(revisions):
    return records.heads(revisions).select("memory_id", "ns", "semantic_key", "revision", "commit_seq", "status", "event_id")


@query(
    "revisions",
    sql=f"+{HEADS} SELECT h.memory_id, r.event_id, r.memory_kind FROM heads h JOIN revisions r ON r.memory_id = h.memory_id AND r.revision = h.revision WHERE h.status = 'active'",
)
def current_revisions(revisions):
    h = records.heads(revisions).where("status = 'active'").select("memory_id", F.col("revision").alias("current_revision"))
    return records.current_revisions(h, revisions).select("memory_id", "event_id", "memory_kind")


@query("revisions", sql="+ req AS (SELECT memory_id, revision + 50 AS revision, event_id AS pos FROM revisions) SELECT q.pos, q.memory_id, q.revision, r.event_id FROM req q LEFT JOIN revisions r USING (memory_id, revision)")
def hydrate_ordered(revisions):
    requests = revisions.select("memory_id", (F.col("revision") + 50).alias("revision"), F.col("event_id").alias("pos"))
    return records.hydrated(requests, revisions.select("memory_id", "revision", "event_id")).select("pos", "memory_id", "revision", "event_id")


def _as_of(time):
    sql = f"SELECT ns, count(*) AS n, count(DISTINCT memory_id) AS memories FROM revisions WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{time}') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '{time}') GROUP BY ns"

    @query("revisions", sql=sql, as_="as_of_valid" if time == EARLY else "as_of_valid_late")
    def as_of(revisions):
        return records.valid_at(revisions, at(time)).groupBy("ns").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("memory_id").alias("memories"))


_as_of(EARLY)
_as_of(LATE)


@query("revisions", sql="SELECT commit_seq, memory_id, revision, op, n > 100 AS has_more, commit_seq - k = 500 AS gapless FROM (SELECT *, row_number() OVER (ORDER BY commit_seq) AS k, count(*) OVER () AS n FROM (SELECT * FROM revisions WHERE ns = 'ns1' AND commit_seq > 500 ORDER BY commit_seq LIMIT 101)) WHERE k <= 100")
def change_page(revisions):
    return records.changes_after(revisions, "ns1", 500, 100).select("commit_seq", "memory_id", "revision", "op", "has_more", "gapless")


@query("revisions", sql="+ gappy AS (SELECT ns, commit_seq + 3 * (commit_seq // 700) AS commit_seq FROM revisions), l AS (SELECT ns, commit_seq, coalesce(lag(commit_seq) OVER (PARTITION BY ns ORDER BY commit_seq), 0) AS b FROM gappy) SELECT ns, b + 1 AS gap_from, commit_seq - 1 AS gap_to FROM l WHERE commit_seq > b + 1")
def change_gaps(revisions):
    return records.gaps(revisions.select("ns", F.expr("commit_seq + 3 * (commit_seq div 700)").alias("commit_seq")), ["ns"])


@query("revisions", "devices", sql="+ m AS (SELECT ns, max(applied) AS w FROM devices GROUP BY ns) SELECT r.event_id, r.ns, coalesce(w, 0) + row_number() OVER (PARTITION BY r.ns ORDER BY r.event_id) AS commit_seq FROM revisions r LEFT JOIN m ON m.ns = r.ns")
def commit_seq_assign(revisions, devices):
    marks = records.high_water(devices.select("ns", F.col("applied").alias("commit_seq")), ["ns"])
    return records.sequenced(revisions.select("event_id", "ns"), marks, ["ns"], "event_id").select("event_id", "ns", F.col("commit_seq").cast("long").alias("commit_seq"))


@query("revisions", sql="SELECT memory_id, commit_seq, ns, revision FROM revisions")
def revision_numbers(revisions):
    return records.numbered(revisions.select("memory_id", "commit_seq", "ns"))


@query("revisions", sql="SELECT ns, max(commit_seq) AS high_water FROM revisions GROUP BY ns")
def high_watermark(revisions):
    return records.high_water(revisions, ["ns"])


@query("revisions", sql="+ c AS (SELECT memory_id, revision, md5(concat(memory_id, '/', CASE WHEN event_id % 211 = 0 THEN 0 ELSE revision END)) AS payload_hash, event_id FROM revisions), r AS (SELECT memory_id, CASE WHEN event_id % 307 = 0 THEN -revision ELSE revision END AS revision, md5(concat(memory_id, '/', revision)) AS h FROM revisions) SELECT c.memory_id, c.revision, CASE WHEN h IS NULL THEN 'REVISION_MISSING' ELSE 'PAYLOAD_HASH' END AS problem FROM c LEFT JOIN r USING (memory_id, revision) WHERE payload_hash IS DISTINCT FROM h")
def change_proof(revisions):
    path = lambda rev: F.md5(F.concat("memory_id", F.lit("/"), rev.cast("string")))
    changes = revisions.select("memory_id", "revision", path(F.when(F.col("event_id") % 211 == 0, 0).otherwise(F.col("revision"))).alias("payload_hash"))
    held = revisions.select("memory_id", F.when(F.col("event_id") % 307 == 0, -F.col("revision")).otherwise(F.col("revision")).alias("revision"), path(F.col("revision")).alias("payload_hash"))
    return records.change_proof(changes, held).select("memory_id", "revision", "problem")


@query("devices", "revisions", sql="+ m AS (SELECT ns, max(commit_seq) AS w FROM revisions GROUP BY ns) SELECT device_id, ns, applied, coalesce(w, 0) AS high_water, coalesce(greatest(w - applied, 0), 0) AS lag FROM devices LEFT JOIN m USING (ns)")
def device_fleet_lag(devices, revisions):
    return operations.device_lag(devices, records.high_water(revisions, ["ns"])).select("device_id", "ns", "applied", "high_water", "lag")


@query(
    "devices",
    "revisions",
    sql="""+ m AS (SELECT ns, max(commit_seq) AS w FROM revisions GROUP BY ns), d AS (SELECT device_id, ns, coalesce(w, 0) AS w, applied % 1500 AS a1 FROM devices LEFT JOIN m USING (ns)),
    s1 AS (SELECT *, CASE WHEN a1 > 0 AND a1 <= 1000 AND a1 <= w THEN a1 ELSE 0 END AS x1 FROM d), s2 AS (SELECT *, CASE WHEN x1 = a1 AND a1 + 900 <= w THEN a1 + 900 ELSE x1 END AS x2 FROM s1)
    SELECT device_id, ns, CAST(x2 AS BIGINT) AS applied_seq, CAST(w AS BIGINT) AS high_water FROM s2""",
)
def device_acks(devices, revisions):
    first = devices.select("device_id", "ns", F.lit(1).alias("pos"), F.lit(0).cast("long").alias("expected"), (F.col("applied") % 1500).alias("applied"))
    second = first.select("device_id", "ns", F.lit(2).alias("pos"), F.col("applied").alias("expected"), (F.col("applied") + 900).alias("applied"))
    return records.acknowledged(first.unionByName(second), records.high_water(revisions, ["ns"])).select("device_id", "ns", "applied_seq", "high_water")


@query("revisions", sql=f"+{HEADS} SELECT memory_id, revision, memory_kind, n > 20 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY memory_id) AS k, count(*) OVER () AS n FROM (SELECT * FROM heads WHERE ns = 'ns2' AND memory_id > 'mem_12' ORDER BY memory_id LIMIT 21)) WHERE k <= 20")
def inventory_page(revisions):
    h = records.heads(revisions).where("ns = 'ns2'")
    rows = operations.inventory(h.select("memory_id", "revision"), revisions.select("memory_id", "revision", "memory_kind"))
    return records.page(rows, ["memory_id"], ["mem_12"], 20).select("memory_id", "revision", "memory_kind", "has_more")


@query("materializations", sql="SELECT provider, memory_id, outcome, canonical_revision FROM (SELECT * FROM materializations WHERE provider > 'p2' OR (provider = 'p2' AND memory_id > 'mem_5') ORDER BY provider, memory_id LIMIT 15)")
def materialization_page(materializations):
    # A record is settled more than once in larger tables; what settled first comes first, which the SQL leaves open.
    return records.page(materializations, ["provider", "memory_id", "settled_at"], ["p2", "mem_5"], 15).select("provider", "memory_id", "outcome", "canonical_revision")


@query(
    "revisions", "outbox", "materializations", "devices",
    sql=f"""+{HEADS}, h AS (SELECT * FROM heads WHERE ns = 'ns1'), o AS (SELECT * FROM outbox WHERE ns = 'ns1'), m AS (SELECT m.* FROM materializations m JOIN h USING (memory_id))
    SELECT (SELECT count(*) FILTER (status = 'active') FROM h) AS active, (SELECT count(*) FILTER (status = 'tombstoned') FROM h) AS tombstoned, (SELECT count(*) FROM h) AS memories,
    (SELECT count(*) FILTER (status = 'PENDING') FROM o) AS pending, (SELECT count(*) FILTER (status = 'PROCESSING') FROM o) AS processing, (SELECT count(*) FILTER (status = 'FAILED') FROM o) AS failed, (SELECT count(*) FILTER (status = 'DONE') FROM o) AS done,
    (SELECT count(*) FILTER (outcome = 'CURRENT') FROM m) AS current, (SELECT count(*) FILTER (outcome = 'STALE') FROM m) AS stale, (SELECT count(*) FILTER (outcome = 'FAILED') FROM m) AS broken,
    (SELECT max(commit_seq) FROM revisions WHERE ns = 'ns1') AS high_water, (SELECT count(*) FROM devices WHERE ns = 'ns1') AS devices,
    (SELECT greatest((SELECT max(commit_seq) FROM revisions WHERE ns = 'ns1') - min(applied), 0) FROM devices WHERE ns = 'ns1') AS max_lag""",
)
def namespace_summary(revisions, outbox, materializations, devices):
    return operations.summary(records.heads(revisions), outbox, materializations.withColumnRenamed("outcome", "status"), devices, revisions, "ns1")


@query("revisions", "outbox", "devices", sql="SELECT 'revisions' AS name, count(*) AS n FROM revisions UNION ALL SELECT 'outbox', count(*) FROM outbox UNION ALL SELECT 'devices', count(*) FROM devices")
def state_snapshot(revisions, outbox, devices):
    return operations.snapshot({"revisions": revisions, "outbox": outbox, "devices": devices})


@query("revisions", "outbox", sql="SELECT 'revisions' AS name, count(*) FILTER (valid_from >= TIMESTAMP '2024-01-15') AS delta FROM revisions UNION ALL SELECT 'outbox', count(*) FILTER (status <> 'DONE') - count(*) FROM outbox")
def snapshot_delta(revisions, outbox):
    before = operations.snapshot({"revisions": revisions.where(F.col("valid_from") < at("2024-01-15")), "outbox": outbox})
    return operations.snapshot_delta(before, operations.snapshot({"revisions": revisions, "outbox": outbox.where("status <> 'DONE'")}))


# Verification.

DECISION = """CASE WHEN h.memory_id IS NULL THEN 'NOT_FOUND' WHEN h.ns <> 'ns0' AND h.ns <> 'ns1' THEN 'SCOPE_MISMATCH' WHEN h.status = 'tombstoned' THEN 'TOMBSTONED'
 WHEN q.claimed_revision <> h.revision THEN 'REVISION_MISMATCH' WHEN NOT h.intact THEN 'REVISION_INTEGRITY' WHEN h.valid_from > TIMESTAMP '{t}' THEN 'NOT_YET_VALID' WHEN h.valid_until < TIMESTAMP '{t}' THEN 'NO_LONGER_VALID' ELSE 'ALLOW' END"""
#: Hits that claim the current revision, but for one in eleven.
CLAIMS = "c AS (SELECT x.memory_id, x.rank, coalesce(h.revision, 1) - CASE WHEN x.rank % 11 = 0 THEN 1 ELSE 0 END AS claimed_revision FROM hits x LEFT JOIN heads h USING (memory_id)), q AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY rank) = 1)"


def _claims(hits, h):
    at_ = h.select("memory_id", F.col("current_revision").alias("__r"))
    return hits.join(at_, "memory_id", "left").select("memory_id", "rank", (F.coalesce("__r", F.lit(1)) - F.when(F.col("rank") % 11 == 0, 1).otherwise(0)).alias("claimed_revision"))


def _asked(hits, revisions):
    """Revisions and heads of what hits ask for."""
    asked = verify.of_requests(revisions, hits)
    return asked, records.heads(asked).withColumnRenamed("revision", "current_revision")


def _decided(hits, revisions, time):
    asked, h = _asked(hits, revisions)
    requests = verify.first_hits(_claims(hits, h)).withColumn("expected_revision", F.col("claimed_revision"))
    # Either of two scopes is asked for.
    scope = F.when(F.col("__ns").isin("ns0", "ns1"), F.col("__ns")).otherwise("ns0")
    return verify.decided(requests, h, asked, scope, at(time))


def _verify(time, suffix):
    d = DECISION.format(t=time)

    @query("hits", "revisions", sql=f"+{HEADS}, {CLAIMS} SELECT q.memory_id, q.rank, q.claimed_revision, {d} AS decision FROM q LEFT JOIN heads h USING (memory_id)", as_=f"verify_decisions{suffix}")
    def verify_decisions(hits, revisions):
        return _decided(hits, revisions, time).select("memory_id", "rank", "claimed_revision", "decision")

    @query("hits", "revisions", sql=f"+{HEADS}, {CLAIMS} SELECT reason, count(*) AS n FROM (SELECT {d} AS reason FROM q LEFT JOIN heads h USING (memory_id)) WHERE reason <> 'ALLOW' GROUP BY reason", as_=f"suppression_counts{suffix}")
    def suppression_counts(hits, revisions):
        return verify.counted(_decided(hits, revisions, time))


_verify(EARLY, "")
_verify(LATE, "_late")


@query("hits", "revisions", sql=f"+{HEADS}, {CLAIMS} SELECT memory_id, rank FROM (SELECT q.memory_id, q.rank, {DECISION.format(t=EARLY)} AS d, h.ns FROM q LEFT JOIN heads h USING (memory_id)) WHERE d = 'ALLOW' AND ns = 'ns1' ORDER BY rank LIMIT 5")
def verified_retrieval_topk(hits, revisions):
    asked, h = _asked(hits, revisions)
    return verify.retrieved(_claims(hits, h), h, asked, F.lit("ns1"), at(EARLY), 5).select("memory_id", "rank")


@query("hits", sql="SELECT memory_id, max(claimed_revision) AS claimed_revision, min(rank) AS first_rank FROM hits WHERE claimed_revision >= 1 GROUP BY memory_id ORDER BY first_rank LIMIT 40")
def provider_best_claim(hits):
    return verify.best_claims(hits, 40)


@query("hits", sql="SELECT memory_id, rank, claimed_revision, disputed FROM (SELECT *, min(claimed_revision) OVER w <> max(claimed_revision) OVER w AS disputed, row_number() OVER (PARTITION BY memory_id ORDER BY rank) AS k FROM hits WINDOW w AS (PARTITION BY memory_id)) WHERE k = 1")
def provider_first_hit(hits):
    return verify.first_hits(hits)


VIEW = f"""+{HEADS}, mine AS (SELECT semantic_key, memory_id AS own, status = 'active' AS allowed FROM heads WHERE ns = 'ns0'),
 p AS (SELECT 0 AS mount, rank AS pos, x.memory_id, rank, semantic_key FROM hits x JOIN heads h USING (memory_id) WHERE h.ns = 'ns0' AND h.status = 'active' AND rank < 250),
 m AS (SELECT 1 + rank % 2 AS mount, rank AS pos, concat('old_', memory_id) AS memory_id, rank, concat('key_', rank % 200) AS semantic_key FROM hits WHERE rank >= 250),
 a AS (SELECT * FROM p UNION ALL SELECT * FROM m), j AS (SELECT a.*, own, mount > 0 AND own IS NOT NULL AS ov, mount > 0 AND own IS NOT NULL AND NOT allowed AS blocked FROM a LEFT JOIN mine USING (semantic_key)),
 s AS (SELECT *, CASE WHEN ov THEN own ELSE memory_id END AS shown_id FROM j), f AS (SELECT *, NOT blocked AND row_number() OVER (PARTITION BY shown_id ORDER BY CAST(blocked AS INT), mount, pos) = 1 AS fst FROM s),
 o AS (SELECT *, CASE WHEN blocked THEN 'VIEW_PRIMARY_SUPPRESSION' WHEN fst THEN 'SHOWN' WHEN ov THEN 'VIEW_PRIMARY_OVERRIDE' ELSE 'VIEW_DUPLICATE' END AS outcome FROM f),
 t AS (SELECT mount, pos FROM o WHERE outcome = 'SHOWN' ORDER BY rank, mount, pos LIMIT 60)"""


def _view(hits, revisions):
    own = records.heads(revisions.where("ns = 'ns0'"))
    primary = hits.where("rank < 250").join(own.where("status = 'active'").select("memory_id", "semantic_key"), "memory_id").select(F.lit(0).cast("long").alias("mount"), F.col("rank").alias("pos"), "memory_id", "rank", "semantic_key")
    old = hits.where("rank >= 250").select((1 + F.col("rank") % 2).alias("mount"), F.col("rank").alias("pos"), F.concat(F.lit("old_"), "memory_id").alias("memory_id"), "rank", F.concat(F.lit("key_"), (F.col("rank") % 200).cast("string")).alias("semantic_key"))
    return primary, old, own.select("semantic_key", "memory_id", (F.col("status") == "active").alias("allowed"))


@query("hits", "revisions", sql=VIEW + " SELECT CAST(o.mount AS BIGINT) AS mount, o.pos, rank, semantic_key, shown_id, CASE WHEN outcome = 'SHOWN' AND t.pos IS NULL THEN 'VIEW_TOP_K' ELSE outcome END AS outcome FROM o LEFT JOIN t ON t.mount = o.mount AND t.pos = o.pos")
def federated_view(hits, revisions):
    return verify.federated(*_view(hits, revisions), 60)


@query("hits", "revisions", sql=VIEW + " SELECT m.semantic_key, m.memory_id, own AS shadowed_by FROM m JOIN mine USING (semantic_key)")
def shadowed_keys(hits, revisions):
    _, old, own = _view(hits, revisions)
    return verify.shadowed(own, old).select("semantic_key", "memory_id", "shadowed_by")


# Outbox.

NOW = f"TIMESTAMP '{EARLY}'"


@query("outbox", sql=f"SELECT outbox_id, memory_id, revision, status FROM outbox o WHERE ns = 'ns1' AND ((status IN ('PENDING', 'FAILED') AND (next_attempt_at IS NULL OR next_attempt_at <= {NOW})) OR (status = 'PROCESSING' AND lease_until <= {NOW})) AND NOT EXISTS (SELECT 1 FROM outbox e WHERE e.memory_id = o.memory_id AND e.revision < o.revision AND e.status <> 'DONE') ORDER BY created_at, outbox_id LIMIT 25")
def outbox_claimable(outbox):
    return queue.claimable(outbox, "ns1", at(EARLY), 25).select("outbox_id", "memory_id", "revision", "status")


@query("outbox", sql="SELECT outbox_id, status, coalesce(max(CAST(status <> 'DONE' AS INT)) OVER (PARTITION BY memory_id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS blocked FROM outbox")
def outbox_fifo_gate(outbox):
    return queue.gated(outbox).select("outbox_id", "status", "blocked")


@query("outbox", sql=f"""+ r AS (SELECT outbox_id, CASE WHEN revision % 3 = 0 THEN 'w9' ELSE claimed_by END AS worker, token AS tok, revision % 4 <> 0 AS all_current, CASE WHEN revision % 7 = 0 THEN 'timeout' END AS error FROM outbox),
 j AS (SELECT o.*, r.*, coalesce(status = 'PROCESSING' AND claimed_by = worker AND token = tok AND lease_until > {NOW}, false) AS accepted FROM outbox o LEFT JOIN r ON r.outbox_id = o.outbox_id)
 SELECT outbox_id, accepted, CASE WHEN NOT accepted THEN status WHEN error IS NULL AND all_current THEN 'DONE' ELSE 'FAILED' END AS new_status FROM j""")
def outbox_settle_fold(outbox):
    results = outbox.select(
        "outbox_id", F.when(F.col("revision") % 3 == 0, "w9").otherwise(F.col("claimed_by")).alias("worker"), "token", (F.col("revision") % 4 != 0).alias("all_current"), F.when(F.col("revision") % 7 == 0, "timeout").alias("error")
    )
    return queue.settled(outbox, results, at(EARLY)).select("outbox_id", "accepted", "new_status")


@query("materializations", sql="SELECT provider, memory_id, max(canonical_revision) AS canonical_revision, max(canonical_revision) FILTER (outcome = 'CURRENT') AS materialized_revision, arg_max(outcome, settled_at) AS status FROM materializations GROUP BY provider, memory_id")
def materialization_state(materializations):
    return queue.materialized(materializations)


@query("outbox", "revisions", sql="SELECT concat('evt_', substr(sha256(concat(o.outbox_id, chr(31), r.commit_seq)), 1, 32)) AS event_id, o.outbox_id, o.memory_id, o.revision, r.commit_seq, CASE WHEN r.op = 'tombstone' THEN 'DELETE' ELSE 'UPSERT' END AS kind FROM outbox o JOIN revisions r USING (memory_id, revision) WHERE o.status <> 'DONE'")
def materialization_events(outbox, revisions):
    return queue.events(outbox.where("status <> 'DONE'"), revisions)


# Receipts and curation.


@query("receipts", sql="SELECT source_id, receipt_id, status FROM receipts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, receipt_id DESC) = 1")
def latest_receipt(rows):
    return receipts.latest_receipts(rows, ["source_id"]).select("source_id", "receipt_id", "status")


ROLLUP = """+ u AS (SELECT r.receipt_id, c.outcome, c.canonical_id, c.exact_duplicate FROM receipts r LEFT JOIN curation c USING (receipt_id)),
 s AS (SELECT receipt_id, count(outcome) AS units, count(*) FILTER (outcome = 'pending_review') AS pending, count(canonical_id) AS canonical, count(*) FILTER (exact_duplicate) AS duplicates, count(*) FILTER (outcome = 'supporting_evidence_only') AS supporting, count(*) FILTER (outcome = 'rejected') AS rejected FROM u GROUP BY receipt_id)"""


@query("receipts", "curation", sql=ROLLUP + " SELECT receipt_id, units, CASE WHEN pending > 0 THEN 'pending_review' WHEN canonical > 0 THEN 'committed' WHEN units = 0 THEN 'no_memory_worthy_content' WHEN duplicates > 0 AND supporting = units THEN 'superseded' WHEN rejected = units THEN 'rejected' ELSE 'no_memory_worthy_content' END AS outcome, CASE WHEN pending > 0 THEN 'awaiting_review' ELSE 'complete' END AS status FROM s")
def receipt_rollup(rows, curation):
    units = rows.select("receipt_id").join(curation.select("receipt_id", "outcome", "canonical_id", "exact_duplicate"), "receipt_id", "left")
    return receipts.rolled_up(units).select("receipt_id", "units", "outcome", "status")


@query("curation", sql="SELECT receipt_id, arg_min(memory_type, unit_ref) AS source_type, arg_max(outcome, unit_ref) AS status, arg_min(relation, unit_ref) FILTER (relation IS NOT NULL) AS archive, coalesce(array_to_string(list_sort(list(DISTINCT canonical_id) FILTER (canonical_id IS NOT NULL)), ','), '') AS canonical_ids, count(*) AS writes FROM curation GROUP BY receipt_id")
def receipt_upsert_merge(curation):
    none = F.array().cast("array<string>")
    versions = curation.select("receipt_id", F.col("unit_ref").alias("seq"), F.col("memory_type").alias("source_type"), F.col("outcome").alias("status"), F.col("relation").alias("archive"), F.when(F.col("canonical_id").isNull(), none).otherwise(F.array("canonical_id")).alias("canonical_ids"))
    return receipts.upserted(versions).withColumn("canonical_ids", F.array_join("canonical_ids", ","))


@query("curation", sql="+ u AS (SELECT DISTINCT receipt_id, CASE WHEN unit_ref = 3 THEN 103 ELSE unit_ref END AS unit_ref FROM curation), p AS (SELECT receipt_id, CASE WHEN unit_ref = 5 THEN 1 ELSE unit_ref END AS unit_ref FROM curation), pc AS (SELECT receipt_id, unit_ref, count(*) AS n FROM p GROUP BY ALL) SELECT receipt_id, unit_ref, CASE WHEN u.receipt_id IS NULL THEN 'unknown_unit' WHEN n IS NULL THEN 'missing_proposal' ELSE 'duplicate_proposal' END AS problem FROM (SELECT *, 1 AS k FROM u) u FULL JOIN pc USING (receipt_id, unit_ref) WHERE k IS NULL OR n IS NULL OR n > 1".replace("u.receipt_id IS NULL", "k IS NULL"))
def curation_coverage(curation):
    units = curation.select("receipt_id", F.when(F.col("unit_ref") == 3, 103).otherwise(F.col("unit_ref")).alias("unit_ref"))
    return receipts.coverage(units, curation.select("receipt_id", F.when(F.col("unit_ref") == 5, 1).otherwise(F.col("unit_ref")).alias("unit_ref")))


@query("curation", sql="SELECT policy, count(*) AS units, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in receipts.OUTCOMES) + " FROM curation GROUP BY policy")
def curation_outcomes(curation):
    return receipts.outcome_totals(curation, ["policy"])


@query("curation", sql="+ w AS (SELECT receipt_id AS record_id, unit_ref AS seq, outcome, canonical_id FROM curation), f AS (SELECT *, coalesce(max(CAST(canonical_id IS NOT NULL AS INT)) OVER (PARTITION BY record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS named FROM w) SELECT record_id, seq, outcome, canonical_id FROM f WHERE NOT (named = 1 AND canonical_id IS NULL) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) = 1")
def curation_sticky(curation):
    return receipts.sticky(curation.select(F.col("receipt_id").alias("record_id"), F.col("unit_ref").alias("seq"), "outcome", "canonical_id"))


PRUNE = """+ s AS (SELECT DISTINCT source_id FROM receipts UNION ALL SELECT 's_none'), l AS (SELECT * FROM receipts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, receipt_id DESC) = 1),
 j AS (SELECT s.source_id, receipt_id, CASE WHEN receipt_id IS NULL THEN 'no_distillation_receipt' ELSE concat_ws(',', CASE WHEN status <> 'complete' THEN concat('receipt_status_', status) END, CASE WHEN retention_policy <> 'v1' THEN 'retention_policy_version_mismatch' END,
 CASE WHEN admission_policy <> 'v1' THEN 'admission_policy_version_mismatch' END, CASE WHEN status <> 'complete' THEN 'receipt_not_complete' END, CASE WHEN NOT canonical_final THEN 'canonicalization_not_final' END, CASE WHEN archive_checksum IS NULL THEN 'raw_archive_not_recorded' END,
 CASE WHEN NOT coverage_complete THEN 'curation_coverage_incomplete' END, CASE WHEN NOT admission_complete THEN 'canonical_admission_incomplete' END, CASE WHEN decisions <> units THEN 'curation_decision_count_mismatch' END, CASE WHEN outcomes <> units THEN 'curation_outcome_count_mismatch' END,
 CASE WHEN pending > 0 THEN 'pending_review_present' END, CASE WHEN archive_checksum IS NOT NULL AND NOT archive_valid THEN 'raw_archive_verification_failed' END) END AS reasons FROM s LEFT JOIN l ON l.source_id = s.source_id)
 SELECT source_id, receipt_id, reasons = '' AS eligible, reasons FROM j"""


@query("receipts", sql=PRUNE)
def prune_eligibility(rows):
    sources = rows.select("source_id").distinct().unionAll(rows.sparkSession.range(1).select(F.lit("s_none").alias("source_id")))
    return receipts.prunable(rows, sources, "v1", "v1").withColumn("reasons", F.array_join("reasons", ","))


# Review and insights.

RECORDS = "rec AS (SELECT record_id, CASE WHEN kind = 'pending_review' THEN 'pending_review' ELSE 'canonical_candidate' END AS outcome, concat('v', doc_id % 2) AS policy, doc_id FROM labelled), cs AS (SELECT * REPLACE (CASE WHEN doc_id % 13 = 0 THEN concat('x', record_id) ELSE record_id END AS record_id) FROM labelled)"


def _records(labelled):
    rec = labelled.select("record_id", F.when(F.col("kind") == "pending_review", "pending_review").otherwise("canonical_candidate").alias("outcome"), F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("policy"))
    return rec, labelled.withColumn("record_id", F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("x"), "record_id")).otherwise(F.col("record_id")))


@query("labelled", sql=f"""+ {RECORDS}, x AS (SELECT (SELECT count(*) FROM rec) <> 100 AS curation_coverage_mismatch, (SELECT count(*) FILTER (policy <> 'v1') FROM rec) > 0 AS semantic_policy_mismatch, (SELECT count(*) FROM cs WHERE record_id NOT IN (SELECT record_id FROM rec)) > 0 AS review_case_source_mismatch,
 (SELECT count(*) FROM rec WHERE outcome = 'pending_review' AND record_id NOT IN (SELECT record_id FROM cs)) > 0 AS pending_review_not_queued, (SELECT count(*) FILTER (outcome = 'pending_review') FROM rec) > 0 AS pending_review_outcomes_present,
 (SELECT count(*) FILTER (state <> 'resolved') FROM cs) > 0 AS unresolved_review_cases, (SELECT count(*) FILTER (kind = 'canary_sample' AND disposition = 'approved_as_classified') FROM cs) < 1 AS insufficient_approved_samples,
 (SELECT count(*) FILTER (disposition = 'misclassified') FROM cs) > 0 AS misclassification_detected, (SELECT count(*) FILTER (kind = 'pending_review' AND canonical_id IS NOT NULL) FROM cs) > 0 AS review_case_crossed_canonical_boundary)
 SELECT *, NOT ({' OR '.join(review.GATE_FLAGS)}) AS eligible FROM x""")
def canary_gate(labelled):
    return review.canary_gate(*_records(labelled), "v1", 100)


@query("curation", sql=" UNION ALL ".join(f"SELECT '{d}' AS dimension, {v} AS value, count(*) AS n FROM curation GROUP BY ALL" for d, v in (("memory_type", "memory_type"), ("speaker", "speaker"), ("epistemic_status", "epistemic_status"), ("outcome", "outcome"), ("relation", "coalesce(relation, 'none')"))))
def canary_telemetry(curation):
    return review.telemetry(curation)


@query("receipts", sql="SELECT source_id AS case_id, receipt_id AS event_id, row_number() OVER (PARTITION BY source_id ORDER BY updated_at, receipt_id) AS version FROM receipts")
def review_lineage(rows):
    events = rows.select(F.col("source_id").alias("case_id"), F.col("receipt_id").alias("event_id"), F.col("updated_at").alias("occurred_at"))
    return review.lineage(events).select("case_id", "event_id", "version")


@query("labelled", sql=f"+ {RECORDS} SELECT record_id, policy FROM rec WHERE outcome = 'pending_review' AND record_id NOT IN (SELECT record_id FROM cs)")
def review_pending_not_queued(labelled):
    return review.pending_not_queued(*_records(labelled)).select("record_id", "policy")


@query("labelled", sql="""+ d AS (SELECT case_id, kind, CASE WHEN kind = 'canary_sample' THEN CASE WHEN doc_id % 3 = 0 THEN 'needs_more_evidence' WHEN doc_id % 3 = 1 THEN 'approved_as_classified' ELSE 'invalid_candidate' END ELSE CASE WHEN doc_id % 2 = 0 THEN 'confirmed_unrelated' ELSE 'misclassified' END END AS d1, doc_id FROM labelled),
 s AS (SELECT *, CASE WHEN kind = 'canary_sample' THEN d1 IN ('needs_more_evidence', 'approved_as_classified') ELSE d1 = 'confirmed_unrelated' END AND doc_id % 7 <> 0 AS ok FROM d),
 t AS (SELECT *, ok AND d1 = 'needs_more_evidence' AS again FROM s)
 SELECT case_id, kind, CASE WHEN again THEN 'resolved' WHEN ok THEN 'resolved' ELSE 'queued' END AS state, CAST(CASE WHEN again THEN 3 WHEN ok THEN 2 ELSE 1 END AS BIGINT) AS version, CASE WHEN again THEN 'misclassified' WHEN ok THEN d1 END AS disposition FROM t""")
def review_fold(labelled):
    sample = F.col("kind") == "canary_sample"
    third, even = F.col("doc_id") % 3, F.col("doc_id") % 2 == 0
    first = F.when(sample, F.when(third == 0, "needs_more_evidence").when(third == 1, "approved_as_classified").otherwise("invalid_candidate")).otherwise(F.when(even, "confirmed_unrelated").otherwise("misclassified"))
    cites = F.array(F.when(F.col("doc_id") % 7 != 0, "curation:1").otherwise("note:1"))
    one = labelled.select("case_id", F.lit(1).alias("pos"), F.lit(1).cast("long").alias("expected_version"), first.alias("disposition"), cites.alias("evidence"))
    two = labelled.where(sample).select("case_id", F.lit(2).alias("pos"), F.lit(2).cast("long").alias("expected_version"), F.lit("misclassified").alias("disposition"), F.array(F.lit("curation:2")).alias("evidence"))
    return review.resolved(labelled.select("case_id", "kind"), one.unionByName(two))


@query("labelled", sql="SELECT coalesce(disposition, 'none') AS disposition, count(*) AS n FROM labelled GROUP BY 1")
def disposition_tally(labelled):
    return review.disposition_tally(labelled)


@query("receipts", sql="SELECT source_id AS insight_id, count(*) AS n FROM receipts GROUP BY 1 HAVING count(*) > 1")
def duplicate_promotions(rows):
    return review.duplicate_promotions(rows.select(F.col("source_id").alias("insight_id")))


INSIGHTS = """i AS (SELECT o_orderkey AS k, receipt_id AS insight_id, o_orderkey % 4 <> 0 AS has_m, o_orderkey % 5 <> 0 AS has_e, o_orderkey % 3 = 0 AS contra, (o_orderkey % 100) / 100.0 AS confidence, CASE WHEN status = 'complete' THEN 'accepted' ELSE 'pending' END AS st FROM receipts)"""


def _insights(rows):
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    some = lambda test, *ids: F.when(test, F.array(*ids)).otherwise(none)
    return rows.select(
        F.col("receipt_id").alias("insight_id"),
        some(k % 4 != 0, F.concat(F.lit("mem_"), (k % 150).cast("string"))).alias("memory_ids"),
        some(k % 5 != 0, F.concat(F.lit("evidence:"), (k % 300).cast("string"))).alias("evidence_ids"),
        some(k % 3 == 0, F.lit("mem_0")).alias("contradicting_ids"),
        ((k % 100) / 100).alias("confidence"),
        F.when(F.col("status") == "complete", "accepted").otherwise("pending").alias("status"),
    )


@query("receipts", sql=f"""+ {INSIGHTS}, r AS (SELECT insight_id, has_m AND has_e AND confidence >= 0.75 AS evidence_closure, concat_ws(',', CASE WHEN NOT has_m THEN 'promotion:no_supporting_memories' END, CASE WHEN NOT has_e THEN 'promotion:no_supporting_evidence' END,
 CASE WHEN confidence < 0.75 THEN 'promotion:confidence_below_threshold' END, CASE WHEN contra THEN 'promotion:unresolved_contradictions' END, CASE WHEN st <> 'accepted' THEN 'promotion:explicit_acceptance_required' END) AS reasons FROM i)
 SELECT insight_id, reasons = '' AS eligible, evidence_closure, CASE WHEN reasons = '' THEN 'promotion:evidence_closed_and_explicitly_accepted' ELSE reasons END AS reasons FROM r""")
def promotion_gate(rows):
    return review.promotion_gate(_insights(rows)).select("insight_id", "eligible", "evidence_closure", F.array_join("reasons", ",").alias("reasons"))


@query("receipts", "revisions", sql=f"""+{HEADS}, {INSIGHTS}, m AS (SELECT insight_id, CASE WHEN has_m THEN concat('mem_', k % 150) END AS mem, CASE WHEN has_e THEN concat('evidence:', k % 300) END AS ev FROM i), e AS (SELECT DISTINCT memory_id, concat('evidence:', event_id % 300) AS ev FROM revisions)
 SELECT insight_id, CASE WHEN mem IS NOT NULL AND coalesce(status, '') <> 'active' THEN mem ELSE '' END AS inactive, CASE WHEN m.ev IS NOT NULL AND e.ev IS NULL THEN m.ev ELSE '' END AS missing,
 NOT (mem IS NOT NULL AND coalesce(status, '') <> 'active') AND NOT (m.ev IS NOT NULL AND e.ev IS NULL) AS closed FROM m LEFT JOIN heads h ON h.memory_id = mem LEFT JOIN e ON e.memory_id = mem AND e.ev = m.ev""")
def evidence_closure(rows, revisions):
    evidence = revisions.select("memory_id", F.concat(F.lit("evidence:"), (F.col("event_id") % 300).cast("string")).alias("evidence_id")).distinct()
    out = review.evidence_closure(_insights(rows), records.heads(revisions), evidence)
    return out.select("insight_id", F.array_join("inactive", ",").alias("inactive"), F.array_join("missing", ",").alias("missing"), "closed")


# Statements.


def _composed(s):
    """Statements with their NFKC form, made once."""
    return s.withColumn("nfkc", nfkc(F.col("text")))


def _typed(s):
    s = semantics.signals(s)
    kind = semantics.memory_type(F.col("text"), F.col("candidate_type"), F.col("nfkc"), F.col("directive"), F.col("explicit") | F.col("placement"))
    return s.withColumn("memory_type", kind).withColumn("speaker", semantics.speaker(F.lit(None).cast("string"), F.col("producer")))


def _rx(pattern, text="text"):
    """A pattern as DuckDB's RE2, which has no look-ahead."""
    body = pattern.replace("自動(?!化)", "自動").replace("'", "''")
    return f"regexp_matches({text}, '{body}', 'i')"


DURABLE_SQL = f"({_rx(fixed.DURABLE_SCOPE, 'replace(text, chr(33258) || chr(21205) || chr(21270), chr(32))')} AND {_rx(fixed.OPERATIONAL_BEHAVIOUR)})"
ONE_SHOT_SQL = f"(NOT {DURABLE_SQL} AND ({' OR '.join(_rx(p) for p in fixed.ONE_SHOT)}))"
EXPLICIT_SQL = f"(NOT {ONE_SHOT_SQL} AND ({DURABLE_SQL} OR (NOT (({_rx(fixed.TASK_REQUEST)} OR {_rx(fixed.PREFERENCE_EXPERIMENT)}) AND NOT {_rx(fixed.PREFERENCE_VERB)}) AND ({_rx(fixed.ACTOR_PREFERENCE)} OR {_rx(fixed.ACTOR_NEGATIVE_PREFERENCE)} OR {_rx(fixed.ACTOR_PREFERENCE_NOUN)} OR {_rx(fixed.CHINESE_PREFERENCE)}))))"
TYPE_SQL = f"""CASE WHEN {ONE_SHOT_SQL} THEN 'transient_state' WHEN {EXPLICIT_SQL} THEN 'preference' WHEN {_rx(fixed.TRANSIENT)} THEN 'transient_state' WHEN {_rx(fixed.COMPLETED_EVENT)} THEN 'event' WHEN {_rx(fixed.PROJECT)} THEN 'project_state'
 WHEN {_rx(fixed.TECHNICAL)} THEN 'technical_fact' WHEN candidate_type = 'relationship_candidate' THEN 'relationship' WHEN candidate_type = 'project_state_candidate' THEN 'project_state' WHEN candidate_type = 'commitment_candidate' THEN 'commitment'
 WHEN candidate_type = 'habit_candidate' THEN 'habit' WHEN candidate_type = 'event_candidate' THEN 'event' WHEN {_rx(fixed.EVENT)} THEN 'event' ELSE 'general_fact' END"""
SPEAKER_SQL = "CASE WHEN producer IN ('user', 'system') THEN producer ELSE 'unknown' END"
STATUS_SQL = """CASE WHEN epistemic_status = 'inferred' THEN 'inferred' WHEN epistemic_status = 'user_asserted' THEN CASE WHEN sp = 'user' AND ty IN ('preference', 'habit', 'relationship') THEN 'user_asserted' ELSE 'uncertain' END
 WHEN epistemic_status = 'system_observed' THEN CASE WHEN sp = 'system' THEN 'system_observed' ELSE 'uncertain' END WHEN sp = 'system' THEN 'observed' ELSE 'uncertain' END"""
TYPED = f"+ t AS (SELECT *, {TYPE_SQL} AS ty, {SPEAKER_SQL} AS sp, {ONE_SHOT_SQL} AS dir FROM statements)"


@query("statements", sql=TYPED + f" SELECT doc_id, ty AS memory_type, sp AS speaker, {STATUS_SQL} AS status FROM t")
def memory_type_classify(s):
    out = _typed(s)
    return out.select("doc_id", "memory_type", "speaker", semantics.epistemic_status(F.col("epistemic_status"), F.col("memory_type"), F.col("speaker")).alias("status"))


@query("statements", sql=f"SELECT doc_id, {ONE_SHOT_SQL} AS one_shot, {DURABLE_SQL} AS durable, {EXPLICIT_SQL} AS explicit_preference FROM statements")
def one_shot_directives(s):
    return semantics.signals(s).select("doc_id", F.col("directive").alias("one_shot"), "durable", F.col("explicit").alias("explicit_preference"))


@query("statements", sql=f"SELECT doc_id, CASE WHEN {_rx(fixed.GENERAL_NEGATIVE)} AND {_rx(fixed.GENERAL_POSITIVE)} THEN 'unknown' WHEN {_rx(fixed.GENERAL_NEGATIVE)} THEN 'negative' ELSE 'affirmative' END AS polarity FROM statements")
def polarity(s):
    return s.select("doc_id", semantics.polarity(F.col("text"), F.lit(None).cast("string")).alias("polarity"))


NORMALIZED_SQL = "trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[\\p{P}\\p{S}]+', ' ', 'g'), '\\s+', ' ', 'g'))"
KEY_SQL = f"concat('semantic:', sha256(concat('{{\"memoryKind\":\"', source, '\",\"memoryType\":\"fact\",\"text\":\"', {NORMALIZED_SQL}, '\"}}')))"


# DuckDB has no NFKC, so SQL composes canonically, which is the same on the given tables; tests hold texts that need it against brute force.
@query("statements", sql=f"SELECT doc_id, {KEY_SQL} AS semantic_key FROM statements")
def semantic_key_exact(s):
    return s.select("doc_id", semantics.semantic_key(F.col("text"), F.lit("fact"), F.col("source"), F.lit(None).cast("string")).alias("semantic_key"))


@query("statements", sql=TYPED + f""", p AS (SELECT *, {STATUS_SQL} AS st, CASE WHEN ty = 'transient_state' OR dir THEN 'transient' WHEN candidate_type IN ('preference_candidate', 'relationship_candidate', 'habit_candidate') THEN 'durable' WHEN candidate_type IN ('commitment_candidate', 'project_state_candidate') THEN 'time_bounded' WHEN candidate_type = 'event_candidate' THEN 'transient' ELSE 'unknown' END AS du FROM t),
 c AS (SELECT *, CASE WHEN st NOT IN ('inferred', 'synthesized', 'uncertain') AND du = 'durable' THEN 'canonical_candidate' ELSE 'supporting_evidence_only' END AS pr FROM p)
 SELECT doc_id, du AS durability, CASE WHEN dir THEN 'supporting_evidence_only' WHEN st <> epistemic_status THEN 'pending_review' WHEN pr <> 'canonical_candidate' THEN pr WHEN doc_id % 9 = 0 THEN 'rejected' ELSE 'canonical_candidate' END AS outcome FROM c""")
def admission_outcomes(s):
    out = _typed(s)
    t, raw = F.col("text"), F.col("epistemic_status")
    directive = F.col("directive")
    status = semantics.epistemic_status(raw, F.col("memory_type"), F.col("speaker"))
    lasting = semantics.durability(F.col("memory_type"), F.col("candidate_type"), directive)
    out = out.withColumns({"d": directive, "st": status, "du": lasting})
    proposed = semantics.curation_outcome(F.col("st"), F.col("du"))
    valid = semantics.attribution_valid(raw, F.lit("semantic_policy"), F.col("st"), t, F.lit(None).cast("string"))
    decided = semantics.admission(F.col("d"), valid, F.lit("new"), proposed, F.col("doc_id") % 9 != 0, F.col("du"), F.col("st"), F.lit(False))
    return out.select("doc_id", F.col("du").alias("durability"), decided["outcome"].alias("outcome"))


@query("statements", sql="SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR doc_id % 10 = 0 THEN 'reject' WHEN epistemic_status = 'inferred' THEN 'reject' ELSE 'commit' END AS action, CASE WHEN doc_id % 6 = 0 OR doc_id % 10 = 0 THEN 'missing_grounding' WHEN epistemic_status = 'inferred' THEN 'inferred_requires_explicit_review' ELSE 'evidence_bound_candidate' END AS reason FROM statements")
def governance(s):
    g = semantics.governance(F.col("doc_id") % 6, F.col("doc_id") % 10, F.col("epistemic_status"))
    return s.select("doc_id", g["action"].alias("action"), g["reason"].alias("reason"))


@query("statements", sql=f"SELECT source, count(*) AS n FROM statements WHERE {ONE_SHOT_SQL} GROUP BY source")
def contamination_scan(s):
    return _composed(s).where(semantics.one_shot_directive(F.col("text"), F.col("nfkc"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("statements")
def token_relation(s):
    """Each statement against the next of its source; what the relation needs of either is made once."""
    s = semantics.signals(s)
    s = s.withColumn("matched", semantics.matched_concepts(F.col("text"), F.lit("preference"), F.lit("user"), F.col("nfkc"), F.col("explicit"), F.col("placement")))
    s = s.withColumn("concept", semantics.concept(F.col("matched")))
    known = F.col("nfkc")
    sides = s.select("doc_id", "source", F.struct(semantics.normalized_text(F.col("text"), known).alias("x"), semantics.semantic_tokens(F.col("text"), known).alias("tokens"), semantics.polarity(F.col("text"), F.col("concept")).alias("polarity"), "concept").alias("own"))
    by = Window.partitionBy("source").orderBy("doc_id")
    pairs = sides.withColumns({"next": F.lead("doc_id").over(by), "other": F.lead("own").over(by)}).where("next IS NOT NULL")
    side = lambda c: tuple(F.col(f"{c}.{f}") for f in ("x", "tokens", "polarity", "concept"))
    return pairs.select("doc_id", "next", semantics.relation_of(side("own"), side("other")).alias("relation"))


@query("statements", sql="SELECT doc_id, text, count(*) OVER (PARTITION BY text) - 1 AS others FROM statements QUALIFY count(*) OVER (PARTITION BY text) > 1")
def duplicate_candidates(s):
    counts = s.groupBy("text").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return s.join(counts, "text").select("doc_id", "text", "others")


# Commit.


SEED = "2024-01-15"


@query("revisions", sql=f"""+ RECURSIVE early AS (SELECT * FROM revisions WHERE valid_from < TIMESTAMP '{SEED}'), heads AS (SELECT * FROM early QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision DESC) = 1),
 marks AS (SELECT ns, max(commit_seq) AS mark FROM early GROUP BY ns),
 c AS (SELECT ns, CASE WHEN event_id % 41 = 0 THEN concat('key_', u + 3) ELSE semantic_key END AS semantic_key, concat('cand_', lpad(event_id::VARCHAR, 8, '0')) AS candidate_id, valid_from AS created_at, event_id, op,
  CASE WHEN op <> 'create' THEN revision - 1 - CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END END AS base, CASE WHEN event_id % 31 = 0 THEN 'mem_none' WHEN event_id % 37 = 0 THEN concat('mem_', u + 1) ELSE memory_id END AS memory_id
  FROM (SELECT *, substr(memory_id, 5)::INT AS u FROM revisions)),
 fresh AS (SELECT c.*, CASE WHEN c.op = 'create' THEN NULL WHEN h.memory_id IS NULL THEN 'not_found' WHEN h.ns <> c.ns THEN 'scope_mismatch' WHEN h.semantic_key <> c.semantic_key THEN 'identity_changed' END AS against
  FROM c LEFT JOIN heads h USING (memory_id) WHERE NOT EXISTS (SELECT 1 FROM early e WHERE e.ns = c.ns AND e.event_id = c.event_id AND e.event_id % 5 <> 0)),
 o AS (SELECT f.*, row_number() OVER (PARTITION BY f.ns, f.semantic_key ORDER BY created_at, candidate_id) AS k, coalesce(h.revision, 0) AS r0, coalesce(h.status, 'absent') AS s0 FROM fresh f LEFT JOIN heads h ON h.ns = f.ns AND h.semantic_key = f.semantic_key),
 f AS (SELECT DISTINCT ns, semantic_key, 0::BIGINT AS k, '' AS candidate_id, '' AS op, '' AS outcome, r0::BIGINT AS revision, s0 AS status FROM o
  UNION ALL SELECT ns, semantic_key, k, candidate_id, op, x, CASE WHEN x = 'accepted' THEN revision + 1 ELSE revision END, CASE WHEN x <> 'accepted' THEN status WHEN op = 'tombstone' THEN 'tombstoned' ELSE 'active' END FROM (
   SELECT o.ns, o.semantic_key, o.k, o.candidate_id, o.op, f.revision, f.status, CASE WHEN o.op = 'create' AND f.revision > 0 THEN 'suppressed' WHEN o.op <> 'create' AND (f.revision = 0 OR against = 'not_found') THEN 'not_found' WHEN against = 'scope_mismatch' THEN against
    WHEN o.op <> 'create' AND base <> f.revision THEN 'conflict' WHEN against IS NOT NULL THEN against WHEN (o.op = 'restore' AND f.status = 'active') OR (o.op IN ('update', 'merge', 'tombstone') AND f.status <> 'active') THEN 'error' ELSE 'accepted' END AS x
   FROM f JOIN o ON o.ns = f.ns AND o.semantic_key = f.semantic_key AND o.k = f.k + 1))
 SELECT f.ns, f.semantic_key, f.candidate_id, f.op, f.outcome, f.revision, f.status, CASE WHEN outcome = 'accepted' THEN mark + row_number() OVER (PARTITION BY f.ns, outcome ORDER BY created_at, f.candidate_id) END AS commit_seq FROM f JOIN fresh USING (candidate_id) LEFT JOIN marks ON marks.ns = f.ns WHERE k > 0""")
def commit_fold(revisions):
    """All changes handed in again after those of the first days: replays but for one in five, and what names no, another or a foreign memory."""
    i, u = F.col("event_id"), F.substring("memory_id", 5, 9).cast("int")
    early = revisions.where(F.col("valid_from") < at(SEED))
    c = revisions.select(
        "ns", F.when(i % 41 == 0, F.concat(F.lit("key_"), (u + 3).cast("string"))).otherwise(F.col("semantic_key")).alias("semantic_key"), F.concat(F.lit("cand_"), F.lpad(i.cast("string"), 8, "0")).alias("candidate_id"), F.col("valid_from").alias("created_at"), F.concat(F.lit("k"), i.cast("string")).alias("idempotency_key"), "op",
        F.when(F.col("op") != "create", F.col("revision") - 1 - F.when(i % 9 == 0, 1).otherwise(0)).alias("base_revision"), F.when(i % 31 == 0, "mem_none").when(i % 37 == 0, F.concat(F.lit("mem_"), (u + 1).cast("string"))).otherwise(F.col("memory_id")).alias("memory_id"),
    )
    changes = early.where(i % 5 != 0).select("ns", F.concat(F.lit("k"), i.cast("string")).alias("idempotency_key"))
    out = commit.folded(c, records.heads(early).select("ns", "memory_id", "semantic_key", "revision", "status"), changes, records.high_water(early, ["ns"]))
    return out.select("ns", "semantic_key", "candidate_id", "op", "outcome", "revision", "status", "commit_seq")


@query("curation", sql="SELECT receipt_id AS memory_id, memory_type AS source_type, speaker AS source_ref, arg_max(outcome, unit_ref) AS note, min(unit_ref) AS first_pos FROM curation GROUP BY ALL")
def evidence_union(curation):
    rows = curation.select(F.col("receipt_id").alias("memory_id"), F.col("unit_ref").alias("pos"), F.col("memory_type").alias("source_type"), F.col("speaker").alias("source_ref"), F.col("outcome").alias("note"))
    return commit.united_evidence(rows)


@query("revisions", sql="""SELECT rule, count(*) AS n FROM (SELECT 'validity' AS rule FROM revisions WHERE valid_until < valid_from UNION ALL SELECT 'unique_key' FROM (SELECT ns, semantic_key FROM revisions GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT 'unique_sequence' FROM (SELECT ns, commit_seq % 3000 AS s FROM revisions GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'base_revision' FROM revisions WHERE (op = 'create') <> (revision = 1) ) GROUP BY rule""")
def integrity_violations(revisions):
    found = violations(
        heads=revisions,
        changes=revisions.withColumn("commit_seq", F.col("commit_seq") % 3000),
        revisions=revisions,
    )
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# Sessions.


@query("messages", sql="SELECT session_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS actors, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role NOT IN ('user', 'assistant')) AS n_other, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM messages GROUP BY session_id")
def session_normalize(m):
    return sessions.normalized(m).select("session_id", F.array_join("actors", ",").alias("actors"), "n_user", "n_assistant", "n_other", "n_chars")


@query("messages", sql="SELECT session_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user, max(pos) AS last_pos FROM messages GROUP BY session_id")
def session_counters(m):
    return m.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("n_user"), F.max("pos").alias("last_pos"))


FINGERPRINT = "f AS (SELECT session_id, sha256(string_agg(concat(pos, chr(31), role, chr(31), text), chr(30) ORDER BY pos)) AS fingerprint FROM messages GROUP BY session_id)"


@query("messages", sql=f"+ {FINGERPRINT} SELECT session_id, CASE WHEN session_id % 4 = 0 THEN 'new' WHEN session_id = 1 THEN 'changed' ELSE 'unchanged' END AS change FROM f UNION ALL SELECT -session_id - 1, 'gone' FROM f WHERE session_id % 4 = 0")
def fingerprint_diff(m):
    now = sessions.fingerprinted(sessions.normalized(m))
    s = F.col("session_id")
    old = now.select(F.when(s % 4 == 0, -s - 1).otherwise(s).alias("session_id"), F.when(s == 1, "other").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return sessions.differing(now, old)


@query("messages", sql=f"+ {FINGERPRINT} SELECT * FROM f")
def session_fingerprint(m):
    return sessions.fingerprinted(sessions.normalized(m)).select("session_id", "fingerprint")


@query("receipts", sql="+ u AS (SELECT source_id AS migration, o_orderkey AS pos, o_orderkey % 5 <> 0 AS ok FROM receipts) SELECT migration, pos FROM (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY migration ORDER BY pos) AS f FROM u) WHERE f = 0")
def migration_prefix(rows):
    units = rows.select(F.col("source_id").alias("migration"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 5 != 0).alias("ok"))
    return sessions.migrated_prefix(units).select("migration", "pos")


ELIGIBLE = "s AS (SELECT session_id, count(*) AS n, sum(length(text)) FILTER (trim(text) <> '') AS chars, count(*) FILTER (trim(text) <> '') AS texts FROM messages GROUP BY session_id)"


@query("messages", sql=f"+ {ELIGIBLE} SELECT session_id, CASE WHEN session_id % 10 = 0 THEN 'hidden_session' WHEN texts = 0 THEN 'no_textual_evidence' WHEN n > 8 THEN 'event_limit' WHEN chars > 2000 THEN 'char_limit' ELSE 'eligible' END AS reason FROM s")
def eligibility(m):
    rows = sessions.normalized(m).withColumn("hidden", F.col("session_id") % 10 == 0)
    return sessions.eligible(rows, 8, 2000).select("session_id", "reason")


@query("messages", sql="+ u AS (SELECT session_id, sum(length(text)) FILTER (trim(text) <> '' AND role = 'user') AS chars, count(*) FILTER (trim(text) <> '' AND role = 'user') AS n, count(*) FILTER (trim(text) <> '') AS texts FROM messages GROUP BY session_id) SELECT session_id, CASE WHEN texts = 0 THEN 'no_textual_evidence' WHEN n = 0 THEN 'no_user_text' WHEN n > 4 THEN 'event_limit' WHEN chars > 800 THEN 'char_limit' ELSE 'eligible' END AS reason FROM u")
def eligibility_direct(m):
    rows = sessions.normalized(m).withColumn("hidden", F.lit(False))
    return sessions.eligible(rows, 4, 800, direct_only=True).select("session_id", "reason")


@query("messages", sql="+ s AS (SELECT session_id, concat(string_agg(text, chr(10) ORDER BY pos), ' the bug and error in this project repo, so I like it instead') AS t, count(*) AS n FROM messages GROUP BY session_id) SELECT session_id, " + ", ".join(f"CAST({' + '.join(f'CAST(contains(lower(t), {chr(39)}{w}{chr(39)}) AS INT)' for w in words)} AS BIGINT) AS {k}_hits" for k, words in sessions.KEYWORDS.items()) + " FROM s")
def session_scores(m):
    rows = sessions.normalized(m)
    text = F.concat(F.array_join(F.col("events")["text"], "\n"), F.lit(" the bug and error in this project repo, so I like it instead"))
    out = sessions.keyword_scores(rows, text, F.size("events"))
    return out.select("session_id", *(F.col(f"{k}_hits").cast("long").alias(f"{k}_hits") for k in sessions.KEYWORDS))


@query("receipts", sql=f"SELECT receipt_id, CASE WHEN o_orderkey % 7 = 0 THEN 'defer:journal_tail_incomplete' WHEN o_orderkey % 3 = 0 THEN 'source_only:no_user_authored_text' WHEN o_orderkey % 11 = 0 THEN 'defer:missing_last_modified_time' WHEN epoch(TIMESTAMP '1995-06-01 00:00:00') - epoch(updated_at) < 300 THEN 'defer:session_not_idle' ELSE 'distill' END AS decision FROM receipts")
def incremental_decision(rows):
    k = F.col("o_orderkey")
    modified = F.when(k % 11 != 0, F.col("updated_at").cast("timestamp"))
    d = sessions.decision(k % 7 == 0, k % 3, modified, F.lit("1995-06-01 00:00:00").cast("timestamp"))
    return rows.select("receipt_id", d.alias("decision"))


@query("messages", sql="SELECT session_id, string_agg(concat('[', role, '] ', trim(text)), chr(10) || chr(10) ORDER BY pos) AS transcript FROM messages WHERE trim(text) <> '' GROUP BY session_id")
def session_transcript(m):
    return sessions.normalized(m).select("session_id", sessions.transcript().alias("transcript")).where("transcript <> ''")


@query("messages", sql="""+ RECURSIVE p AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos, role, text, i) AS k, greatest(0, least(600, coalesce(length(text), 0) - 600 * i)) AS size FROM (SELECT *, unnest(range(greatest(1, ceil(coalesce(length(text), 0) / 600.0)::BIGINT))) AS i FROM messages)),
 f AS (SELECT session_id, k, size, 0 AS chunk, size AS chars, 1 AS n FROM p WHERE k = 1 UNION ALL SELECT p.session_id, p.k, p.size, f.chunk + CAST(full_ AS INT), CASE WHEN full_ THEN p.size ELSE f.chars + 2 + p.size END, CASE WHEN full_ THEN 1 ELSE f.n + 1 END FROM (SELECT f.*, q.size AS next_size, (f.chars + 2 + q.size > 600 OR f.n >= 4) AS full_ FROM f JOIN p q ON q.session_id = f.session_id AND q.k = f.k + 1) f JOIN p ON p.session_id = f.session_id AND p.k = f.k + 1)
 SELECT session_id, chunk, count(*) AS n_segments, CAST(sum(size) + 2 * (count(*) - 1) AS BIGINT) AS n_chars FROM f GROUP BY ALL""")
def session_chunks(m):
    return sessions.packed(sessions.normalized(m), 600, 4)


@query("messages")
def window_merge(m):
    prior = m.where("pos < 4").withColumn("side", F.lit(0))
    return sessions.published(prior.unionByName(m.where("pos >= 2").withColumn("side", F.lit(1))))


@query("receipts", sql="""+ RECURSIVE p AS (SELECT source_id AS c, o_orderkey AS pos, concat('rev', o_orderkey % 4) AS rev, CAST(epoch(updated_at) AS BIGINT) AS u, CASE WHEN status = 'complete' THEN 1 WHEN status = 'failed' THEN 2 ELSE 0 END AS rk, concat('d', o_orderkey % 6) AS d, row_number() OVER (PARTITION BY source_id ORDER BY o_orderkey) AS k FROM receipts),
 f AS (SELECT c, k, pos, rev, u, rk, d, 'created' AS outcome FROM p WHERE k = 1 UNION ALL SELECT c, k, pos, CASE WHEN x = 'updated' THEN rev ELSE rev0 END, CASE WHEN x = 'updated' THEN u ELSE u0 END, CASE WHEN x = 'updated' THEN rk ELSE rk0 END, CASE WHEN x = 'updated' THEN d ELSE d0 END, x FROM (
  SELECT p.*, f.rev AS rev0, f.u AS u0, f.rk AS rk0, f.d AS d0, CASE WHEN f.d = p.d THEN 'idempotent' WHEN p.u < f.u THEN 'stale' WHEN p.u = f.u OR p.rev = f.rev THEN 'revision_conflict' WHEN p.rk < f.rk THEN 'lifecycle_regression' ELSE 'updated' END AS x FROM f JOIN p ON p.c = f.c AND p.k = f.k + 1))
 SELECT c AS conversation_id, pos, outcome FROM f""")
def capture_outcomes(rows):
    s = rows.select(
        F.col("source_id").alias("conversation_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("rev"), (F.col("o_orderkey") % 4).cast("string")).alias("revision"), F.unix_timestamp(F.col("updated_at").cast("timestamp")).alias("updated_at"),
        F.when(F.col("status") == "complete", "completed").when(F.col("status") == "failed", "archived").otherwise("active").alias("status"), F.concat(F.lit("d"), (F.col("o_orderkey") % 6).cast("string")).alias("digest"),
    )
    return sessions.capture_outcomes(s)


# Graph.

EDGES = f"""+{HEADS}, a AS (SELECT concat('memory:', memory_id) AS src, CASE WHEN revision % 3 = 0 THEN 'project_state' ELSE 'general_fact' END AS ty, concat('class', revision % 2) AS cl, memory_kind AS ki, CASE WHEN revision % 4 = 0 THEN 'user' ELSE 'unknown' END AS sp, concat('src', event_id % 20) AS so FROM heads WHERE status = 'active'),
 f AS (SELECT src, 'concerns' AS type, concat('memory-type:', ty) AS dst FROM a UNION SELECT src, 'concerns', concat('memory-class:', cl) FROM a UNION SELECT src, 'related_to', concat('memory-kind:', ki) FROM a UNION SELECT src, 'concerns', concat('speaker:', sp) FROM a WHERE sp <> 'unknown'
 UNION SELECT src, 'belongs_to_project', concat('project:', ki) FROM a WHERE ty = 'project_state' UNION SELECT src, 'derived_from', concat('source:', so) FROM a), e AS (SELECT * FROM f UNION ALL SELECT dst, CASE WHEN type = 'derived_from' THEN 'supports' ELSE type END, src FROM f)"""


def _edges(revisions):
    r = F.col("revision")
    rows = records.heads(revisions).select(
        "memory_id", "status", F.when(r % 3 == 0, "project_state").otherwise("general_fact").alias("memory_type"), F.concat(F.lit("class"), (r % 2).cast("string")).alias("memory_class"), "memory_kind",
        F.when(r % 4 == 0, "user").otherwise("unknown").alias("speaker"), F.array(F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string"))).alias("sources"),
    )
    return graph.edges(rows)


@query("revisions", sql=EDGES + " SELECT * FROM e")
def graph_edges(revisions):
    return _edges(revisions)


@query("revisions", sql=EDGES + " SELECT src AS id, count(*) AS out_degree, split_part(src, ':', 1) AS kind FROM e GROUP BY src")
def graph_nodes(revisions):
    return graph.nodes(_edges(revisions))


@query("revisions", sql=EDGES + " SELECT dst, src, type FROM e WHERE dst LIKE 'speaker:%'")
def graph_dangling(revisions):
    e = _edges(revisions)
    return graph.dangling(e, graph.nodes(e).where("kind <> 'speaker'"))


@query("statements", sql="+ d AS (SELECT concat(CASE WHEN doc_id % 5 = 0 THEN 'n' ELSE 'p' END, doc_id) AS path, md5(text) AS h FROM statements), o AS (SELECT concat(CASE WHEN doc_id % 3 = 0 THEN 'o' ELSE 'p' END, doc_id) AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS g FROM statements) SELECT path, CASE WHEN h IS NULL THEN 'removed' WHEN g IS NOT DISTINCT FROM h THEN 'unchanged' ELSE 'written' END AS change FROM d FULL JOIN o USING (path)")
def file_diff(s):
    i = F.col("doc_id")
    path = lambda test, other: F.concat(F.when(test, other).otherwise("p"), i.cast("string")).alias("path")
    desired = s.select(path(i % 5 == 0, "n"), F.md5("text").alias("hash"))
    existing = s.select(path(i % 3 == 0, "o"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.md5("text")).alias("hash"))
    return graph.file_changes(desired, existing)


TITLE_SQL = """+ f AS (SELECT doc_id, trim(regexp_extract(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^[^。！？.!?]*')) AS t FROM {lens})
 SELECT doc_id, CASE WHEN t = '' THEN 'untitled' WHEN length(t) > 72 THEN concat(substring(t, 1, 69), '…') ELSE t END AS title FROM f"""


@query("statements", sql=TITLE_SQL.format(lens="statements"))
def titles(s):
    return s.select("doc_id", graph.title(F.col("text"), "untitled").alias("title"))


# Units: texts alone.

@query("units", sql=f"SELECT doc_id, {KEY_SQL} AS semantic_key FROM units")
def semantic_key_units(u):
    return u.select("doc_id", semantics.semantic_key(F.col("text"), F.lit("fact"), F.col("source"), F.lit(None).cast("string")).alias("semantic_key"))


@query("units", sql=f"+ k AS (SELECT doc_id, sha256({NORMALIZED_SQL}) AS key FROM units) SELECT doc_id, key, count(*) OVER (PARTITION BY key) - 1 AS others FROM k WHERE key IS NOT NULL QUALIFY count(*) OVER (PARTITION BY key) > 1")
def duplicate_candidates_units(u):
    # A null text has no key. Keys are dealt out by document, so that both uses read one exchange and texts are normalised once.
    keyed = u.select("doc_id", F.sha2(semantics.normalized_text(F.col("text")), 256).alias("key")).repartition("doc_id")
    counts = keyed.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return keyed.join(counts, "key").select("doc_id", "key", "others")


@query("units", sql="+ m AS (SELECT concat('mem_', min(doc_id)) AS memory_id, lower(trim(nfc_normalize(text))) AS key FROM units GROUP BY text) SELECT doc_id AS ref, memory_id FROM units JOIN m ON key = lower(trim(nfc_normalize(text)))")
def normalized_text_match_units(u):
    memories = u.groupBy("text").agg(F.concat(F.lit("mem_"), F.min("doc_id").cast("string")).alias("memory_id"))
    return ingest.same_text(memories, u.select(F.col("doc_id").alias("ref"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"))).select("ref", "memory_id")


@query("units", sql=TITLE_SQL.format(lens="units"))
def titles_units(u):
    return titles(u)


@query("units", sql="""+ d AS (SELECT concat(CASE WHEN doc_id % 5 = 0 THEN 'n' ELSE 'p' END, doc_id) AS path, md5(text) AS h FROM units), o AS (SELECT concat(CASE WHEN doc_id % 3 = 0 THEN 'o' ELSE 'p' END, doc_id) AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS g FROM units)
 SELECT path, CASE WHEN h IS NULL THEN 'removed' WHEN g IS NOT DISTINCT FROM h THEN 'unchanged' ELSE 'written' END AS change FROM d FULL JOIN o USING (path)""")
def file_diff_units(u):
    return file_diff(u)


# Functions.


@query("revisions", sql="SELECT event_id, concat('exp_', sha256(concat(ns, chr(31), memory_id, chr(31), event_id))) AS experience_id, concat('sha256:', sha256(concat('{\"text\":\"', memory_kind, ' ', event_id, '\"}'))) AS content_hash, md5(concat(memory_id, revision)) AS md5_id FROM revisions")
def derived_ids(revisions):
    return revisions.select(
        "event_id", canon.joined_id("exp_", F.col("ns"), F.col("memory_id"), F.col("event_id").cast("string")).alias("experience_id"), canon.content_hash(F.concat_ws(" ", "memory_kind", F.col("event_id").cast("string"))).alias("content_hash"),
        F.md5(F.concat("memory_id", F.col("revision").cast("string"))).alias("md5_id"),
    )


@query("statements", sql=f"SELECT count(*) FILTER ({_rx(fixed.TECHNICAL)}) AS technical, count(*) FILTER ({_rx(fixed.PROJECT)}) AS project, count(*) FILTER ({_rx(fixed.PLACEMENT)}) AS placement FROM statements")
def pattern_counts(s):
    t = F.col("text")
    return s.agg(F.count_if(matches(t, fixed.TECHNICAL)).alias("technical"), F.count_if(matches(t, fixed.PROJECT)).alias("project"), F.count_if(matches(t, fixed.PLACEMENT)).alias("placement"))


# From units to decisions.


@query("statements")
def distill_pipeline(s):
    """Statements classified, admitted and held against the statements of the first source."""
    status = F.when(F.col("doc_id") % 10 == 7, "tombstoned").otherwise("active")
    return ingest.distilled_by_first(s.withColumn("memory_kind", F.lit("note")), "doc_id", status)


@query("revisions", sql=f"+{HEADS} SELECT r.event_id, r.semantic_key FROM revisions r WHERE EXISTS (SELECT 1 FROM heads h WHERE h.ns = r.ns AND h.semantic_key = concat('key_', r.event_id % 400) AND h.memory_id <> r.memory_id)")
def semantic_collision(revisions):
    candidates = revisions.withColumn("own_key", F.col("semantic_key")).withColumn("semantic_key", F.concat(F.lit("key_"), (F.col("event_id") % 400).cast("string")))
    return ingest.collisions(candidates, records.heads(revisions)).select("event_id", F.col("own_key").alias("semantic_key"))


@query("revisions", sql="SELECT concat('key_', user_group) AS semantic_key, memory_id, event_id FROM (SELECT *, event_id % 120 AS user_group FROM revisions) WHERE true QUALIFY row_number() OVER (PARTITION BY user_group ORDER BY commit_seq DESC, memory_id) = 1")
def current_by_key(revisions):
    rows = revisions.select(F.concat(F.lit("key_"), (F.col("event_id") % 120).cast("string")).alias("semantic_key"), "memory_id", "event_id", F.col("commit_seq").alias("updated_at"))
    return ingest.current_by_key(rows, rows.select("semantic_key").distinct()).select("semantic_key", "memory_id", "event_id")


@query("statements", "labelled", sql="""+ c AS (SELECT concat('case', doc_id) AS candidate_id, candidate_type, CASE WHEN doc_id % 3 = 0 THEN 'episode' ELSE 'semantic_assertion' END AS memory_class, CASE WHEN doc_id % 5 = 0 THEN 'given' END AS memory_type FROM statements)
 SELECT c.candidate_id, coalesce(c.memory_type, l.kind, CASE WHEN candidate_type = 'preference_candidate' THEN 'preference' WHEN candidate_type = 'relationship_candidate' THEN 'relationship' WHEN candidate_type = 'project_state_candidate' THEN 'project_state' WHEN candidate_type = 'commitment_candidate' THEN 'commitment'
 WHEN candidate_type = 'habit_candidate' THEN 'habit' WHEN candidate_type = 'event_candidate' OR memory_class = 'episode' THEN 'event' ELSE 'general_fact' END) AS memory_type FROM c LEFT JOIN labelled l ON l.case_id = c.candidate_id""")
def type_backfill(s, labelled):
    i = F.col("doc_id")
    c = s.select(F.concat(F.lit("case"), i.cast("string")).alias("candidate_id"), "candidate_type", F.when(i % 3 == 0, "episode").otherwise("semantic_assertion").alias("memory_class"), F.when(i % 5 == 0, "given").alias("memory_type"))
    r = labelled.select(F.col("case_id").alias("candidate_id"), F.col("kind").alias("memory_type"))
    return ingest.backfilled(c, r).select("candidate_id", "memory_type")


@query("curation", sql="""SELECT record_id, coalesce(outcome IN ('canonical_candidate', 'duplicate') AND CASE WHEN outcome = 'canonical_candidate' THEN unit_ref % 3 <> 0 ELSE unit_ref % 4 <> 0 END AND unit_ref % 5 <> 0, false) AS backed FROM curation""")
def admission_proof(curation):
    merge = F.col("outcome") == "duplicate"
    u = F.col("unit_ref")
    base = curation.withColumns({"candidate_id": F.concat(F.lit("c"), "record_id"), "semantic_key": F.concat(F.lit("k"), "receipt_id"), "text": F.col("record_id"), "status": F.col("epistemic_status"), "target": F.concat(F.lit("mem_"), "receipt_id")})
    candidates = base.select("candidate_id", "record_id", F.when(merge, "merge").otherwise("create").alias("op"), "memory_type", "speaker", "semantic_key", "policy", F.when(~merge & (u % 3 == 0), "other").otherwise(F.col("text")).alias("text"), "status", F.when(u % 4 == 0, "other").otherwise(F.col("target")).alias("target"))
    held = base.select("record_id", "memory_type", "speaker", "semantic_key", "policy", "candidate_id", F.when(merge, "canonical_merge").otherwise(F.col("outcome")).alias("outcome"), "text", "status", "target", F.lit(True).alias("worthy"), F.when(u % 5 == 0, "transient").otherwise("durable").alias("durability"), F.when(merge, "duplicate").otherwise("novel").alias("disposition"))
    return ingest.admission_proofs(candidates, held).select("record_id", "backed")


@query("curation", sql="SELECT record_id, CASE WHEN unit_ref % 6 = 0 THEN 'new' WHEN unit_ref % 4 = 0 OR policy = 'v1' THEN 'drift' ELSE 'reuse' END AS state FROM curation")
def prior_curation(curation):
    u = F.col("unit_ref")
    units = curation.select("record_id", "policy", F.md5("record_id").alias("text_hash"))
    prior = curation.select(F.when(u % 6 == 0, F.concat(F.lit("x"), "record_id")).otherwise(F.col("record_id")).alias("record_id"), F.lit("v0").alias("policy"), F.when(u % 4 == 0, "other").otherwise(F.md5("record_id")).alias("text_hash"))
    return ingest.reused(units, prior).select("record_id", "state")


@query("curation", sql="SELECT concat('case', record_id) AS case_id, concat('e', record_id) AS event_id FROM curation WHERE unit_ref % 3 <> 0 AND (relation IS NOT DISTINCT FROM CASE WHEN unit_ref % 2 = 0 THEN 'equivalent' ELSE relation END)")
def review_join(curation):
    u = F.col("unit_ref")
    cases = curation.select(F.concat(F.lit("case"), "record_id").alias("case_id"), "record_id", F.lit(2).alias("version"), "policy", F.when(u % 2 == 0, "equivalent").otherwise(F.col("relation")).alias("relation"))
    events = curation.select(F.concat(F.lit("case"), "record_id").alias("case_id"), F.concat(F.lit("e"), "record_id").alias("event_id"), F.when(u % 3 == 0, 1).otherwise(2).alias("version"))
    return ingest.review_of(cases, events, curation).select("case_id", "event_id")


@query("curation", sql="SELECT c.record_id, 'invalid_candidate' AS disposition FROM curation c WHERE c.memory_type = 'type1' AND c.relation IS NULL AND c.policy IN ('v0', 'v1') AND c.speaker = 'user'")
def exact_remediation(curation):
    bindings = curation.sparkSession.createDataFrame([("type1", None, p, "user", "invalid_candidate") for p in ("v0", "v1")], "memory_type string, relation string, policy string, speaker string, disposition string")
    return ingest.remediated(curation, bindings, ["memory_type", "relation", "policy", "speaker"]).select("record_id", "disposition")


@query("labelled", sql="SELECT case_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 THEN 'policy_superseded' ELSE 'kept' END AS disposition, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 THEN 'policy:v1->v2' END AS evidence FROM labelled WHERE state <> 'resolved'")
def reevaluation_closure(labelled):
    i = F.col("doc_id")
    cases = labelled.select("case_id", "record_id", "state", F.lit("v1").alias("policy"))
    now = labelled.select("record_id", F.when(i % 3 == 0, "pending_review").otherwise("rejected").alias("outcome"), F.when(i % 4 == 0, "v1").otherwise("v2").alias("policy"))
    return ingest.reevaluated(cases, now)


@query("statements", sql="+ m AS (SELECT concat('mem_', min(doc_id)) AS memory_id, lower(trim(nfc_normalize(text))) AS key FROM statements GROUP BY text) SELECT doc_id AS ref, memory_id FROM statements JOIN m ON key = lower(trim(nfc_normalize(text)))")
def normalized_text_match(s):
    memories = s.groupBy("text").agg(F.concat(F.lit("mem_"), F.min("doc_id").cast("string")).alias("memory_id"))
    shout = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return ingest.same_text(memories, s.select(F.col("doc_id").alias("ref"), F.concat(F.lit("  "), shout, F.lit(" ")).alias("text"))).select("ref", "memory_id")


@query("receipts", "revisions", sql=f"+ {INSIGHTS}, m AS (SELECT insight_id, concat('mem_', k % 300) AS mem FROM i) SELECT insight_id, mem AS memory_ids, 'pending' AS status FROM m WHERE mem IN (SELECT memory_id FROM revisions)")
def reflect_known(rows, revisions):
    insights = rows.select(F.col("receipt_id").alias("insight_id"), F.array(F.concat(F.lit("mem_"), (F.col("o_orderkey") % 300).cast("string")), F.lit("mem_none")).alias("memory_ids"))
    return ingest.reflected(insights, revisions).select("insight_id", F.array_join("memory_ids", ",").alias("memory_ids"), "status")


@query("messages", sql="SELECT session_id, pos, CASE WHEN role = 'system' THEN 'unknown' ELSE concat('kind-', role) END AS kind FROM messages")
def actor_lookup(m):
    rows = sessions.normalized(m)
    actors = F.transform(F.filter("actors", lambda a: a != "system"), lambda a: F.struct(a.alias("id"), F.concat(F.lit("kind-"), a).alias("kind")))
    events = F.transform("events", lambda e: F.struct(e["pos"].alias("pos"), e["role"].alias("actor_id")))
    return ingest.actors_of(rows.select("session_id", actors.alias("actors"), events.alias("events")))


@query("statements", sql=f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'event_candidate' WHEN doc_id % 4 = 1 THEN 'fact_candidate' WHEN {EXPLICIT_SQL} THEN 'preference_candidate' ELSE 'fact_candidate' END AS candidate_type,
 CASE WHEN doc_id % 4 = 1 THEN 'synthesized' WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 2 AND {EXPLICIT_SQL} THEN 'user_asserted' ELSE 'uncertain' END ELSE 'inferred' END AS epistemic_status, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'unknown' END AS speaker, CASE WHEN doc_id % 10 <= 2 THEN (doc_id % 10) / 2.0 END AS confidence FROM statements""")
def provider_mapping(s):
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "experience").when(i % 4 == 1, "observation").when(i % 4 == 2, "world")
    meta = F.map_filter(
        F.create_map(F.lit("projection_kind"), F.when(i % 2 == 0, "source_actor"), F.lit("source_actor"), F.when(i % 2 == 0, "user"), F.lit("epistemic_status"), F.lit("inferred"), F.lit("confidence"), ((i % 10) / 2).cast("string")),
        lambda k, v: v.isNotNull(),
    )
    out = ingest.mapped(s.select("doc_id", "text", kind.alias("kind"), meta.alias("metadata")))
    return out.select("doc_id", "candidate_type", "epistemic_status", "speaker", "confidence")


@query("revisions", sql="SELECT memory_id, revision FROM (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision DESC) = 1) WHERE memory_id IN ('mem_3', 'mem_5', 'mem_7') ORDER BY memory_id LIMIT 5")
def reflection_source(revisions):
    preferred = revisions.sparkSession.createDataFrame([(f"mem_{i}",) for i in (3, 5, 7)], "memory_id string")
    return ingest.reflection_sources(revisions, preferred).select("memory_id", "revision")


PILOT = ("preference_change", "inferred_insight", "technical_debugging", "long_project_conversation", "ordinary_conversation")


def _pilot_sql() -> str:
    """Each category's best session among those that no category before it has."""
    hits = ", ".join(f"{' + '.join(f'CAST(contains(lower(t), {chr(39)}{w}{chr(39)}) AS INT)' for w in words)} AS {k}" for k, words in fixed.KEYWORDS.items())
    scores = """preference * 12 + CASE WHEN preference >= 2 THEN 8 ELSE 0 END AS preference_change, inference * 12 + project * 2 AS inferred_insight, technical * 10 + least(n, 20) / 20.0::DOUBLE AS technical_debugging,
 project * 8 + CASE WHEN n >= 25 THEN 15 WHEN n >= 15 THEN 6 ELSE 0 END + least(n, 100) / 100.0::DOUBLE AS long_project_conversation, CASE WHEN n BETWEEN 4 AND 24 AND technical = 0 AND project = 0 AND preference = 0 THEN 20 - inference * 2 ELSE 0 END AS ordinary_conversation"""
    picks = [
        f"p{i} AS (SELECT {i} AS pos, '{c}' AS category, session_id, {c}::DOUBLE AS score FROM sc WHERE session_id NOT IN (SELECT -1 {' '.join(f'UNION ALL SELECT session_id FROM p{j}' for j in range(i))}) ORDER BY score DESC, session_id LIMIT 1)"
        for i, c in enumerate(PILOT)
    ]
    every = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(PILOT)))
    return f"+ s AS (SELECT session_id, substr(string_agg(text, chr(10) ORDER BY pos, role, text), 1, {fixed.KEYWORD_CHARS}) AS t, count(*) AS n FROM messages GROUP BY session_id), h AS (SELECT session_id, n, {hits} FROM s), sc AS (SELECT session_id, {scores} FROM h), {', '.join(picks)} SELECT *, CASE WHEN score > 0 THEN 'heuristic_match' ELSE 'fallback' END AS selection FROM ({every})"


@query("messages", sql=_pilot_sql())
def pilot_selection(m):
    rows = sessions.keyword_scores(sessions.normalized(m), F.array_join(F.col("events")["text"], "\n"), F.size("events")).withColumn("n", F.size("events"))
    return ingest.pilot_sessions(ingest.scored_sessions(rows), list(PILOT))


@query("receipts", sql="SELECT receipt_id, CASE WHEN a < -5 OR a > 60 THEN 'OBSERVATION_STALE' END AS problem, CASE WHEN a BETWEEN -5 AND 60 THEN CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 1 THEN 'healthy' ELSE 'degraded' END END AS status FROM (SELECT *, 100 - o_orderkey % 120 AS a FROM receipts)")
def health_observation(rows):
    now = F.lit("2024-01-01 00:01:40").cast("timestamp")
    r = rows.select("receipt_id", (F.col("o_orderkey") % 3 != 0).alias("ok"), F.concat(F.lit("s"), (F.col("o_orderkey") % 4).cast("string")).alias("schema_state"), F.lit("s1").alias("expected_schema"), F.timestamp_seconds(F.lit(1704067200) + F.col("o_orderkey") % 120).alias("observed_at"))
    return ingest.observation(r, now).select("receipt_id", "problem", "status")


@query("revisions", sql="SELECT memory_id, revision, status, event_id FROM revisions WHERE ns = 'ns0' AND memory_id = 'mem_3' ORDER BY revision DESC LIMIT 1")
def reference_lookup(revisions):
    return ingest.reference(revisions, "ns0", "mem_3").select("memory_id", "revision", "status", "event_id")


@query("receipts", sql="SELECT concat('unit_', substr(sha256(concat(receipt_id, chr(31), archive_checksum)), 1, 32)) AS unit_ref, source_id AS text, 'synthesized' AS epistemic_status FROM receipts WHERE archive_checksum IS NOT NULL")
def synthetic_evidence(rows):
    units = ingest.synthetic_units(rows.select(F.col("receipt_id").alias("exploration_id"), F.col("archive_checksum").alias("checksum"), F.col("source_id").alias("summary")))
    return units.select("unit_ref", "text", "epistemic_status")


@query("curation", sql="SELECT count(*) FILTER (canonical_id IS NOT NULL AND speaker = 'user') AS eligible, count(*) FILTER (relation IS NOT NULL) AS related, count(DISTINCT policy) AS scopes, count(*) FILTER (concat('unit:', unit_ref) IN ('unit:1', 'unit:2')) AS closed FROM curation")
def boundary_counts(curation):
    body = curation.withColumn("j", F.parse_json(F.to_json(F.struct(((F.col("speaker") == "user") & F.col("canonical_id").isNotNull()).alias("eligible"), F.array_compact(F.array("relation")).alias("related")))))
    refs = F.array(F.concat(F.lit("unit:"), F.col("unit_ref").cast("string")))
    return body.withColumn("refs", refs).agg(
        F.count_if(F.variant_get("j", "$.eligible", "boolean")).alias("eligible"), F.count_if(F.size(F.variant_get("j", "$.related", "array<string>")) > 0).alias("related"), F.count_distinct("policy").alias("scopes"),
        F.count_if(F.exists("refs", lambda r: r.isin("unit:1", "unit:2"))).alias("closed"),
    )


@query("labelled", sql="SELECT case_id, state, row_number() OVER (ORDER BY CASE state WHEN 'queued' THEN 0 ELSE 1 END, doc_id DESC, case_id) AS place FROM labelled ORDER BY place LIMIT 50")
def ordered_events(labelled):
    order = [F.when(F.col("state") == "queued", 0).otherwise(1), F.col("doc_id").desc(), F.col("case_id")]
    top = labelled.orderBy(*order).limit(50)
    # One page of rows.
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("case_id", "state", "place")


@query("revisions", sql=EDGES + " SELECT type, count(*) AS n, count(DISTINCT split_part(dst, ':', 1)) AS kinds FROM e GROUP BY type")
def edge_counts(revisions):
    return _edges(revisions).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.substring_index("dst", ":", 1)).alias("kinds"))


# Look-ups, listings, counters and plans.


@query("revisions", sql="+ q AS (SELECT event_id AS pos, ns, CASE WHEN event_id % 7 = 0 THEN -commit_seq ELSE commit_seq + 2 END AS commit_seq FROM revisions) SELECT q.pos, q.ns, q.commit_seq, r.memory_id, r.op FROM q LEFT JOIN revisions r ON r.ns = q.ns AND r.commit_seq = q.commit_seq")
def change_lookup(revisions):
    requests = revisions.select(F.col("event_id").alias("pos"), "ns", F.when(F.col("event_id") % 7 == 0, -F.col("commit_seq")).otherwise(F.col("commit_seq") + 2).alias("commit_seq"))
    return records.changes_at(requests, revisions.select("ns", "commit_seq", "memory_id", "op")).select("pos", "ns", "commit_seq", "memory_id", "op")


@query("revisions", sql="SELECT r.memory_id, r.revision, r.event_id, string_agg(concat('event:', e.event_id), ',' ORDER BY e.event_id) AS refs FROM revisions r LEFT JOIN revisions e ON e.memory_id = r.memory_id AND e.revision <= r.revision AND e.revision > r.revision - 3 WHERE r.revision > 1 GROUP BY ALL")
def hydrate_evidence(revisions):
    """Each revision with what it and the two before it came from."""
    requests = revisions.where("revision > 1").select("memory_id", "revision")
    three = F.explode(F.sequence(F.col("revision"), F.col("revision") + 2)).alias("of")
    evidence = revisions.select("memory_id", "event_id", three).select("memory_id", F.col("of").alias("revision"), F.col("event_id").alias("pos"), F.lit("event").alias("source_type"), F.col("event_id").cast("string").alias("source_ref"))
    out = records.hydrated_with_evidence(requests, revisions.select("memory_id", "revision", "event_id"), evidence)
    refs = F.transform("evidence", lambda e: F.concat_ws(":", e["source_type"], e["source_ref"]))
    return out.select("memory_id", "revision", "event_id", F.array_join(refs, ",").alias("refs"))


def _listing(status, name):
    where = "" if status is None else f"WHERE state = '{status}'"

    @query("labelled", sql=f"SELECT case_id, state FROM labelled {where} ORDER BY doc_id // 10, case_id LIMIT 100", as_=name)
    def listing(labelled):
        return review.listed(labelled.withColumn("created_at", F.expr("doc_id div 10")), status, 100).select("case_id", "state")


_listing(None, "review_listing")
_listing("queued", "review_listing_queued")


@query("labelled", sql=f"+ {RECORDS} SELECT concat('case_', substr(sha256(record_id), 1, 32)) AS case_id, record_id, 'queued' AS state, 1::BIGINT AS version FROM rec WHERE outcome = 'pending_review' AND record_id NOT IN (SELECT record_id FROM cs)")
def review_enqueue(labelled):
    return review.enqueued(*_records(labelled)).select("case_id", "record_id", "state", "version")


POLARITY_SQL = f"CASE WHEN {_rx(fixed.GENERAL_NEGATIVE)} AND {_rx(fixed.GENERAL_POSITIVE)} THEN 'unknown' WHEN {_rx(fixed.GENERAL_NEGATIVE)} THEN 'negative' ELSE 'affirmative' END"


@query("statements", sql=TYPED + f""" SELECT doc_id, concat_ws(',', concat('semantic:memory_type:', ty), concat('semantic:speaker_provenance:', sp), concat('semantic:epistemic_status:', {STATUS_SQL}), concat('semantic:polarity:', {POLARITY_SQL}),
 CASE WHEN dir THEN 'semantic:lifetime:operational_directive_ephemeral' END) AS reasons FROM t""")
def classify_reasons(s):
    """Of statements that no concept is looked for in."""
    out = _typed(s)
    status = semantics.epistemic_status(F.col("epistemic_status"), F.col("memory_type"), F.col("speaker"))
    none = F.array().cast("array<string>")
    codes = semantics.reason_codes(F.col("memory_type"), F.col("speaker"), status, semantics.polarity(F.col("text"), F.lit(None).cast("string")), F.col("directive"), none)
    return out.select("doc_id", F.array_join(codes, ",").alias("reasons"))


@query("curation", sql="""SELECT record_id, concat('sha256:', sha256(concat('{"candidateId":"c', record_id, '","canonicalAdmission":{"curationRecordId":"cur_', record_id, '","outcome":"', outcome, '"},"memoryType":"', memory_type, '","providerRunId":', CASE WHEN relation IS NULL THEN 'null' ELSE concat('"', relation, '"') END, ',"speakerProvenance":"', speaker, '"}'))) AS fingerprint FROM curation""")
def admission_fingerprints(curation):
    fields = {"candidateId": F.concat(F.lit("c"), "record_id"), "memoryType": F.col("memory_type"), "speakerProvenance": F.col("speaker"), "providerRunId": F.col("relation"), "canonicalAdmission": {"outcome": F.col("outcome"), "curationRecordId": F.concat(F.lit("cur_"), "record_id")}}
    return curation.select("record_id", canon.state_fingerprint(**fields).alias("fingerprint"))


@query("curation", sql="""SELECT record_id, concat('sha256:', sha256(concat('{"memoryType":"', memory_type, '","scope":{"lifeDid":"did:', speaker, '","memoryNamespace":"', policy, '"},"semanticRelation":', CASE WHEN relation IS NULL THEN 'null' ELSE concat('"', relation, '"') END, ',"targetMemoryId":', CASE WHEN canonical_id IS NULL THEN 'null' ELSE concat('"', canonical_id, '"') END, '}'))) AS fingerprint FROM curation""")
def review_fingerprints(curation):
    fields = {"scope": {"memoryNamespace": F.col("policy"), "lifeDid": F.concat(F.lit("did:"), "speaker")}, "targetMemoryId": F.col("canonical_id"), "semanticRelation": F.col("relation"), "memoryType": F.col("memory_type")}
    return curation.select("record_id", canon.state_fingerprint(**fields).alias("fingerprint"))


@query("curation", sql="""SELECT record_id, concat('sha256:', sha256(concat('{"memoryId":', CASE WHEN canonical_id IS NULL THEN 'null' ELSE concat('"', canonical_id, '"') END, ',"memoryType":"', memory_type, '","proposedText":"', record_id, '"}'))) AS fingerprint FROM curation""")
def candidate_fingerprints(curation):
    return curation.select("record_id", canon.candidate_fingerprint(memoryType=F.col("memory_type"), proposedText=F.col("record_id"), memoryId=F.col("canonical_id")).alias("fingerprint"))


DECISIONS = "d AS (SELECT source_id, CASE WHEN o_orderkey % 7 = 0 THEN 'defer' WHEN o_orderkey % 5 = 0 THEN 'source_only' WHEN o_orderkey % 3 = 0 THEN 'unchanged' WHEN o_orderkey % 11 = 0 THEN 'no_textual_evidence' ELSE 'distill' END AS decision FROM receipts)"


@query("receipts", sql=f"+ {DECISIONS} SELECT source_id, count(*) AS scanned, count(*) FILTER (decision <> 'unchanged') AS changed, " + ", ".join(f"count(*) FILTER (decision = '{d}') AS {c}" for c, d in operations.SYNC_COUNTERS.items()) + " FROM d GROUP BY source_id")
def sync_counters(rows):
    k = F.col("o_orderkey")
    d = F.when(k % 7 == 0, "defer:journal_tail_incomplete").when(k % 5 == 0, "source_only:no_user_authored_text").when(k % 3 == 0, "unchanged").when(k % 11 == 0, "no_textual_evidence").otherwise("distill")
    return operations.sync_counters(rows.select("source_id", d.alias("decision")), ["source_id"])


@query("receipts", sql="SELECT source_id AS migration, count(*) AS processed, count(*) FILTER (status = 'complete') AS ingested, count(*) FILTER (status = 'failed') AS skipped, max(o_orderkey) AS cursor, bool_and(status <> 'awaiting_review') AS consistent FROM receipts GROUP BY source_id")
def migration_state(rows):
    outcome = F.when(F.col("status") == "complete", "ingested").when(F.col("status") == "failed", "skipped")
    return operations.migration_state(rows.select(F.col("source_id").alias("migration"), F.col("o_orderkey").alias("pos"), outcome.alias("outcome")))


@query("outbox", sql="SELECT status AS name, count(*) AS n FROM outbox GROUP BY status")
def ledger_counts(outbox):
    return operations.ledger_counts(outbox.select(F.col("status").alias("name")))


@query("revisions", "outbox", sql="SELECT * FROM (VALUES ('outbox', 'incompatible', 'token: string, worker: missing'), ('receipts', 'missing', ''), ('revisions', 'ready', '')) t(\"table\", state, problems)")
def schema_readiness(revisions, outbox):
    needed = {"revisions": {"memory_id": "string", "revision": "bigint"}, "outbox": {"outbox_id": "string", "token": "int", "worker": "string"}, "receipts": {"receipt_id": "string"}}
    return operations.readiness({"revisions": revisions, "outbox": outbox}, needed)


@query("receipts", sql="SELECT receipt_id, CASE WHEN o_orderkey % 13 = 0 THEN 'hidden' WHEN o_orderkey % 4 < 2 THEN 'too_short' WHEN NOT (status = 'failed' OR archive_checksum IS NULL OR epoch(TIMESTAMP '1996-01-01') - epoch(updated_at) >= 172800) THEN 'not_complete' END AS problem FROM receipts")
def pilot_eligibility(rows):
    k = F.col("o_orderkey")
    ended = F.when(F.col("archive_checksum").isNull(), F.col("updated_at"))
    problem = sessions.pilot_problem(k % 13 == 0, k % 4, F.col("status") == "failed", ended, F.col("updated_at").cast("timestamp"), F.lit("1996-01-01 00:00:00").cast("timestamp"))
    return rows.select("receipt_id", problem.alias("problem"))


@query("receipts", sql="SELECT receipt_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE updated_at END AS ended_at FROM receipts ORDER BY coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE updated_at END, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1997-01-01' END) DESC NULLS LAST, receipt_id LIMIT 200")
def recent_sessions(rows):
    s = rows.select("receipt_id", F.when(F.col("o_orderkey") % 3 != 0, F.col("updated_at")).alias("ended_at"), F.when(F.col("o_orderkey") % 2 == 0, at("1997-01-01")).alias("started_at"))
    return sessions.recent(s, ["ended_at", "started_at"], "receipt_id", 200).select("receipt_id", "ended_at")


@query("statements", sql=r"""+ p AS (SELECT doc_id, text, substr(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS s FROM statements) SELECT doc_id, concat(CASE WHEN s = '' THEN 'node' ELSE s END, '-', substr(sha256(text), 1, 8)) AS slug FROM p""")
def node_slugs(s):
    return s.select("doc_id", graph.node_slug(F.col("text")).alias("slug"))


@query("revisions", sql=EDGES + " SELECT src AS id, split_part(src, ':', 1) AS kind, string_agg(concat('- ', type, ': [[', dst, ']]'), chr(10) ORDER BY type, dst) AS body FROM (SELECT DISTINCT src, type, dst FROM e) GROUP BY src")
def graph_notes(revisions):
    return graph.notes(_edges(revisions))


@query("receipts", sql="SELECT concat('exp', o_orderkey) AS experience_id, CASE WHEN status = 'complete' AND o_orderkey % 6 = 0 THEN 'receipt_missing' WHEN status <> 'complete' AND o_orderkey % 6 <> 0 THEN 'receipt_unexpected' END AS problem FROM receipts")
def experience_references(rows):
    e = rows.select(F.concat(F.lit("exp"), F.col("o_orderkey").cast("string")).alias("experience_id"), "source_id", F.when(F.col("status") == "complete", "DISTILLATION_SUBMITTED").otherwise("SOURCE_ONLY").alias("disposition"), F.when(F.col("o_orderkey") % 6 != 0, F.col("receipt_id")).alias("receipt_id"))
    return ingest.experience_references(e).select("experience_id", "problem")


@query("receipts", sql="SELECT receipt_id, source_id, status, updated_at, archive_checksum IS NOT NULL AS archived FROM receipts")
def public_receipts(rows):
    return ingest.public_receipts(rows)


@query("hits", "revisions", sql=f"""+ early AS (SELECT * FROM revisions WHERE valid_from < TIMESTAMP '{SEED}'), now_ AS (SELECT memory_id, max(revision) AS last FROM revisions WHERE valid_from < TIMESTAMP '{SEED} 03:00:00' GROUP BY memory_id), heads AS (SELECT * FROM early QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision DESC) = 1),
 q AS (SELECT memory_id, min(rank) AS rank FROM hits GROUP BY memory_id) SELECT q.memory_id, CASE WHEN h.memory_id IS NULL THEN 'NOT_FOUND' WHEN h.ns <> 'ns0' AND h.ns <> 'ns1' THEN 'SCOPE_MISMATCH' WHEN h.status = 'tombstoned' THEN 'TOMBSTONED' WHEN NOT h.intact THEN 'REVISION_INTEGRITY' WHEN h.valid_from > TIMESTAMP '{SEED}' THEN 'NOT_YET_VALID'
 WHEN h.valid_until < TIMESTAMP '{SEED}' THEN 'NO_LONGER_VALID' WHEN last <> h.revision THEN 'HEAD_CHANGED' ELSE 'ALLOW' END AS decision FROM q LEFT JOIN heads h USING (memory_id) LEFT JOIN now_ USING (memory_id)""")
def verify_moving_heads(hits, revisions):
    """Decisions by the heads of one moment, which are read again three hours later."""
    early, later = (revisions.where(F.col("valid_from") < at(t)) for t in (SEED, f"{SEED} 03:00:00"))
    requests = hits.groupBy("memory_id").agg(F.min("rank").alias("rank")).withColumn("expected_revision", F.lit(None).cast("long"))
    now = lambda r: records.heads(r).withColumnRenamed("revision", "current_revision")
    scope = F.when(F.col("__ns").isin("ns0", "ns1"), F.col("__ns")).otherwise("ns0")
    return verify.decided(requests, now(early), early, scope, at(SEED), now(later)).select("memory_id", "decision")


@query("receipts", "revisions", sql=f"""+{HEADS}, {INSIGHTS}, ok AS (SELECT i.*, concat('mem_', k % 150) AS mem FROM i WHERE has_m AND has_e AND NOT contra AND confidence >= 0.75 AND st = 'accepted'),
 early AS (SELECT memory_id, arg_max(status, revision) AS status, max(revision) AS revision FROM revisions WHERE valid_from < TIMESTAMP '{SEED}' GROUP BY memory_id), p AS (SELECT ok.insight_id, ok.mem, e.revision FROM ok JOIN early e ON e.memory_id = mem AND e.status = 'active')
 SELECT p.insight_id, CASE WHEN h.status <> 'active' THEN 'gone' WHEN h.revision = p.revision THEN 'promoted' ELSE 'stale' END AS outcome FROM p JOIN heads h ON h.memory_id = mem""")
def promotion_apply(rows, revisions):
    """Plans of one moment held against the records of another."""
    insights = _insights(rows)
    plan = review.promotion_plan(insights, records.heads(revisions.where(F.col("valid_from") < at(SEED))))
    return review.applied(plan, insights, records.heads(revisions))


@query("outbox", "revisions", sql="""+ e AS (SELECT concat('evt_', substr(sha256(concat(o.outbox_id, chr(31), r.commit_seq)), 1, 32)) AS event_id, o.memory_id, o.revision FROM outbox o JOIN revisions r USING (memory_id, revision))
 SELECT CASE WHEN revision % 9 = 0 THEN concat('x', event_id) ELSE event_id END AS event_id, CASE WHEN revision % 9 = 0 THEN 'UNKNOWN_EVENT' WHEN revision % 7 = 0 THEN 'MEMORY' WHEN revision % 5 = 0 THEN 'REVISION' ELSE 'STATUS' END AS problem FROM e WHERE revision % 9 = 0 OR revision % 7 = 0 OR revision % 5 = 0 OR revision % 4 = 0""")
def delivery_receipts(outbox, revisions):
    sent, r = queue.events(outbox, revisions), F.col("revision")
    got = sent.select(
        F.when(r % 9 == 0, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id")).alias("event_id"), F.when(r % 7 == 0, "other").otherwise(F.col("memory_id")).alias("memory_id"),
        F.when(r % 5 == 0, r + 1).otherwise(r).alias("revision"), F.when(r % 4 == 0, "LOST").otherwise("CURRENT").alias("status"),
    )
    return queue.receipt_problems(got, sent).select("event_id", "problem")


@query("revisions", sql=f"""+{HEADS} SELECT r.event_id, CASE WHEN r.event_id % 29 = 0 THEN 'operation' WHEN r.op = 'create' AND r.event_id % 2 = 0 THEN 'create_with_base' WHEN r.op <> 'create' AND r.event_id % 13 = 0 THEN 'mutation_without_base' WHEN r.event_id % 17 = 0 THEN 'text' WHEN r.event_id % 19 = 0 THEN 'confidence' WHEN r.valid_until < r.valid_from THEN 'validity' END AS problem,
 CASE WHEN r.event_id % 3 = 0 THEN r.semantic_key ELSE h.semantic_key END AS semantic_key FROM revisions r JOIN heads h USING (memory_id)""")
def candidate_ingest(revisions):
    i = F.col("event_id")
    c = revisions.select(
        "event_id", "ns", "memory_id", F.when(i % 3 == 0, F.col("semantic_key")).alias("semantic_key"), F.when(i % 29 == 0, "supersede").otherwise(F.col("op")).alias("op"), F.when(F.col("op") == "create", F.when(i % 2 == 0, 1)).otherwise(F.when(i % 13 != 0, F.greatest(F.lit(1), F.col("revision") - 1))).alias("base_revision"),
        F.when(i % 17 == 0, " ").otherwise("text").alias("text"), F.when(i % 19 == 0, 1.5).otherwise(0.5).alias("confidence"), F.lit(None).cast("string").alias("memory_type"), "valid_from", "valid_until",
    )
    bases = records.heads(revisions).select("memory_id", "semantic_key", F.lit("event").alias("memory_type"))
    return commit.ingested(c, bases).select("event_id", "problem", "semantic_key")


@query("messages", sql="SELECT session_id, coalesce(session_id % 5 = 0 OR (session_id % 5 = 1 AND session_id % 2 = 0), false) AS background FROM (SELECT DISTINCT session_id FROM messages)")
def background_sessions(m):
    s = F.col("session_id")
    source = F.when(s % 5 == 0, "cron").when(s % 5 == 1, "api_server").when(s % 5 == 2, "cli")
    own = F.concat(F.when(s % 2 == 0, "bridge-").otherwise("own-"), s.cast("string"))
    return m.select("session_id").distinct().select("session_id", sessions.background(source, own, "bridge-").alias("background"))
