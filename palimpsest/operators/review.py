"""Review cases, their decisions, the canary gate, and the promotion of insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.canon import joined_id
from palimpsest.functions.semantics import promotion

# Dispositions that a case of each kind allows.
PENDING_DISPOSITIONS = ("confirmed_contradiction", "confirmed_unrelated", "invalid_candidate", "needs_more_evidence", "policy_superseded")
SAMPLE_DISPOSITIONS = ("approved_as_classified", "misclassified", "needs_more_evidence")


def lineage(events: DataFrame) -> DataFrame:
    """Events with the version that each gives its case."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy("case_id").orderBy("occurred_at", "event_id")).cast("long"))


def _allowed() -> Column:
    cites = F.exists("evidence", lambda e: e.startswith("curation:"))
    policy = F.exists("evidence", lambda e: e.rlike("^policy:.+->")) & F.exists("evidence", lambda e: e.startswith("receipt:"))
    kind = F.when(F.col("kind") == "pending_review", F.col("disposition").isin(*PENDING_DISPOSITIONS)).otherwise(F.col("disposition").isin(*SAMPLE_DISPOSITIONS))
    return kind & cites & ((F.col("disposition") != "policy_superseded") | policy)


def resolved(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """State of every case (case_id, kind) after its decisions (case_id, pos, expected_version, disposition, evidence), in order.

    A decision counts if it expects the case's version, its disposition and evidence are allowed, and the case is not yet resolved.
    needs_more_evidence defers: the case stays open under a higher version.
    """
    good = decisions.join(cases.select("case_id", "kind"), "case_id").where(_allowed())
    log = good.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "expected_version", "disposition"))).alias("log"))
    start = F.struct(F.lit("queued").alias("state"), F.lit(1).cast("long").alias("version"), F.lit(None).cast("string").alias("disposition"))

    def step(at: Column, d: Column) -> Column:
        ok = (at["state"] != "resolved") & (at["version"] == d["expected_version"])
        state = F.when(d["disposition"] == "needs_more_evidence", "deferred").otherwise("resolved")
        return F.when(ok, F.struct(state.alias("state"), (at["version"] + 1).alias("version"), d["disposition"].alias("disposition"))).otherwise(at)

    empty = F.array().cast("array<struct<pos:bigint,expected_version:bigint,disposition:string>>")
    out = cases.join(log, "case_id", "left").withColumn("end", F.aggregate(F.coalesce("log", empty), start, step))
    return out.select("case_id", "kind", "end.state", "end.version", "end.disposition")


def pending_not_queued(records: DataFrame, cases: DataFrame) -> DataFrame:
    """Records pending review that have no case."""
    return records.where("outcome = 'pending_review'").join(cases.select("record_id"), "record_id", "left_anti")


def telemetry(records: DataFrame) -> DataFrame:
    """dimension, value, n for type, speaker, epistemic status, outcome and relation (none where null), in one pass."""
    dims = {"memory_type": "memory_type", "speaker": "speaker", "epistemic_status": "epistemic_status", "outcome": "outcome", "relation": "coalesce(relation, 'none')"}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.expr(v).alias("value")) for k, v in dims.items())))
    return records.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


GATE_FLAGS = (
    "curation_coverage_mismatch", "semantic_policy_mismatch", "review_case_source_mismatch", "pending_review_not_queued", "pending_review_outcomes_present",
    "unresolved_review_cases", "insufficient_approved_samples", "misclassification_detected", "review_case_crossed_canonical_boundary",
)


def canary_gate(records: DataFrame, cases: DataFrame, policy: str, units: int, least_samples: int = 1) -> DataFrame:
    """One row: eligible, and which of GATE_FLAGS hold.

    records: record_id, outcome, policy. cases: record_id, kind, state, disposition, canonical_id.
    """
    r = records.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("policy") != policy).alias("foreign"), F.count_if(F.col("outcome") == "pending_review").alias("pending")
    )
    known = cases.join(records.select("record_id", F.lit(True).alias("__known")), "record_id", "left")
    c = known.agg(
        F.count_if(F.col("__known").isNull()).alias("strangers"),
        F.count_if(F.col("state") != "resolved").alias("open"),
        F.count_if((F.col("kind") == "canary_sample") & (F.col("disposition") == "approved_as_classified")).alias("approved"),
        F.count_if(F.col("disposition") == "misclassified").alias("wrong"),
        F.count_if((F.col("kind") == "pending_review") & F.col("canonical_id").isNotNull()).alias("crossed"),
    )
    q = pending_not_queued(records, cases).agg(F.count(F.lit(1)).alias("unqueued"))
    tests = ["n <> {units}".format(units=units), "foreign > 0", "strangers > 0", "unqueued > 0", "pending > 0", "open > 0", f"approved < {least_samples}", "wrong > 0", "crossed > 0"]
    row = r.crossJoin(c).crossJoin(q)  # one row each
    flags = {name: F.expr(test) for name, test in zip(GATE_FLAGS, tests)}
    out = row.select(*(t.alias(n) for n, t in flags.items()))
    some = F.array_contains(F.array(*map(F.col, GATE_FLAGS)), True)
    return out.withColumn("eligible", ~some)


def promotion_gate(insights: DataFrame) -> DataFrame:
    return insights.withColumn("gate", promotion(F.col("memory_ids"), F.col("evidence_ids"), F.col("contradicting_ids"), F.col("confidence"), F.col("status"))).select(*insights.columns, "gate.*")


def evidence_closure(insights: DataFrame, heads: DataFrame, evidence: DataFrame) -> DataFrame:
    """insights with the supporting records that are not active, and the evidence that no supporting record has.

    heads: memory_id, status. evidence: memory_id, evidence_id.
    """
    support = insights.select("insight_id", F.explode("memory_ids").alias("memory_id"))
    state = support.join(heads.select("memory_id", "status"), "memory_id", "left")
    idle = state.where("status IS NULL OR status <> 'active'").groupBy("insight_id").agg(F.array_sort(F.collect_set("memory_id")).alias("inactive"))
    has = support.join(evidence, "memory_id").groupBy("insight_id").agg(F.collect_set("evidence_id").alias("__has"))
    out = insights.join(idle, "insight_id", "left").join(has, "insight_id", "left")
    none = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(F.col("evidence_ids"), F.coalesce("__has", none)))
    out = out.withColumns({"inactive": F.coalesce("inactive", none), "missing": missing}).drop("__has")
    return out.withColumn("closed", (F.size("inactive") == 0) & (F.size("missing") == 0))


def duplicate_promotions(promotions: DataFrame) -> DataFrame:
    return promotions.groupBy("insight_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def status_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Insights whose status moved against the rules: pending to any, accepted to superseded, nothing else."""
    moved = after.join(before.select("insight_id", F.col("status").alias("__was")), "insight_id").where(F.col("status") != F.col("__was"))
    legal = (F.col("__was") == "pending") | ((F.col("__was") == "accepted") & (F.col("status") == "superseded"))
    return moved.where(~legal).withColumnRenamed("__was", "was")


def disposition_tally(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.coalesce("disposition", F.lit("none")).alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


def listed(cases: DataFrame, status: str | None, limit: int) -> DataFrame:
    """A page of cases in order of creation, of one status if one is given."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 cases")
    return (cases if status is None else cases.where(F.col("state") == status)).orderBy("created_at", "case_id").limit(limit)


def enqueued(records: DataFrame, cases: DataFrame) -> DataFrame:
    """New cases for records that wait for review and have none: one for each record, its id made from the record's, so that a repeat finds it."""
    new = pending_not_queued(records, cases).dropDuplicates(["record_id"])
    return new.select(joined_id("case_", F.col("record_id"), length=32).alias("case_id"), "record_id", F.lit("pending_review").alias("kind"), F.lit("queued").alias("state"), F.lit(1).cast("long").alias("version"))


def promotion_plan(insights: DataFrame, heads: DataFrame) -> DataFrame:
    """insight_id, plan: for every insight that may be promoted, a fingerprint of itself and of the revisions that it rests on."""
    gate = promotion(F.col("memory_ids"), F.col("evidence_ids"), F.col("contradicting_ids"), F.col("confidence"), F.col("status"))
    good = insights.where(gate["eligible"])
    rests = good.select("insight_id", F.explode("memory_ids").alias("memory_id")).join(heads.where("status = 'active'").select("memory_id", "revision"), "memory_id", "left")
    on = rests.groupBy("insight_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "memory_id", F.coalesce(F.col("revision").cast("string"), F.lit("none"))))), ",").alias("on"), F.count_if(F.col("revision").isNull()).alias("lost"))
    own = F.concat_ws("|", "insight_id", F.array_join("evidence_ids", ","), F.col("confidence").cast("string"))
    return good.join(on.where("lost = 0"), "insight_id").select("insight_id", F.sha2(F.concat_ws("|", own, "on"), 256).alias("plan"))


def applied(plan: DataFrame, insights: DataFrame, heads: DataFrame) -> DataFrame:
    """insight_id, outcome of a plan held against what is now: promoted where nothing has moved, stale, or gone. A dry run is the same without the write."""
    now = promotion_plan(insights, heads).withColumnRenamed("plan", "__now")
    outcome = F.when(F.col("__now").isNull(), "gone").when(F.col("__now") == F.col("plan"), "promoted").otherwise("stale")
    return plan.join(now, "insight_id", "left").select("insight_id", outcome.alias("outcome"))
