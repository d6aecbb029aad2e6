import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import commit, graph, queue, receipts, records, review, sessions, verify

T = "2026-09-01 12:00:00"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def seeds(spark):
    """Ten candidates of a ranking: one is allowed, the others are suppressed for nine reasons."""
    heads = spark.createDataFrame(
        [
            ("m_ok", "a", "active", 2), ("m_scope", "b", "active", 1), ("m_tomb", "a", "tombstoned", 2), ("m_sup", "a", "superseded", 1), ("m_rev", "a", "active", 3),
            ("m_miss", "a", "active", 9), ("m_int", "a", "active", 1), ("m_early", "a", "active", 1), ("m_late", "a", "active", 1),
        ],
        "memory_id string, ns string, status string, current_revision long",
    )
    revisions = spark.createDataFrame(
        [
            ("m_ok", 2, True, "2026-09-01 12:00:00", "2026-09-01 12:00:00"), ("m_scope", 1, True, None, None), ("m_tomb", 2, True, None, None), ("m_sup", 1, True, None, None), ("m_rev", 3, True, None, None),
            ("m_int", 1, False, None, None), ("m_early", 1, True, "2026-09-01 12:00:01", None), ("m_late", 1, True, None, "2026-09-01 11:59:59"),
        ],
        "memory_id string, revision long, intact boolean, f string, u string",
    ).select("memory_id", "revision", "intact", F.col("f").cast("timestamp_ntz").alias("valid_from"), F.col("u").cast("timestamp_ntz").alias("valid_until"))
    claims = [("m_ok", 2), ("m_none", 1), ("m_scope", 1), ("m_tomb", 2), ("m_sup", 1), ("m_rev", 2), ("m_miss", 9), ("m_int", 1), ("m_early", 1), ("m_late", 1)]
    hits = spark.createDataFrame([(m, r, i) for i, (m, r) in enumerate(claims)], "memory_id string, claimed_revision long, rank long")
    return heads, revisions, hits


REASONS = ["ALLOW", "NOT_FOUND", "SCOPE_MISMATCH", "TOMBSTONED", "SUPERSEDED", "REVISION_MISMATCH", "REVISION_MISSING", "REVISION_INTEGRITY", "NOT_YET_VALID", "NO_LONGER_VALID"]


def test_each_reason_once(seeds):
    heads, revisions, hits = seeds
    out = verify.decided(hits.withColumn("expected_revision", F.col("claimed_revision")), heads, revisions, F.lit("a"), F.lit(T).cast("timestamp_ntz"))
    assert [r.decision for r in out.orderBy("rank").collect()] == REASONS
    assert sum(r.n for r in verify.counted(out).collect()) == 9


def test_retrieval_keeps_rank_and_conserves(seeds):
    heads, revisions, hits = seeds
    out = verify.retrieved(hits.unionAll(hits), heads, revisions, F.lit("a"), F.lit(T).cast("timestamp_ntz"), 10)
    assert [r.memory_id for r in out.collect()] == ["m_ok"]
    with pytest.raises(ValueError):
        verify.retrieved(hits, heads, revisions, F.lit("a"), F.lit(T), 101)


def test_federated_view(spark):
    view = "mount long, pos long, memory_id string, rank long, semantic_key string"
    primary = spark.createDataFrame([(0, 0, "p1", 1, "k1"), (0, 1, "p1", 2, "k1")], view)
    mounted = spark.createDataFrame([(1, 0, "h1", 1, "k1"), (1, 1, "h2", 2, "k2"), (1, 2, "h3", 3, "k3"), (1, 3, "h4", 4, "k4"), (2, 0, "h4", 1, "k4")], view)
    own = spark.createDataFrame([("k1", "p1", True), ("k2", "p2", False), ("k3", "p3", True)], "semantic_key string, memory_id string, allowed boolean")
    out = rows(verify.federated(primary, mounted, own, 2).select("mount", "pos", "shown_id", "outcome"), "mount", "pos")
    assert out == [
        (0, 0, "p1", "SHOWN"), (0, 1, "p1", "VIEW_DUPLICATE"), (1, 0, "p1", "VIEW_PRIMARY_OVERRIDE"), (1, 1, "p2", "VIEW_PRIMARY_SUPPRESSION"),
        (1, 2, "p3", "SHOWN"), (1, 3, "h4", "VIEW_TOP_K"), (2, 0, "h4", "VIEW_DUPLICATE"),
    ]


@pytest.fixture(scope="module")
def batch(spark):
    c = [
        ("a", "k1", "c01", 1, "i1", "create", None), ("a", "k1", "c02", 2, "i2", "update", 1), ("a", "k1", "c03", 3, "i3", "update", 1), ("a", "k1", "c04", 4, "i4", "tombstone", 2),
        ("a", "k1", "c05", 5, "i5", "create", None), ("a", "k1", "c06", 6, "i6", "update", 3), ("a", "k1", "c07", 7, "i7", "restore", 3), ("a", "k2", "c08", 8, "i8", "create", None), ("b", "k1", "c09", 9, "i9", "create", None),
        ("a", "k3", "c10", 10, "old", "create", None),
    ]
    schema = "ns string, semantic_key string, candidate_id string, created_at long, idempotency_key string, op string, base_revision long"
    heads = spark.createDataFrame([], "ns string, semantic_key string, revision long, status string")
    changes = spark.createDataFrame([("a", "old")], "ns string, idempotency_key string")
    marks = spark.createDataFrame([("a", 40)], "ns string, high_water long")
    return c, schema, heads, changes, marks


EXPECTED = [
    ("c01", "accepted", 1, "active", 41), ("c02", "accepted", 2, "active", 42), ("c03", "conflict", 2, "active", None), ("c04", "accepted", 3, "tombstoned", 43), ("c05", "suppressed", 3, "tombstoned", None),
    ("c06", "error", 3, "tombstoned", None), ("c07", "accepted", 4, "active", 44), ("c08", "accepted", 1, "active", 45), ("c09", "accepted", 1, "active", 1),
]


@pytest.mark.parametrize("seed", range(3))
def test_fold_does_not_depend_on_the_order_of_rows(spark, batch, seed):
    c, schema, heads, changes, marks = batch
    shuffled = random.Random(seed).sample(c, len(c))
    out = commit.folded(spark.createDataFrame(shuffled, schema).repartition(3), heads, changes, marks)
    assert rows(out.select("candidate_id", "outcome", "revision", "status", "commit_seq"), "candidate_id") == EXPECTED


def test_feed_has_no_gaps_after_a_fold(spark, batch):
    c, schema, heads, changes, marks = batch
    out = commit.change_rows(commit.folded(spark.createDataFrame(c, schema), heads, changes, marks))
    assert records.gaps(out, ["ns"]).collect() == [("a", 1, 40)]


def test_fifo_two_ways(spark, data):
    from palimpsest.sources.lens import lens

    outbox = lens(spark, data, "outbox").where("ns = 'ns1'")
    now = F.lit("2024-02-05").cast("timestamp_ntz")
    free = {r.outbox_id for r in queue.claimable(outbox, "ns1", now, 100).collect()}
    gate = {r.outbox_id for r in queue.gated(outbox).where(~F.col("blocked")).where(queue.due(now)).collect()}
    assert free == gate


def test_claims_are_repeatable(spark, data):
    from palimpsest.sources.lens import lens

    outbox = lens(spark, data, "outbox").limit(5)
    lease = F.lit("2024-02-06").cast("timestamp_ntz")
    assert rows(queue.claims(outbox, "w", lease), "outbox_id") == rows(queue.claims(outbox, "w", lease), "outbox_id")


def test_sticky_record(spark):
    w = spark.createDataFrame([("r", 1, None), ("r", 2, "m"), ("r", 3, None), ("s", 1, None), ("s", 2, None)], "record_id string, seq long, canonical_id string")
    assert rows(receipts.sticky(w), "record_id") == [("r", 2, "m"), ("s", 2, None)]


def test_outcomes_sum_to_units(spark, data):
    from palimpsest.sources.lens import lens

    out = receipts.outcome_totals(lens(spark, data, "curation"), ["policy"])
    assert all(sum(r[o] for o in receipts.OUTCOMES) == r.units for r in out.collect())


def test_status_moves(spark):
    s = "insight_id string, status string"
    before = spark.createDataFrame([("a", "pending"), ("b", "accepted"), ("c", "rejected"), ("d", "accepted")], s)
    after = spark.createDataFrame([("a", "rejected"), ("b", "superseded"), ("c", "accepted"), ("d", "pending")], s)
    assert [r.insight_id for r in review.status_moves(before, after).orderBy("insight_id").collect()] == ["c", "d"]


def test_windows():
    m = [("user", x) for x in "abcdef"]
    assert sessions.merged_windows([], m) == ("initial", m)
    assert sessions.merged_windows(m, m) == ("unchanged", m)
    assert sessions.merged_windows(m[:4], m[2:]) == ("merged", m)
    assert sessions.merged_windows(m[:2], m[3:])[0] == "disjoint"
    assert sessions.merged_windows([m[0], m[1], m[0]], [m[0]])[0] == "ambiguous"
    assert sessions.merged_windows([m[0], m[1], m[3]], [m[0], m[2], m[3]])[0] == "interleaved"
    assert sessions.merged_windows(m, m[2:4])[0] == "unchanged"


def test_chunks_fit(spark, data):
    from palimpsest.sources.lens import lens

    out = sessions.packed(sessions.normalized(lens(spark, data, "messages")), 300, 3)
    assert out.where("n_chars > 300 OR n_segments > 3").count() == 0


def test_transient_sessions(spark):
    s = "events array<struct<role:string,text:string,tool:string>>"
    cases = [([("user", "Hello!", None), ("assistant", "Hi, a long answer", None)], True), ([("user", "I moved to Oslo", None)], False), ([("user", "ok", "shell")], False), ([("assistant", "x", None)], False), ([("user", "please continue", None), ("user", "謝謝。", None)], True)]
    df = spark.createDataFrame([(c,) for c, _ in cases], s).coalesce(1)
    assert [r[0] for r in df.select(sessions.transient_only()).collect()] == [t for _, t in cases]


def test_injected_parts(spark):
    df = spark.createDataFrame([(["<environment_context>x", " real "],), (["a", "b"],), (["# AGENTS.md"],)], "p array<string>").coalesce(1)
    assert [r[0] for r in df.select(sessions.own_input(F.col("p"))).collect()] == ["real", None, None]


def test_graph_edges_have_a_reverse(spark, data):
    from palimpsest.plans.catalog import QUERIES

    e = {tuple(r) for r in QUERIES["graph_edges"](spark, data).select("src", "type", "dst").collect()}
    other = {"derived_from": "supports", "supports": "derived_from"}
    assert all((d, other.get(t, t), s) in e for s, t, d in e)


def test_long_title(spark):
    df = spark.createDataFrame([("x" * 80,), ("One. Two",), ("  ",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(graph.title(F.col("t"), "none")).collect()] == ["x" * 69 + "…", "One", "none"]


def test_ingest_finds_problems(spark):
    c = spark.createDataFrame(
        [("a", None, None, "create", None, "x", 0.5, None), ("a", "m1", None, "update", None, "x", 0.5, None), ("a", None, None, "supersede", None, "x", 0.5, None), ("a", None, None, "create", None, " ", 0.5, None), ("a", None, None, "create", None, "x", 1.5, None)],
        "ns string, memory_id string, semantic_key string, op string, base_revision long, text string, confidence double, memory_type string",
    ).withColumns({"valid_from": F.lit(None).cast("timestamp"), "valid_until": F.lit(None).cast("timestamp")})
    bases = spark.createDataFrame([("m1", "key", "event")], "memory_id string, semantic_key string, memory_type string")
    out = commit.ingested(c.coalesce(1), bases).select("op", "problem", "semantic_key").collect()
    assert sorted((r.op, str(r.problem)) for r in out) == [("create", "None"), ("create", "confidence"), ("create", "text"), ("supersede", "operation"), ("update", "mutation_without_base")]
    assert all(r.semantic_key.startswith(("exact:sha256:", "key")) for r in out)


def brute_alignments(a, b):
    """All longest ordered alignments as sets of pairs."""

    def below(i, j):
        if i == len(a) or j == len(b):
            return {()}
        both = {((i, j), *rest) for rest in below(i + 1, j + 1)} if a[i] == b[j] else set()
        return below(i + 1, j) | below(i, j + 1) | both

    found = below(0, 0)
    return {x for x in found if len(x) == max(map(len, found))}


def test_alignments_and_placements_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(1, 6))] for _ in range(2))
        ways, pairs = sessions.alignments(a, b)
        assert ways == len(brute_alignments(a, b)) and tuple(pairs) in brute_alignments(a, b)
        laid = [k for k in range(1 - len(b), len(a)) if all(a[i] == b[i - k] for i in range(max(0, k), min(len(a), k + len(b))))]
        assert sessions.placements(a, b) == laid


def test_a_long_window_is_an_outcome(spark):
    rows = [(1, 0, i, "user", f"m{i}") for i in range(3)] + [(1, 1, i, "user", f"m{i}") for i in range(600)] + [(2, 1, 0, "user", "x")]
    out = sessions.published(spark.createDataFrame(rows, "session_id long, side int, pos long, role string, text string"))
    assert sorted(map(tuple, out.collect())) == [(1, "too_long", 3), (2, "initial", 1)]


def test_commit_outcomes_of_named_memories(spark):
    heads = spark.createDataFrame([("a", "m1", "k1", 2, "active", "fact"), ("b", "m2", "k2", 1, "active", "fact"), ("a", "m3", "k3", 1, "tombstoned", "fact")], "ns string, memory_id string, semantic_key string, revision long, status string, memory_kind string")
    c = [
        ("a", "k1", "c1", "m9", "update", 2, "fact", "not_found"), ("a", "k1", "c2", "m2", "update", 2, "fact", "scope_mismatch"), ("a", "k1", "c3", "m1", "update", 1, "fact", "conflict"), ("a", "k1", "c4", "m1", "update", 2, "habit", "identity_changed"),
        ("a", "k1", "c5", "m1", "restore", 2, "fact", "error"), ("a", "k1", "c6", "m1", "update", 2, "fact", "accepted"), ("a", "k3", "c7", "m3", "update", 1, "fact", "error"), ("a", "k3", "c8", "m3", "restore", 1, "fact", "accepted"), ("a", "k4", "c9", None, "update", 1, "fact", "not_found"),
    ]
    df = spark.createDataFrame([(*x[:7], x[2], i) for i, x in enumerate(c)], "ns string, semantic_key string, candidate_id string, memory_id string, op string, base_revision long, memory_kind string, idempotency_key string, created_at long")
    none = spark.createDataFrame([], "ns string, idempotency_key string")
    out = commit.folded(df, heads, none, spark.createDataFrame([("a", 7)], "ns string, high_water long"))
    got = {r.candidate_id: (r.outcome, r.commit_seq) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {x[2]: x[7] for x in c} and (got["c6"][1], got["c8"][1]) == (8, 9)


def test_a_fold_is_linear_in_a_key(spark):
    n = 30_000
    df = spark.range(n).select(F.lit("a").alias("ns"), F.lit("k").alias("semantic_key"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("candidate_id"), F.col("id").alias("created_at"), F.col("id").cast("string").alias("idempotency_key"), F.when(F.col("id") == 0, "create").otherwise("update").alias("op"), F.when(F.col("id") > 0, F.col("id")).alias("base_revision"))
    empty = lambda s: spark.createDataFrame([], s)
    out = commit.folded(df, empty("ns string, semantic_key string, revision long, status string"), empty("ns string, idempotency_key string"), empty("ns string, high_water long"))
    assert tuple(out.agg(F.max("revision"), F.max("commit_seq"), F.count_if(F.col("outcome") != "accepted")).first()) == (n, n, 0)


def test_retries():
    from palimpsest.functions.retry import retried

    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "done"

    assert retried(call, lambda e: isinstance(e, TimeoutError), sleep=waits.append) == "done" and waits == [0.25, 0.5]
    with pytest.raises(KeyError):
        retried(lambda: {}["x"], lambda e: isinstance(e, TimeoutError), sleep=waits.append)
    with pytest.raises(ValueError):
        retried(call, lambda e: True, attempts=4)


def test_reasons_name_concepts(spark):
    from palimpsest.functions.semantics import reason_codes

    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],)], "m array<string>").coalesce(1)
    codes = reason_codes(F.lit("preference"), F.lit("user"), F.lit("user_asserted"), F.lit("affirmative"), F.lit(False), F.col("m"))
    four = ["semantic:memory_type:preference", "semantic:speaker_provenance:user", "semantic:epistemic_status:user_asserted", "semantic:polarity:affirmative"]
    assert [r[0] for r in df.select(codes).collect()] == [four, [*four, "semantic:concept:a"], [*four, "semantic:concept_ambiguous:a,b"]]
