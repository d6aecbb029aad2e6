"""Verification of ranked candidates against current records, and views over several scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.fixed import TOP_K_LIMIT
from palimpsest.functions.semantics import first_of

ALLOW = "ALLOW"
#: Ids that are sent to all tasks at once, at most.
BROADCAST_IDS = 500_000


def of_requests(revisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Revisions of the memories that are asked for, so that heads are made of these alone. Ids are broadcast if they are counted to be few."""
    ids = requests.select("memory_id").distinct()
    few = ids.count() <= BROADCAST_IDS
    return revisions.join(F.broadcast(ids) if few else ids, "memory_id", "left_semi")


def decided(requests: DataFrame, heads: DataFrame, revisions: DataFrame, ns: Column, at: Column, later_heads: DataFrame | None = None) -> DataFrame:
    """requests (memory_id, expected_revision, ...) with decision: ALLOW or the first reason that suppresses.

    heads: memory_id, ns, status, current_revision. revisions: memory_id, revision, intact, valid_from, valid_until. later_heads are the heads as
    they are read once more at the end: what was allowed by a head that is another by then is HEAD_CHANGED.
    """
    h = heads.select("memory_id", F.col("ns").alias("__ns"), F.col("status").alias("__status"), F.col("current_revision").alias("__revision"))
    r = revisions.select("memory_id", F.col("revision").alias("__revision"), F.col("intact").alias("__intact"), F.col("valid_from").alias("__from"), F.col("valid_until").alias("__until"), F.lit(True).alias("__known"))
    found = requests.join(h, "memory_id", "left").join(r, ["memory_id", "__revision"], "left")
    moved = F.lit(False)
    if later_heads is not None:
        found = found.join(later_heads.select("memory_id", F.struct("ns", "status", "current_revision").alias("__later")), "memory_id", "left")
        moved = ~F.col("__later").eqNullSafe(F.struct(F.col("__ns").alias("ns"), F.col("__status").alias("status"), F.col("__revision").alias("current_revision")))
    decision = first_of(
        [
            (F.col("__status").isNull(), "NOT_FOUND"),
            (F.col("__ns") != ns, "SCOPE_MISMATCH"),
            (F.col("__status") == "tombstoned", "TOMBSTONED"),
            (F.col("__status") == "superseded", "SUPERSEDED"),
            (F.col("expected_revision") != F.col("__revision"), "REVISION_MISMATCH"),
            (F.col("__known").isNull(), "REVISION_MISSING"),
            (~F.coalesce("__intact", F.lit(False)), "REVISION_INTEGRITY"),
            (F.coalesce(F.col("__from") > at, F.lit(False)), "NOT_YET_VALID"),
            (F.coalesce(F.col("__until") < at, F.lit(False)), "NO_LONGER_VALID"),
            (moved, "HEAD_CHANGED"),
        ],
        ALLOW,
    )
    return found.withColumn("decision", decision).select(*requests.columns, "decision")


def first_hits(candidates: DataFrame) -> DataFrame:
    """The best-ranked row of each memory_id, and whether its rows claim different revisions."""
    by = Window.partitionBy("memory_id")
    rows = candidates.withColumns({"disputed": F.min("claimed_revision").over(by) != F.max("claimed_revision").over(by), "__place": F.row_number().over(by.orderBy("rank"))})
    return rows.where("__place = 1").drop("__place")


def best_claims(hits: DataFrame, top_k: int) -> DataFrame:
    """The highest claimed revision of each memory at its first rank, top_k of them. Claims without an id or a positive revision are dropped."""
    good = hits.where("memory_id IS NOT NULL AND length(memory_id) <= 132 AND claimed_revision >= 1")
    best = good.groupBy("memory_id").agg(F.max("claimed_revision").alias("claimed_revision"), F.min("rank").alias("first_rank"))
    return best.orderBy("first_rank", "memory_id").limit(top_k)


def counted(decisions: DataFrame) -> DataFrame:
    """reason, n: suppressed rows by reason."""
    return decisions.where(F.col("decision") != ALLOW).groupBy(F.col("decision").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def retrieved(hits: DataFrame, heads: DataFrame, revisions: DataFrame, ns: Column, at: Column, top_k: int) -> DataFrame:
    """The verified part of a provider's ranking: allowed rows by rank, at most top_k."""
    if not 0 <= top_k <= TOP_K_LIMIT:
        raise ValueError(f"top_k is 0 to {TOP_K_LIMIT}")
    requests = first_hits(hits).withColumn("expected_revision", F.col("claimed_revision"))
    allowed = decided(requests, heads, revisions, ns, at).where(F.col("decision") == ALLOW)
    return allowed.orderBy("rank", "memory_id").limit(top_k)


def federated(primary: DataFrame, mounted: DataFrame, primary_heads: DataFrame, top_k: int) -> DataFrame:
    """One view of a primary ranking and mounted ones: (pos, ns, memory_id, rank, semantic_key, outcome).

    primary and mounted have (mount, pos, memory_id, rank, semantic_key); mount 0 is the primary. primary_heads has
    (semantic_key, memory_id, allowed). What has the key of a primary record gives way to it: VIEW_PRIMARY_SUPPRESSION if that
    is not allowed, VIEW_PRIMARY_OVERRIDE if it was shown already, else the primary record is shown at the mount's
    rank. Repeats are VIEW_DUPLICATE. What is shown is sorted by rank, then order, and cut: VIEW_TOP_K.
    """
    mine = primary_heads.select("semantic_key", F.col("memory_id").alias("__own"), F.col("allowed").alias("__allowed"))
    rows = primary.unionByName(mounted).join(mine, "semantic_key", "left")
    over = (F.col("mount") > 0) & F.col("__own").isNotNull()
    shown_id = F.when(over, F.col("__own")).otherwise(F.col("memory_id"))
    rows = rows.withColumns({"shown_id": shown_id, "__blocked": over & ~F.col("__allowed"), "__over": over})
    earlier = Window.partitionBy("shown_id").orderBy(F.col("__blocked").cast("int"), "mount", "pos")
    rows = rows.withColumn("__first", (F.row_number().over(earlier) == 1) & ~F.col("__blocked"))
    outcome = first_of([(F.col("__blocked"), "VIEW_PRIMARY_SUPPRESSION"), (F.col("__first"), "SHOWN"), (F.col("__over"), "VIEW_PRIMARY_OVERRIDE")], "VIEW_DUPLICATE")
    rows = rows.withColumn("outcome", outcome)
    # Only shown rows are ranked; the cut needs no more than top_k of them.
    top = rows.where("outcome = 'SHOWN'").orderBy("rank", "mount", "pos").limit(top_k).select("mount", "pos", F.lit(True).alias("__kept"))
    rows = rows.join(F.broadcast(top), ["mount", "pos"], "left")  # at most top_k rows
    outcome = F.when((F.col("outcome") == "SHOWN") & F.col("__kept").isNull(), "VIEW_TOP_K").otherwise(F.col("outcome"))
    return rows.select("mount", "pos", "rank", "semantic_key", "shown_id", outcome.alias("outcome"))


def shadowed(primary: DataFrame, mounted: DataFrame) -> DataFrame:
    """Mounted rows whose semantic key the primary has, with the record that shadows them."""
    return mounted.join(primary.select("semantic_key", F.col("memory_id").alias("shadowed_by")), "semantic_key")
