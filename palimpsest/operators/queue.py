"""The outbox: claims in order of each record's revisions, fenced settlement, delivery events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.canon import canonical_json, joined_id, sha256_of
from palimpsest.functions.fixed import CLAIM_LIMIT


def due(now: Column) -> Column:
    """Rows that may be claimed by themselves."""
    waiting = F.col("status").isin("PENDING", "FAILED") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    return waiting | ((F.col("status") == "PROCESSING") & (F.col("lease_until") <= now))


def gated(outbox: DataFrame) -> DataFrame:
    """outbox with blocked: whether an earlier revision of the record is unfinished."""
    earlier = Window.partitionBy("memory_id").orderBy("revision").rangeBetween(Window.unboundedPreceding, -1)
    return outbox.withColumn("blocked", F.coalesce(F.max((F.col("status") != "DONE").cast("int")).over(earlier), F.lit(0)) == 1)


def claimable(outbox: DataFrame, ns: str, now: Column, limit: int) -> DataFrame:
    if not 1 <= limit <= CLAIM_LIMIT:
        raise ValueError(f"a claim has 1 to {CLAIM_LIMIT} rows")
    # A row is free if none of its record's unfinished revisions comes before it: one least revision a record, by a partial aggregate.
    first = outbox.where("status <> 'DONE'").groupBy("memory_id").agg(F.min("revision").alias("__first"))
    free = outbox.where((F.col("ns") == ns) & due(now)).join(first, "memory_id").where(F.col("revision") <= F.col("__first")).select(*outbox.columns)
    return free.orderBy("created_at", "outbox_id").limit(limit)


def claims(rows: DataFrame, worker: str, lease_until: Column) -> DataFrame:
    """Claim events of claimable rows; the token is derived, so a repeated claim is the same."""
    token = joined_id("lease_", F.col("outbox_id"), F.lit(worker), lease_until.cast("string"), length=32)
    return rows.select("outbox_id", F.lit("PROCESSING").alias("status"), F.lit(worker).alias("claimed_by"), token.alias("token"), lease_until.alias("lease_until"))


def settled(outbox: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """outbox after results (outbox_id, worker, token, all_current, error): status, and accepted by the fence.

    A result counts only under the row's own worker and token while its lease runs. DONE needs no error and only current
    materializations.
    """
    r = results.select("outbox_id", F.col("worker").alias("__worker"), F.col("token").alias("__token"), "all_current", "error")
    fence = (F.col("status") == "PROCESSING") & (F.col("claimed_by") == F.col("__worker")) & (F.col("token") == F.col("__token")) & (F.col("lease_until") > now)
    accepted = F.coalesce(fence, F.lit(False))
    status = F.when(~accepted, F.col("status")).when(F.col("error").isNull() & F.col("all_current"), "DONE").otherwise("FAILED")
    rows = outbox.join(r, "outbox_id", "left").withColumns({"accepted": accepted, "new_status": status})
    return rows.drop("__worker", "__token")


def materialized(states: DataFrame) -> DataFrame:
    """Materialization of every (provider, memory_id): revisions never go back; only CURRENT outcomes move the materialized one."""
    return states.groupBy("provider", "memory_id").agg(
        F.max("canonical_revision").alias("canonical_revision"),
        F.max(F.when(F.col("outcome") == "CURRENT", F.col("canonical_revision"))).alias("materialized_revision"),
        F.max_by("outcome", "settled_at").alias("status"),
    )


def events(outbox: DataFrame, changes: DataFrame) -> DataFrame:
    """Delivery events of work items: DELETE for tombstones, else UPSERT."""
    item = outbox.join(changes.select("memory_id", "revision", "op", "commit_seq"), ["memory_id", "revision"])
    kind = F.when(F.col("op") == "tombstone", "DELETE").otherwise("UPSERT")
    return item.select(joined_id("evt_", F.col("outbox_id"), F.col("commit_seq").cast("string"), length=32).alias("event_id"), "outbox_id", "memory_id", "revision", "commit_seq", kind.alias("kind"))


def receipt_problems(receipts: DataFrame, sent: DataFrame) -> DataFrame:
    """Receipts that do not answer their event: unknown event, other record, other revision, or a status that is none."""
    e = sent.select("event_id", F.col("memory_id").alias("__memory"), F.col("revision").alias("__revision"))
    problem = (
        F.when(F.col("__memory").isNull(), "UNKNOWN_EVENT")
        .when(F.col("memory_id") != F.col("__memory"), "MEMORY")
        .when(F.col("revision") != F.col("__revision"), "REVISION")
        .when(~F.col("status").isin("CURRENT", "STALE", "FAILED", "DELETED"), "STATUS")
    )
    return receipts.join(e, "event_id", "left").withColumn("problem", problem).where("problem IS NOT NULL").drop("__memory", "__revision")


def event_payload_hash() -> Column:
    return sha256_of(canonical_json(memoryId=F.col("memory_id"), revision=F.col("revision"), kind=F.col("kind")))
