"""Summaries of a scope's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.validate import schema_problems


def device_lag(devices: DataFrame, marks: DataFrame) -> DataFrame:
    """devices (device_id, ns, applied) with the mark of their scope and how far they are behind it."""
    lag = F.greatest(F.col("high_water") - F.col("applied"), F.lit(0))
    return devices.join(marks, "ns", "left").withColumn("high_water", F.coalesce("high_water", F.lit(0))).withColumn("lag", F.coalesce(lag, F.lit(0)))


def _n(**tests: str) -> list:
    return [F.count_if(F.expr(test)).alias(name) for name, test in tests.items()]


def summary(heads: DataFrame, outbox: DataFrame, materializations: DataFrame, devices: DataFrame, changes: DataFrame, ns: str) -> DataFrame:
    """One row of counts for a scope, each table read once."""
    h = heads.where(F.col("ns") == ns)
    head_counts = h.agg(*_n(active="status = 'active'", tombstoned="status = 'tombstoned'"), F.count(F.lit(1)).alias("memories"))
    queue = outbox.where(F.col("ns") == ns).agg(*_n(pending="status = 'PENDING'", processing="status = 'PROCESSING'", failed="status = 'FAILED'", done="status = 'DONE'"))
    # Materializations have no scope of their own.
    views = materializations.join(h.select("memory_id"), "memory_id").agg(*_n(current="status = 'CURRENT'", stale="status = 'STALE'", broken="status = 'FAILED'"))
    mark = changes.where(F.col("ns") == ns).agg(F.coalesce(F.max("commit_seq"), F.lit(0)).alias("high_water"))
    applied = devices.where(F.col("ns") == ns).agg(F.count(F.lit(1)).alias("devices"), F.min("applied").alias("__least"))
    row = head_counts.crossJoin(queue).crossJoin(views).crossJoin(mark).crossJoin(applied)  # one row each
    worst = F.coalesce(F.greatest(F.col("high_water") - F.col("__least"), F.lit(0)), F.lit(0))
    return row.withColumn("max_lag", worst).drop("__least")


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: rows of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select("name", F.col("n").alias("__before"))
    return after.join(b, "name", "full").select("name", (F.coalesce("n", F.lit(0)) - F.coalesce("__before", F.lit(0))).alias("delta"))


def inventory(heads: DataFrame, revisions: DataFrame) -> DataFrame:
    """Heads with the kind and time of their current revision, for paging by memory_id."""
    return heads.join(revisions, ["memory_id", "revision"])


#: Counters of a sync and the decisions that each counts.
SYNC_COUNTERS = {"ingested": "distill", "source_only": "source_only", "deferred": "defer", "no_textual_evidence": "no_textual_evidence", "unchanged": "unchanged"}


def sync_counters(decisions: DataFrame, by: list[str]) -> DataFrame:
    """scanned, changed and one counter a decision ("name" or "name:reason") of sources."""
    name = F.substring_index("decision", ":", 1)
    counts = [F.count_if(name == d).alias(c) for c, d in SYNC_COUNTERS.items()]
    return decisions.groupBy(*by).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(name != "unchanged").alias("changed"), *counts)


def migration_state(units: DataFrame) -> DataFrame:
    """migration, processed, ingested, skipped, cursor of units (migration, pos, outcome), and whether every processed unit is one of the two."""
    return units.groupBy("migration").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("outcome") == "ingested").alias("ingested"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.max("pos").alias("cursor"),
        F.bool_and(F.coalesce(F.col("outcome").isin("ingested", "skipped"), F.lit(False))).alias("consistent"),
    )


def ledger_counts(ledger: DataFrame) -> DataFrame:
    """name, n: how often each step of a ledger was run."""
    return ledger.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def readiness(tables: dict[str, DataFrame], needed: dict[str, dict[str, str]]) -> DataFrame:
    """table, state, problems: ready, missing or incompatible, by the schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, columns in needed.items():
        problems = schema_problems(tables[name], columns) if name in tables else []
        rows.append((name, "missing" if name not in tables else "incompatible" if problems else "ready", ", ".join(problems)))
    return spark.createDataFrame(rows, "table string, state string, problems string")
