"""Rules that tables must keep, as one table of what breaks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _repeated(rule: str, df: DataFrame, *keys: str) -> DataFrame:
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.select(F.lit(rule).alias("rule"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("key"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def _broken(rule: str, df: DataFrame, key: str, test: str) -> DataFrame:
    return df.where(test).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(test).alias("detail"))


def violations(heads: DataFrame, changes: DataFrame, revisions: DataFrame) -> DataFrame:
    """rule, key, detail: repeated keys and sequence numbers, reversed validity, revisions that do not begin with a create."""
    parts = [
        _repeated("unique_key", heads, "ns", "semantic_key"),
        _repeated("unique_sequence", changes, "ns", "commit_seq"),
        _broken("validity", revisions, "memory_id", "valid_until < valid_from"),
        _broken("base_revision", revisions, "memory_id", "(op = 'create') <> (revision = 1)"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lease_violations(outbox: DataFrame) -> DataFrame:
    """PROCESSING rows have worker, token and lease; others have none."""
    held = "(claimed_by IS NOT NULL AND token IS NOT NULL AND lease_until IS NOT NULL)"
    some = "(claimed_by IS NOT NULL OR token IS NOT NULL OR lease_until IS NOT NULL)"
    return _broken("lease", outbox, "outbox_id", f"(status = 'PROCESSING' AND NOT {held}) OR (status <> 'PROCESSING' AND {some})")


def receipt_violations(receipts: DataFrame) -> DataFrame:
    return _broken("decision_count", receipts, "receipt_id", "decisions > units")


def schema_problems(df: DataFrame, needed: dict[str, str]) -> list[str]:
    """Columns that are missing or of another type; checked on the schema alone."""
    have = dict(df.dtypes)
    return [f"{c}: {'missing' if c not in have else have[c]}" for c, t in needed.items() if have.get(c) != t]
