"""Records, revisions and their ordered change feed.

A record is a memory_id in a scope (here ns); its revisions are rows (memory_id, revision), never changed, each with the
commit_seq of its scope's feed. The head of a record is its row of the highest revision.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.fixed import SYNC_PAGE


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first by order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def heads(revisions: DataFrame) -> DataFrame:
    """One row a record: that of its highest revision. A partial aggregate, so nothing is sorted."""
    rest = [c for c in revisions.columns if c != "memory_id"]
    best = revisions.groupBy("memory_id").agg(F.max_by(F.struct(*rest), "revision").alias("head"))
    return best.select("memory_id", *(F.col(f"head.{c}").alias(c) for c in rest))


def current_revisions(head_rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """Heads (memory_id, current_revision) with the revision that each points to."""
    return head_rows.join(revisions, (head_rows["memory_id"] == revisions["memory_id"]) & (head_rows["current_revision"] == revisions["revision"])).drop(revisions["memory_id"])


def sequenced(accepted: DataFrame, high_water: DataFrame, scope: list[str], *order: str) -> DataFrame:
    """accepted rows with the commit_seq that follows their scope's high-water mark, in order."""
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    marks = high_water.select(*scope, F.col("high_water").alias("__mark"))
    return accepted.join(marks, scope, "left").withColumn("commit_seq", F.coalesce("__mark", F.lit(0)) + place).drop("__mark")


def high_water(changes: DataFrame, scope: list[str]) -> DataFrame:
    return changes.groupBy(*scope).agg(F.coalesce(F.max("commit_seq"), F.lit(0)).alias("high_water"))


def numbered(mutations: DataFrame) -> DataFrame:
    """Revision numbers of mutations in the order in which they were committed."""
    return mutations.withColumn("revision", F.row_number().over(Window.partitionBy("memory_id").orderBy("commit_seq")).cast("long"))


def gaps(changes: DataFrame, scope: list[str], width: int = 65_536) -> DataFrame:
    """Ranges of commit_seq that a scope's feed lacks, from 1 up to its last.

    Numbers are looked at in stretches of width, so that a large scope is many tasks; what a stretch begins behind is the last number of the stretch
    before it, of one row a stretch.
    """
    rows = changes.withColumn("__stretch", F.expr(f"commit_seq div {width}"))
    ends = rows.groupBy(*scope, "__stretch").agg(F.max("commit_seq").alias("__last"))
    ends = ends.withColumn("__behind", F.lag("__last").over(Window.partitionBy(*scope).orderBy("__stretch"))).drop("__last")
    inner = F.lag("commit_seq").over(Window.partitionBy(*scope, "__stretch").orderBy("commit_seq"))
    rows = rows.withColumn("__before", inner).where("__before IS NULL OR commit_seq > __before + 1").join(ends, [*scope, "__stretch"])
    rows = rows.withColumn("__before", F.coalesce("__before", "__behind", F.lit(0)))
    return rows.where("commit_seq > __before + 1").select(*scope, (F.col("__before") + 1).alias("gap_from"), (F.col("commit_seq") - 1).alias("gap_to"))


def after(key: list[str], values: list) -> Column:
    """Rows behind a composite key: later in the first key that differs."""
    tests = [reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(key[:i], values[:i])], F.col(key[i]) > F.lit(values[i])) for i in range(len(key))]
    return reduce(lambda a, b: a | b, tests)


def page(df: DataFrame, key: list[str], cursor: list | None, size: int) -> DataFrame:
    """Up to size rows behind the cursor in order of the key, with has_more. One row more is read to know.

    The key has to tell all rows apart, or a page is any of those that tie, and the next loses the rest of them. A cursor of its first columns only is
    behind all rows that begin so.
    """
    rows = (df.where(after(key[: len(cursor)], cursor)) if cursor else df).orderBy(*key).limit(size + 1)
    place, all_rows = F.row_number().over(Window.orderBy(*key)), F.count(F.lit(1)).over(Window.partitionBy())
    # The windows run over one page.
    return rows.withColumns({"__place": place, "has_more": all_rows > size}).where(F.col("__place") <= size).drop("__place")


def changes_after(changes: DataFrame, ns: str, commit_seq: int, size: int) -> DataFrame:
    """A page of a scope's feed; every row tells whether the feed is gapless up to it."""
    if not 1 <= size <= SYNC_PAGE:
        raise ValueError(f"a page has 1 to {SYNC_PAGE} rows")
    rows = page(changes.where(F.col("ns") == ns), ["commit_seq"], [commit_seq], size)
    place = F.row_number().over(Window.orderBy("commit_seq"))
    return rows.withColumn("gapless", F.col("commit_seq") - place == commit_seq)


def hydrated(requests: DataFrame, revisions: DataFrame) -> DataFrame:
    """Requests (pos, memory_id, revision), repeats allowed, each with its revision's columns or nulls."""
    return requests.join(revisions, ["memory_id", "revision"], "left")


def valid_at(revisions: DataFrame, at: Column) -> DataFrame:
    """Rows valid at a time: bounds are inclusive, null is open."""
    return revisions.where(F.coalesce(F.col("valid_from") <= at, F.lit(True)) & F.coalesce(F.col("valid_until") >= at, F.lit(True)))


def change_proof(changes: DataFrame, revisions: DataFrame) -> DataFrame:
    """Changes whose revision is missing or has another payload hash."""
    r = revisions.select("memory_id", "revision", F.col("payload_hash").alias("__hash"))
    return changes.join(r, ["memory_id", "revision"], "left").where(~F.col("payload_hash").eqNullSafe(F.col("__hash"))).withColumn("problem", F.when(F.col("__hash").isNull(), "REVISION_MISSING").otherwise("PAYLOAD_HASH")).drop("__hash")


def acknowledged(acks: DataFrame, marks: DataFrame, step: int = SYNC_PAGE) -> DataFrame:
    """The applied sequence of every device after its acknowledgements (device_id, ns, pos, expected, applied), in order.

    One counts if it expects what was applied before it, goes on by 1 to step, and stays at or below the high-water mark.
    """
    rows = acks.join(marks, "ns", "left").groupBy("device_id", "ns").agg(F.array_sort(F.collect_list(F.struct("pos", "expected", "applied"))).alias("log"), F.first(F.coalesce("high_water", F.lit(0))).alias("mark"))
    ok = lambda at, a: (a["expected"] == at) & (a["applied"] > at) & (a["applied"] - at <= step) & (a["applied"] <= F.col("mark"))
    return rows.select("device_id", "ns", F.aggregate("log", F.lit(0).cast("long"), lambda at, a: F.when(ok(at, a), a["applied"]).otherwise(at)).alias("applied_seq"), (F.col("mark")).alias("high_water"))


def changes_at(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """Requests (pos, ns, commit_seq), repeats allowed, each with its change's columns or nulls."""
    return requests.join(changes, ["ns", "commit_seq"], "left")


def hydrated_with_evidence(requests: DataFrame, revisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Requests with their revision's columns and its evidence (memory_id, revision, pos, source_type, source_ref) as an array in order."""
    refs = evidence.groupBy("memory_id", "revision").agg(F.array_sort(F.collect_list(F.struct("pos", "source_type", "source_ref"))).alias("evidence"))
    return hydrated(requests, revisions).join(refs, ["memory_id", "revision"], "left")
