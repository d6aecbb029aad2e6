"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of the words by its weight, at most `most` times what it has. A document is
first taken floor(target / source size) whole times; the words left over are drawn by Pareto order
sampling: with u uniform from the document's id and p its inclusion probability, documents are ranked
by (u / (1 - u)) / (p / (1 - p)) and taken from the least until the words of the source are reached, so the
sample's size is fixed by its words. p falls with a document's length against its source's mean, so a single
giant does not use up what is left. One last document, the one nearest in length to the gap, closes it.

Scale: the text is read once and only (id, source, size) is kept, as a table in the shared folder. Cutting
a ranked source needs no sort of it: sizes are summed by bins of the rank that hold about BIN documents
each, and only the bin that the cut falls into is sorted. A hot source has more bins, not a larger one.

Null text has no words and null source is a source of its own, the last; documents without words are taken
with zero words; an id that repeats is ranked with equal odds and each row counts by itself; a null id is
hashed as the empty string. Equal odds are ranked by id, then size. A text is measured whole, however long; every
document has some odds, a giant against its source's mean the least. An empty table gives no rows. Extra columns pass through
repeated(), whatever their names. Windows over sources run in one task, over one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, saved, table, unused

#: Documents in a bin of ranks, about.
BIN = 4096
WEIGHTS = (5, 2, 1)
MOST = 3
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n, source_size -> also target: least(weight * level, most * source_size), level such that they sum to all words.

    sources has a row for each source, so its windows run over that many rows.
    """
    by_name, by_cap, all_rows = (
        Window.orderBy(F.col("source").isNull(), "source"),
        Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank")),
        Window.partitionBy(),
    )
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    cycle = F.array(*map(F.lit, weights))
    w = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * most)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("fixed", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("open_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", (F.sum("source_size").over(all_rows) - F.col("fixed")) / F.col("open_weight"))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    w = w.withColumn("level", F.max(F.when(fits, F.col("level"))).over(all_rows))
    target = F.when(F.col("cap") / F.col("weight") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return w.select("source", "n", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the id: 52 bits of its md5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def by_source(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """Joins on source, null included; right has a row for each source and is broadcast only if they were counted to be few."""
    right = right.withColumnRenamed("source", "source_")
    return left.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target (its source's), copies, taken = copies * size; content is a hash of its text."""
    sized = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("content"), F.monotonically_increasing_id().alias("row")), "sizes")
    sources = saved(source_targets(sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")), weights, most), "targets")
    few = sources.count() <= BROADCAST_ROWS // 10

    # Whole copies are certain; what is left of the target is the sample's size in words.
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = sources.withColumn("mean", F.greatest(F.lit(1), F.expr("source_size div n")))
    # Propensity: 1024 * mean / (mean + size), in integers so that its sums are exact, and 1 at least.
    d = by_source(sized, sources, few).withColumn("propensity", F.expr("greatest(1, (1024 * mean) div (mean + size))"))
    scale = saved(d.groupBy("source").agg(F.sum(F.col("propensity") * F.col("size")).alias("propensities")), "propensities")
    ratio = F.when(F.col("propensities") > 0, F.col("rest") / F.col("propensities")).otherwise(0.0)
    d = by_source(d, scale, few).withColumn("p", F.least(F.lit(1.0), ratio * F.col("propensity")))
    u = uniform(F.col("doc_id"), seed)
    d = d.withColumn("u", u).withColumn(
        "xi",
        F.when(F.col("p") >= 1.0, 0.0).when(F.col("p") <= 0.0, F.lit(float("inf"))).otherwise((F.col("u") / (1.0 - F.col("u"))) / (F.col("p") / (1.0 - F.col("p")))),
    )
    # Bins: the rank scaled by the odds of the source's mean probability is spread about evenly over (0, 1).
    mean_p = F.least(F.lit(0.999), F.greatest(F.lit(1e-9), F.col("rest") / F.greatest(F.col("source_size"), F.lit(1))))
    scaled = F.col("xi") * (mean_p / (1.0 - mean_p))
    even = F.when(F.col("xi") == float("inf"), 1.0).otherwise(scaled / (1.0 + scaled))
    d = d.withColumn("bin", F.least(F.expr(f"n div {BIN}"), F.floor(even * F.expr(f"1 + n div {BIN}")).cast("long")))
    bins = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.sum("bin_size").over(upto))
    # The first bin that passes the rest. A source whose bins never do is taken whole.
    cut = bins.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("cut"))
    d = by_source(d, saved(cut.select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before")), "cuts"), few)
    running = Window.partitionBy("source").orderBy("xi", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = d.where("bin = cut_bin").withColumn("drawn", F.col("before") + F.sum("size").over(running) <= F.col("rest"))
    outside = d.where("cut_bin IS NULL OR bin <> cut_bin").withColumn("drawn", F.expr("cut_bin IS NULL OR bin < cut_bin"))
    ranked = saved(inside.unionByName(outside).select("row", "doc_id", "source", "size", "content", "source_size", "target", "whole", "rest", "xi", "drawn"), "ranked")

    # The document not drawn that is nearest in size to what is still missing, if it brings the words nearer.
    gaps = ranked.groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    near = by_source(ranked.where("NOT drawn AND size > 0"), saved(gaps, "gaps"), few).where(off < F.col("gap"))
    closing = near.groupBy("source").agg(F.min(F.struct(off.alias("off"), "xi", "doc_id", "size", "row")).alias("best")).select("source", F.col("best.row").alias("closing"))
    out = by_source(ranked, saved(closing, "closing"), few)
    copies = F.col("whole") + F.when(F.col("drawn") | F.coalesce(F.col("row") == F.col("closing"), F.lit(False)), 1).otherwise(0)
    # A source at its cap has no rest; its documents of no words count as drawn and stay within the cap.
    out = out.withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "content", "row")


def op1(spark, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, the columns of docs unchanged.

    Rows of equal id, source and text are alike; the copies of all of them are dealt out among them evenly. Texts move once: the plan's
    numbers are dealt to where their rows are, and lead them in a window. Rows without an id are told apart by their texts.
    """
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    plan = mixed(docs, **options).groupBy("doc_id", "source", "content").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows"))
    row, source, key, content, every, rows, copies, copy = unused(docs, "row", "source", "key", "content", "all", "rows", "copies", "copy")
    of_docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.col(id_col).alias(key), F.col(source_col).alias(source), F.xxhash64(text_col).alias(content), F.lit(None).cast("long").alias(every), F.lit(None).cast("long").alias(rows))
    blank = F.lit(None).cast(of_docs.schema[row].dataType)
    of_plan = plan.select(blank.alias(row), F.col("doc_id").alias(key), F.col("source").alias(source), F.col("content").alias(content), F.col("all").alias(every), F.col("rows").alias(rows))
    # The plan's row is the first of its group; the rows behind it are numbered 2, 3, ...
    group = Window.partitionBy(key, source, content).orderBy(F.col(every).isNull())
    running = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = of_docs.unionByName(of_plan).select(row, F.first(every).over(running).alias(every), F.first(rows).over(running).alias(rows), (F.row_number().over(group) - 1).alias(copy))
    share = F.expr(f"`{every}` div `{rows}`") + F.when(F.col(copy) <= F.col(every) % F.col(rows), 1).otherwise(0)
    taken = both.where(F.col(row).isNotNull()).select(row, share.cast("int").alias(copies)).where(F.col(copies) > 0)
    return taken.select(row, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))


#: The mix in DuckDB's SQL, over a view documents; {documents} is the table.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, count(*)::BIGINT AS n, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, source_size * 3 AS cap, (ARRAY[5, 2, 1])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::BIGINT AS weight,
    row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT::DOUBLE AS own_level
  FROM weighted WINDOW before AS (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, max(CASE WHEN own_level <= cap::DOUBLE / weight THEN own_level END) OVER () AS level FROM levels
), targets AS (
  SELECT source, n, source_size, coalesce(CASE WHEN cap::DOUBLE / weight < level THEN cap::DOUBLE ELSE weight * level END, 0.0) AS target FROM leveled
), rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS whole, greatest(1, source_size // n) AS mean FROM targets
), d0 AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest, greatest(1, (1024 * r.mean) // (r.mean + s.size)) AS propensity,
    (('0x' || substr(md5('20240607:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
), d1 AS (
  SELECT *, sum(propensity * size) OVER (PARTITION BY source)::BIGINT AS propensities FROM d0
), d2 AS (
  SELECT *, least(1.0::DOUBLE, (CASE WHEN propensities > 0 THEN rest / propensities ELSE 0.0 END) * propensity) AS p FROM d1
), d3 AS (
  SELECT *, CASE WHEN p >= 1.0 THEN 0.0 WHEN p <= 0.0 THEN 'inf'::DOUBLE ELSE (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS xi FROM d2
), d4 AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY xi, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS drawn, row_number() OVER () AS rw FROM d3
), gaps AS (
  SELECT source, any_value(rest) - coalesce(sum(size) FILTER (drawn), 0)::BIGINT AS gap FROM d4 GROUP BY source
), closing AS (
  SELECT rw FROM (
    SELECT d4.rw, row_number() OVER (PARTITION BY d4.source ORDER BY abs(size - gap), xi, doc_id, size) AS k
    FROM d4 JOIN gaps g ON d4.source IS NOT DISTINCT FROM g.source WHERE NOT drawn AND size > 0 AND abs(size - gap) < gap
  ) WHERE k = 1
)
SELECT doc_id, size, source_size, target, (least(3, whole + CASE WHEN drawn OR rw IN (SELECT rw FROM closing) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM d4
"""
