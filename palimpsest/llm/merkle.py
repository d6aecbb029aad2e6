"""Merkle fingerprints of texts: pieces, paragraphs, sections, root. DataFrame functions only.

A section is up to 16 lines, or fewer before a blank line; a paragraph is a line; a leaf is a piece of a paragraph that ends
a sentence or has 32 characters. Every cut keeps all characters, so equal roots mean equal texts, and branches
that differ show where two texts do. A fingerprint is written as

    root sha-256, blank, sections joined by ";", each: hash "/" paragraphs joined by ",", each: hash ":" leaf hashes joined by "."

with the first eight digits of the branches' md5. The likeness of two fingerprints is 1 for equal roots, else the Dice
coefficient of their distinct leaves.

Null texts count as empty; an empty text has no leaves. Rows of equal id are ordered by text; a row without an id has no place
in the order and is its own next one, as a single row is. Equal texts have equal fingerprints, so rows that repeat have too. A text
is fingerprinted whole, in time linear in its length. An empty table gives no rows. Extra columns are not read; with_next passes them
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, table, unused

SECTION = r"(?:[^\n]++\n?+){1,16}\n*+|\n++"
PARAGRAPH = r"[^\n]++\n*+|\n++"
LEAF = r"[^.!?\n]{1,32}+[.!?\n]*+|[.!?\n]++"
#: Neighbouring rows in one bucket, about; beyond 2**18 buckets they grow.
BUCKET = 512


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _tree(text: Column) -> Column:
    """Hashes of leaves by paragraph by section."""
    leaves = lambda p: F.transform(_all(p, LEAF), lambda x: F.md5(x))
    return F.transform(_all(text, SECTION), lambda s: F.transform(_all(s, PARAGRAPH), leaves))


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of a column that has no nulls."""
    tree, pars_, sections_ = unused(df, "tree", "pars", "sections")
    short = lambda h: F.substring(h, 1, 8)
    df = df.withColumn(tree, _tree(F.col(text)))
    # (hash, written form) of each paragraph, then of each section.
    pars = F.transform(tree, lambda s: F.transform(s, lambda p: F.struct(F.md5(F.array_join(p, "")).alias("h"), F.array_join(F.transform(p, short), ".").alias("w"))))
    df = df.withColumn(pars_, pars)
    sections = F.transform(
        pars_,
        lambda s: F.struct(F.md5(F.array_join(s["h"], "")).alias("h"), F.array_join(F.transform(s, lambda p: F.concat(short(p["h"]), F.lit(":"), p["w"])), ",").alias("w")),
    )
    df = df.withColumn(sections_, sections)
    root = F.sha2(F.array_join(F.col(sections_)["h"], ""), 256)
    written = F.array_join(F.transform(sections_, lambda s: F.concat(short(s["h"]), F.lit("/"), s["w"])), ";")
    return df.withColumn(out, F.concat(root, F.lit(" "), written)).drop("__tree", pars_, "__sections")


def leaves(fingerprint: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fingerprint, F.lit(r"[:.]([0-9a-f]{8})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    x, y = leaves(a), leaves(b)
    dice = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(dice)


def edits(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: struct(at, old, new): after `at` paragraphs that both begin with, `old` of a are replaced by `new` of b, and the rest is the same.

    at is null if their roots are equal. A paragraph that is put in moves none of the others. Several edits are told as the range of them all.
    """
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    # A branch of a paragraph is followed by a colon.
    pars = lambda f: F.regexp_extract_all(f, F.lit(r"([0-9a-f]{8}):"), F.lit(1))
    of = F.struct(pars(a).alias("x"), pars(b).alias("y"))

    def alike(x: Column, y: Column) -> Column:
        """Elements that two arrays begin with alike; zipping pads the shorter with nulls."""
        unlike = F.transform(F.arrays_zip(x.alias("p"), y.alias("q")), lambda z: ~z["p"].eqNullSafe(z["q"]))
        first = F.array_position(unlike, True)
        return F.when(first > 0, first - 1).otherwise(F.greatest(F.size(x), F.size(y))).cast("int")

    # One-element arrays name what is used more than once, so that each is made once.
    head = F.transform(F.array(of), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), alike(s["x"], s["y"]).alias("head")))
    both = F.transform(
        head,
        lambda s: F.struct(
            s["head"].alias("head"),
            F.size(s["x"]).alias("n"),
            F.size(s["y"]).alias("m"),
            F.least(alike(F.reverse(s["x"]), F.reverse(s["y"])), F.least(F.size(s["x"]), F.size(s["y"])) - s["head"]).alias("tail"),
        ),
    )
    found = F.transform(both, lambda s: F.struct(s["head"].alias("at"), (s["n"] - s["head"] - s["tail"]).alias("old"), (s["m"] - s["head"] - s["tail"]).alias("new")))
    none = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("old"), F.lit(0).alias("new"))
    return F.when(same, none).otherwise(F.element_at(found, 1))


def _upto(bounds: Column, key: Column, steps: int) -> Column:
    """How many of the sorted bounds (2**steps - 1 of them) do not exceed the key, by binary search."""
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(steps)))) if steps else F.array().cast("array<int>")
    return F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.element_at(bounds, at + half) <= key, half).otherwise(0))


def _bounds(key: Column, steps: int) -> Column:
    """2**steps - 1 bounds that cut a key into parts of about equal numbers of rows."""
    n = 1 << steps
    return F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n) if steps else F.array().cast("array<bigint>")


def with_next(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """rows with next_<column> of the next row by key, then order; the first row's after the last. A row with a null key has no neighbours and is its own next.

    Rows are dealt into buckets of neighbouring keys, each sorted by itself; the first rows of a bucket are also
    sent, marked, to the end of the bucket before. So nothing is sorted in one task, and each row moves once. Buckets hold
    about BUCKET rows each, however keys lie: their bounds are quantiles of the keys (quantiles of all, then of what lies between two of
    them), found by reading the keys alone. Rows of one key are one bucket.
    """
    bucket, cell, fine, first, before, at, inner = unused(rows, "bucket", "cell", "fine", "first", "before", "at", "inner")
    keys = rows.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull())
    # Cells by buckets: at most 2**18 buckets, fewer than BROADCAST_ROWS.
    steps = min(9, max(0, ((keys.count() // BUCKET).bit_length() + 1) // 2))
    # One row, with at most 511 numbers; then one such row for each cell.
    outer = F.lit(keys.agg(_bounds(F.col(key), steps)).first()[0] or []).cast("array<bigint>")
    with_cell = lambda df: df.withColumn(cell, _upto(outer, F.col(key).cast("long"), steps))
    parts = saved(with_cell(keys).groupBy(cell).agg(_bounds(F.col(key), steps).alias(inner)), "bucket-bounds")

    def numbered(df: DataFrame) -> DataFrame:
        number = F.col(cell) * (1 << steps) + F.coalesce(_upto(F.col(inner), F.col(key).cast("long"), steps), F.lit(0))
        return with_cell(df).join(F.broadcast(parts), cell, "left").withColumn(bucket, number.cast("long")).drop(cell, inner)

    firsts = numbered(keys).groupBy(bucket).agg(F.min(key).alias(first))
    ring = Window.orderBy(bucket)
    # A row for each bucket.
    last = F.coalesce(F.lag(bucket).over(ring), F.max(bucket).over(Window.partitionBy()))
    firsts = saved(firsts.select(F.col(bucket).alias(fine), first, last.alias(before)), "bucket-firsts")
    # Rows without a key lie anywhere.
    apart = F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(*order), F.lit(1 << 18))).otherwise(F.col(bucket))
    placed = numbered(rows).withColumn(bucket, apart)
    placed = placed.join(F.broadcast(firsts), (F.col(bucket) == F.col(fine)) & (F.col(key) == F.col(first)), "left")
    place = lambda b, m: F.struct(b.alias("bucket"), F.lit(m).alias("marked"))
    ends = F.when(F.col(before).isNotNull(), F.array(place(F.col(bucket), 0), place(F.col(before), 1))).otherwise(F.array(place(F.col(bucket), 0)))
    placed = placed.withColumn(at, F.explode(ends)).drop(first, before, fine, bucket)
    in_bucket = Window.partitionBy(f"{at}.bucket").orderBy(f"{at}.marked", key, *order)
    following = {f"next_{c}": F.when(F.col(key).isNull(), F.col(c)).otherwise(F.lead(c).over(in_bucket)) for c in columns}
    return placed.withColumns(following).where(F.col(f"{at}.marked") == 0).drop(at)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its fingerprint, that of its edited text (the second half from the next document), likenesses, and where the edit lies.

    edit_at, edit_old, edit_new: see edits().
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(fingerprinted(rows, "text", "fingerprint"), "doc_id", ["text"], ["text", "fingerprint"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = fingerprinted(rows.drop("text", "next_text"), "edited", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        edits(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edit"),
    ).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.col("edit.at").alias("edit_at"), F.col("edit.old").alias("edit_old"), F.col("edit.new").alias("edit_new"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
