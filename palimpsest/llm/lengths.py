"""Exact histogram of encoded lengths, from which every context limit is answered.

Documents are encoded where they lie and only (length, documents) leaves a task, summed again before one
row for each distinct length is kept. Sums from the longest down then give, for a limit equal to any length, how
many documents and tokens are at least that long and what is left when every document is cut at the limit.
Between two lengths that occur the answers are linear in the limit, so the table answers all limits.

Null and empty texts have length 0 (no end id unless asked for); a long text is encoded whole; rows that repeat count each; documents
of equal length are one row; an empty table gives no rows; no column but the text is read. The windows run in one task over a row for
each distinct length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import table
from .tokens import default_path, encoder
from .words import blocks


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = encoder(path), Counter()
        for whole in batches:
            for batch in blocks(whole, "text", 4 << 20):
                found.update(np.diff(encode(batch.column(0))[1]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "n_docs"])

    return run


def histogram(docs: DataFrame, tokenizer: str | None = None, extra: int = 0, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: a row for each encoded length that occurs; extra ids are added to each document."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted(tokenizer or default_path()), "n_tokens long, n_docs long")
    return counts.groupBy((F.col("n_tokens") + extra).alias("n_tokens")).agg(F.sum("n_docs").alias("n_docs"))


def with_limits(counts: DataFrame) -> DataFrame:
    """Adds to each length L: documents and tokens of length L or more, all tokens when cut at L, and the share of documents of length L or less."""
    longer = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = counts.withColumns({"docs_at_least": F.sum("n_docs").over(longer), "tokens_at_least": F.sum(tokens).over(longer), "all_docs": F.sum("n_docs").over(every), "all_tokens": F.sum(tokens).over(every)})
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_cut_here"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def at_limit(limits: DataFrame, limit: int) -> DataFrame:
    """One row: documents, tokens, documents cut and tokens kept when every document is cut at the limit."""
    return limits.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit))), F.lit(0)).alias("tokens_kept"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """One row: the least length that a share q of the documents does not exceed."""
    return limits.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op6(spark, sf_dir: str) -> DataFrame:
    return with_limits(histogram(table(spark, sf_dir, "documents")))
