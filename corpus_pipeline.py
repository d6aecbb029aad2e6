"""Documents to token files: toxicity, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before kept, and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of documents.

Stages share what their operators say: null and empty texts are kept but for where their group has another, null ids are never one
group, rows that repeat an id are one document in near-duplicates and each their own elsewhere, texts are read whole, extra columns
pass through up to the last stage. Empty documents, labels or benchmarks give the stages' empty or unchanged tables. Token files stay
in the shared folder under palimpsest/kept; what lies between stages goes with the application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontam, mixing, neardup, tokenbin, toxicity
from palimpsest.llm.store import kept_path, saved, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 by a model of all that are labelled."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group that is linked by a similarity of 0.8 or more of five-word shingles."""
    return neardup.deduplicated(docs, 80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the rows of copies are equal."""
    return mixing.repeated(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each row, read back from them."""
    path = kept_path(spark, "token-ids")
    tokenbin.write(docs, path)
    return tokenbin.read(spark, path)


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
    ("token-ids", token_files),
]

#: Scores of a trained model are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
