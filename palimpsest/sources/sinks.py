"""Idempotent writers: archives by content, artifacts written once, checkpoints as a log, deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.canon import content_hash
from palimpsest.operators.records import latest


def _existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(like.schema).parquet(path)
    return spark.createDataFrame([], like.schema)


def archive(rows: DataFrame, path: str) -> None:
    """Appends rows (ns, source_id, content) under their content's hash, each (source, hash) once however often it is written."""
    new = rows.withColumn("checksum", content_hash(F.col("content"))).dropDuplicates(["ns", "source_id", "checksum"])
    old = _existing(rows.sparkSession, path, new).select("ns", "source_id", "checksum")
    new.join(old, ["ns", "source_id", "checksum"], "left_anti").write.mode("append").parquet(path)


def archive_valid(rows: DataFrame) -> DataFrame:
    return rows.withColumn("valid", F.coalesce(F.col("checksum") == content_hash(F.col("content")), F.lit(False)))


def put_once(rows: DataFrame, path: str) -> DataFrame:
    """Appends rows (identity, checksum, ...) whose identity is new, each once; returns those whose identity is held under another checksum.

    Of rows of one identity in a batch the one of the least checksum is put, and the others clash with it.
    """
    old = _existing(rows.sparkSession, path, rows).select("identity", F.col("checksum").alias("__held"))
    first = rows.groupBy("identity").agg(F.min("checksum").alias("__first"))
    known = rows.join(first, "identity").join(old, "identity", "left").withColumn("held", F.coalesce("__held", "__first"))
    clash = known.where(F.col("checksum") != F.col("held")).select(*rows.columns, "held")
    new = known.where(F.col("__held").isNull() & (F.col("checksum") == F.col("__first"))).select(*rows.columns)
    # Read after the batch is written, clashes are the same: what is held then is what was first.
    new.dropDuplicates(["identity"]).write.mode("append").parquet(path)
    return clash


def save_checkpoint(rows: DataFrame, path: str, version: int) -> None:
    """Appends fingerprints (source_id, fingerprint) as of a version."""
    rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(path)


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The last fingerprint of each source; of several of one version the least."""
    return latest(spark.read.parquet(path), ["source_id"], F.col("version").desc(), F.col("fingerprint"))


def recovered_checkpoint(snapshot: DataFrame, journal: DataFrame) -> DataFrame:
    """source_id, fingerprint of a snapshot (source_id, fingerprint, version) and the deltas (the same) written after it: the last of each source."""
    return latest(snapshot.unionByName(journal), ["source_id"], F.col("version").desc(), F.col("fingerprint")).select("source_id", "fingerprint")


def save_checkpoint_once(rows: DataFrame, path: str, version: int) -> bool:
    """save_checkpoint(), unless the log has this version or a later one: then nothing is written."""
    old = _existing(rows.sparkSession, path, rows.withColumn("version", F.lit(version).cast("long")))
    held = old.agg(F.max("version")).first()[0]
    if held is not None and held >= version:
        return False
    save_checkpoint(rows, path, version)
    return True


def compact_checkpoint(spark: SparkSession, path: str, to: str) -> None:
    load_checkpoint(spark, path).write.mode("overwrite").parquet(to)


def projection(revisions: DataFrame) -> DataFrame:
    """What a provider is sent of active revisions, with a document id for each revision."""
    return revisions.where("status = 'active'").select(F.concat("memory_id", F.lit(":r"), F.col("revision").cast("string")).alias("document_id"), "memory_id", "revision", "text")


def deliver(client: Callable[[list[dict]], None], batch_size: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands rows to a client on the executors, in batches; the batch id makes a repeat recognisable."""

    def run(df: DataFrame, batch_id: int) -> None:
        def send(rows) -> None:
            held = []
            for row in rows:
                held.append(row.asDict() | {"batch_id": batch_id})
                if len(held) == batch_size:
                    client(held)
                    held = []
            if held:
                client(held)

        df.foreachPartition(send)

    return run
