"""The change feed as a stream, and stateful streams over it.

A feed's progress is its commit_seq, not event time. Batches come from files as they are committed; sinks are keyed by what
they write, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def changes(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def high_water(stream: DataFrame) -> DataFrame:
    """The running high-water mark of each scope."""
    return stream.groupBy("ns").agg(F.max("commit_seq").alias("high_water"), F.count(F.lit(1)).alias("changes"))


def heads(stream: DataFrame) -> DataFrame:
    """The running head of each record."""
    rest = [c for c in stream.columns if c != "memory_id"]
    return stream.groupBy("memory_id").agg(F.max_by(F.struct(*rest), "revision").alias("head"))


def replicate(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each change once by (ns, commit_seq), however often it or its batch is delivered.

    A batch writes a folder of its own, which its repeat overwrites, without the changes that other batches' folders have. Those are found by
    a join on the two numbers; only folders of scopes' rows are read, two columns of them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(["ns", "commit_seq"])
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            held = spark.read.schema(batch.schema.add("batch", "long")).parquet(path).where(F.col("batch") != batch_id)
            once = once.join(held.select("ns", "commit_seq"), ["ns", "commit_seq"], "left_anti")
        once.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SourceDiff(StatefulProcessor):
    """Tells new, changed and unchanged sources apart by the fingerprint last seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("fingerprint", "fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            found = []
            for fingerprint in part.sort_values("seq").fingerprint:
                before = self.last.get()[0] if self.last.exists() else None
                found.append("new" if before is None else "unchanged" if before == fingerprint else "changed")
                if before != fingerprint:
                    self.last.update((fingerprint,))
            yield pd.DataFrame({"source_id": [key[0]] * len(found), "change": found})

    def close(self) -> None:
        pass


def source_changes(stream: DataFrame) -> DataFrame:
    """source_id, change of fingerprints (source_id, seq, fingerprint) as they arrive. Needs the RocksDB state store."""
    return stream.groupBy("source_id").transformWithStateInPandas(SourceDiff(), "source_id string, change string", "append", "None")


def session_closings(stream: DataFrame, idle: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that have been idle: (session_id, window, messages) of messages (session_id, at)."""
    window = F.session_window("at", idle)
    return stream.withWatermark("at", late).groupBy("session_id", window.alias("window")).agg(F.count(F.lit(1)).alias("messages"))


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Deliveries without repeats of an idempotency key within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["ns", "idempotency_key"])
