"""Tables written in the shared folder of the cluster, which cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a table of two or three numbers a row may be broadcast (32 MB at most).
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch in actions of this package, beside the engine's bound in bytes.
BATCH_ROWS = 2000
#: Bytes read (compressed) for each partition that spread() makes, and most partitions.
PARTITION_BYTES = 64 << 20
MOST_PARTITIONS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A temporary one is set only where the session has none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of this application, which is deleted when its JVM ends."""
    folder = f"{shared_dir(spark)}/palimpsest/{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def kept_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for what is to stay."""
    return f"{shared_dir(spark)}/palimpsest/kept/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Python gets BATCH_ROWS rows at once while an action of this package runs; the session's own setting is back when it ends."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = int(before)
    spark.conf.set(name, min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, path: str, **options: str) -> None:
    """Writes df as Parquet."""
    with small_batches(df.sparkSession):
        df.write.options(**options).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str, by_range: bool = False) -> DataFrame:
    """df dealt out by columns: to as many partitions as the session says, which may be joined where they are small, or one for each 64 MB read, if that is more."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # A source that does not know its size tells one without bound.
    parts = min(sum(n for n in sizes if n < 1 << 60) // PARTITION_BYTES, MOST_PARTITIONS)
    deal = df.repartitionByRange if by_range else df.repartition
    few = parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return deal(*columns) if few else deal(parts, *columns)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a saved() table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/palimpsest/" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name for each of names that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
