"""Token ids of documents in block files, and their reading.

Documents are range-partitioned and sorted by id, so part files in order hold them in ascending id. A file's
rows are blocks (simple8b) of up to BLOCK ids or one longer document, with their place: part, block in part,
ids before it in the part, document ids. Spark's committer writes them, so a lost executor's parts are
written again under the same numbers. Where a part begins among all ids is a sum over parts, of which there
are as many as files.

Null and empty texts have the end id only. Rows that share an id are each written, ordered by a hash of the text and then
the text, so that an id of very many rows is split as well; null ids come first. A text longer than a block is a block of its own. An empty table gives files without rows. Extra columns are not
read. Any tokenizer of the library will do; what is not known to cut texts exactly encodes them whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .store import new_path, spread, table, written
from .tokens import default_path, encoder
from .words import blocks, released

#: Ids in a block, about.
BLOCK = 1 << 17
END_ID = 2
ROWS = "part int, block int, start long, n_ids long, doc_ids array<bigint>, payload binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        encode, part = encoder(path), TaskContext.get().partitionId()
        ids, docs, held, block, start = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "start": start, "n_ids": held, "doc_ids": ids, "payload": simple8b.encode_block(docs)}], schema=_ARROW)

        for batch in (b for whole in batches for b in blocks(whole, "text", 1 << 20)):
            found, offsets = encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                tokens = np.append(found[a:b], np.uint32(end_id))
                if docs and held + len(tokens) > BLOCK:
                    yield flush()
                    block, start = block + 1, start + held
                    ids, docs, held = [], [], 0
                ids.append(doc_id)
                docs.append(tokens)
                held += len(tokens)
        if docs:
            yield flush()
        released()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every document of docs to path."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    placed = spread(rows, "doc_id", "hash", by_range=True).sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    written(placed.mapInArrow(_encode(tokenizer or default_path(), end_id), ROWS), path, compression="zstd")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for doc_ids, start, payload in zip(*(batch.column(i) for i in range(3))):
            offsets, ids = simple8b.decode_block(payload.as_py())
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(offsets[:-1] + start.as_py()), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at path."""
    held = spark.read.schema(ROWS).parquet(path)
    parts = held.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part file: as many as spread() makes partitions.
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    placed = held.join(F.broadcast(parts), "part").select("doc_ids", (F.col("part_start") + F.col("start")).alias("start"), "payload")
    return placed.mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids, read from the files at path."""

    def run(batches):
        for batch in batches:
            for doc_ids, payload in zip(batch.column(0), batch.column(1)):
                offsets, ids = simple8b.decode_block(payload.as_py())
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])

    return spark.read.schema(ROWS).parquet(path).select("doc_ids", "payload").mapInArrow(run, "doc_id long, ids array<bigint>")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
