"""Folds of rows in a defined order: one key after another, one row after another, with a state that does not grow.

Rows are dealt by their keys and sorted within partitions; a task goes through its rows once and keeps one state, so a key's
rows are never held together and the work is linear in them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def in_order(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[dict, dict | None], tuple[dict | None, list[dict]]], schema: str) -> DataFrame:
    """What step(row, state) gives for every row, state being that after the row before (None at the first of a key): the state after it, and rows of the schema.

    After a key's last row step(None, state) is asked for what is left.
    """
    names = rows.columns
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, open_ = None, None, False
        for batch in batches:
            out: list[dict] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                own = tuple(row[k] for k in keys)
                if not open_ or own != key:
                    if open_:
                        out += step(None, state)[1]
                    key, state, open_ = own, None, True
                state, found = step(row, state)
                out += found
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if open_:
            yield pa.RecordBatch.from_pylist(step(None, state)[1], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
