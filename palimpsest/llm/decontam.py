"""Benchmark passages in documents by Wu-Manber search over words.

Patterns are windows of WINDOW consecutive item words, or a whole shorter item. For each pattern length a table of
shifts, indexed by the hash of a block of two words, tells how far a window may move on: blocks in no pattern
move it past the block, others to the nearest place where they would fit. Many stretches of text are searched in
step, each with its own cursor. A shift of zero means that the block ends some pattern: the patterns with that last
block are in one bucket, those whose first block differs are passed over, and the rest are compared word by word,
by hash and then by their bytes.

Documents do not move: the patterns go to them, as arrays of some 150 bytes a window. A benchmark of at most PART windows is one pass.
A larger one is searched part by part: a part is collected, broadcast, searched in a pass over all documents, and given up before the
next, so what is held and sent at once is bounded however large the benchmark is. Such a pass writes what it found in each distinct
text that it hit, by two hashes of the text (128 bits); in the end the documents are joined with what all parts found, by broadcast
where that is counted to be small, else by a shuffle.

Null texts and items have no words; items without words match nothing; an item that repeats counts once; items
with equal windows all count. An item with a null id is searched as any other, only the list of ids is without it. Rows of documents
that repeat are each marked alike; texts are searched whole, however long, some MB of text at once. Empty tables give no rows, or
documents without hits. Extra columns pass through, whatever their names, but for those named as the output, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, saved, table, unused
from .words import ALNUM, U, blocks, buffers, hashed_words, mixed

WINDOW = 10
#: Windows that are searched, and broadcast, at once.
PART = 200_000
#: Window starts that one cursor goes through.
STRETCH = 512
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_C = U(0x9FB21C651E98DF25)


def _blocks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _C + second)


class Patterns:
    """The windows of one length."""

    def __init__(self, windows: list[tuple[bytes, ...]], items: list[tuple[int, ...]]) -> None:
        self.m = len(windows[0])
        column = pa.array([b" ".join(w).decode("utf-8", "surrogatepass") for w in windows])
        _, hashes, _ = hashed_words(*buffers(column), ALNUM)
        grid = hashes.reshape(len(windows), self.m)
        if self.m == 1:
            last = mixed(grid[:, 0])
        else:
            last = _blocks(grid[:, -2], grid[:, -1])
        order = np.argsort(last, kind="stable")
        self.last, self.grid = last[order], grid[order]
        self.first = last[order] if self.m == 1 else _blocks(self.grid[:, 0], self.grid[:, 1])
        texts = [b" ".join(windows[i]) for i in order]
        self.text, self.at = b"".join(texts), np.cumsum([0, *map(len, texts)])
        owners = [items[i] for i in order]
        self.item, self.item_at = np.array([i for o in owners for i in o], np.int64), np.cumsum([0, *map(len, owners)])
        width = max(16, (4 * len(windows) * self.m).bit_length())
        self.cut = U(64 - width)
        self.shift = np.full(1 << width, max(1, self.m - 1), np.uint16)
        for j in range(self.m - 1):
            np.minimum.at(self.shift, (_blocks(grid[:, j], grid[:, j + 1]) >> self.cut).astype(np.int64), self.m - 2 - j)
        if self.m == 1:
            self.shift[(last >> self.cut).astype(np.int64)] = 0

    def ending(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the last block of the windows that begin at `at`."""
        if self.m == 1:
            return mixed(words[at])
        return _blocks(words[at + self.m - 2], words[at + self.m - 1])

    def candidates(self, words: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """Beginnings of windows whose last block may end a pattern."""
        begin, end = ranges[:-1], ranges[1:] - self.m  # of each text: first and last window
        ok = end >= begin
        begin, end = begin[ok], end[ok]
        pieces = (end - begin) // STRETCH + 1
        at = np.repeat(begin, pieces) + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(at + STRETCH - 1, np.repeat(end, pieces))
        found = []
        while len(at):
            step = self.shift[(self.ending(words, at) >> self.cut).astype(np.int64)].astype(np.int64)
            zero = step == 0
            if zero.any():
                found.append(at[zero])
                step[zero] = 1
            at = at + step
            on = at <= stop
            at, stop = at[on], stop[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, words: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window beginnings and the pattern of equal hashes there."""
        at = self.candidates(words, ranges)
        end = self.ending(words, at)
        low, high = np.searchsorted(self.last, end, "left"), np.searchsorted(self.last, end, "right")
        n = high - low
        pos = np.repeat(at, n)
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if self.m > 1:
            same = _blocks(words[pos], words[pos + 1]) == self.first[which]
            pos, which = pos[same], which[same]
        for j in range(self.m):
            same = words[pos + j] == self.grid[which, j]
            pos, which = pos[same], which[same]
        return pos, which


def windows_of(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[Patterns]:
    owners: dict[tuple[bytes, ...], set[int]] = {}
    for item, text in items:
        words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(tuple(words[i : i + window]), set()).update(() if item is None else (item,))
    by_length: dict[int, list] = {}
    for w in owners:
        by_length.setdefault(len(w), []).append(w)
    return [Patterns(ws, [tuple(sorted(owners[w])) for w in ws]) for _, ws in sorted(by_length.items())]


def _search(text: pa.Array, patterns: list[Patterns]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Each text's range of words, the words that are hit, and (text, item) pairs."""
    buf, offs = buffers(text)
    starts, words, ranges = hashed_words(buf, offs, ALNUM)
    cover = np.zeros(len(words) + 1, np.int64)
    pairs = set()
    for p in patterns:
        pos, which = p.matches(words, ranges)
        rows = np.searchsorted(ranges, pos, "right") - 1
        for at, w, row in zip(pos.tolist(), which.tolist(), rows.tolist()):
            # Up to the next word, if there is one in this text.
            stop = int(starts[at + p.m]) if at + p.m < ranges[row + 1] else int(offs[row + 1])
            if b" ".join(_WORDS.findall(buf[int(starts[at]) : stop].tobytes().translate(_LOWER))) == p.text[p.at[w] : p.at[w + 1]]:
                cover[at] += 1
                cover[at + p.m] -= 1
                pairs.update((row, item) for item in p.item[p.item_at[w] : p.item_at[w + 1]].tolist())
    return ranges, np.cumsum(cover)[:-1] > 0, sorted(pairs)


_RUNS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_RUNS_SQL, _ITEMS_SQL = "array<struct<begin:bigint,end:bigint>>", "array<bigint>"


def _runs(hit: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"begin": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


def _found(batches: Iterator[pa.RecordBatch], text: str, patterns: list[Patterns]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list, list]]:
    """Slices of batches, with the number of words of each text, its runs and its items."""
    for whole in batches:
        for batch in blocks(whole, text):
            ranges, hit, pairs = _search(batch.column(batch.schema.names.index(text)), patterns)
            runs: list = [[] for _ in range(batch.num_rows)]
            items: list = [[] for _ in range(batch.num_rows)]
            for row in np.unique(np.searchsorted(ranges, np.flatnonzero(hit), "right") - 1).tolist():
                runs[row] = _runs(hit[ranges[row] : ranges[row + 1]])
            for row, item in pairs:
                items[row].append(item)
            yield batch, np.diff(ranges), runs, items


def _parts(benchmark: DataFrame, window: int, item_col: str, item_text_col: str) -> Iterator[list[Patterns]]:
    """The patterns of the benchmark, part by part."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = 1 + size // (2 * PART)  # a window begins at a word, of two characters with its gap at least
    if parts > 1:
        part = F.pmod(F.coalesce(F.when(F.col("item").isNotNull(), F.xxhash64("item")), F.xxhash64("text")), F.lit(parts))
        items = saved(items.where("text IS NOT NULL").select(part.alias("part"), "item", "text"), "benchmark")
    for k in range(parts):
        yield windows_of([(r["item"], r["text"]) for r in (items.where(F.col("part") == k) if parts > 1 else items).collect()], window)


def _hashes(text_col: str) -> list:
    return [F.xxhash64(F.lit(seed), text_col) for seed in (1, 2)]


def _by_text(docs: DataFrame, parts: Iterator[list[Patterns]], text_col: str) -> DataFrame:
    """h1, h2, runs, items of each distinct text that any part hits; runs of several parts are not merged yet."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), *(h.alias(n) for h, n in zip(_hashes(text_col), ("h1", "h2"))))
    schema = f"h1 long, h2 long, runs {_RUNS_SQL}, items {_ITEMS_SQL}"
    written = None
    for patterns in parts:
        sent = spark.sparkContext.broadcast(patterns)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, _, runs, items in _found(batches, "text", sent.value):
                hit = np.flatnonzero([bool(r) for r in runs])
                rows = batch.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array([runs[i] for i in hit], _RUNS), pa.array([items[i] for i in hit], pa.list_(pa.int64()))], ["h1", "h2", "runs", "items"])

        # Copies of a text are hit alike: one of them is kept.
        once = texts.mapInArrow(run, schema).groupBy("h1", "h2").agg(F.first("runs").alias("runs"), F.first("items").alias("items"))
        found = saved(once, "hits")
        sent.destroy()
        written = found if written is None else written.unionByName(found)
    both = written.groupBy("h1", "h2").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return saved(both, "all-hits")


def _joined(docs: DataFrame, found: DataFrame, text_col: str, how: str, *columns: str) -> DataFrame:
    """docs joined with what was found in their texts, under the names of columns."""
    h1, h2 = unused(docs, "h1", "h2")
    found = found.toDF(h1, h2, *columns)
    # Counted: rows of two hashes, and what their arrays hold.
    size = F.lit(1) + sum((F.size(c) for c in columns), F.lit(0))
    few = found.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_ROWS
    a, b = _hashes(text_col)
    return docs.join(F.broadcast(found) if few else found, (a == F.col(h1)) & (b == F.col(h2)), how).drop(h1, h2)


def _merged(text_col: str, n_words: str, runs_name: str):
    """Counts words and merges runs that overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts, _, _ in _found(batches, text_col, []):
            names = batch.schema.names
            out = []
            for runs in batch.column(names.index(runs_name)).to_pylist():
                merged: list[dict] = []
                for r in sorted(runs or [], key=lambda r: r["begin"]):
                    if merged and r["begin"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], r["end"])
                    else:
                        merged.append(r)
                out.append(merged)
            done = {n_words: pa.array(counts), runs_name: pa.array(out, _RUNS)}
            yield pa.RecordBatch.from_arrays([done.get(n, batch.column(i)) for i, n in enumerate(names)], names)

    return run


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words, runs (begin and end of hit words, in words) and items (ids with a window that occurs), in place of columns so named."""
    docs = docs.drop("n_words", "runs", "items")
    parts = _parts(benchmark, window, item_col, item_text_col)
    first = next(parts)
    second = next(parts, None)
    blank = {"n_words": F.lit(0).cast("long"), "runs": F.expr(f"CAST(array() AS {_RUNS_SQL})"), "items": F.expr(f"CAST(array() AS {_ITEMS_SQL})")}
    schema = docs.withColumns(blank).schema
    if second is not None:
        found = _by_text(docs, chain([first, second], parts), text_col)
        out = _joined(docs, found, text_col, "left", "runs", "items").withColumn("items", F.coalesce("items", blank["items"]))
        return out.withColumn("n_words", blank["n_words"]).mapInArrow(_merged(text_col, "n_words", "runs"), out.withColumn("n_words", blank["n_words"]).schema).select(*schema.names)
    sent = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts, runs, items in _found(batches, text_col, sent.value):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.int64()))], schema.names)

    return docs.mapInArrow(run, schema)


def n_hit():
    return F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = marked(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated")
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark window."""
    parts = _parts(benchmark, window, item_col, item_text_col)
    first = next(parts)
    second = next(parts, None)
    if second is not None:
        found = _by_text(docs, chain([first, second], parts), text_col)
        return _joined(docs, found.select("h1", "h2"), text_col, "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, runs, _ in _found(batches, text_col, sent.value):
            yield batch.filter(pa.array([not r for r in runs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
