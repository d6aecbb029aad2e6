"""Near-duplicates: banded MinHash candidates, odd sketches to sift them, full shingle sets to confirm them.

1. In one pass over the texts every document gets: the size of its set of five-word shingles, a 128-bit hash of the
   set, band keys of its MinHash values and an odd sketch, a bitmap in which each MinHash value flips one bit.
   The number of bands is chosen so that a pair at the threshold shares none with probability below MISS.
2. Documents of equal sets are one class, numbered when the classes are written and shown by its least id; only classes go on.
3. In each band bucket every class is paired with the bucket's least id, its centre, so a bucket of n gives n - 1
   pairs. Pairs whose sizes or odd sketches cannot reach the threshold are sifted out; the rest are confirmed on full
   sets: texts go to their centre in stretches of SPREAD members, sorted, so a task holds one set at a time.
4. Classes that are linked need no further link to each other. What stars may miss are links between members of a
   bucket that are still in different components: those outside the bucket's largest component are compared with
   all its members, in units of STRETCH by STRETCH. The members of a stretch are one row with their odd sketches, so a
   unit is two rows. It compares odd sketches, which picks the members whose texts are needed; these are dealt by their sizes
   into units of UNIT_BYTES a side, or one text, which compare full sets; only links that join components leave them. A pair is
   compared in the first band that it shares and nowhere else. So no link between components is lost, and no pairs are written out.
   Of m members that are mostly unlinked each is sent m / STRETCH times, 250 bytes a time (a million: 61 GB), and compared with m sketches.

Null doc_id: the row is returned with component_id null and is kept. Null and empty texts have no shingles and are
linked with nothing. Rows that share a doc_id count as one document: their sets all link, and a link of one is a link of all. Rows that
repeat and ties are alike: the least id shows a class, a component and a group. A long text is one row's work; its set is made whole.
An empty table gives no rows. Extra columns pass through deduplicated(), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .store import BROADCAST_ROWS, saved, spread, table, unused
from .words import NON_SPACE, U, blocks, buffers, hashed_words, mixed, released

SHINGLE = 5
#: MinHash values in a band.
ROWS = 6
#: Probability that a pair at the threshold shares no band.
MISS = 1e-7
#: Bits of an odd sketch.
BITS = 512
#: Members of a bucket on either side of a unit of sketches.
STRETCH = 4096
#: Bytes of texts and sets on either side of a unit of sets; a text that is longer is alone.
UNIT_BYTES = 8 << 20
#: Standard deviations of an odd sketch's estimate that a pair may lie below the threshold.
SIGMAS = 5.5
#: Members that are compared with a centre in one stretch.
SPREAD = 500


def n_bands(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def most_bits(threshold: float, k: int) -> int:
    """Bits set in the XOR of two odd sketches of k values that a pair at the threshold does not exceed."""
    s, z = 2 * k * (1 - threshold), BITS
    mean = z / 2 * (1 - math.exp(-2 * s / z))
    # Variance from values that fall on one bit, and from the number of MinHash values that differ.
    of_sketch = z / 4 * (1 - math.exp(-4 * s / z)) - s * math.exp(-4 * s / z)
    of_minhash = (2 * math.exp(-2 * s / z)) ** 2 * k * threshold * (1 - threshold)
    return min(z, math.ceil(mean + SIGMAS * math.sqrt(of_sketch + of_minhash)))


def shingle_sets(text: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _, words, ranges = hashed_words(*buffers(text), NON_SPACE)
    weights = [np.random.default_rng(101 + j).integers(1, 1 << 63, dtype=U) * U(2) + U(1) for j in range(size)]
    n = len(words) - size + 1
    whole = mixed(sum((words[j : j + n] * weights[j] for j in range(size)), np.zeros(n, U))) if n > 0 else np.zeros(0, U)
    for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist()):
        if b - a >= size:
            h = np.sort(whole[a : b - size + 1])
            yield h[np.concatenate([[True], h[1:] != h[:-1]])]
        elif b > a:
            h = np.array([b - a], U)
            for j in range(b - a):
                h = mixed(h ^ (words[a + j : a + j + 1] * weights[j]))
            yield h
        else:
            yield np.zeros(0, U)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """The 128-bit hash of a set, as two signed numbers."""
    return int(hashes.sum(dtype=U).view(np.int64)), int(mixed(hashes).sum(dtype=U).view(np.int64))


class Signer:
    """Band keys and odd sketch of a set."""

    def __init__(self, threshold: float) -> None:
        self.bands = n_bands(threshold)
        k = self.bands * ROWS
        rng = np.random.default_rng(11)
        self.times = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        self.place = rng.integers(1, 1 << 63, k, dtype=U) * U(2) + U(1)
        self.weights = rng.integers(1, 1 << 63, ROWS, dtype=U) * U(2) + U(1)
        self.band = np.arange(self.bands, dtype=U) * U(0x9E3779B97F4A7C15)

    def least(self, hashes: np.ndarray) -> np.ndarray:
        """The least value of the set under each of the hash functions."""
        x = (hashes >> U(32)).astype(np.uint32)
        out = np.full(len(self.times), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024, None] * self.times
            part += self.plus
            np.minimum(out, part.min(0), out=out)
        return out

    def __call__(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and sketch words of rows of least values."""
        wide = least.astype(U)
        keys = mixed((mixed(wide.reshape(len(wide), self.bands, ROWS)) * self.weights).sum(2, dtype=U) + self.band)
        bit = (mixed(wide * self.place) >> U(64 - BITS.bit_length() + 1)).astype(np.int64)
        sketch = np.zeros((len(wide), BITS), np.uint8)
        np.bitwise_xor.at(sketch, (np.arange(len(wide))[:, None], bit), 1)
        return keys.view(np.int64), np.packbits(sketch, axis=1).view(np.int64)


def _signed(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(threshold)
        for whole in batches:
            for batch in blocks(whole, "text"):
                n, h1, h2, least = [], [], [], []
                sizes = np.diff(buffers(batch.column(1))[1])
                for s in shingle_sets(batch.column(1)):
                    n.append(len(s))
                    one, two = _digest(s)
                    h1.append(one)
                    h2.append(two)
                    least.append(signer.least(s))
                keys, sketch = signer(np.array(least))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                columns = [batch.column(0), pa.array(sizes), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists(keys), lists(sketch)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "n", "h1", "h2", "bands", "sketch"])
        released()

    return run


def _confirmed(percent: int):
    """Rows (centre, stretch, other, h1, h2, text) sorted, the centre's own text first (other null): the links. Texts of other sets that share the id are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for whole in batches:
            for batch in blocks(whole, "text"):
                a, b = [], []
                centre_of, other_of, h1, h2 = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
                for centre, other, one, two, s in zip(centre_of, other_of, h1, h2, shingle_sets(batch.column(5))):
                    if _digest(s) != (one, two):
                        continue
                    if other is None:
                        at, own = centre, s
                    elif at == centre:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(s) - both):
                            a.append(centre)
                            b.append(other)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _confirm(pairs: DataFrame, n_pairs: int, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a centre, b) whose full sets reach the threshold. pairs: a, b, and rep, h1, h2 of either (_a, _b)."""
    counts = pairs.groupBy("a", "rep_a", "h1_a", "h2_a").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("stretches"))
    placed = pairs.join(counts.select("a", "stretches"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("stretches")).cast("int").alias("stretch"), F.col("b").alias("other"), F.col("rep_b").alias("rep"), F.col("h1_b").alias("h1"), F.col("h2_b").alias("h2"))
    centres = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("stretches") - 1)).alias("stretch"), F.lit(None).cast("long").alias("other"), F.col("rep_a").alias("rep"), F.col("h1_a").alias("h1"), F.col("h2_a").alias("h2"))
    needs = saved(placed.union(centres), "needs")
    few = 2 * n_pairs <= BROADCAST_ROWS  # rows of six numbers, counted
    texts = docs.join(F.broadcast(needs) if few else needs, docs["doc_id"] == needs["rep"])
    texts = spread(texts.select("a", "stretch", "other", "h1", "h2", "text"), "a", "stretch")
    return texts.sortWithinPartitions("a", "stretch", F.col("other").asc_nulls_first()).mapInArrow(_confirmed(percent), "a long, b long")


def _sifted(pairs: DataFrame, signs: DataFrame, percent: int, bits: int) -> DataFrame:
    """The pairs whose sizes and odd sketches may reach the threshold, with what their texts are found by."""
    side = lambda x: signs.select(F.col("vid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "rep", "h1", "h2")))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.where(_may("n_a", "n_b", "sketch_a", "sketch_b", percent, bits)).select("a", "b", *(f"{c}_{x}" for x in "ab" for c in ("rep", "h1", "h2")))


def _may(n_a: str, n_b: str, s_a: str, s_b: str, percent: int, bits: int):
    differ = sum((F.bit_count(F.col(s_a)[i].bitwiseXOR(F.col(s_b)[i])) for i in range(BITS // 64)), F.lit(0))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (differ <= bits)


_NUMBERS = ("vid", "label", "n", "size", "rep", "h1", "h2")


def _units(members: DataFrame, labels: DataFrame, signs: DataFrame) -> DataFrame:
    """key, i, j, side, members: stretches of buckets that hold several components; side 0 are members outside the largest, side 1 all. A stretch is one row."""
    rest = members.select("key", "vid").join(labels, "vid", "left").select("key", "vid", F.coalesce("label", "vid").alias("label"))
    sizes = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    split = sizes.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    pieces = lambda n: F.ceil(n / STRETCH).cast("int")
    split = saved(split.select("key", "main", pieces(F.col("all") - F.col("most")).alias("ni"), pieces(F.col("all")).alias("nj")), "split")
    left = rest.join(split, "key")
    place = lambda side, n: F.struct(F.lit(side).alias("side"), F.pmod(F.xxhash64("vid"), F.col(n)).cast("int").alias("block"))
    both = F.array(place(0, "ni"), place(1, "nj"))
    left = left.withColumn("at", F.explode(F.when(F.col("label") != F.col("main"), both).otherwise(F.array(place(1, "nj"))))).select("key", "ni", "nj", "vid", "label", "at.*")
    # Of band keys 32 bits are enough to know the first that two members share.
    short = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("bands")
    own = F.struct(*_NUMBERS, "sketch", short)
    packed = saved(left.join(signs, "vid").groupBy("key", "side", "block", "ni", "nj").agg(F.collect_list(own).alias("members")), "stretches")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own, other = F.col("block"), F.explode(F.when(F.col("side") == 0, upto("nj")).otherwise(upto("ni")))
    units = packed.withColumn("other", other).withColumns({"i": F.when(F.col("side") == 0, own).otherwise(F.col("other")), "j": F.when(F.col("side") == 1, own).otherwise(F.col("other"))})
    return units.drop("block", "other", "ni", "nj")


def _numbers(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


_PICKED = "key long, i int, j int, si int, sj int, side int, vid long, label long, rep long, h1 long, h2 long"


def _picked(units: DataFrame, percent: int, bits: int) -> DataFrame:
    """The members of units that may be linked to another component there by their odd sketches, dealt into units (si, sj) of bounded size."""

    def run(unit: pa.Table) -> pa.Table:
        key, names = unit["key"][0].as_py() >> 32, [x.split()[0] for x in _PICKED.split(", ")]
        kinds = dict.fromkeys(("key", "vid", "label", "rep", "h1", "h2"), pa.int64())
        empty = pa.table({n: pa.array([], kinds.get(n, pa.int32())) for n in names})
        if len(unit) < 2:
            return empty
        members = unit["members"].combine_chunks()
        sides = [members[i].values for i in np.argsort(unit["side"].to_numpy())]
        num = [{c: x.field(c).to_numpy(zero_copy_only=False) for c in _NUMBERS} for x in sides]
        sketch = [_numbers(x.field("sketch")).view(U) for x in sides]
        bands = [_numbers(x.field("bands")) for x in sides]
        few, every = num
        keep = [np.zeros(len(x["vid"]), bool) for x in num]
        for x in range(len(few["vid"])):
            y = np.flatnonzero((every["label"] != few["label"][x]) & (100 * np.minimum(every["n"], few["n"][x]) >= percent * np.maximum(every["n"], few["n"][x])))
            y = y[np.bitwise_count(sketch[1][y] ^ sketch[0][x]).sum(1) <= bits]
            if len(y):
                y = y[bands[0][x][(bands[1][y] == bands[0][x]).argmax(1)] == key]
                keep[0][x] = len(y) > 0
                keep[1][y] = True
        picks, stretch = [], []
        for k in (0, 1):
            at = np.flatnonzero(keep[k])
            picks.append(at)
            stretch.append((np.cumsum(num[k]["size"][at] + 8 * num[k]["n"][at]) // UNIT_BYTES).astype(np.int64))
        if not len(picks[0]) or not len(picks[1]):
            return empty
        # Numbers of stretches go up without gaps, and every stretch of one side meets every one of the other.
        stretch = [np.unique(x, return_inverse=True)[1] for x in stretch]
        out: dict[str, list] = {n: [] for n in names}
        for k in (0, 1):
            times = int(stretch[1 - k].max()) + 1
            at, mine, other = np.repeat(picks[k], times), np.repeat(stretch[k], times), np.tile(np.arange(times), len(picks[k]))
            size = len(at)
            columns = {"key": np.full(size, unit["key"][0].as_py()), "i": np.full(size, unit["i"][0].as_py()), "j": np.full(size, unit["j"][0].as_py()), "si": (mine, other)[k], "sj": (other, mine)[k], "side": np.full(size, k)}
            for n in names:
                out[n].append(columns[n] if n in columns else num[k][n][at])
        return pa.table({n: pa.array(np.concatenate(v)).cast(kinds.get(n, pa.int32())) for n, v in out.items()})

    return units.groupBy("key", "i", "j").applyInArrow(run, _PICKED)


def _joined(picked: DataFrame, n_picked: int, docs: DataFrame, percent: int) -> DataFrame:
    """Links between components in each unit, on full sets; what a link has joined there is not joined again."""

    def run(unit: pa.Table) -> pa.Table:
        sets = list(shingle_sets(unit["text"]))
        # Texts of other sets that share an id, and rows that repeat, are passed over.
        seen, right = set(), []
        for i, row in enumerate(zip(*(unit[c].to_pylist() for c in ("side", "vid", "h1", "h2")))):
            if row[:2] not in seen and _digest(sets[i]) == row[2:]:
                seen.add(row[:2])
                right.append(i)
        sets = [sets[i] for i in right]
        side, vid, label = (unit[c].to_numpy()[right] for c in ("side", "vid", "label"))
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.flatnonzero(side == 1)
        found = {x: x for x in label.tolist()}

        def root(x: int) -> int:
            while found[x] != x:
                x = found[x]
            return x

        a, b = [], []
        if len(every):
            of_every = np.concatenate([sets[y] for y in every])
            known, place = np.unique(of_every, return_inverse=True)
            begins = np.cumsum(sizes[every]) - sizes[every]
            mark = np.zeros(len(known), np.int32)
            for x in np.flatnonzero(side == 0):
                at = np.minimum(np.searchsorted(known, sets[x]), len(known) - 1)
                at = at[known[at] == sets[x]]
                mark[at] = 1
                both = np.add.reduceat(mark[place], begins)
                mark[at] = 0
                for y in every[100 * both >= percent * (sizes[x] + sizes[every] - both)]:
                    u, v = root(int(label[x])), root(int(label[y]))
                    if u != v:
                        found[max(u, v)] = min(u, v)
                        a.append(int(vid[x]))
                        b.append(int(vid[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    few = n_picked <= BROADCAST_ROWS  # rows of eleven numbers, counted
    texts = docs.join(F.broadcast(picked) if few else picked, docs["doc_id"] == picked["rep"])
    columns = ["key", "i", "j", "si", "sj"]
    return texts.select(*columns, "side", "vid", "label", "h1", "h2", "text").groupBy(*columns).applyInArrow(run, "a long, b long")


def _of_ids(some: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of an id that has several, if there are any."""
    own = F.struct("h1", "h2")
    several = saved(some.groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high").select("doc_id"), "several")
    n = several.count()
    if not n:
        return None
    several = F.broadcast(several) if n <= BROADCAST_ROWS else several
    rows = some.join(several, "doc_id", "left_semi").select("doc_id", "h1", "h2").distinct().join(classes, ["h1", "h2"]).select("doc_id", "vid")
    return rows.groupBy("doc_id").agg(F.min("vid").alias("a"), F.collect_set("vid").alias("all")).select("a", F.explode("all").alias("b")).where("a <> b")


def grouped(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept."""
    threshold = percent / 100
    bits = most_bits(threshold, n_bands(threshold) * ROWS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = saved(rows.mapInArrow(_signed(threshold), "doc_id long, size long, n long, h1 long, h2 long, bands array<bigint>, sketch array<bigint>"), "signed")
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    # Numbers are given as the table is written, and so stay.
    classes = saved(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")).withColumn("vid", F.monotonically_increasing_id()), "classes")
    # A class's signature is that of a row of its least id; rows that repeat it are one.
    own = classes.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "rep", "vid")
    signs = some.join(own, (F.col("doc_id") == F.col("rep")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).dropDuplicates(["doc_id", "h1", "h2"]).drop("doc_id", "g1", "g2")
    banded = signs.select("vid", F.explode("bands").alias("key"))
    centres = banded.groupBy("key").agg(F.min("vid").alias("centre"), F.max("vid").alias("last")).where("centre <> last").drop("last")
    members = saved(banded.join(centres, "key").select("key", "centre", "vid"), "members")
    sketches = saved(signs.drop("bands").join(members.select("vid").distinct(), "vid", "left_semi"), "sketches")
    texts = rows.where("doc_id IS NOT NULL")

    stars = saved(_sifted(members.where("vid <> centre").select(F.col("centre").alias("a"), F.col("vid").alias("b")).distinct(), sketches, percent, bits), "stars")
    links = saved(_confirm(stars, stars.count(), texts, percent), "links")
    if (more := _of_ids(some, classes)) is not None:
        links = saved(links.union(more), "links")
    labels = saved(components(links), "labels")

    picked = saved(_picked(_units(members, labels, signs), percent, bits), "picked")
    n_picked = picked.count()
    if n_picked:
        labels = saved(components(links.union(_joined(picked, n_picked, texts, percent))), "labels")

    # The least id of each component of several classes.
    linked = labels.join(classes.select("vid", "rep"), "vid")
    least = saved(linked.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    few = least.count() <= BROADCAST_ROWS
    of_class = labels.join(F.broadcast(least) if few else least, "label").select("vid", "component_id")
    named = classes.join(of_class, "vid", "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("component_id", "rep").alias("component_id"))
    own = signed.select("doc_id", "n", "h1", "h2")
    full = own.where("n > 0").join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    out = full.select("doc_id", "n", "component_id").union(own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


def deduplicated(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: that of the least id, and of rows that share it the first by text. Rows without an id stay."""
    own = F.col(id_col).cast("long")
    (key, first) = unused(docs, "key", "first")
    groups = grouped(docs, percent, id_col, text_col)
    gone = saved(groups.where("NOT kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    left = docs.join(F.broadcast(gone) if few else gone, own == F.col(key), "left_anti")
    again = saved(docs.where(own.isNotNull()).groupBy(own.alias(key)).count().where("count > 1").select(key), "again")
    n = again.count()
    if not n:
        return left
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    of_many = left.join(again, own == F.col(key), "left_semi").withColumn(first, place).where(F.col(first) == 1).drop(first)
    return left.join(again, own == F.col(key), "left_anti").unionByName(of_many)
