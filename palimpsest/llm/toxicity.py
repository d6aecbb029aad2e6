"""Toxicity of whole texts from averaged subword embeddings.

A word's vector is the mean of the embeddings of its character n-grams (GRAMS code points, with a mark at either end) and of
itself, all hashed into BUCKETS rows; a passage of PASSAGE words is the mean of its words' vectors; a linear softmax over
two classes scores it. A misspelt word shares n-grams, and so most of its vector, with words seen in training. A
text scores as its worst passage does, so a few words in a long text count as much as in a short one.

Embeddings and softmax rows are trained together by full-batch gradient descent in numpy on the driver, every coordinate of
both with a step of its own (Adam; its damping keeps n-grams with little evidence near their beginning). The batch is a
sample: about SAMPLE documents of each label, taken by the hash of their ids, none longer than SAMPLE_BYTES / 16 and
SAMPLE_BYTES together for each label. Executors cut the sample into words; the driver gets numbers and distinct words, so at most that
many bytes. Passages are trained with their text's label, those of toxic texts later by how
toxic they look against their text's worst, for most of their passages are not. Texts are dealt into FOLDS; as many folds as
a large sample needs are held out in turn, and the model is the mean of those trained on the rest. What held-out texts score
sets the cut: the middle of where it makes the fewest errors. The score is a logistic function of the distance from it.
With two classes the softmax needs only the difference of its rows, so a bucket's share of a score is one number, and
scoring is a table look-up in numpy over each Arrow batch, half a MB of text at a time; a text is scored whole, however long.

Null and empty texts, and texts without words, get the score of an empty passage. Rows with a null label or id, and labels other
than 0 and 1, are not learned from; an id with both labels counts as toxic; rows that repeat an id are all learned from and scored
alike where their texts are; equal texts have equal scores. If a label is missing altogether every text scores the share of label 1,
0 with no labels. Empty tables give no rows. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, table, unused
from .words import U, blocks, released

BUCKETS = 1 << 20
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)
PASSAGE = 6
#: Training texts that must have a bucket's n-grams.
LEAST_TEXTS = 3
#: Steps of training, the first step's size, and the damping of steps.
ROUNDS = 60
RATE = 0.1
DAMPING = 3e-5
#: Parts of the sample, one of which is held out at a time, and words of the sample that are trained on at most in all these turns.
FOLDS = 5
TURNS_WORDS = 1_500_000
#: Documents of each label learned from, about, and bytes of their texts.
SAMPLE = 4000
SAMPLE_BYTES = 16 << 20
#: Words whose n-grams are found at once, and n-grams that are summed at once, so that the driver holds little.
_WORDS = 1 << 13
_STRIDE = 1 << 19
_MIX = U(0x9E3779B97F4A7C15)
_PRIME = U(0x100000001B3)
#: Lower case of the code points before U+0590, where it is one code point.
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x590))], np.uint32)


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with 0 for what is in no word, one more 0 before each text and six after the last; the begin of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    lengths = np.asarray(pc.utf8_length(column), np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = memoryview(data)[offs[0] : offs[-1]] if data is not None else b""
    points = np.frombuffer(str(raw, "utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = (points >= 0x80) | ((points >= 0x30) & (points <= 0x39)) | ((points >= 0x41) & (points <= 0x5A)) | ((points >= 0x61) & (points <= 0x7A))
    low = np.where(points < len(_LOWER), _LOWER[np.minimum(points, len(_LOWER) - 1)], points)
    out = np.zeros(len(points) + n + 6, np.uint32)
    out[np.arange(len(points)) + np.repeat(np.arange(1, n + 1), lengths)] = np.where(word, low, 0)
    return out, np.concatenate([[0], np.cumsum(lengths)]) + np.arange(n + 1)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _spans(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of words in padded text."""
    word = text != 0
    return np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:]) + 1


def _features(text: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Word begins; for each n-gram size, and whole words: bucket at each place, first place and end of places by word."""
    begin, end = _spans(text)
    wide = text.astype(U) + U(1)
    out = []
    h = wide.copy()
    for n in range(2, GRAMS[-1] + 1):
        h = h[:-1] * _PRIME + wide[n - 1 :]
        if n in GRAMS:
            last = np.maximum(end + 2 - n, begin - 1)
            out.append((_bucket(h ^ U(n << 48)), begin - 1, last))
    if len(begin):
        power = np.cumprod(np.concatenate([np.ones(1, U), np.full(int((end - begin).max()), _PRIME)]), dtype=U)
        place = np.arange(begin[0], len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
        inside = np.minimum(place, len(power) - 1)
        whole = np.add.reduceat(np.where(text[begin[0] :] != 0, wide[begin[0] :] * power[inside], U(0)), begin - begin[0])
        whole = _bucket(whole ^ U(99 << 48))
    else:
        whole = np.zeros(0, np.int32)
    at = np.arange(len(begin))
    out.append((whole, at, at + 1))
    return begin, out


def _word_scores(table_: np.ndarray, features) -> np.ndarray:
    """Each word's mean over its features of the table's entries."""
    total, n = 0.0, 0
    for bucket, first, last in features:
        sums = np.concatenate([[0.0], np.cumsum(table_[bucket], dtype=float)])
        total = total + sums[last] - sums[first]
        n = n + (last - first)
    return total / np.maximum(n, 1)


def _passages(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of every passage among all words, and each text's range of passages; texts without words have none."""
    pieces = -(-counts // PASSAGE)
    starts = np.cumsum(counts) - counts
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(starts, pieces) + PASSAGE * within, np.concatenate([[0], np.cumsum(pieces)])


@dataclass
class Model:
    #: Each bucket's share of the logit, its embedding times the difference of the softmax rows.
    table: np.ndarray
    bias: float
    #: Slope of the logit on the worst passage.
    scale: float

    def worst(self, column: pa.Array) -> np.ndarray:
        """What the worst passage of each text scores; 0 for texts without words."""
        text, bounds = _padded(column)
        begin, features = _features(text)
        worst = np.zeros(len(column))
        if len(begin):
            words = _word_scores(self.table, features)
            starts, own = _passages(np.diff(np.searchsorted(begin, bounds)))
            means = np.add.reduceat(words, starts) / np.diff(np.append(starts, len(words)))
            some = own[1:] > own[:-1]
            worst[some] = np.maximum.reduceat(means, own[:-1][some])
        return worst

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.scale * self.worst(column), -40, 40)))


@dataclass
class Bag:
    """A sample as numbers: n-grams of words, words of passages, passages of texts."""

    #: Bucket of each n-gram of each word that enough texts have, among `used`, and the word, in order of words.
    bucket: np.ndarray
    owner: np.ndarray
    used: np.ndarray
    #: N-grams of each word, all of them.
    size: np.ndarray
    #: Words in order, each one's passage, and begin and length of passages.
    tokens: np.ndarray
    passage: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    #: Range of each text's passages, and each passage's text.
    own: np.ndarray
    text_of: np.ndarray

    def of_passages(self, of_buckets: np.ndarray) -> np.ndarray:
        """Mean over passages of words' means of what buckets have."""
        words, out = np.zeros(len(self.size)), np.zeros(len(self.starts))
        for owner, bucket in _strides(self.owner, self.bucket):
            words[owner[0] : owner[-1] + 1] += np.bincount(owner - owner[0], of_buckets[bucket])
        words /= self.size
        for passage, tokens in _strides(self.passage, self.tokens):
            out[passage[0] : passage[-1] + 1] += np.bincount(passage - passage[0], words[tokens])
        out /= self.lengths
        return out

    def of_buckets(self, of_passages: np.ndarray) -> np.ndarray:
        """The transpose of of_passages."""
        share = of_passages / self.lengths
        words, out = np.zeros(len(self.size)), np.zeros(len(self.used))
        for passage, tokens in _strides(self.passage, self.tokens):
            words += np.bincount(tokens, share[passage], len(words))
        words /= self.size
        for owner, bucket in _strides(self.owner, self.bucket):
            out += np.bincount(bucket, words[owner], len(out))
        return out


def _strides(*arrays: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    for at in range(0, len(arrays[0]), _STRIDE):
        yield tuple(a[at : at + _STRIDE] for a in arrays)


def bagged(vocabulary: pa.Array, tokens: np.ndarray, counts: np.ndarray) -> Bag:
    """Texts of `counts` words each, at least one, given as numbers of distinct words."""
    n_words, n_texts = len(vocabulary), len(counts)
    seen = np.unique(tokens.astype(np.int64) * n_texts + np.repeat(np.arange(n_texts), counts))
    in_texts = np.bincount(seen // n_texts, minlength=n_words)
    del seen
    size, texts_of, times = np.zeros(n_words, np.int32), np.zeros(BUCKETS), np.zeros(BUCKETS, np.int64)
    for bucket, owner in _sliced(vocabulary):
        size += np.bincount(owner, minlength=n_words).astype(np.int32)
        texts_of += np.bincount(bucket, in_texts[owner], BUCKETS)
        times += np.bincount(bucket, minlength=BUCKETS)
    # Buckets that few texts have tell nothing about others.
    often = texts_of >= LEAST_TEXTS
    used = np.flatnonzero(often)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    buckets, owners = (np.empty(int(times[used].sum()), np.int32) for _ in range(2))
    at = 0
    # Found once more rather than held.
    for bucket, owner in _sliced(vocabulary):
        kept = often[bucket]
        end = at + int(kept.sum())
        buckets[at:end], owners[at:end] = place[bucket[kept]], owner[kept]
        at = end
    starts, own = _passages(counts)
    lengths = np.diff(np.append(starts, len(tokens)))
    passage = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    return Bag(buckets, owners, used, np.maximum(size, 1), tokens, passage, starts, lengths, own, np.repeat(np.arange(n_texts, dtype=np.int32), np.diff(own)))


def _sliced(vocabulary: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of words, and the words' numbers, in order of words, a slice of the words at a time."""
    for low in range(0, len(vocabulary), _WORDS):
        _, features = _features(_padded(vocabulary[low : low + _WORDS])[0])
        bucket = np.concatenate([b[_ranges(first, last)] for b, first, last in features])
        owner = np.concatenate([np.repeat(np.arange(low, low + len(first), dtype=np.int32), last - first) for _, first, last in features])
        order = np.argsort(owner, kind="stable")
        yield bucket[order], owner[order]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places from first up to last, of all pairs."""
    n = last - first
    total = int(n.sum())
    return np.repeat(first, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p


def gradients(bag: Bag, embedding: np.ndarray, rows: np.ndarray, bias: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the passages, and gradients of their weighted cross-entropy by embeddings, softmax rows and biases."""
    # The softmax needs logits less that of class 0 only, and its errors sum to zero over the classes.
    shares = embedding @ (rows[1:] - rows[0]).T
    logits = np.zeros((len(target), len(rows)), embedding.dtype)
    for k in range(1, len(rows)):
        logits[:, k] = bias[k] - bias[0] + PASSAGE * bag.of_passages(shares[:, k - 1])
    p = softmax(logits)
    del logits
    wrong = p.copy()
    wrong[np.arange(len(target)), target] -= 1
    wrong *= weight[:, None]
    back = np.zeros((len(bag.used), len(rows)), embedding.dtype)
    for k in range(1, len(rows)):
        back[:, k] = bag.of_buckets(PASSAGE * wrong[:, k])
    back[:, 0] = -back.sum(1)
    return p, back @ rows, back.T @ embedding, wrong.sum(0)


class _Adam:
    """Steps of one array, every coordinate by its own moments."""

    def __init__(self, shape: tuple[int, ...], damping: float) -> None:
        self.first, self.second, self.n, self.damping = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, damping

    def step(self, gradient: np.ndarray, rate: float) -> np.ndarray:
        """The step against a gradient, which is used up."""
        self.n += 1
        self.first *= np.float32(0.9)
        self.first += np.float32(0.1) * gradient
        gradient *= gradient
        gradient *= np.float32(0.01)
        self.second *= np.float32(0.99)
        self.second += gradient
        np.sqrt(self.second, out=gradient)
        gradient /= np.float32((1 - 0.99**self.n) ** 0.5)
        gradient += np.float32(self.damping)
        np.divide(self.first, gradient, out=gradient)
        gradient *= np.float32(rate / (1 - 0.9**self.n))
        return gradient


def embedded(bag: Bag, labels: np.ndarray, kept: np.ndarray, classes: int = 2, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings of the used buckets, softmax rows and biases, trained on the texts that are kept; all classes weigh alike."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.01, (len(bag.used), dimensions)).astype(np.float32)
    rows, bias = rng.normal(0, 0.5, (classes, dimensions)).astype(np.float32), np.zeros(classes)
    target, on = labels.astype(np.int32)[bag.text_of], kept[bag.text_of]
    sizes = np.bincount(target[on], minlength=classes)
    weight = np.where(on, 1 / (classes * np.maximum(sizes, 1))[target], 0.0)
    share = np.ones(len(target))
    of_embedding, of_rows = _Adam(embedding.shape, DAMPING), _Adam(rows.shape, 1e-12)
    for step in range(1, rounds + 1):
        p, g_embedding, g_rows, g_bias = gradients(bag, embedding, rows, bias, target, weight * share)
        if step in (rounds // 4, rounds // 2, 3 * rounds // 4):
            # A text's passages count by how much they look like its label against the one that does most, but for those of label 0.
            own = p[np.arange(len(target)), target]
            share = np.where(target > 0, own / np.maximum.reduceat(own, bag.own[:-1])[bag.text_of], 1.0)
        rate = RATE * (1 + np.cos(np.pi * step / rounds)) / 2
        embedding -= of_embedding.step(g_embedding, rate)
        rows -= of_rows.step(g_rows, 0.1 * rate)
        del g_embedding
        bias -= rate * np.clip(4 * g_bias, -1, 1)
    return embedding, rows, bias


def trained(texts: list[str], labels: np.ndarray) -> Model:
    """A model of texts and their labels, 0 or 1."""
    return _trained(*_encoded(pa.array(texts, pa.string())), np.asarray(labels))


def _encoded(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, the texts as their numbers, and the number of words of each text."""
    text, bounds = _padded(column)
    begin, end = _spans(text)
    # Words end at a 0, so splitting all padded text at it gives them in order.
    words = pa.array([w for w in text.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split("\0") if w], pa.string()) if len(begin) else pa.array([], pa.string())
    coded = words.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, np.int32), np.diff(np.searchsorted(begin, bounds))


def _trained(vocabulary: pa.Array, tokens: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
    labels = labels.astype(int)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0)
    some = counts > 0
    labels, counts = labels[some], counts[some]
    if not len(labels) or labels.min() == labels.max():
        return _trained(vocabulary, tokens[:0], counts[:0], labels)
    bag = bagged(vocabulary, tokens, counts)
    fold = np.random.default_rng(1).permutation(len(labels)) % FOLDS
    turns = min(FOLDS, max(1, TURNS_WORDS // len(tokens)))
    tables, held = [], np.full(len(labels), np.nan)
    for turn in range(turns):
        embedding, rows, _ = embedded(bag, labels, fold != turn)
        tables.append(PASSAGE * (embedding @ (rows[1] - rows[0])))
        worst = np.maximum.reduceat(bag.of_passages(tables[-1]), bag.own[:-1])
        held[fold == turn] = worst[fold == turn]
    full = np.zeros(BUCKETS, np.float32)
    full[bag.used] = np.mean(tables, 0)
    known = ~np.isnan(held)
    return Model(full, *_calibrated(held[known], labels[known]))


def _calibrated(x: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic function that crosses one half where the fewest are on the wrong side, in the middle of all such places."""
    order = np.argsort(x, kind="stable")
    x, labels = x[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(labels)]) + np.concatenate([np.cumsum((1 - labels)[::-1])[::-1], [0]])
    spread = x.std() + 1e-9
    # Places before, between and after the scores; equal scores have none between them.
    places = np.concatenate([[x[0] - spread], (x[1:] + x[:-1]) / 2, [x[-1] + spread / 10]])
    open_ = np.concatenate([[True], x[1:] > x[:-1], [True]])
    best = np.flatnonzero(open_ & (wrong == wrong[open_].min()))
    cut = places[best[len(best) // 2]]
    return float(-4 / spread * cut), float(4 / spread)


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, place, text -> id, label, place, size in bytes, check, distinct words, words as numbers of them; a row each."""
    for whole in batches:
        for batch in blocks(whole, "text", 2 << 20):
            out = {"id": batch.column(0), "label": batch.column(1), "place": batch.column(2), "size": [], "check": [], "words": [], "tokens": []}
            for text in batch.column(3):
                raw = text.as_buffer() or b""
                words, tokens, _ = _encoded(pa.array([text.as_py()], pa.string()))
                out["size"].append(len(raw))
                out["check"].append(zlib.crc32(raw))
                out["words"].append(words.to_pylist())
                out["tokens"].append(tokens.tolist())
            yield pa.RecordBatch.from_pydict(out, schema=_WORDED)


_WORDED = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("place", pa.float64()), ("size", pa.int64()), ("check", pa.int64()), ("words", pa.list_(pa.string())), ("tokens", pa.list_(pa.int32()))])


def learned(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled documents for which held_out, of labels, is not true."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    # A row is taken by the hash of its id; about SAMPLE of each label, whatever their number.
    place = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) / float(1 << 30)
    taken = known.where(place < F.when(F.col("label") == 1, SAMPLE / max(1, sizes.get(1, 0))).otherwise(SAMPLE / max(1, sizes.get(0, 0))))
    ids = taken.groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES // 16)
    # Some 2 * SAMPLE rows of two numbers, by construction.
    chosen = texts.join(F.broadcast(ids), "id").select("id", "label", place.alias("place"), "text")
    sample = saved(chosen.mapInArrow(_worded, "id long, label int, place double, size long, check long, words array<string>, tokens array<int>"), "toxic-sample")
    # Rows of ids that repeat are equal in place; the window runs over the sample.
    upto = Window.partitionBy("label").orderBy("place", "id", "check").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sample.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= SAMPLE_BYTES).select("id", "label", "check", "words", "tokens").toArrow()
    rows = rows.take(pa.array(np.lexsort([rows["check"].to_numpy(), rows["id"].to_numpy()]))).combine_chunks()
    words, tokens, marks = _flat(rows["words"]), _flat(rows["tokens"]), rows["label"].to_numpy()
    del rows
    coded = words[0].dictionary_encode()
    # A token's number among all distinct words: that of its text's word.
    number = np.asarray(coded.indices, np.int32)[np.asarray(tokens[0]) + np.repeat(words[1], tokens[2])]
    vocabulary, counts = coded.dictionary, tokens[2]
    del words, tokens, coded
    pa.default_memory_pool().release_unused()
    return _trained(vocabulary, number, counts, marks)


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values of a list column, and begin and size of each list."""
    lists = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    return lists.flatten(), np.cumsum(sizes) - sizes, sizes


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score column, in place of one so named."""
    docs = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, text_col, 1 << 19):
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column(names.index(text_col))))], [*names, out])
        released()

    return docs.mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) == 0)
    out = scored(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """docs that score below 0.5 by a model of the labelled documents."""
    model = learned(labelled, labels, F.lit(False))
    (score,) = unused(docs, "score")
    return scored(docs, model, text_col, score).where(F.col(score) < 0.5).drop(score)
