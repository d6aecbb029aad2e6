"""Languages of whole texts as mixtures, by expectation-maximisation over n-gram likelihoods.

Learning counts hashed byte n-grams (1 to GRAMS, a mark at either end of a word) by language. A word's likelihood under a language
is that of its n-grams, their logarithms summed and divided by GRAMS since n-grams of several sizes overlap. A text is
taken as a draw of words from a mixture of languages; expectation-maximisation finds its proportions.
Languages are then dropped, the least first, while the penalised likelihood (Bayesian information criterion: half a
logarithm of the number of words for each language) does not fall. The prediction is the largest proportion left.

Learning reads at most SAMPLE documents of each language, about, taken by the hash of their ids where they lie; only the sample is
shuffled, its whole texts are counted on the executors and only counts by (language, bucket), bounded by BUCKETS for each language, come
to the driver. There are at most MOST_LANGUAGES languages, so the driver and a model hold 256 MB at most; a column with more values is no
language and is refused. Texts are scored where they lie, whole, all words of some MB of text at once.

Null texts, and texts without a letter, are `und` with score 0. Rows with a null language, id or text teach nothing; with no
language learned every text is `und`. Of languages with equal shares the first by name is predicted, and the last by name is
dropped first. Rows that repeat, ids that repeat and equal texts are each learned from and predicted alike. Empty tables give no
rows. Extra columns pass through, whatever their names, but for those named as the output, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table
from .words import U, Alphabet, blocks, buffers

GRAMS = 3
BUCKETS = 1 << 16
#: Documents of each language learned from, about.
SAMPLE = 2000
#: Languages, at most.
MOST_LANGUAGES = 1000
#: Share of a bucket's probability that is the same for all buckets.
SMOOTHING = 0.01
ROUNDS = 12
UNKNOWN = "und"
#: Letters of other scripts are all bytes from 0x80 on; digits and marks are not evidence of a language.
LETTERS = Alphabet(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: Words whose n-grams are looked up at once.
_STRIDE = 1 << 18


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by


def _marked(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, 0 for what is no letter, with a 0 before each text and after the last; the begin of each text."""
    n = len(offs) - 1
    out = np.zeros(len(buf) + n + 1, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), np.diff(offs))] = np.where(LETTERS.mask[buf], LETTERS.lower[buf], 0)
    return out, offs + np.arange(n + 1)


def _grams(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram of each size (columns) that begins at each place, and whether it has a letter and crosses no gap."""
    wide = text.astype(U) + U(1)
    letter = text != 0
    n = len(text)
    buckets, valid = np.zeros((GRAMS, n), np.int32), np.zeros((GRAMS, n), bool)
    h, inner, some = np.zeros(n, U), np.ones(n, bool), np.zeros(n, bool)
    for k in range(GRAMS):
        m = n - k
        h = h[:m] * U(0x100000001B3) + wide[k:]
        if k >= 2:  # what lies between the first and last byte must be letters
            inner = inner[:m] & letter[k - 1 : n - 1]
        some = some[:m] | letter[k:]
        x = h ^ U((k + 1) << 56)
        buckets[k, :m] = ((x * U(0x9E3779B97F4A7C15)) >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
        valid[k, :m] = inner[:m] & some
    return buckets, valid


@dataclass
class Model:
    languages: list[str]
    #: Logarithm of each bucket's probability by language, a last row of zeros for places without an n-gram.
    table: np.ndarray

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words by languages, and each text's range of words."""
        text, begins = _marked(*buffers(column))
        letter = text != 0
        first = np.flatnonzero(letter[1:] & ~letter[:-1])  # the mark before each word
        ranges = np.searchsorted(first, begins)
        out = np.zeros((len(first), len(self.languages)), np.float32)
        for a in range(0, len(first), _STRIDE):
            b = min(len(first), a + _STRIDE)
            low, high = int(first[a]), int(first[b]) if b < len(first) else len(text)
            # The next word's mark closes the last word here.
            part = text[low : high + 1]
            buckets, valid = _grams(part)
            at = first[a:b] - low
            for k in range(GRAMS):
                rows = np.where(valid[k], buckets[k], BUCKETS)
                rows[high - low :] = BUCKETS
                out[a:b] += np.add.reduceat(self.table[rows], at, axis=0)
        return out / GRAMS, ranges

    def mixtures(self, column: pa.Array) -> np.ndarray:
        """Texts by languages: proportions that sum to 1, or 0 for texts without words."""
        words, ranges = self.likelihoods(column)
        n, k = len(column), len(self.languages)
        counts = np.diff(ranges)
        some = np.flatnonzero(counts > 0)
        out = np.zeros((n, k))
        if not len(some) or not k:
            return out
        begins, counts = ranges[:-1][some], counts[some]
        owner = np.repeat(np.arange(len(some)), counts)
        top = words.max(1, keepdims=True)
        ratio = np.exp(words - top)

        def fitted(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            """Proportions after so many rounds and the logarithm of the likelihood (up to what all sets have alike)."""
            for _ in range(rounds):
                joint = ratio * share[owner]
                joint /= joint.sum(1, keepdims=True) + 1e-30
                share = (np.add.reduceat(joint, begins, axis=0) / counts[:, None]).astype(np.float32)
            return share, np.add.reduceat(np.log((ratio * share[owner]).sum(1) + 1e-30), begins)

        share, fit = fitted(np.full((len(some), k), 1 / k, np.float32), ROUNDS)
        penalty = 0.5 * np.log(np.maximum(counts, 2))
        open_ = (share > 0).sum(1) > 1
        while open_.any():
            # Of equal shares the last is dropped.
            least = share.shape[1] - 1 - np.where(share > 0, share, 2)[:, ::-1].argmin(1)
            smaller = share.copy()
            smaller[np.arange(len(some)), least] = 0
            smaller[~open_] = share[~open_]
            smaller /= smaller.sum(1, keepdims=True)
            smaller, less = fitted(smaller, 3)
            better = open_ & (less + penalty >= fit)
            share = np.where(better[:, None], smaller, share)
            fit = np.where(better, less, fit)
            open_ = better & ((share > 0).sum(1) > 1)
        out[some] = share
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, bucket, n; one row for each pair that the task has seen."""
    totals: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in blocks(whole, "text", 1 << 20):
            langs = batch.column(0).to_pylist()
            text, begins = _marked(*buffers(batch.column(1)))
            buckets, valid = _grams(text)
            for i, lang in enumerate(langs):
                mine = slice(int(begins[i]), int(begins[i + 1]) + 1)
                into = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for k in range(GRAMS):
                    into += np.bincount(buckets[k, mine][valid[k, mine]], minlength=BUCKETS)
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])


def learned(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the documents with a language for which held_out is not true."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out)
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32))
    place = F.pmod(F.xxhash64(F.lit(23), id_col), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(SAMPLE / sizes[lang])))), F.col(lang_col))
    sample = known.where(place < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # The scan keeps its tasks; some SAMPLE rows of each language are dealt out, a few languages' worth to a task.
    dealt = sample.repartition(max(8, 2 * len(languages)), F.xxhash64("text"))
    counts = dealt.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS rows for each language.
    rows = counts.toArrow()
    table_ = np.zeros((BUCKETS, len(languages)))
    which = np.searchsorted(languages, rows["lang"].to_numpy(zero_copy_only=False).astype(str)) if len(rows) else np.zeros(0, int)
    table_[rows["bucket"].to_numpy(), which] = rows["n"].to_numpy()
    total = np.maximum(table_.sum(0, keepdims=True), 1)
    p = (1 - SMOOTHING) * table_ / total + SMOOTHING / BUCKETS
    return Model(languages, np.concatenate([np.log(p), np.zeros((1, len(languages)))]).astype(np.float32))


def predicted(docs: DataFrame, model: Model, text_col: str = "text", mixture: bool = False) -> DataFrame:
    """docs with lang_pred and score, and with the mixture (a map of the languages in the selected set) if asked for, in place of columns so named."""
    docs = docs.drop("lang_pred", "score", *["mixture"] * mixture)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)})
    if mixture:
        added = added.withColumn("mixture", F.create_map().cast("map<string,double>"))
    out_names = added.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], object)
        for whole in batches:
            for batch in blocks(whole, text_col, 1 << 19):
                column = batch.column(batch.schema.names.index(text_col))
                shares = model.mixtures(column)
                letters = np.array(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
                shares[~letters] = 0
                score = shares.max(1, initial=0.0)
                best = np.where(score > 0, shares.argmax(1) if shares.shape[1] else 0, len(model.languages))
                columns = [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(np.minimum(score, 1.0))]
                if mixture:
                    columns.append(pa.array([[(names[j], float(s)) for j, s in enumerate(row) if s > 0] for row in shares], pa.map_(pa.string(), pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, out_names)

    return docs.mapInArrow(run, added.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    out = predicted(docs.select("doc_id", "text"), learned(docs, held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
