"""Words of Arrow string columns and their 64-bit hashes, found on the UTF-8 buffer with numpy."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at once; a longer text is cut between two words.
PIECE = 1 << 20
_BASE = U(0x9E3779B97F4A7C15)
_POW = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1 at least, modulo 2**64."""
    global _POW
    if len(_POW) < n:
        _POW = np.cumprod(np.concatenate([np.ones(1, U), np.full(2 * n, _BASE, U)]), dtype=U)
    return _POW


class Alphabet:
    """The bytes that make words; A-Z count as a-z."""

    def __init__(self, is_word) -> None:
        self.mask = np.array([bool(is_word(b)) for b in range(256)])
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        values = _rng_values()
        self.values = np.where(self.mask, values[self.lower], U(0))


def _rng_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)


#: [^\x20\x09-\x0D]+
NON_SPACE = Alphabet(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased
ALNUM = Alphabet(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(29))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def hashed_words(buf: np.ndarray, offs: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte and hash of every word, and each text's range in them (one more entry than texts)."""
    starts, hashes, at, n = [], [], 0, len(buf)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            cut = int(offs[np.searchsorted(offs, end, "right") - 1])
            if cut > at:
                end = cut
            else:  # one long text: cut before a byte that no word has
                while end < n:
                    gap = np.flatnonzero(~alphabet.mask[buf[end : end + PIECE]])
                    if len(gap):
                        end += int(gap[0])
                        break
                    end = min(n, end + PIECE)
        part = buf[at:end]
        word = alphabet.mask[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        own = offs[np.searchsorted(offs, at) : np.searchsorted(offs, end)] - at
        first[own] = word[own]
        s = np.flatnonzero(first)
        if len(s):
            lens = np.diff(np.append(s, len(part)))
            rel = np.arange(s[0], len(part)) - np.repeat(s, lens)
            v = alphabet.values[part[s[0] :]] * powers(int(lens.max()) + 1)[rel]
            hashes.append(mixed(np.add.reduceat(v, s - s[0])))
            starts.append(s + at)
        at = end
    st = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return st, np.concatenate(hashes) if hashes else np.zeros(0, U), np.searchsorted(st, offs)


def released() -> None:
    """Gives memory that a worker holds but does not use back to the machine, where the C library can; other stages reuse the worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def blocks(batch: pa.RecordBatch, text: str, most: int = 2 << 20):
    """The batch in slices of about `most` bytes of text each, a single row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.cumsum(np.diff(buffers(column)[1]))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end
