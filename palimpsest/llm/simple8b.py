"""Simple-8b: as many ids as fit in each 64-bit word, its upper four bits telling how many.

A selector 1-14 stands for (ids, bits); selector 0 is an escape: the next word is one id of 64 bits.
Blocks hold whole documents. Their ids are first replaced by ranks of frequency within the block, so that
common ids take few bits; the block's table of ids undoes it. Layout, little-endian:

    "S8B1", u32 documents, u32 ids, u32 table entries, u32 words,
    u32 offset of each document in ids and the end, u64 table, u64 words
"""

from __future__ import annotations

import numpy as np

U = np.uint64
MAGIC = b"S8B1"
#: (ids, bits) of selectors 1 to 14.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


#: Bits of each value below 2**16.
_SHORT = np.array([max(1, v.bit_length()) for v in range(1 << 16)], np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least."""
    if len(values) and values.max() < 1 << 16:
        return _SHORT[values.astype(np.uint16)]
    out = np.ones(len(values), np.uint8)
    for b in range(1, 64):
        over = values >> U(b) != 0
        if not over.any():
            break
        out += over
    return out


def pack(values: np.ndarray) -> np.ndarray:
    """The words of the values: at each place the selector that takes most values is used."""
    values = np.ascontiguousarray(values, U)
    n = len(values)
    if not n:
        return np.zeros(0, U)
    need = np.concatenate([_bits(values), np.zeros(64, np.uint8)])
    # widest[k][i]: most bits that any of the 2**k values from i on needs.
    widest = [need]
    for k in range(6):
        last = widest[-1]
        widest.append(np.maximum(last[: len(last) - (1 << k)], last[1 << k :]))
    choice = np.zeros(n, np.uint8)
    for s in range(len(SELECTORS), 0, -1):
        count, bits = SELECTORS[s - 1]
        k = count.bit_length() - 1
        most = np.maximum(widest[k][:n], widest[k][count - (1 << k) : count - (1 << k) + n])
        np.putmask(choice, most <= bits, s)
    step = np.array([1, *(c for c, _ in SELECTORS)], np.uint8)[choice].tobytes()
    starts, i = [], 0
    add = starts.append
    while i < n:
        add(i)
        i += step[i]
    at = np.array(starts)
    chosen = choice[at]
    place = np.arange(len(at)) + np.cumsum(chosen == 0) - (chosen == 0)
    out = np.zeros(len(at) + int((chosen == 0).sum()), U)
    padded = np.concatenate([values, np.zeros(64, U)])
    for s in np.unique(chosen):
        mine = chosen == s
        if s == 0:
            out[place[mine] + 1] = values[at[mine]]
            continue
        count, bits = SELECTORS[s - 1]
        first = at[mine]
        word = np.full(len(first), int(s) << 60, U)
        for j in range(count):
            word |= padded[first + j] << U(j * bits)
        out[place[mine]] = word
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n values of the words."""
    selector = (words >> U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():  # a raw word may look like anything, so escapes are found in order
        i = 0
        for i in np.flatnonzero(selector == 0):
            if not raw[i]:
                raw[i + 1] = True
    counts = np.array([1, *(c for c, _ in SELECTORS), 0])[selector]
    counts[raw] = 0
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), U)
    for s in np.unique(selector[~raw]):
        mine = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[begin[mine]] = words[mine + 1]
            continue
        count, bits = SELECTORS[s - 1]
        mask, first, own = U((1 << bits) - 1), begin[mine], words[mine]
        for j in range(count):
            out[first + j] = (own >> U(j * bits)) & mask
    return out[:n]


def encode_block(documents: list[np.ndarray]) -> bytes:
    lengths = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate(documents).astype(U) if documents else np.zeros(0, U)
    if len(ids) and int(ids.max()) < 1 << 20:
        counts = np.bincount(ids.astype(np.int64))
        used = np.flatnonzero(counts)
        used = used[np.argsort(-counts[used], kind="stable")].astype(U)
        rank = np.zeros(len(counts), U)
        rank[used.astype(np.int64)] = np.arange(len(used), dtype=U)
        codes = rank[ids.astype(np.int64)]
    else:
        used, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.zeros(len(used), U)
        rank[order] = np.arange(len(used), dtype=U)
        codes, used = rank[inverse], used[order]
    words = pack(codes)
    head = np.array([len(documents), len(ids), len(used), len(words)], "<u4")
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u4")
    return MAGIC + head.tobytes() + offsets.tobytes() + used.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the documents and all ids of the block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n_ids, n_used, n_words = np.frombuffer(block, "<u4", 4, 4).astype(int)
    at = 20
    offsets = np.frombuffer(block, "<u4", n_docs + 1, at)
    at += 4 * (n_docs + 1)
    used = np.frombuffer(block, "<u8", n_used, at)
    words = np.frombuffer(block, "<u8", n_words, at + 8 * n_used)
    codes = unpack(words.astype(U), n_ids)
    return offsets.astype(np.int64), used[codes.astype(np.int64)] if n_ids else np.zeros(0, U)
