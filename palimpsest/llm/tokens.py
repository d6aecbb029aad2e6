"""Exact encoding with the tokenizers library, each distinct run of text once.

A byte-level tokenizer cuts a text before every lone space and newline that stands between two other characters, and before
a mark that ends a word, and encodes the parts by themselves. So a text's ids are those of its parts joined. All
parts of a batch are found and hashed on its UTF-8 buffer (two hashes of 64 bits, so that a part is never taken for
another); each distinct one is encoded once and kept, and ids are gathered with numpy. Texts with other white space,
runs of it, or special tokens are cut only where this holds, one by one.

Tokenizers of any other kind, of which this is not known to hold, encode each text whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from .words import U, buffers, mixed, powers

#: Parts kept for reuse in one Python worker, about 200 MB; beyond, the worker starts anew.
KEPT = 1_000_000
#: Bytes of text of one pass.
PASS = 1 << 20
#: Other white space than spaces and newlines.
_OTHER = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_MARKS = ".,;:!?"
#: Letters below stand for themselves in every version of Unicode's tables.
_LATIN = "\u0250"


def _byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def cuts_exactly(tokenizer) -> bool:
    """Whether a tokenizer is known to encode the parts of a text by themselves: byte-level pairs, nothing done before, special tokens that begin with "<|"."""
    j = json.loads(tokenizer.to_str())
    model, split = j["model"], j.get("pre_tokenizer") or {}
    plain = not any(j.get(k) for k in ("normalizer", "truncation", "padding")) and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    pairs = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    letters = pairs and all(c in model["vocab"] for c in _byte_letters())
    return bool(plain and letters and all(t["content"].startswith("<|") and not t.get("normalized") for t in j.get("added_tokens", [])))


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cuts = cuts_exactly(self.tokenizer)
        self.letters = _byte_letters()
        self.blank, self.newline = self.letters[32], self.whole("\n")
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self._forget()

    def _forget(self) -> None:
        #: Number of each part, and where its ids begin and end in one array.
        self.number: dict[bytes, int] = {}
        self.ends = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def part(self, part: bytes) -> list[int]:
        """Of a part; one of a space or newline and letters comes straight from the model, for the tokenizer cuts it nowhere else."""
        text = part.decode()
        word = text[1:]
        if word.isalpha() and (text[0] == " " or text[0] == "\n"):
            if not word.isascii():
                if max(word) >= _LATIN:
                    return self.whole(text)
                letters = self.letters
                word = "".join([letters[b] for b in part[1:]])
            if text[0] == " ":
                return [t.id for t in self.model.tokenize(self.blank + word)]
            return self.newline + [t.id for t in self.model.tokenize(word)]
        return self.whole(text)

    def _keep(self, parts: list[bytes]) -> None:
        n, flat, ends = len(self.number), [], []
        begin = int(self.ends[n])
        for part in parts:
            flat += self.part(part)
            ends.append(begin + len(flat))
        while n + len(parts) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
        while begin + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[begin : begin + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(parts)] = ends
        self.number.update(zip(parts, range(n, n + len(parts))))

    def one(self, text: str) -> np.ndarray:
        """Ids of a text by itself."""
        if not text:
            return np.zeros(0, np.uint32)
        if not self.cuts or any(s in text for s in self.specials):
            return np.array(self.whole(text), np.uint32)
        return np.concatenate([np.array(self.whole(p), np.uint32) for p in _CUT.split(text)])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column, and each text's range."""
        buf, offs = buffers(column)
        out, counts, at = [], np.zeros(len(offs) - 1, np.int64), 0
        while at < len(counts):
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + PASS, "right")) - 1)
            ids, n = self._pass(buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at])
            out.append(ids)
            counts[at:end] = n
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def _pass(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(offs) - 1, np.int64)
        if not len(buf):
            return np.zeros(0, np.uint32), counts
        odd = _odd_texts(buf, offs) if self.cuts else np.ones(len(counts), bool)
        if odd.any():  # one by one; the others as they are
            pieces = []
            for i in range(len(counts)):
                part = buf[offs[i] : offs[i + 1]]
                if odd[i]:
                    pieces.append(self.one(part.tobytes().decode()))
                else:
                    pieces.append(self._pass(part, np.array([0, len(part)]))[0])
                counts[i] = len(pieces[-1])
            return np.concatenate(pieces), counts
        begin = _parts(buf, offs)
        size = np.diff(np.append(begin, len(buf)))
        place = np.arange(len(buf)) - np.repeat(begin, size)
        weight = powers(int(size.max()))[place]
        first, second = (mixed(np.add.reduceat(table[buf] * weight, begin) ^ size.astype(U)) for table in _TABLES)
        _, sample, which = np.unique(first, return_index=True, return_inverse=True)
        if not (second[sample][which] == second).all():  # two parts of one hash: tell them apart by both
            _, sample, which = np.unique(np.stack([first, second], 1), axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
        if len(self.number) + len(sample) > KEPT:
            self._forget()
        raw = buf.tobytes()
        parts = [raw[a:b] for a, b in zip(begin[sample].tolist(), (begin + size)[sample].tolist())]
        found = list(map(self.number.get, parts))
        first_new = len(self.number)
        self._keep([p for p, n in zip(parts, found) if n is None])
        numbers = np.array([-1 if n is None else n for n in found])
        numbers[numbers < 0] = np.arange(first_new, len(self.number))
        starts = self.ends[numbers]
        lengths = self.ends[numbers + 1] - starts
        lengths, starts = lengths[which], starts[which]
        upto = np.cumsum(lengths)
        ids = self.ids[np.arange(int(upto[-1])) + np.repeat(starts - (upto - lengths), lengths)]
        bounds = np.searchsorted(begin, offs)
        total = np.concatenate([[0], upto])
        return ids, total[bounds[1:]] - total[bounds[:-1]]


_TABLES = tuple(np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1) for seed in (31, 37))
_ENDS = np.isin(np.arange(256), [ord(m) for m in _MARKS])
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
#: Bytes of white space that is neither space nor newline, and first bytes of such characters.
_LONE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_WIDE = tuple(c.encode() for c in _OTHER if ord(c) > 127)


def _odd_texts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts with white space other than lone spaces and newlines between two other characters, or that may hold a special token."""
    space = (buf == 32) | (buf == 10)
    bad = _LONE[buf]
    bad[:-1] |= space[:-1] & space[1:]
    bad[:-1] |= (buf[:-1] == 60) & (buf[1:] == 124)
    for c in _WIDE:
        m = len(buf) - len(c) + 1
        if m > 0 and (head := buf[:m] == c[0]).any():
            for j in range(1, len(c)):
                head &= buf[j : j + m] == c[j]
            bad[:m] |= head
    some = offs[:-1] < offs[1:]
    odd = np.zeros(len(some), bool)
    odd[some] = space[offs[:-1][some]] | space[offs[1:][some] - 1]
    at = np.flatnonzero(bad)
    odd[np.searchsorted(offs, at, "right") - 1] = True
    return odd


def _parts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Begins of parts: texts, spaces, newlines, and marks that end a word of ASCII or Latin-1 letters or digits."""
    begin = (buf == 32) | (buf == 10)
    space = begin.copy()
    last = np.append(space[1:], True)  # the next byte is a space, or the text ends
    first = offs[:-1][offs[:-1] < offs[1:]]
    last[first[1:] - 1] = True
    word = _ALNUM[buf]
    word[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    begin[1:] |= _ENDS[buf[1:]] & last[1:] & word[:-1]
    begin[first] = True
    return np.flatnonzero(begin)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own; loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
