"""Translation of patterns to the JVM's regular expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


@cache
def jvm(pattern: str) -> str:
    """The pattern, case-insensitive, with ASCII word edges and Unicode white space."""
    body = pattern.replace(r"[\s\S]", r"[\x{0}-\x{10FFFF}]").replace(r"\s", f"[{_SPACE}]").replace(r"\b", _EDGE)
    return f"(?i){body}"


@cache
def linear(pattern: str) -> str:
    """The pattern for automata (RE2) over text whose ASCII letters are small, which finds it where jvm() does.

    They have no look-ahead: the end of a line is taken in, and so is the character that must differ, which therefore may only end a match.
    """
    body = pattern.replace(r"[\s\S]", r"[\x{0}-\x{10FFFF}]")
    if any(escape in body for escape in (r"\S", r"\W", r"\B", r"\D", "(?=", "(?<")):
        raise ValueError(f"not for automata: {pattern}")
    return body.lower().replace(r"\x{10ffff}", r"\x{10FFFF}").replace(r"\s", f"[{_SPACE}]").replace("(?!化)", r"(?:[^化]|\z)").replace("$", r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z")


class Scanned:
    """A text that was gone through before: the patterns of the scan are found in its bits, all others in the text."""

    def __init__(self, text: Column, bits: Column, places: dict[str, int]):
        self.text, self.bits, self.places = text, bits, places

    def __ne__(self, other: str) -> Column:
        return self.text != other

    def matches(self, pattern: str) -> Column:
        if pattern not in self.places:
            return self.text.rlike(jvm(pattern))
        return F.getbit(self.bits, F.lit(self.places[pattern])) == 1


#: Bytes of text that a scan holds in its several forms at a time.
_SLICE = 4 << 20


def _scan(texts: pa.Array, plain: list[str], composed: list[str]) -> pa.Array:
    bits, others, start = [], [], 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    while start < len(texts):
        end, room = start, _SLICE
        while end < len(texts) and (end == start or sizes[end] <= room):
            room -= sizes[end]
            end += 1
        part, start = texts.slice(start, end - start), end
        strings = part.to_pylist()
        same = [t is None or unicodedata.is_normalized("NFKC", t) for t in strings]
        other = [None if s else unicodedata.normalize("NFKC", t) for s, t in zip(same, strings)]
        full = part if all(same) else pa.array([t if s else o for s, t, o in zip(same, strings, other)], pa.string())
        found = pa.array([0] * len(part), pa.int64())
        sides = (pc.ascii_lower(part), plain), (pc.utf8_trim(pc.ascii_lower(full), " "), composed)
        place = 0
        for low, patterns in sides:
            for pattern in patterns:
                # Null where the text is.
                hit = pc.match_substring_regex(low, pattern).cast(pa.int64())
                found = pc.bit_wise_or(found, pc.shift_left(hit, pa.scalar(place, pa.int64())))
                place += 1
        bits.append(found)
        others.append(pa.array(other, pa.string()))
    if not bits:
        return pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], ["bits", "nfkc"])
    return pa.StructArray.from_arrays([pa.concat_arrays(bits), pa.concat_arrays(others)], ["bits", "nfkc"])


def scan(text: Column, plain: Sequence[str], composed: Sequence[str]) -> Column:
    """struct(bits, nfkc): a bit for each pattern of plain, found in text, and of composed, found in its trimmed NFKC form; that form where it differs.

    The JVM tries every alternative at every character; automata take each character once, all patterns in one Arrow batch with the composition.
    """
    if len(plain) + len(composed) > 63:
        raise ValueError("a long has no more bits")
    p, c = [linear(x) for x in plain], [linear(x) for x in composed]

    def scanner(texts: pa.Array) -> pa.Array:
        return _scan(texts.cast(pa.string()), p, c)

    return F.arrow_udf(scanner, "struct<bits: bigint, nfkc: string>")(text)


def matches(text: Column | Scanned, pattern: str) -> Column:
    return text.matches(pattern) if isinstance(text, Scanned) else text.rlike(jvm(pattern))


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, jvm(pattern), by)


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column, known: bool | Column | Scanned = False) -> Column | Scanned:
    """Compatibility composition; the JVM has no function for it, so texts go through an Arrow batch.

    known: True if all texts are ASCII, or a column that has it already, so that it is made once for many rules.
    """
    if isinstance(known, (Column, Scanned)):
        return known
    return text if known else F.pandas_udf(_composed, "string")(text)


def trimmed(text: Column | Scanned) -> Column | Scanned:
    """Without blanks at the ends; scans look at trimmed texts."""
    return text if isinstance(text, Scanned) else F.trim(text)


def collapsed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{_SPACE}]+", " "))
