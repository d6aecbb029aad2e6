"""Canonical JSON, hashes and derived identifiers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\u001f"


def _sorted_struct(fields: dict) -> Column:
    """A struct of fields in order of their names, at every depth where a field is a dictionary."""
    return F.struct(*((_sorted_struct(v) if isinstance(v, dict) else v).alias(k) for k, v in sorted(fields.items())))


def canonical_json(keep_nulls: bool = False, **fields: Column | dict) -> Column:
    """JSON of the fields in order of their names, dictionaries likewise; null fields are left out unless kept."""
    options = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return F.to_json(_sorted_struct(fields), options)


def stable_json(value: object) -> str:
    """The same for a Python value, keys sorted at every depth."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_of(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def stable_sha256(value: object) -> str:
    return "sha256:" + hashlib.sha256(stable_json(value).encode()).hexdigest()


def joined_id(prefix: str, *parts: Column, length: int = 64) -> Column:
    """prefix and the first digits of the sha-256 of the parts joined by U+001F."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(UNIT, *parts), 256), 1, length))


def scope_key(*parts: Column) -> Column:
    return F.concat_ws(UNIT, *parts)


def operation_uuid(text: Column) -> Column:
    """A version 5-like UUID from the sha-256 of the text."""
    h = F.sha2(text, 256)
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def content_hash(text: Column) -> Column:
    return sha256_of(canonical_json(text=text))


def candidate_fingerprint(**fields: Column) -> Column:
    """Fingerprint of a candidate: absent fields count as null."""
    return sha256_of(canonical_json(keep_nulls=True, **fields))


def normalized_identifiers(ids: Column) -> Column:
    """Trimmed, without empties and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != ""))


def evidence_parts(evidence_id: Column) -> tuple[Column, Column]:
    """type and reference of "type:reference"; null if either is missing or has blanks around."""
    kind, ref = (F.regexp_extract(evidence_id, r"^([^:]+):([\s\S]+)$", i) for i in (1, 2))
    ok = (kind != "") & (ref != "") & (F.trim(kind) == kind) & (F.trim(ref) == ref)
    return F.when(ok, kind), F.when(ok, ref)


def state_fingerprint(**fields: Column | dict) -> Column:
    """Fingerprint of a state that is to be seen again as it was: of an admission, a review candidate or a provider's unit. Nulls count."""
    return sha256_of(canonical_json(keep_nulls=True, **fields))
