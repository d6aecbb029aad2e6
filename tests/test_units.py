"""Queries over the real text of documents against brute force, on texts that DuckDB cannot normalise."""

import hashlib
import json
import re
import unicodedata
from collections import Counter

import pytest

from palimpsest.plans import catalog
from palimpsest.sources.lens import lens

TEXTS = ["File one.", "ﬁle  ONE!", "ＦＩＬＥ one", "用戶偏好深色模式。", "用戶偏好深色模式｡", "Straße", "STRASSE", "  long \n" + "word " * 30_000, "", "¿?", "naïve", "nai\u0308ve"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("units"))
    spark.createDataFrame([(i, t, f"src{i % 2}") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").write.parquet(f"{out}/documents.parquet")
    return out


def normalized(text):
    marked = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in unicodedata.normalize("NFKC", text).lower())
    return re.sub(r"\s+", " ", marked).strip()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_units_have_the_real_text(spark, folder):
    rows = {r.doc_id: r.semantic_key for r in catalog.QUERIES["semantic_key_units"](spark, folder).collect()}
    body = lambda i, t: json.dumps({"memoryKind": f"src{i % 2}", "memoryType": "fact", "text": normalized(t)}, ensure_ascii=False, separators=(",", ":"))
    assert rows == {i: "semantic:" + sha(body(i, t)) for i, t in enumerate(TEXTS)}


def test_all_statements_have_keys(spark, data):
    texts = {r.doc_id: r for r in lens(spark, data, "statements").collect()}
    rows = {r.doc_id: r.semantic_key for r in catalog.QUERIES["semantic_key_exact"](spark, data).collect()}
    body = lambda r: json.dumps({"memoryKind": r.source, "memoryType": "fact", "text": normalized(r.text)}, ensure_ascii=False, separators=(",", ":"))
    assert rows == {i: "semantic:" + sha(body(r)) for i, r in texts.items()}
    assert any(not r.text.isascii() for r in texts.values())


def test_duplicates_of_units(spark, folder):
    keys = [sha(normalized(t)) for t in TEXTS]
    counts = Counter(keys)
    rows = {(r.doc_id, r.key, r.others) for r in catalog.QUERIES["duplicate_candidates_units"](spark, folder).collect()}
    assert rows == {(i, k, counts[k] - 1) for i, k in enumerate(keys) if counts[k] > 1} and len(rows) > 5


def test_text_match_and_titles_of_units(spark, folder):
    key = lambda t: unicodedata.normalize("NFKC", t).strip(" ").lower()
    rows = {(r.ref, r.memory_id) for r in catalog.QUERIES["normalized_text_match_units"](spark, folder).collect()}
    assert rows == {(i, f"mem_{j}") for i, t in enumerate(TEXTS) for j, m in enumerate(TEXTS) if key(t) == key(m)}
    titles = {r.doc_id: r.title for r in catalog.QUERIES["titles_units"](spark, folder).collect()}
    assert titles[7] == ("long " + "word " * 30)[:69] + "…" and titles[8] == "untitled" and titles[9] == "¿" and titles[0] == "File one"


def test_file_changes_of_units(spark, folder):
    i = range(len(TEXTS))
    new, old = {f"{'n' if k % 5 == 0 else 'p'}{k}": TEXTS[k] for k in i}, {f"{'o' if k % 3 == 0 else 'p'}{k}": None if k % 7 == 0 else TEXTS[k] for k in i}
    want = {p: "removed" if p not in new else "unchanged" if old.get(p) == new[p] else "written" for p in new | old}
    assert {r.path: r.change for r in catalog.QUERIES["file_diff_units"](spark, folder).collect()} == want
