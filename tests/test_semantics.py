import pytest
from pyspark.sql import functions as F

from palimpsest.functions import canon, semantics
from palimpsest.functions.patterns import collapsed, matches, nfkc

TYPES = [
    ("User prefers dark mode.", "preference"),
    ("用戶偏好深色模式。", "preference"),
    ("The UI stores a dark mode preference.", "general_fact"),
    ("User asked the agent to continue.", "transient_state"),
    ("Please continue the task.", "transient_state"),
    ("Continue unless blocked, without asking me.", "preference"),
    ("The score is currently 12 moves.", "transient_state"),
    ("The review was completed on Monday.", "event"),
    ("We fixed the parser.", "project_state"),
    ("The database rejects long keys.", "technical_fact"),
    ("She showed the garden to a friend.", "event"),
]


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


@pytest.mark.parametrize("text,kind", TYPES)
def test_memory_type(one, text, kind):
    got = one.select(semantics.memory_type(F.lit(text), F.lit("fact_candidate"))).first()[0]
    assert got == kind


RELATIONS = [
    ("User prefers dark mode.", "用戶偏好深色模式。", "equivalent"),
    ("User prefers dark mode on mobile devices.", "User prefers dark mode.", "candidate_subsumes_existing"),
    ("User prefers dark mode.", "User prefers dark mode at night.", "existing_subsumes_candidate"),
    ("User prefers notifications.", "使用者不喜歡通知。", "contradicts"),
    ("User prefers notifications.", "User does not prefer notifications.", "contradicts"),
    ("User prefers dark mode.", "User prefers notifications.", "unrelated"),
    ("User prefers Vim keybindings.", "user prefers vim keybindings", "equivalent"),
]


@pytest.mark.parametrize("a,b,relation", RELATIONS)
def test_relation(one, a, b, relation):
    concept = lambda t: semantics.concept(semantics.matched_concepts(F.lit(t), F.lit("preference"), F.lit("user")))
    got = one.select(semantics.relation(F.lit(a), F.lit(b), concept(a), concept(b))).first()[0]
    assert got == relation


def test_two_concepts_are_none(one):
    row = one.select(semantics.matched_concepts(F.lit("User prefers dark mode and notifications."), F.lit("preference"), F.lit("user")).alias("m"))
    assert row.select("m", semantics.concept(F.col("m")).alias("c")).first() == (["dark_mode", "notifications"], None)


def test_word_edges_are_ascii(one):
    assert one.select(matches(F.lit("用user戶"), r"\buser\b")).first()[0]
    assert not one.select(matches(F.lit("users"), r"\buser\b")).first()[0]


def test_white_space_and_composition(one):
    assert one.select(collapsed(F.lit("　a  b\n"))).first()[0] == "a b"
    assert one.select(nfkc(F.lit("ﬁ Ａ"))).first()[0] == "fi A"


def test_quote_needs_four_characters(one):
    q = lambda raw, quote: one.select(semantics.quote_grounded(F.lit(raw), F.lit(quote).cast("string"))).first()[0]
    assert q("he said  so\nclearly", "said so clearly")
    assert not q("abc", "abc")
    assert not q("abcd", None)


def test_admission_takes_the_first_reason(one):
    def outcome(directive=False, valid=True, disposition="new", proposed="canonical_candidate", worthy=True, lasting="durable", status="observed", rewritten=False):
        lits = [F.lit(x) for x in (directive, valid, disposition, proposed, worthy, lasting, status, rewritten)]
        return one.select(semantics.admission(*lits)["outcome"]).first()[0]

    assert outcome() == "canonical_candidate"
    assert outcome(directive=True, valid=False) == "supporting_evidence_only"
    assert outcome(valid=False, disposition="duplicate") == "pending_review"
    assert outcome(disposition="duplicate") == "supporting_evidence_only"
    assert outcome(worthy=False) == "rejected"
    assert outcome(lasting="unknown") == "pending_review"
    assert outcome(lasting="transient") == "supporting_evidence_only"
    assert outcome(status="inferred") == "pending_review"
    assert outcome(rewritten=True) == "pending_review"


def test_canonical_json_and_hashes(one):
    assert one.select(canon.canonical_json(b=F.lit(1), a=F.lit(None).cast("string"))).first()[0] == '{"b":1}'
    assert one.select(canon.canonical_json(keep_nulls=True, b=F.lit(1), a=F.lit(None).cast("string"))).first()[0] == '{"a":null,"b":1}'
    assert one.select(canon.content_hash(F.lit("x"))).first()[0] == canon.stable_sha256({"text": "x"})
    assert canon.stable_json({"b": [1, {"d": 1, "c": "é"}], "a": None}) == '{"a":null,"b":[1,{"c":"é","d":1}]}'
    uuid = one.select(canon.operation_uuid(F.lit("x"))).first()[0]
    assert uuid[14] == "5" and uuid[19] in "89ab" and len(uuid) == 36


def test_identifiers(one):
    got = one.select(canon.normalized_identifiers(F.array(*map(F.lit, (" a", "b", "a ", ""))))).first()[0]
    assert got == ["a", "b"]
    kind, ref = canon.evidence_parts(F.col("e"))
    rows = one.select(F.explode(F.array(*map(F.lit, ("t:r:s", "t:", "x", " t:r")))).alias("e")).select(kind, ref).collect()
    assert [tuple(r) for r in rows] == [("t", "r:s"), (None, None), (None, None), (None, None)]
