"""Deterministic classification of statements, as column expressions.

Each rule list is tried in order; the first that holds decides. Expressions stay within the JVM's regular expressions;
only NFKC needs an Arrow batch. `known` is True where texts are ASCII, or a column that has their NFKC form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed as V
from .canon import sha256_of
from .patterns import Scanned, collapsed, matches, nfkc, replaced, scan, trimmed

PUNCTUATION = r"[\p{P}\p{S}]+"


def first_of(rules: list[tuple[Column, Column | str]], otherwise: Column | str) -> Column:
    """The value of the first rule that holds."""
    out = None
    for test, value in rules:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def normalized_text(text: Column, known: bool | Column = False) -> Column:
    return collapsed(F.regexp_replace(F.lower(nfkc(text, known)), PUNCTUATION, " "))


def canonicalized_text(text: Column, known: bool | Column = False) -> Column:
    aliased = reduce(lambda t, a: replaced(t, *a), V.ALIASES, F.lower(nfkc(text, known)))
    return collapsed(F.regexp_replace(aliased, PUNCTUATION, " "))


def semantic_tokens(text: Column, known: bool | Column = False) -> Column:
    return tokens_of(canonicalized_text(text, known))


def tokens_of(canonical: Column) -> Column:
    """semantic_tokens() from the canonicalized text, which is used often: give a column."""
    words = F.array_distinct(F.filter(F.split(canonical, " "), lambda t: (F.length(t) > 1) & ~t.isin(*V.STOP_TOKENS)))
    every_device = F.array_contains(words, "all") & (F.array_contains(words, "device") | F.array_contains(words, "devices"))
    widened = F.array_union(F.array_except(words, F.array(F.lit("devices"))), F.array(F.lit("device"), F.lit("mobile"), F.lit("desktop")))
    return F.when(every_device, widened).otherwise(words)


def durable_rule(text: Column, known: bool | Column = False) -> Column:
    """A rule of conduct that outlasts the session."""
    t = trimmed(nfkc(text, known))
    return (t != "") & matches(t, V.DURABLE_SCOPE) & matches(t, V.OPERATIONAL_BEHAVIOUR)


def one_shot_directive(text: Column, known: bool | Column = False, durable: Column | None = None) -> Column:
    """A command for the current session only."""
    t = trimmed(nfkc(text, known))
    any_of = reduce(lambda a, b: a | b, (matches(t, p) for p in V.ONE_SHOT))
    return (t != "") & ~(durable_rule(text, known) if durable is None else durable) & any_of


def explicit_preference(text: Column, known: bool | Column = False, directive: Column | None = None, durable: Column | None = None) -> Column:
    stated = reduce(lambda a, b: a | b, (matches(text, p) for p in (V.ACTOR_PREFERENCE, V.ACTOR_NEGATIVE_PREFERENCE, V.ACTOR_PREFERENCE_NOUN, V.CHINESE_PREFERENCE)))
    of_a_task = (matches(text, V.TASK_REQUEST) | matches(text, V.PREFERENCE_EXPERIMENT)) & ~matches(text, V.PREFERENCE_VERB)
    directive = one_shot_directive(text, known) if directive is None else directive
    return ~directive & ((durable_rule(text, known) if durable is None else durable) | (~of_a_task & stated))


def placement_family(text: Column, known: bool | Column = False, explicit: Column | None = None) -> Column:
    about = matches(text, V.LIVE_COMMENTARY) & matches(text, V.PLACEMENT) & matches(text, V.NARRATIVE)
    return about & ((explicit_preference(text, known) if explicit is None else explicit) | matches(text, V.INLINE_RULE) | matches(text, V.CHINESE_INLINE_RULE))


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """df with nfkc, durable, directive, explicit and placement: what the rules below share, each made once."""
    t, n = F.col(text), F.col("nfkc")
    df = df.withColumn("nfkc", nfkc(t)).withColumn("durable", durable_rule(t, n)).withColumn("directive", one_shot_directive(t, n, F.col("durable")))
    df = df.withColumn("explicit", explicit_preference(t, n, F.col("directive"), F.col("durable")))
    return df.withColumn("placement", placement_family(t, n, F.col("explicit")))


#: What scanned_signals() looks for in texts, and in their NFKC forms.
_PLAIN = tuple(
    dict.fromkeys(
        (
            *(V.ACTOR_PREFERENCE, V.ACTOR_NEGATIVE_PREFERENCE, V.ACTOR_PREFERENCE_NOUN, V.CHINESE_PREFERENCE, V.TASK_REQUEST, V.PREFERENCE_VERB, V.PREFERENCE_EXPERIMENT),
            *(V.LIVE_COMMENTARY, V.PLACEMENT, V.NARRATIVE, V.INLINE_RULE, V.CHINESE_INLINE_RULE, V.TRANSIENT, V.COMPLETED_EVENT, V.PROJECT, V.TECHNICAL, V.EVENT),
            *(V.GENERAL_NEGATIVE, V.GENERAL_POSITIVE, V.NEGATIVE_PREFERENCE, V.QUALIFIER),
            *(p for c in V.CONCEPTS for p in (*c[3], c[4]) if p),
        )
    )
)
_COMPOSED = (V.DURABLE_SCOPE, V.OPERATIONAL_BEHAVIOUR, *V.ONE_SHOT)


def scanned_signals(df: DataFrame, text: str = "text") -> tuple[DataFrame, Scanned]:
    """What signals() gives, and the text as rules may have it, from one scan; the column __scan goes with it."""
    places = {p: i for i, p in enumerate(_PLAIN)}
    df = df.withColumn("__scan", scan(F.col(text), _PLAIN, _COMPOSED)).withColumn("nfkc", F.coalesce("__scan.nfkc", text)).withColumn("__scan", F.col("__scan.bits"))
    t = Scanned(F.col(text), F.col("__scan"), places)
    n = Scanned(F.trim("nfkc"), F.col("__scan"), {p: len(_PLAIN) + i for i, p in enumerate(_COMPOSED)})
    df = df.withColumn("durable", durable_rule(t, n)).withColumn("directive", one_shot_directive(t, n, F.col("durable")))
    df = df.withColumn("explicit", explicit_preference(t, n, F.col("directive"), F.col("durable")))
    return df.withColumn("placement", placement_family(t, n, F.col("explicit"))), t


def memory_type(text: Column, candidate_type: Column, known: bool | Column = False, directive: Column | None = None, preference: Column | None = None) -> Column:
    of_candidate = [("relationship_candidate", "relationship"), ("project_state_candidate", "project_state"), ("commitment_candidate", "commitment"), ("habit_candidate", "habit"), ("event_candidate", "event")]
    rules = [
        (one_shot_directive(text, known) if directive is None else directive, "transient_state"),
        (explicit_preference(text, known) | placement_family(text, known) if preference is None else preference, "preference"),
        (matches(text, V.TRANSIENT), "transient_state"),
        (matches(text, V.COMPLETED_EVENT), "event"),
        (matches(text, V.PROJECT), "project_state"),
        (matches(text, V.TECHNICAL), "technical_fact"),
        *((candidate_type == c, t) for c, t in of_candidate),
        (matches(text, V.EVENT), "event"),
    ]
    return first_of(rules, "general_fact")


def speaker(declared: Column, producer_kind: Column) -> Column:
    return F.coalesce(declared, F.when(producer_kind.isin("user", "system"), producer_kind), F.lit("unknown"))


def epistemic_status(status: Column, kind: Column, who: Column) -> Column:
    """The status that the speaker and the type allow."""
    observer = who.isin("system", "tool")
    return first_of(
        [
            (status.isin("inferred", "synthesized", "uncertain"), status),
            ((status == "user_asserted") & (who == "user") & kind.isin("preference", "habit", "relationship"), "user_asserted"),
            (status == "user_asserted", "uncertain"),
            ((status == "system_observed") & observer, "system_observed"),
            (status == "system_observed", "uncertain"),
            (observer, "observed"),
        ],
        "uncertain",
    )


def matched_concepts(text: Column, kind: Column, who: Column, known: bool | Column = False, explicit: Column | None = None, placement: Column | None = None) -> Column:
    """Ids of all concepts that match; user preferences only."""
    found = []
    explicit = explicit_preference(text, known) if explicit is None else explicit
    placement = placement_family(text, known) if placement is None else placement
    for name, _, _, needed, barred, _ in V.CONCEPTS:
        test = explicit if needed else placement
        test = reduce(lambda a, p: a & matches(text, p), needed, test)
        if barred:
            test = test & ~matches(text, barred)
        found.append(F.when(test, F.lit(name)))
    return F.when((kind == "preference") & (who == "user"), F.array_compact(F.array(*found))).otherwise(F.array().cast("array<string>"))


def concept(matched: Column) -> Column:
    """The concept, if exactly one matches."""
    return F.when(F.size(matched) == 1, matched[0])


def _of_concept(name: Column, values: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(name == k, v) for k, v in values.items()))


def concept_key(name: Column) -> Column:
    return _of_concept(name, {c[0]: F.lit(c[1]) for c in V.CONCEPTS})


def _generic_polarity(text: Column) -> Column:
    negative = matches(text, V.NEGATIVE_PREFERENCE)
    positive = matches(replaced(text.text if isinstance(text, Scanned) else text, V.NEGATED_EXPRESSION, " "), V.POSITIVE_PREFERENCE)
    return first_of([(matches(text, V.QUALIFIER) | (negative & positive), "unknown"), (negative, "negative"), (positive, "affirmative")], "unknown")


def _pair(negative: Column, positive: Column, both: str) -> Column:
    return first_of([(negative & positive, both), (negative, "negative"), (positive, "affirmative")], "unknown")


def _placement_polarity(text: Column) -> Column:
    contrast = matches(text, V.CONTRAST)
    against_separate = matches(text, V.REJECTS_SEPARATE) | (contrast & matches(text, V.HAS_SEPARATE))
    positive, separate = matches(text, V.POSITIVE_INLINE), matches(text, V.WANTS_SEPARATE)
    return first_of(
        [
            (matches(text, V.QUALIFIER), "unknown"),
            (against_separate & matches(text, V.HAS_INLINE), "affirmative"),
            (matches(text, V.RULED_OUT_INLINE) | matches(text, V.NEGATIVE_INLINE), "negative"),
            (positive & separate & ~contrast, "unknown"),
            (positive, "affirmative"),
            (separate, "negative"),
        ],
        "unknown",
    )


def polarity(text: Column, concept_id: Column) -> Column:
    """Of a statement within its concept, or without one of any text."""
    rules = {
        "generic": _generic_polarity(text),
        "placement": _placement_polarity(text),
        "third_person": _pair(matches(text, V.THIRD_PERSON_NEGATIVE), matches(text, V.THIRD_PERSON_POSITIVE), "unknown"),
        "traditional_chinese": _pair(matches(text, V.TRADITIONAL_CHINESE_NEGATIVE), matches(text, V.TRADITIONAL_CHINESE_POSITIVE), "negative"),
    }
    negative, positive = matches(text, V.GENERAL_NEGATIVE), matches(text, V.GENERAL_POSITIVE)
    general = first_of([(negative & positive, "unknown"), (negative, "negative")], "affirmative")
    by_rule = {rule: [c[0] for c in V.CONCEPTS if c[5] == rule] for rule in rules}
    return first_of([(concept_id.isin(*names), rules[rule]) for rule, names in by_rule.items()], general)


def semantic_key(text: Column, kind: Column, memory_kind: Column, concept_id: Column, known: bool | Column = False) -> Column:
    return key_of(normalized_text(text, known), kind, memory_kind, concept_id)


def key_of(normalized: Column, kind: Column, memory_kind: Column, concept_id: Column) -> Column:
    """semantic_key() from the normalized text."""
    body = F.to_json(F.struct(memory_kind.alias("memoryKind"), kind.alias("memoryType"), normalized.alias("text")))
    # Never null, so that a join on it needs no filter, which would repeat all that the key is made of.
    return F.coalesce(concept_key(concept_id), F.concat(F.lit("semantic:"), F.sha2(body, 256)), F.lit(""))


def relation(candidate_text: Column, existing_text: Column, candidate_concept: Column, existing_concept: Column, known: bool | Column = False) -> Column:
    """How a candidate stands to the record of the same key."""
    side = lambda t, c: (normalized_text(t, known), semantic_tokens(t, known), polarity(t, c), c)
    return relation_of(side(candidate_text, candidate_concept), side(existing_text, existing_concept))


def relation_of(candidate: tuple[Column, ...], existing: tuple[Column, ...]) -> Column:
    """The same from (normalized text, tokens, polarity, concept) of either side; give columns, for each is used often."""
    (x, a, p, c), (y, b, q, d) = candidate, existing
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    loose = _of_concept(c, {k[0]: F.lit(k[2]) for k in V.CONCEPTS})
    return first_of(
        [
            (c.isNull() & d.isNull() & (x == y), "equivalent"),
            (c.isNull() | d.isNull() | (c != d) | (p == "unknown") | (q == "unknown"), "unrelated"),
            (p != q, "contradicts"),
            (within(a, b) & within(b, a), "equivalent"),
            (within(a, b), "existing_subsumes_candidate"),
            (within(b, a), "candidate_subsumes_existing"),
            (loose, "equivalent"),
        ],
        "unrelated",
    )


def durability(kind: Column, candidate_type: Column, directive: Column) -> Column:
    return first_of(
        [
            ((kind == "transient_state") | directive, "transient"),
            (candidate_type.isin("preference_candidate", "relationship_candidate", "habit_candidate"), "durable"),
            (candidate_type.isin("commitment_candidate", "project_state_candidate"), "time_bounded"),
            (candidate_type == "event_candidate", "transient"),
        ],
        "unknown",
    )


def curation_outcome(status: Column, lasting: Column) -> Column:
    derived = status.isin("inferred", "synthesized", "uncertain")
    return F.when(~derived & lasting.isin("durable", "identity_long_term"), "canonical_candidate").otherwise("supporting_evidence_only")


def quote_grounded(raw: Column, quote: Column) -> Column:
    q = collapsed(quote)
    return F.coalesce((F.length(q) >= 4) & (F.instr(collapsed(raw), q) > 0), F.lit(False))


def attribution_valid(provider: Column, basis: Column, status: Column, raw: Column, quote: Column) -> Column:
    return first_of(
        [
            (basis.isin("semantic_policy", "provider_declared"), status == provider),
            (basis == "direct_source_quote", (provider == "user_asserted") & (status == "user_asserted") & quote_grounded(raw, quote)),
            (basis == "system_record", (status == "system_observed") & (provider == "system_observed")),
            (basis == "derived", status.isin("inferred", "synthesized", "uncertain")),
            (basis == "unknown", status == "uncertain"),
        ],
        F.lit(False),
    )


def admission(directive: Column, valid: Column, disposition: Column, proposed: Column, worthy: Column, lasting: Column, status: Column, rewritten: Column) -> Column:
    """struct(outcome, reason, epistemic_status, durability, memory_worthy); reason is null where the proposal stands."""

    def decision(outcome: Column | str, reason: str | None, epistemic: Column = status, lasts: Column = lasting, is_worthy: Column = worthy) -> Column:
        return F.struct(
            (F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"),
            F.lit(reason).cast("string").alias("reason"),
            epistemic.alias("epistemic_status"),
            lasts.alias("durability"),
            is_worthy.alias("memory_worthy"),
        )

    return first_of(
        [
            (directive, decision("supporting_evidence_only", "admission:operational_directive_not_canonical", status, F.lit("transient"), F.lit(False))),
            (~valid, decision("pending_review", "admission:epistemic_attribution_not_grounded", F.lit("uncertain"))),
            (disposition == "merge_required", decision("pending_review", "admission:semantic_merge_requires_review")),
            (disposition == "duplicate", decision("supporting_evidence_only", "admission:provider_marked_duplicate")),
            (proposed != "canonical_candidate", decision(proposed, None)),
            (~worthy, decision("rejected", "admission:not_memory_worthy", status, lasting, F.lit(False))),
            (lasting == "unknown", decision("pending_review", "admission:durability_not_canonical")),
            (~lasting.isin("durable", "identity_long_term"), decision("supporting_evidence_only", "admission:durability_not_canonical")),
            (~status.isin("observed", "user_asserted", "system_observed"), decision("pending_review", "admission:derived_epistemic_requires_review")),
            (rewritten, decision("pending_review", "admission:curated_rewrite_requires_review")),
        ],
        decision("canonical_candidate", "admission:canonical_candidate_allowed", status, lasting, F.lit(True)),
    )


def governance(n_evidence: Column, n_sources: Column, status: Column) -> Column:
    """struct(action, reason) of a candidate before it is committed."""
    reason = first_of(
        [
            ((n_evidence == 0) | (n_sources == 0), "missing_grounding"),
            (status.isin("inferred", "synthesized", "uncertain"), F.concat(status, F.lit("_requires_explicit_review"))),
        ],
        "evidence_bound_candidate",
    )
    return F.struct(F.when(reason == "evidence_bound_candidate", "commit").otherwise("reject").alias("action"), reason.alias("reason"))


def promotion(memories: Column, evidence: Column, contradicting: Column, confidence: Column, status: Column, least: float = V.MIN_INSIGHT_CONFIDENCE) -> Column:
    """struct(eligible, evidence_closure, reasons) of an insight."""
    flags = [
        (F.size(memories) == 0, "promotion:no_supporting_memories"),
        (F.size(evidence) == 0, "promotion:no_supporting_evidence"),
        (confidence < least, "promotion:confidence_below_threshold"),
        (F.size(contradicting) > 0, "promotion:unresolved_contradictions"),
        (status != "accepted", "promotion:explicit_acceptance_required"),
    ]
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in flags)))
    closure = (F.size(memories) > 0) & (F.size(evidence) > 0) & (confidence >= least)
    none = F.array(F.lit("promotion:evidence_closed_and_explicitly_accepted"))
    return F.struct((F.size(reasons) == 0).alias("eligible"), closure.alias("evidence_closure"), F.when(F.size(reasons) == 0, none).otherwise(reasons).alias("reasons"))


def statement_hash(text: Column) -> Column:
    return sha256_of(text)


def reason_codes(kind: Column, who: Column, status: Column, meaning: Column, directive: Column, matched: Column) -> Column:
    """Why a statement is classified as it is: a code for each decision, a directive, and the concept or concepts that match."""
    code = lambda name, value: F.concat(F.lit(f"semantic:{name}:"), value)
    return F.array_compact(
        F.array(
            code("memory_type", kind),
            code("speaker_provenance", who),
            code("epistemic_status", status),
            code("polarity", meaning),
            F.when(directive, "semantic:lifetime:operational_directive_ephemeral"),
            F.when(F.size(matched) == 1, code("concept", F.element_at(F.concat(matched, F.array(F.lit(""))), 1))),
            F.when(F.size(matched) > 1, code("concept_ambiguous", F.array_join(matched, ","))),
        )
    )
