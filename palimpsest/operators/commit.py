"""Folding candidates into revisions, in a defined order.

A batch is ordered by (created_at, candidate_id). Within a scope and semantic key candidates are applied one after another to the
record as it stands. Outcomes, the first that holds:

    suppressed         a create for a key that exists
    not_found          a mutation of a record that does not exist, or of a memory that has no head
    scope_mismatch     a mutation of a memory of another scope
    conflict           a base revision that is not the current one
    identity_changed   another class, kind, type or key than the memory has
    error              a restore of what is active, or another mutation of what is not
    accepted           takes the next revision and the next sequence number of its scope

Keys do not touch each other, so a task folds one key after another with one state (folds.in_order), and sequence numbers are given to
the accepted rows of a scope afterwards.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.canon import candidate_fingerprint, joined_id
from palimpsest.operators.folds import in_order
from palimpsest.operators.records import sequenced

OPERATIONS = ("create", "update", "merge", "tombstone", "restore")
#: What a mutation may not change, beside the key.
IDENTITY = ("memory_class", "memory_kind", "memory_type")


def ingested(candidates: DataFrame, bases: DataFrame) -> DataFrame:
    """Candidates with defaults from the base record, their fingerprint, key, and the first problem, if any."""
    b = bases.select("memory_id", F.col("semantic_key").alias("__key"), F.col("memory_type").alias("__type"))
    c = candidates.join(b, "memory_id", "left")
    kind = F.coalesce("memory_type", "__type", F.lit("general_fact"))
    fingerprint = candidate_fingerprint(ns=F.col("ns"), memoryType=kind, proposedText=F.col("text"), memoryId=F.col("memory_id"))
    key = F.coalesce("semantic_key", "__key", F.concat(F.lit("exact:"), fingerprint))
    problem = (
        F.when(~F.col("op").isin(*OPERATIONS), "operation")
        .when((F.col("op") == "create") & F.col("base_revision").isNotNull(), "create_with_base")
        .when((F.col("op") != "create") & (F.col("memory_id").isNull() | F.coalesce(F.col("base_revision") < 1, F.lit(True))), "mutation_without_base")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "text")
        .when(~F.col("confidence").between(0.0, 1.0), "confidence")
        .when(F.col("valid_until") < F.col("valid_from"), "validity")
    )
    return c.withColumns({"memory_type": kind, "fingerprint": fingerprint, "semantic_key": key, "problem": problem}).drop("__key", "__type")


def _step(c: dict | None, state: dict | None) -> tuple[dict | None, list[dict]]:
    if c is None:
        return None, []
    revision, status = (state["revision"], state["status"]) if state else (c["__revision"] or 0, c["__status"])
    create = c["op"] == "create"
    if create and revision:
        outcome = "suppressed"
    elif not create and (not revision or c["__against"] == "not_found"):
        outcome = "not_found"
    elif not create and c["__against"] == "scope_mismatch":
        outcome = "scope_mismatch"
    elif not create and c["base_revision"] != revision:
        outcome = "conflict"
    elif not create and c["__against"]:
        outcome = c["__against"]
    elif c["op"] == "restore" and status == "active" or c["op"] in ("update", "merge", "tombstone") and status != "active":
        outcome = "error"
    else:
        outcome, revision, status = "accepted", revision + 1, "tombstoned" if c["op"] == "tombstone" else "active"
    names = ("ns", "semantic_key", "candidate_id")
    return {"revision": revision, "status": status}, [{n: c[n] for n in names} | {"outcome": outcome, "revision": revision, "status": status or "absent"}]


def _against(candidates: DataFrame, heads: DataFrame) -> DataFrame:
    """candidates with __against: what a mutation that names a memory has against that memory's head, as it was before the batch."""
    if "memory_id" not in candidates.columns or "memory_id" not in heads.columns:
        return candidates.withColumn("__against", F.lit(None).cast("string"))
    kept = [c for c in IDENTITY if c in candidates.columns and c in heads.columns]
    h = heads.select("memory_id", F.col("ns").alias("__ns"), F.col("semantic_key").alias("__key"), *(F.col(c).alias(f"__{c}") for c in kept), F.lit(True).alias("__known"))
    changed = reduce(or_, (~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in kept), ~F.col("semantic_key").eqNullSafe(F.col("__key")))
    against = F.when(F.col("__known").isNull(), "not_found").when(F.col("__ns") != F.col("ns"), "scope_mismatch").when(changed, "identity_changed")
    out = candidates.join(h, "memory_id", "left").withColumn("__against", F.when((F.col("op") != "create") & F.col("memory_id").isNotNull(), against))
    return out.drop("__ns", "__key", "__known", *(f"__{c}" for c in kept))


def folded(candidates: DataFrame, heads: DataFrame, changes: DataFrame, high_water: DataFrame) -> DataFrame:
    """candidates (ns, semantic_key, candidate_id, created_at, idempotency_key, op, base_revision) with outcome, revision, status, commit_seq.

    heads: ns, semantic_key, revision, status. Where candidates name a memory_id and heads have them, scope and identity are checked against it; the
    fold still goes by key. Candidates whose idempotency key is in changes are replays and keep nothing new.
    """
    replayed = changes.select("ns", "idempotency_key").distinct()
    fresh = candidates.join(replayed, ["ns", "idempotency_key"], "left_anti")
    at = heads.select("ns", "semantic_key", F.col("revision").cast("long").alias("__revision"), F.col("status").alias("__status"))
    rows = _against(fresh, heads).join(at, ["ns", "semantic_key"], "left")
    # A mutation of a memory under a key that it has not is folded with its own key, where there may be no record.
    rows = rows.select("ns", "semantic_key", "created_at", "candidate_id", "op", F.col("base_revision").cast("long").alias("base_revision"), "__revision", "__status", "__against")
    done = in_order(rows, ["ns", "semantic_key"], ["created_at", "candidate_id"], _step, "ns string, semantic_key string, candidate_id string, outcome string, revision long, status string")
    out = fresh.join(done, ["ns", "semantic_key", "candidate_id"])
    accepted = sequenced(out.where("outcome = 'accepted'"), high_water, ["ns"], "created_at", "candidate_id")
    return accepted.unionByName(out.where("outcome <> 'accepted'").withColumn("commit_seq", F.lit(None).cast("long")))


def change_rows(committed: DataFrame) -> DataFrame:
    """Feed rows of accepted candidates."""
    return committed.where("outcome = 'accepted'").select("ns", "commit_seq", "semantic_key", "revision", "op", "idempotency_key", joined_id("evt_", F.col("ns"), F.col("commit_seq").cast("string"), length=32).alias("event_id"))


def united_evidence(evidence: DataFrame) -> DataFrame:
    """(memory_id, pos, source_type, source_ref, note): each reference once, where it first stood, with its last note."""
    key = Window.partitionBy("memory_id", "source_type", "source_ref")
    rows = evidence.withColumns({"first_pos": F.min("pos").over(key), "last": F.max("pos").over(key)})
    return rows.where("pos = last").select("memory_id", "source_type", "source_ref", "note", "first_pos")
