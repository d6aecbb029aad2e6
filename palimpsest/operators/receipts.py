"""Receipts of pipeline runs, curation records, and whether raw material may be pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.semantics import first_of
from palimpsest.operators.records import latest

OUTCOMES = ("canonical_candidate", "supporting_evidence_only", "pending_review", "rejected", "duplicate")


def latest_receipts(receipts: DataFrame, source: list[str]) -> DataFrame:
    """The last receipt of each source: by time, then id."""
    return latest(receipts, source, F.col("updated_at").desc(), F.col("receipt_id").desc())


def upserted(versions: DataFrame) -> DataFrame:
    """What a sequence of writes of each receipt leaves.

    versions: receipt_id, seq, source_type, status, archive, canonical_ids. The source type is the first, status the last; the
    archive is kept once recorded; ids are united and sorted.
    """
    first_known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return versions.groupBy("receipt_id").agg(
        F.min_by("source_type", "seq").alias("source_type"),
        F.max_by("status", "seq").alias("status"),
        first_known("archive").alias("archive"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("canonical_ids")))).alias("canonical_ids"),
        F.count(F.lit(1)).alias("writes"),
    )


def rolled_up(units: DataFrame) -> DataFrame:
    """Outcome and status of every receipt from its units (receipt_id, outcome, canonical_id, exact_duplicate)."""
    n = lambda test: F.count_if(F.expr(test))
    sums = units.groupBy("receipt_id").agg(
        F.count("outcome").alias("units"),
        n("outcome = 'pending_review'").alias("pending"),
        F.count("canonical_id").alias("canonical"),
        n("exact_duplicate").alias("duplicates"),
        n("outcome = 'supporting_evidence_only'").alias("supporting"),
        n("outcome = 'rejected'").alias("rejected"),
    )
    outcome = first_of(
        [
            (F.col("pending") > 0, "pending_review"),
            (F.col("canonical") > 0, "committed"),
            (F.col("units") == 0, "no_memory_worthy_content"),
            ((F.col("duplicates") > 0) & (F.col("supporting") == F.col("units")), "superseded"),
            (F.col("rejected") == F.col("units"), "rejected"),
        ],
        "no_memory_worthy_content",
    )
    return sums.withColumns({"outcome": outcome, "status": F.when(F.col("pending") > 0, "awaiting_review").otherwise("complete")})


def coverage(units: DataFrame, proposals: DataFrame) -> DataFrame:
    """Every (receipt_id, unit_ref) of either side that is not matched one to one, with the problem."""
    u = units.groupBy("receipt_id", "unit_ref").agg(F.count(F.lit(1)).alias("units"))
    p = proposals.groupBy("receipt_id", "unit_ref").agg(F.count(F.lit(1)).alias("proposals"))
    both = u.join(p, ["receipt_id", "unit_ref"], "full").fillna(0, ["units", "proposals"])
    problem = first_of([(F.col("units") == 0, "unknown_unit"), (F.col("proposals") == 0, "missing_proposal"), (F.col("proposals") > 1, "duplicate_proposal")], F.lit(None).cast("string"))
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("receipt_id", "unit_ref", "problem")


def outcome_totals(records: DataFrame, by: list[str]) -> DataFrame:
    """One column of counts for each outcome."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def sticky(records: DataFrame) -> DataFrame:
    """The record that stands of each record_id's writes (seq): the last, but once one has a canonical id those without are ignored."""
    named = F.max(F.when(F.col("canonical_id").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("record_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    counts = records.withColumn("__ignored", (F.coalesce(named, F.lit(0)) == 1) & F.col("canonical_id").isNull()).where("NOT __ignored")
    return latest(counts.drop("__ignored"), ["record_id"], F.col("seq").desc())


def prunable(receipts: DataFrame, sources: DataFrame, retention_policy: str, admission_policy: str) -> DataFrame:
    """sources (source_id) with eligible and reasons, by the last receipt of each.

    receipts: source_id, receipt_id, updated_at, status, retention_policy, admission_policy, canonical_final, archive_checksum,
    archive_valid, coverage_complete, admission_complete, units, decisions, outcomes, pending.
    """
    r = latest_receipts(receipts, ["source_id"])
    flags: list[tuple[Column, Column | str]] = [
        (F.col("status") != "complete", F.concat(F.lit("receipt_status_"), F.col("status"))),
        (F.col("retention_policy") != retention_policy, "retention_policy_version_mismatch"),
        (F.col("admission_policy") != admission_policy, "admission_policy_version_mismatch"),
        (F.col("status") != "complete", "receipt_not_complete"),
        (~F.col("canonical_final"), "canonicalization_not_final"),
        (F.col("archive_checksum").isNull(), "raw_archive_not_recorded"),
        (~F.col("coverage_complete"), "curation_coverage_incomplete"),
        (~F.col("admission_complete"), "canonical_admission_incomplete"),
        (F.col("decisions") != F.col("units"), "curation_decision_count_mismatch"),
        (F.col("outcomes") != F.col("units"), "curation_outcome_count_mismatch"),
        (F.col("pending") > 0, "pending_review_present"),
        (F.col("archive_checksum").isNotNull() & ~F.col("archive_valid"), "raw_archive_verification_failed"),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.lit(name) if isinstance(name, str) else name) for test, name in flags)))
    reasons = F.when(F.col("receipt_id").isNull(), F.array(F.lit("no_distillation_receipt"))).otherwise(found)
    out = sources.join(r, "source_id", "left").withColumn("reasons", reasons)
    return out.select(*sources.columns, "receipt_id", (F.size("reasons") == 0).alias("eligible"), "reasons")
