"""Generic tables seen as tables of the record engine.

Each lens is one SELECT in SQL that Spark and DuckDB both read, so that operators and their checks start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PLUS_HOURS = {"spark": "make_dt_interval(0, CAST(floor(value) AS INT))", "duckdb": "to_hours(CAST(floor(value) AS INT))"}
_LIST = {"spark": "array", "duckdb": "list_value"}

#: Sentences for the pattern rules, to which fixture prose says nothing. Every document keeps its whole text, with one of them before or behind it.
STATEMENTS = (
    "User prefers dark mode.",
    "用戶偏好深色模式。",
    "User prefers dark mode on all devices.",
    "User prefers dark mode on mobile devices.",
    "User prefers dark mode at night.",
    "User prefers notifications.",
    "使用者不喜歡通知。",
    "User does not prefer notifications.",
    "User prefers Traditional Chinese for interactions.",
    "User prefers playing short games first.",
    "User prefers dark mode and notifications.",
    "User prefers Vim keybindings.",
    "The UI stores a dark mode preference.",
    "User asked the agent to continue.",
    "The database migration was completed on Monday.",
    "The review token expires after an hour.",
    "The score is currently 12 moves.",
    "Continue unless blocked, without asking me.",
    "Please continue the task.",
    "She showed the garden to a friend.",
)

LENSES = {
    "revisions": (
        "events",
        """SELECT concat('ns', user_id % 3) AS ns, concat('mem_', user_id) AS memory_id, concat('key_', user_id) AS semantic_key,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS revision,
        CAST(row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS BIGINT) AS commit_seq,
        CASE WHEN event_type = 'error' THEN 'tombstoned' ELSE 'active' END AS status,
        CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'create' WHEN event_type = 'error' THEN 'tombstone'
          WHEN event_type = 'signup' THEN 'restore' WHEN event_type = 'purchase' THEN 'merge' ELSE 'update' END AS op,
        event_type AS memory_kind, event_id, event_id % 97 <> 0 AS intact, ts AS valid_from, CASE WHEN event_type = 'view' THEN NULL ELSE ts + {plus_hours} END AS valid_until FROM events""",
    ),
    "outbox": (
        "events",
        """SELECT concat('out_', event_id) AS outbox_id, concat('ns', user_id % 3) AS ns, concat('mem_', user_id) AS memory_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS revision,
        CASE WHEN event_id % 10 < 6 THEN 'DONE' WHEN event_id % 10 = 6 THEN 'PROCESSING' WHEN event_id % 10 = 7 THEN 'FAILED' ELSE 'PENDING' END AS status,
        ts AS created_at, CASE WHEN event_id % 10 = 7 THEN ts + {plus_hours} END AS next_attempt_at,
        CASE WHEN event_id % 10 = 6 THEN ts + {plus_hours} END AS lease_until,
        CASE WHEN event_id % 10 = 6 THEN concat('w', event_id % 4) END AS claimed_by, CASE WHEN event_id % 10 = 6 THEN concat('t', event_id) END AS token FROM events""",
    ),
    "devices": ("customer", "SELECT c_name AS device_id, concat('ns', c_nationkey % 3) AS ns, CAST((c_custkey * 37) % 4000 AS BIGINT) AS applied FROM customer"),
    "materializations": (
        "supplier",
        """SELECT concat('p', s_suppkey % 5) AS provider, concat('mem_', s_suppkey % 150) AS memory_id, CAST(s_suppkey % 7 + 1 AS BIGINT) AS canonical_revision, s_suppkey AS settled_at,
        CASE WHEN s_suppkey % 3 = 0 THEN 'CURRENT' WHEN s_suppkey % 3 = 1 THEN 'STALE' ELSE 'FAILED' END AS outcome FROM supplier""",
    ),
    "receipts": (
        "orders",
        """SELECT concat('r', o_orderkey) AS receipt_id, concat('s', o_custkey) AS source_id, o_orderkey, o_orderdate AS updated_at,
        CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'awaiting_review' ELSE 'failed' END AS status,
        concat('v', o_orderkey % 3) AS retention_policy, concat('v', o_orderkey % 4) AS admission_policy, o_orderkey % 5 <> 0 AS canonical_final,
        CASE WHEN o_orderkey % 6 <> 0 THEN concat('c', o_orderkey) END AS archive_checksum, o_orderkey % 11 <> 0 AS archive_valid, o_orderkey % 7 <> 0 AS coverage_complete,
        o_orderkey % 9 <> 0 AS admission_complete, CAST(4 AS BIGINT) AS units, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 3 ELSE 4 END AS BIGINT) AS decisions,
        CAST(CASE WHEN o_orderkey % 17 = 0 THEN 3 ELSE 4 END AS BIGINT) AS outcomes, CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS BIGINT) AS pending FROM orders""",
    ),
    "curation": (
        "lineitem",
        """SELECT concat(l_orderkey, '-', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) AS record_id, concat('r', l_orderkey) AS receipt_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS unit_ref,
        CASE WHEN l_returnflag = 'A' THEN 'canonical_candidate' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'rejected' WHEN l_returnflag = 'R' THEN 'pending_review'
          WHEN l_linestatus = 'F' THEN 'supporting_evidence_only' ELSE 'duplicate' END AS outcome,
        CASE WHEN l_returnflag = 'A' THEN concat('mem_', l_partkey % 500) END AS canonical_id, l_returnflag = 'N' AND l_linestatus = 'F' AS exact_duplicate,
        concat('type', l_linenumber % 4) AS memory_type, CASE WHEN l_partkey % 2 = 0 THEN 'user' ELSE 'system' END AS speaker,
        CASE WHEN l_suppkey % 3 = 0 THEN 'observed' ELSE 'uncertain' END AS epistemic_status, CASE WHEN l_partkey % 5 = 0 THEN 'equivalent' WHEN l_partkey % 5 = 1 THEN 'contradicts' END AS relation,
        concat('v', l_suppkey % 2) AS policy FROM lineitem""",
    ),
    "messages": ("conversations", "SELECT conv_id AS session_id, turn AS pos, role, text FROM conversations"),
    "labelled": (
        "labels",
        """SELECT concat('case', doc_id) AS case_id, concat('rec', doc_id) AS record_id, CASE WHEN quality = 1 THEN 'canary_sample' ELSE 'pending_review' END AS kind,
        CASE WHEN doc_id % 5 = 0 THEN 'queued' ELSE 'resolved' END AS state,
        CASE WHEN doc_id % 5 = 0 THEN NULL WHEN toxic = 1 THEN 'misclassified' WHEN quality = 1 THEN 'approved_as_classified' ELSE 'invalid_candidate' END AS disposition,
        CASE WHEN toxic = 1 AND quality = 0 THEN concat('mem_', doc_id) END AS canonical_id, doc_id FROM labels""",
    ),
    "statements": (
        "documents",
        "SELECT doc_id, source, CASE WHEN doc_id % 40 < 20 THEN concat(sentence, ' ', text) ELSE concat(text, ' ', sentence) END AS text,"
        " CASE WHEN doc_id % 7 = 0 THEN 'relationship_candidate' WHEN doc_id % 7 = 1 THEN 'project_state_candidate' WHEN doc_id % 7 = 2 THEN 'commitment_candidate' WHEN doc_id % 7 = 3 THEN 'habit_candidate'"
        " WHEN doc_id % 7 = 4 THEN 'event_candidate' WHEN doc_id % 7 = 5 THEN 'preference_candidate' ELSE 'fact_candidate' END AS candidate_type,"
        " CASE WHEN doc_id % 4 = 0 THEN 'inferred' WHEN doc_id % 4 = 1 THEN 'user_asserted' WHEN doc_id % 4 = 2 THEN 'system_observed' ELSE 'observed' END AS epistemic_status,"
        " CASE WHEN doc_id % 3 = 0 THEN 'user' WHEN doc_id % 3 = 1 THEN 'system' ELSE 'agent' END AS producer FROM (SELECT doc_id, source, coalesce(text, '') AS text, CASE "
        + " ".join(f"WHEN doc_id % {len(STATEMENTS)} = {i} THEN '{s}'" for i, s in enumerate(STATEMENTS))
        + " END AS sentence FROM documents) AS said",
    ),
    "units": ("documents", "SELECT doc_id, source, text FROM documents"),
    "hits": (
        "embeddings",
        "SELECT concat('mem_', vec_id % 170) AS memory_id, vec_id AS rank, CAST(vec_id % 5 + 60 AS BIGINT) AS claimed_revision FROM embeddings",
    ),
}


def lens_sql(name: str, dialect: str = "spark") -> str:
    return LENSES[name][1].format(plus_hours=_PLUS_HOURS[dialect], list=_LIST[dialect])


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/{LENSES[name][0]}.parquet")
    return spark.sql(lens_sql(name).replace(f"FROM {LENSES[name][0]}", "FROM {source}"), source=source)


def duck(query: str, *names: str) -> str:
    """query over lenses, as DuckDB's SQL."""
    query = query.strip()
    more, body = query.startswith("+"), query.lstrip("+").lstrip()
    recursive = body.startswith("RECURSIVE ")
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({lens_sql(n, 'duckdb')})" for n in names) + (", " if more else " ") + body.removeprefix("RECURSIVE ")
