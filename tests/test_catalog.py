import pytest

from palimpsest.plans import catalog

from .conftest import duck_rows, normal


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, data, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.ORACLES:
        assert normal(got) == normal(duck_rows(catalog.ORACLES[name], data))
    else:
        assert len(got)


def test_every_query_has_sql_but_folds():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"token_relation", "window_merge", "distill_pipeline"}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_of_queries_prune_columns_and_push_filters(spark, data):
    page = physical(catalog.QUERIES["materialization_page"](spark, data))
    assert "s_acctbal" not in page and "ReadSchema: struct<s_suppkey:bigint>" in page
    for name, unread in (("high_watermark", ("props", "value:")), ("session_counters", ("text",)), ("sync_counters", ("o_totalprice", "o_orderpriority")), ("ledger_counts", ("props", "value:")), ("canary_telemetry", ("l_extendedprice:double,l_discount",))):
        schemas = [x for x in physical(catalog.QUERIES[name](spark, data)).split("ReadSchema: ")[1:]]
        assert schemas and not any(u in x.split(">")[0] for x in schemas for u in unread), name


def test_plans_of_queries_have_no_python_but_where_stated(spark, data):
    """Folds go through Arrow, as do statements that need NFKC; all other record queries stay in the JVM."""
    stated = {"commit_fold", "session_chunks", "capture_outcomes", "window_merge"}
    of_statements = {"statements", "units"}
    for name in ("verify_decisions", "federated_view", "outbox_claimable", "receipt_rollup", "graph_notes", "promotion_apply", "pilot_selection", "change_lookup", "prune_eligibility", "evidence_closure"):
        plan = physical(catalog.QUERIES[name](spark, data))
        assert name not in stated | of_statements and not any(x in plan for x in ("MapInArrow", "ArrowEvalPython", "MapInPandas", "BatchEvalPython")), name
    for name in stated:
        assert "MapInArrow" in physical(catalog.QUERIES[name](spark, data))


def test_no_query_compares_all_rows_with_all(spark, data):
    for name in sorted(set(catalog.QUERIES) - {"distill_pipeline"}):
        plan = physical(catalog.QUERIES[name](spark, data))
        # One-row tables of totals may be put side by side.
        if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
            assert name in {"namespace_summary", "canary_gate"}, name
