import duckdb

from palimpsest.operators import records
from palimpsest.plans import catalog

from .conftest import duck_rows, normal


def test_pages_take_each_row_once_where_records_tie(spark):
    df = spark.createDataFrame([("p", "m1" if i < 2 else "m2", i) for i in range(12)], "provider string, memory_id string, settled_at long").repartition(4)
    key, seen, cursor = ["provider", "memory_id", "settled_at"], [], ["p", "m1"]
    while cursor:
        rows = records.page(df, key, cursor, 3).collect()
        seen += [r.settled_at for r in rows]
        cursor = [rows[-1][k] for k in key] if rows and rows[-1].has_more else None
    assert seen == list(range(2, 12))


def test_materialization_page_is_the_same_in_any_order_of_rows(spark, tmp_path):
    """Six rows a record: the page cuts through ties, which are in order of settlement however the table lies."""
    sql = catalog.ORACLES["materialization_page"].replace("ORDER BY provider, memory_id LIMIT", "ORDER BY provider, memory_id, settled_at LIMIT")
    assert sql != catalog.ORACLES["materialization_page"]
    got = []
    for order in ("s_suppkey", "s_suppkey DESC", "hash(s_suppkey)"):
        folder = tmp_path / order.replace("(", "_")
        folder.mkdir()
        duckdb.sql(f"COPY (SELECT CAST(i AS BIGINT) AS s_suppkey FROM range(1, 1001) r(i) ORDER BY {order.replace('s_suppkey', 'i')}) TO '{folder}/supplier.parquet'")
        got.append(normal(catalog.QUERIES["materialization_page"](spark, str(folder)).toPandas()))
        assert got[-1] == normal(duck_rows(sql, folder))
    assert got[0] == got[1] == got[2]
