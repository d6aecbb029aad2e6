import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import readers, sinks
from palimpsest.streaming import feed


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "s.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, session_id TEXT, role TEXT, content TEXT, created_at REAL)")
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?, ?)", [(i, f"s{i % 3}", "user", f"text {i}", float(i)) for i in range(1, 50)])
    db.execute("INSERT INTO messages VALUES (99, 's9', 'user', CAST(x'ff41' AS TEXT), 0)")
    db.commit()
    db.close()
    df = readers.sqlite_table(spark, path, "messages", readers.MESSAGES, partitions=4)
    assert df.count() == 50
    assert df.where("id = 99").first().content == "�A"
    with pytest.raises(Exception, match="no columns"):
        readers.sqlite_table(spark, path, "messages", "id long, nothing string").count()
    page = readers.session_page(df.select("session_id").distinct().withColumnRenamed("session_id", "id"), "s0", 2)
    assert [r.id for r in page.collect()] == ["s1", "s2"]


def test_structured_content(spark):
    p = readers.STRUCTURED
    cases = [("plain", "plain"), (p + '[{"text":"a"},"b",{"x":1},3]', "a\nb\n\n3"), (p + '{"text":"t"}', "t"), (p + '"s"', "s"), (p + "{bad", p + "{bad")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string").coalesce(1)
    assert [r[0] for r in df.select(readers.decoded_content(F.col("c"))).collect()] == [t for _, t in cases]


def _line(role, *parts):
    return json.dumps({"timestamp": "t", "payload": {"type": "message", "role": role, "content": [{"type": "input_text" if role == "user" else "output_text", "text": p} for p in parts]}})


def test_journal_with_a_torn_tail(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text(_line("user", "hi") + "\n" + _line("assistant", "yo") + '\n{"torn')
    out = readers.journals(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.role, r.parts, r.torn) for r in out] == [("user", ["hi"], False), ("assistant", ["yo"], False), (None, None, True)]
    (tmp_path / "a" / "y.jsonl").write_text('{"torn\n' + _line("user", "hi") + "\n")
    with pytest.raises(Exception, match="no JSON"):
        readers.journals(spark, str(tmp_path)).collect()


def test_snapshots(spark, tmp_path):
    good = {"conversationId": "c1", "revision": "r", "status": "active", "updatedAt": "2026-01-01T00:00:00Z", "messages": [{"id": "1", "role": "user", "text": "x"}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"conversationId": "c2", "messages": good["messages"] * 2}))
    rows = readers.snapshots(spark, str(tmp_path))
    assert [tuple(r) for r in readers.snapshot_problems(rows).collect()] == [("c2", "message_id")]
    (tmp_path / "c.json").write_text("{bad")
    with pytest.raises(Exception):
        readers.snapshots(spark, str(tmp_path)).collect()


def test_timestamps(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000000",), ("2023-11-14T22:13:20Z",), ("x",)], "t string").coalesce(1)
    got = [r[0] for r in df.select(F.unix_timestamp(readers.coerced_timestamp(F.col("t")))).collect()]
    assert got == [1700000000] * 3 + [None]


def test_sinks_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([("a", "s1", "x"), ("a", "s1", "x"), ("a", "s2", "y")], "ns string, source_id string, content string")
    for _ in range(2):
        sinks.archive(rows, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and sinks.archive_valid(stored).where("NOT valid").count() == 0
    held = str(tmp_path / "artifacts")
    first = spark.createDataFrame([("i1", "c1")], "identity string, checksum string")
    assert sinks.put_once(first, held).count() == 0
    assert sinks.put_once(spark.createDataFrame([("i1", "c2"), ("i2", "c3")], "identity string, checksum string"), held).count() == 1
    assert spark.read.parquet(held).count() == 2


def test_checkpoint_log(spark, tmp_path):
    path = str(tmp_path / "cp")
    for v, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "2")]]):
        sinks.save_checkpoint(spark.createDataFrame(rows, "source_id string, fingerprint string"), path, v)
    assert sorted((r.source_id, r.fingerprint) for r in sinks.load_checkpoint(spark, path).collect()) == [("a", "2"), ("b", "1")]


SCHEMA = "ns string, commit_seq long, memory_id string, revision long"


def test_stream_equals_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = spark.createDataFrame([("a", i, f"m{i % 3}", i) for i in range(1, 20)], SCHEMA)
    rows.where("commit_seq < 10").coalesce(1).write.parquet(src)
    feed.replicate(feed.changes(spark, src, SCHEMA), out, cp).awaitTermination()
    rows.where("commit_seq >= 10").coalesce(1).write.mode("append").parquet(src)
    feed.replicate(feed.changes(spark, src, SCHEMA), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 19
    q = feed.heads(feed.changes(spark, src, SCHEMA)).writeStream.format("memory").queryName("heads_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.memory_id: r["head"].revision for r in spark.table("heads_now").collect()}
    assert got == {"m0": 18, "m1": 19, "m2": 17}


def test_stateful_source_diff(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "source_id string, seq long, fingerprint string"

    def run():
        stream = feed.source_changes(spark.readStream.schema(schema).parquet(src))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], schema).coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([("a", 2, "x"), ("b", 2, "y"), ("c", 2, "z")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", "new"), ("a", "unchanged"), ("b", "changed"), ("b", "new"), ("c", "new")]


def test_one_identity_is_put_once_in_a_batch(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    rows = spark.createDataFrame([("i", "b"), ("i", "a"), ("i", "a"), ("j", "c")], "identity string, checksum string")
    assert [tuple(r) for r in sinks.put_once(rows, path).collect()] == [("i", "b", "a")]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("i", "a"), ("j", "c")]


def test_changes_of_an_earlier_batch_are_not_written_again(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = spark.range(1, 11).select(F.lit("a").alias("ns"), F.col("id").alias("commit_seq"), F.lit("m").alias("memory_id"), F.col("id").alias("revision"))
    schema = "ns string, commit_seq long, memory_id string, revision long"
    for low, high in ((1, 6), (4, 10), (1, 10)):
        rows.where(F.col("commit_seq").between(low, high)).coalesce(1).write.mode("append").parquet(src)
        feed.replicate(feed.changes(spark, src, schema), out, cp).awaitTermination()
    assert sorted(r.commit_seq for r in spark.read.parquet(out).collect()) == list(range(1, 11))


def test_checkpoint_versions(spark, tmp_path):
    path = str(tmp_path / "cp")
    row = lambda f: spark.createDataFrame([("s", f)], "source_id string, fingerprint string")
    assert sinks.save_checkpoint_once(row("one"), path, 1) and sinks.save_checkpoint_once(row("two"), path, 2)
    assert not sinks.save_checkpoint_once(row("late"), path, 2)
    assert sinks.load_checkpoint(spark, path).first().fingerprint == "two"
    v = "source_id string, fingerprint string, version long"
    got = sinks.recovered_checkpoint(spark.createDataFrame([("s", "a", 1), ("t", "b", 1)], v), spark.createDataFrame([("s", "c", 2)], v)).collect()
    assert sorted(map(tuple, got)) == [("s", "c"), ("t", "b")]
