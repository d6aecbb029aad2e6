"""Readers of session stores: SQLite files, JSONL journals, JSON snapshots. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.functions.semantics import first_of

#: What a structured message's content begins with.
STRUCTURED = "\u0000json:"
MESSAGES = "session_id string, id long, role string, content string, created_at double"
SESSIONS = "id string, source string, title string, started_at double, ended_at double"
_JOURNAL = "timestamp string, ordinal long, payload struct<type:string,role:string,content:array<struct<type:string,text:string>>>"
_SNAPSHOT = "conversationId string, revision string, status string, startedAt string, updatedAt string, messages array<struct<id:string,role:string,text:string,createdAt:string>>"


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """format("sqlite_table"): options path, table, and partitions for tables with a rowid. Files are opened read-only on the executors."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(schema, self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.columns = [f.name for f in schema.fields]
        self.texts = {f.name for f in schema.fields if f.dataType.typeName() == "string"}
        self.path, self.table, self.n = options["path"], options["table"], int(options.get("partitions", "1"))

    def _open(self):
        import sqlite3
        from urllib.parse import quote

        db = sqlite3.connect(f"file:{quote(self.path)}?mode=ro", uri=True)
        have = {row[1] for row in db.execute(f"PRAGMA table_info({self._quoted(self.table)})")}
        if missing := [c for c in self.columns if c not in have]:
            raise ValueError(f"{self.table} has no columns {missing}")
        return db

    @staticmethod
    def _quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def partitions(self) -> list[InputPartition]:
        db = self._open()
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self._quoted(self.table)}").fetchone()
        db.close()
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.n)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        db = self._open()
        # Texts come as bytes, so that those that are not UTF-8 are repaired and not refused.
        columns = ", ".join(f"CAST({self._quoted(c)} AS BLOB)" if c in self.texts else self._quoted(c) for c in self.columns)
        for row in db.execute(f"SELECT {columns} FROM {self._quoted(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.low, partition.high)):
            yield tuple(v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in row)
        db.close()


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", name).option("partitions", partitions).load()


def session_page(sessions: DataFrame, after: str | None, limit: int) -> DataFrame:
    rows = sessions if after is None else sessions.where(F.col("id") > after)
    return rows.orderBy("id").limit(limit)


def decoded_content(content: Column) -> Column:
    """Structured content as text: its parts' texts by line; what is no JSON stays as it is."""
    body = F.substring(content, len(STRUCTURED) + 1, 2**31 - 1)
    value = F.try_parse_json(body)
    kind = F.schema_of_variant(value)
    parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p).startswith("OBJECT"), "").otherwise(F.try_variant_get(p, "$", "string")), F.lit("")))
    text = first_of(
        [
            (kind.startswith("ARRAY"), F.array_join(parts, "\n")),
            (kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(value, "$.text", "string"), F.lit(""))),
        ],
        F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")),
    )
    return F.when(content.startswith(STRUCTURED) & value.isNotNull(), text).otherwise(content)


def journals(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of JSONL journals: session_id (of the path), pos, role, parts, and whether the last line is torn.

    A line that is no JSON is allowed only as the unterminated last one; elsewhere it is an error.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(folder, wholetext=True)
    files = files.select(F.sha2(F.col("_metadata.file_path"), 256).alias("session_id"), F.col("value"))
    lines = files.select("session_id", F.posexplode(F.split("value", "\n")).alias("pos", "line"), F.size(F.split("value", "\n")).alias("n"))
    rows = lines.where(F.trim("line") != "").withColumns({"torn": F.try_parse_json("line").isNull(), "r": F.from_json("line", _JOURNAL)})
    bad = F.col("torn") & (F.col("pos") < F.col("n") - 1)
    rows = rows.withColumn("torn", F.when(bad, F.raise_error(F.concat(F.lit("journal line "), F.col("pos").cast("string"), F.lit(" is no JSON")))).otherwise(F.col("torn")))
    kind = F.when(F.col("r.payload.role") == "user", "input_text").otherwise("output_text")
    parts = F.transform(F.filter("r.payload.content", lambda p: p["type"] == kind), lambda p: p["text"])
    return rows.select("session_id", F.coalesce("r.ordinal", F.col("pos").cast("long")).alias("pos"), F.when(F.col("r.payload.type") == "message", F.col("r.payload.role")).alias("role"), parts.alias("parts"), "torn")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation snapshots, a JSON object a file; a file that is none, or lacks an id, fails the read."""
    rows = spark.read.schema(_SNAPSHOT).option("mode", "FAILFAST").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("conversationId", F.when(F.col("conversationId").isNull(), F.raise_error(F.lit("a snapshot has no conversationId"))).otherwise(F.col("conversationId")))


def snapshot_problems(rows: DataFrame) -> DataFrame:
    """conversationId, problem of snapshots that break a rule."""
    ids = F.col("messages")["id"]
    problem = first_of(
        [
            (~F.col("status").isin("active", "completed", "archived"), "status"),
            (F.exists("messages", lambda m: ~F.coalesce(m["role"].isin("user", "assistant", "system", "tool"), F.lit(False))), "role"),
            (F.size(F.array_distinct(ids)) < F.size(ids), "message_id"),
            (F.try_to_timestamp("updatedAt").isNull(), "updatedAt"),
        ],
        F.lit(None).cast("string"),
    )
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("conversationId", "problem")


def coerced_timestamp(value: Column) -> Column:
    """A timestamp from seconds, from milliseconds beyond 1e10, or from text."""
    number = value.try_cast("double")
    return F.when(number > 1e10, F.timestamp_millis(number.cast("long"))).when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(F.try_to_timestamp(value.cast("string")))
