"""Records as a property graph: typed nodes and edges, their reverse, and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.patterns import nfkc


def edges(records: DataFrame) -> DataFrame:
    """src, type, dst of active records (memory_id, memory_type, memory_class, memory_kind, speaker, sources), each once, and reversed."""
    to = lambda kind, value: F.concat(F.lit(f"{kind}:"), value)
    edge = lambda t, dst, test=F.lit(True): F.when(test, F.struct(F.lit(t).alias("type"), dst.alias("dst")))
    own = F.array(
        edge("concerns", to("memory-type", F.col("memory_type"))),
        edge("concerns", to("memory-class", F.col("memory_class"))),
        edge("related_to", to("memory-kind", F.col("memory_kind"))),
        edge("concerns", to("speaker", F.col("speaker")), ~F.col("speaker").isin("unknown", "mixed")),
        edge("belongs_to_project", to("project", F.col("memory_kind")), F.col("memory_type") == "project_state"),
    )
    derived = F.transform("sources", lambda s: F.struct(F.lit("derived_from").alias("type"), to("source", s).alias("dst")))
    rows = records.where("status = 'active'").select(F.concat(F.lit("memory:"), F.col("memory_id")).alias("src"), F.explode(F.concat(F.array_compact(own), derived)).alias("e"))
    forward = rows.select("src", "e.type", "e.dst").distinct()
    back = forward.select(F.col("dst").alias("src"), F.when(F.col("type") == "derived_from", "supports").otherwise(F.col("type")).alias("type"), F.col("src").alias("dst"))
    return forward.unionByName(back)


def nodes(edge_rows: DataFrame) -> DataFrame:
    """id, kind, out_degree of every node."""
    return edge_rows.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree")).withColumn("kind", F.substring_index("id", ":", 1))


def dangling(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Edges that lead to no node."""
    return edge_rows.join(node_rows.select(F.col("id").alias("dst")), "dst", "left_anti")


def file_changes(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """path, change: written, unchanged or removed, by path and hash."""
    d, e = desired.select("path", F.col("hash").alias("__new")), existing.select("path", F.col("hash").alias("__old"))
    change = F.when(F.col("__new").isNull(), "removed").when(F.col("__new").eqNullSafe(F.col("__old")), "unchanged").otherwise("written")
    return d.join(e, "path", "full").select("path", change.alias("change"))


def title(text, fallback: str):
    """The first sentence, shortened to 69 characters and an ellipsis beyond 72."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    sentence = F.trim(F.split(flat, "[。！？.!?]", 2)[0])
    sentence = F.when(sentence == "", fallback).otherwise(sentence)
    return F.when(flat == "", fallback).otherwise(F.when(F.length(sentence) > 72, F.concat(F.substring(sentence, 1, 69), F.lit("…"))).otherwise(sentence))


def node_slug(key):
    """A readable id of a node: letters and digits of its key joined by hyphens, 48 characters at most, and eight digits of its hash."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(nfkc(key)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    short = F.substring(plain, 1, 48)
    return F.concat_ws("-", F.when(short == "", "node").otherwise(short), F.substring(F.sha2(key, 256), 1, 8))


def notes(edges: DataFrame) -> DataFrame:
    """id, kind, body: a note for each node, its edges as lines in order of type and target. Order is that of code points."""
    line = F.concat(F.lit("- "), "type", F.lit(": [["), "dst", F.lit("]]"))
    lines = edges.groupBy("src").agg(F.array_sort(F.collect_set(F.struct("type", "dst", line.alias("line")))).alias("lines"))
    return lines.select(F.col("src").alias("id"), F.substring_index("src", ":", 1).alias("kind"), F.array_join(F.col("lines")["line"], "\n").alias("body"))
