"""Snapshots, diffs and file fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions import meta
from graphlens.model import Graph


def diff(before: Graph, after: Graph, live: Graph | None = None) -> DataFrame:
    """(change, id): nodes and edges added, removed or changed, and impacted neighbours.

    Impacted are existing neighbours, in the live graph, of added, removed or changed nodes that
    are not changed themselves. An edge's id is `source|type|target`.
    """
    live = live or after
    a, b = (g.nodes.select("id", F.xxhash64("name", "type", meta.canonical()).alias("h")) for g in (before, after))
    both = a.join(b.toDF("id", "h2"), "id", "full")
    change = F.when(F.col("h").isNull(), "node_added").when(F.col("h2").isNull(), "node_removed").when(F.col("h") != F.col("h2"), "node_changed")
    nodes = both.select(change.alias("change"), "id").where("change is not null")
    name = F.concat_ws("|", "source_id", "type", "target_id")
    e, f = (g.edges.select(name.alias("id")).distinct() for g in (before, after))
    edges = f.join(e, "id", "left_anti").select(F.lit("edge_added").alias("change"), "id").unionByName(
        e.join(f, "id", "left_anti").select(F.lit("edge_removed").alias("change"), "id"))
    touched = nodes.select("id")
    steps = live.edges.select("source_id", "target_id").union(live.edges.select("target_id", "source_id")).toDF("id", "other")
    near = steps.join(touched, "id", "left_semi").select(F.col("other").alias("id")).distinct()
    impacted = near.join(touched, "id", "left_anti").join(live.nodes.select("id"), "id", "left_semi")
    return nodes.unionByName(edges).unionByName(impacted.select(F.lit("impacted").alias("change"), "id"))


def diff_counts(changes: DataFrame) -> DataFrame:
    """(change, n)."""
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two fingerprint tables of path, modified, size, sha256."""
    same = F.struct("modified", "size", "sha256")
    a, b = before.select("path", same.alias("a")), after.select("path", same.alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def take_snapshot(graph: Graph, folder: str, label: str) -> None:
    """Writes both tables under a label; the same label is overwritten."""
    stamp = F.current_timestamp()
    for name, rows in (("nodes", graph.nodes), ("edges", graph.edges)):
        rows.withColumn("captured_at", stamp).write.mode("overwrite").parquet(f"{folder}/{name}/label={label}")


def read_snapshot(spark, folder: str, label: str) -> Graph:
    """The graph of a label."""
    nodes, edges = (spark.read.parquet(f"{folder}/{n}/label={label}").drop("captured_at", "label") for n in ("nodes", "edges"))
    return Graph(nodes, edges)


def list_snapshots(spark, folder: str) -> DataFrame:
    """(label, captured_at, nodes, edges), the newest first."""
    parts = []
    for name in ("nodes", "edges"):
        rows = spark.read.parquet(f"{folder}/{name}").groupBy(F.col("label").cast("string").alias("label"))
        parts.append(rows.agg(F.max("captured_at").alias("captured_at"), F.count("*").alias(name)))
    return parts[0].join(parts[1].drop("captured_at"), "label", "left").orderBy(F.desc("captured_at"))
