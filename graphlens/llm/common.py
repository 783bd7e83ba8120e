"""What the training-data operators share: tables, shared storage and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds after which components() gives up; the contraction needs about log2(longest chain).
MAX_ROUNDS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session takes a temporary folder and a cluster the warehouse.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        set_dir = tempfile.mkdtemp(prefix="graphlens-")
    else:
        set_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from those taken."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def utf8_bytes(text: Column) -> Column:
    """Length of a text in UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph.

    links has columns a, b of one integral type. Returns (id, root) for every id of a link, where
    root is the smallest id reachable from it. Alternates large-star and small-star contractions:
    every round is two aggregations (combined map-side) and two equi-joins that AQE can split, so
    a hub with a third of all links stays spread out. Rounds end when no edge changes.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where(F.col("hi") != F.col("lo"))
        .distinct(),
        f"{name}-edges",
    )
    mark = _fingerprint(edges)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        edges = written(_small_star(_large_star(edges)), f"{name}-edges")
        now = _fingerprint(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components of {name} did not settle in {MAX_ROUNDS} rounds")
    tips = edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("root"))
    roots = edges.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct()
    return tips.unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .where(F.col("hi") != F.col("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).where(F.col("hi") != F.col("lo")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]
