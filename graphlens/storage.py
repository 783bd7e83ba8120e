"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset, a temporary folder locally and the warehouse on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = tempfile.mkdtemp(prefix="graphlens-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df, in partitions of a column if given, and reads it back.

    Loops stay short in lineage and survive lost executors.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if by:
        # a task writes the rows of one value: few files each, and a large value is dealt over several tasks
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """Writes df in buckets of a column, as many as a shuffle has partitions, and reads it back.

    A join on that column then shuffles the other side only, however often it is joined.
    """
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(table)
    return spark.table(table)
