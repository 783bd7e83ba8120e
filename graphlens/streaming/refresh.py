"""Streaming refresh: node facts arrive as files and fold into the graph's fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlens.model import FACT, fold_nodes


def fact_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Facts (model.FACT) as JSON lines, in the files that appear in a folder."""
    return spark.readStream.schema(FACT).json(folder)


def append_facts(facts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch once to the fact table, partitioned by batch so that a repeat replaces it."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_nodes(spark: SparkSession, table: str) -> DataFrame:
    """The nodes that all facts so far give."""
    return fold_nodes(spark.read.parquet(table).drop("batch"))


def topics(facts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Events of each batch of facts as JSON lines in a folder for each topic: graph-updates and analysis-progress."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        updates = rows.select(F.to_json(F.struct(F.lit(number).alias("batch"), "id", "type")).alias("value"), F.lit("graph-updates").alias("topic"))
        counts = rows.groupBy("type").agg(F.count("*").alias("facts"))
        steps = counts.select(F.to_json(F.struct(F.lit(number).alias("batch"), "type", "facts")).alias("value"), F.lit("analysis-progress").alias("topic"))
        updates.unionByName(steps).write.mode("overwrite").partitionBy("topic").text(f"{folder}/batch={number}")
        rows.unpersist()

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(facts: DataFrame) -> DataFrame:
    """Facts per type and source file so far, a streaming aggregate."""
    return facts.groupBy("type", "source_file").agg(F.count("*").alias("facts"), F.max("seq").alias("last_seq"))
