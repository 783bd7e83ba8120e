"""Source trees as tables: text files, fingerprints and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.storage import settle


def text_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(file, text) of the files under a root."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def fingerprints(spark: SparkSession, root: str, glob: str = "*", before: DataFrame | None = None) -> DataFrame:
    """(path, modified, size, sha256) of the files under a root.

    before holds earlier fingerprints: a file of the same time and size keeps its digest, and contents
    are read from the oldest of the other files on only (the reader skips older ones).
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    listed = rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    if before is None:
        return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    kept = listed.join(before.select("path", "modified", "size", "sha256"), ["path", "modified", "size"])
    new = listed.join(kept.select("path"), "path", "left_anti")
    oldest = new.agg(F.min("modified")).first()[0]
    if oldest is None:
        return kept
    read = rows.where(F.col("modificationTime") >= F.lit(oldest)).select("path", F.sha2("content", 256).alias("sha256"))
    return kept.unionByName(new.join(read, "path").select(*kept.columns))


def persist_fingerprints(found: DataFrame, folder: str) -> None:
    """Writes fingerprints to a folder for the next scan; what found was made from may lie there."""
    settle(found, "fingerprints").write.mode("overwrite").parquet(folder)


def properties(files: DataFrame) -> DataFrame:
    """(file, key, value) of `key=value` or flat `key: value` lines; comments left out."""
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).where(~F.trim("line").rlike("^[#!]|^$"))
    key = F.trim(F.regexp_extract("line", r"^\s*([^=:\s][^=:]*?)\s*[=:]", 1))
    value = F.trim(F.regexp_extract("line", r"^[^=:]*[=:](.*)$", 1))
    return lines.select("file", "at", key.alias("key"), value.alias("value")).where("key <> ''").groupBy("file", "key").agg(F.max_by("value", "at").alias("value"))
