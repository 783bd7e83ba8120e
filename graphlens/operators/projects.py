"""Projects: registration, listing and switching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = ("PENDING", "ANALYZING", "READY", "FAILED")


def project_id(root: Column) -> Column:
    """The first 16 digits of the root path's SHA-256."""
    return F.substring(F.sha2(root.cast("string"), 256), 1, 16)


def register(projects: DataFrame, new: DataFrame) -> DataFrame:
    """projects with the new ones (root, name) as PENDING; a known root stays as it is."""
    rows = new.select(project_id(F.col("root")).alias("id"), "name", "root", F.lit("PENDING").alias("status")).dropDuplicates(["id"])
    return projects.unionByName(rows.join(projects.select("id"), "id", "left_anti"))


def listing(projects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Projects with their node counts; nodes has project_id."""
    counts = nodes.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("nodes"))
    return projects.join(counts, "id", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)).cast("long"))


def switch(projects: DataFrame, wanted: str) -> DataFrame:
    """The project to use: only a READY one."""
    return projects.where((F.col("id") == wanted) & (F.col("status") == "READY"))
