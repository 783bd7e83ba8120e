"""What resolvers share: tables of facts and access to annotations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions import meta
from graphlens.model import EDGE, FACT

#: Facts of a later stage come after those of an earlier one.
STAGE = 1 << 40


@dataclass(frozen=True)
class Facts:
    """Node facts (model.FACT) and edges (model.EDGE)."""

    nodes: DataFrame
    edges: DataFrame

    def __add__(self, other: Facts) -> Facts:
        return Facts(self.nodes.unionByName(other.nodes), self.edges.unionByName(other.edges))


def together(parts: Iterable[Facts]) -> Facts:
    return reduce(Facts.__add__, parts)


def nothing(spark) -> Facts:
    return Facts(spark.createDataFrame([], FACT), spark.createDataFrame([], EDGE))


def nodes(rows: DataFrame, node_id: Column, name: Column, kind: str | Column, stage: int, **metadata: Column) -> DataFrame:
    """Node facts. Inside a stage they are in the order of a hash of file and id: any, but always the same."""
    file = F.col("file") if "file" in rows.columns else F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    order = F.pmod(F.xxhash64(file, node_id, name), F.lit(STAGE))
    return rows.select(
        node_id.alias("id"), name.alias("name"), kind.alias("type"), (meta.pack(**metadata) if metadata else meta.empty()).alias("metadata"),
        file.alias("source_file"), (order + F.lit(stage * STAGE)).alias("seq"),
    )


def edges(rows: DataFrame, source: Column, target: Column, kind: str | Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(source.alias("source_id"), target.alias("target_id"), kind.alias("type"))


def unite(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def class_id(name: Column | str = "fqn") -> Column:
    return F.concat(F.lit("class:"), F.col(name) if isinstance(name, str) else name)


def known(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose column is the id of a node (ids has id)."""
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_semi").select(*rows.columns)


def has(annotations: Column, *names: str) -> Column:
    """Whether one of the annotations is there."""
    return F.exists(annotations, lambda a: a["name"].isin(*names))


def first(annotations: Column, *names: str) -> Column:
    """The first annotation of these names, null if there is none."""
    return F.get(F.filter(annotations, lambda a: a["name"].isin(*names)), F.lit(0))


def argument(annotation: Column, *keys: str) -> Column:
    """Text of the first argument with one of the keys; the key of a single value is empty."""
    return F.get(F.filter(annotation["args"], lambda p: p["key"].isin(*keys)), F.lit(0))["value"]


def literal(value: Column) -> Column:
    """What a string literal says; null for anything else."""
    return F.when(value.rlike(r'^"[^"]*"$'), F.substring(value, F.lit(2), F.length(value) - 2))


def plain(value: Column) -> Column:
    """Text without quotes, braces and white space."""
    return F.regexp_replace(value, r'[{}"\s]', "")


def unquoted(value: Column) -> Column:
    return F.replace(value, F.lit('"'), F.lit(""))


def listed(value: Column) -> Column:
    """The entries of a comma-separated text without blanks."""
    return F.filter(F.split(plain(value), ","), lambda x: x != "")


def last_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def methods(classes: DataFrame) -> DataFrame:
    """One row for each method, with its class."""
    kept = classes.select("file", "package", "fqn", "name", "annotations", F.explode("methods").alias("m"))
    return kept.select(
        "file", "package", "fqn", "name", "annotations", F.col("m.name").alias("method"), F.col("m.type").alias("returns"),
        F.col("m.params").alias("params"), F.col("m.annotations").alias("marks"), F.col("m.body").alias("body"), F.col("m.calls").alias("calls"),
    )


def fields(classes: DataFrame) -> DataFrame:
    """One row for each field, with its class."""
    kept = classes.select("file", "fqn", "name", "annotations", F.explode("fields").alias("f"))
    return kept.select(
        "file", "fqn", "name", "annotations", F.col("f.name").alias("field"), F.col("f.type").alias("kind"), F.col("f.annotations").alias("marks")
    )
