"""Null-safe access to the string metadata of nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(**values: Column) -> Column:
    """A metadata map of the values that are not null; __ in a name stands for nothing."""
    pairs = [c for k, v in values.items() for c in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def empty() -> Column:
    """A metadata map without keys."""
    return F.create_map().cast("map<string,string>")


def get(key: str, default: str | None = None, column: str = "metadata") -> Column:
    """metadata[key], or the default where it is missing."""
    value = F.col(column)[key]
    return value if default is None else F.coalesce(value, F.lit(default))


def is_true(key: str, column: str = "metadata") -> Column:
    """Whether metadata[key] is 'true'; false where it is missing."""
    return F.coalesce(F.col(column)[key] == "true", F.lit(False))


def canonical(column: str = "metadata") -> Column:
    """A text that is equal for equal maps: maps themselves cannot be compared or grouped."""
    return F.to_json(F.array_sort(F.map_entries(column)))


def names(column: Column) -> Column:
    """A comma- or space-separated list as an array."""
    return F.filter(F.split(column, r"[,\s]+"), lambda x: x != "")
