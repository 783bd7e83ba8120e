"""Resolvers that a user adds by name: DataFrame functions, or table functions over the declarations of each file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from graphlens.resolvers.base import STAGE, Facts, edges

#: What a table function gives: nodes with name and metadata, edges with their target in `other`.
FOUND = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("part", "id", "other", "type")]
    + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("file", T.StringType())]
)
#: The stage of added resolvers: after all others, so that their metadata wins and first names stay.
LATE = 10

_registered: dict[str, Callable[[DataFrame, DataFrame], Facts]] = {}


class FileResolver:
    """Base of a table function that sees the types of one file at a time, in their order.

    A subclass has resolve(file, types), which gives node() and edge() rows; types are rows of java.types.
    """

    @staticmethod
    def analyze(types: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=FOUND, partitionBy=[PartitioningColumn("file")], orderBy=[OrderingColumn("at")])

    def __init__(self) -> None:
        self.types: list[Row] = []

    def eval(self, row: Row) -> None:
        self.types.append(row)

    def terminate(self) -> Iterator[tuple]:
        if self.types:
            yield from self.resolve(self.types[0]["file"], self.types)

    def resolve(self, file: str, types: list[Row]) -> Iterator[tuple]:
        raise NotImplementedError


def node(file: str, id_: str, name: str, kind: str, **metadata: str) -> tuple:
    """A node that a table function found in a file."""
    return "node", id_, name, kind, metadata, file


def edge(file: str, source: str, target: str, kind: str) -> tuple:
    """An edge that a table function found in a file."""
    return "edge", source, target, kind, {}, file


def _facts(found: DataFrame) -> Facts:
    order = F.pmod(F.xxhash64("file", "id", "other"), F.lit(STAGE)) + F.lit(LATE * STAGE)
    made = found.where("part = 'node'").select("id", F.col("other").alias("name"), "type", "metadata", F.col("file").alias("source_file"), order.alias("seq"))
    return Facts(made, edges(found.where("part = 'edge'"), F.col("id"), F.col("other"), F.col("type")).distinct())


def register(name: str, resolver: type[FileResolver] | Callable[[DataFrame, DataFrame], Facts]) -> None:
    """Adds a resolver to every analysis from now on; one of the same name is replaced.

    A function gets the declared types and the texts (file, text) as DataFrames and returns Facts. A
    FileResolver becomes a table function of Spark that is given the types file by file.
    """
    if isinstance(resolver, type) and issubclass(resolver, FileResolver):
        table = F.udtf(resolver)

        def run(types: DataFrame, texts: DataFrame) -> Facts:
            types.sparkSession.udtf.register(name, table)
            return _facts(table(types.asTable()))

        _registered[name] = run
    else:
        _registered[name] = resolver


def unregister(name: str) -> None:
    """Takes a resolver away; a name that is not there is no error."""
    _registered.pop(name, None)


def names() -> list[str]:
    """The names of the added resolvers, in the order in which they came."""
    return list(_registered)


def resolved(types: DataFrame, texts: DataFrame) -> list[Facts]:
    """The facts of every added resolver."""
    return [f(types, texts) for f in _registered.values()]
