"""The property graph: nodes and typed edges as two DataFrames, folded from facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE = "id string, name string, type string, metadata map<string,string>"
EDGE = "source_id string, target_id string, type string"
FACT = NODE + ", source_file string, seq long"

# The vocabulary of node and edge types.
NODE_TYPES = (
    "CONTROLLER", "CONTROLLER_ENDPOINT", "SERVICE", "REPOSITORY", "COMPONENT", "CONFIGURATION", "PERSISTENCE_ENTITY", "DATA_REPOSITORY",
    "DATA_CONVERTER", "MESSAGE_PRODUCER", "MESSAGE_CONSUMER", "MESSAGE_TOPIC", "PROXY", "CLASS", "INTERFACE", "METHOD", "MODULE",
    "SECURITY_FILTER_CHAIN", "AUTH_RULE", "SECURITY_FLAG", "CONFIG_PROPERTIES", "CONFIG_KEY", "CONFIG_VALUE", "CONFIG_PROFILE_GROUP",
    "DATA_TRANSFER_OBJECT", "EXTERNAL_SERVICE", "SERVICE_CALL", "FEIGN_CLIENT", "TEST", "METRIC", "HEALTH_INDICATOR", "TRACE_SPAN",
    "PERFORMANCE_ISSUE", "PERFORMANCE_HINT", "SCHEMA_TABLE", "SCHEMA_COLUMN", "SCHEMA_MIGRATION", "COMPATIBILITY_ISSUE",
)
EDGE_TYPES = (
    "INJECTS", "CALLS", "MAPS_TO", "PUBLISHES_TO", "SUBSCRIBES_FROM", "IMPLEMENTS", "EXTENDS", "ANNOTATED_WITH", "CONTAINS", "ROUTES_TO",
    "HAS_MANY", "BELONGS_TO", "SECURED_BY", "CONFIGURED_BY", "USES_CONFIG", "RESOLVES_TO", "ACCEPTS", "RETURNS", "CALLS_REMOTE",
    "LOAD_BALANCED_BY", "TESTS", "MOCKS", "DEPENDS_ON", "OVERRIDES", "MEASURES", "TRACES", "PERFORMANCE_RISK", "SCHEMA_MAPS_TO",
    "COMPATIBILITY_RISK", "THROWS",
)


@dataclass(frozen=True)
class Graph:
    """nodes (NODE) and edges (EDGE); edges may point at ids that are no nodes."""

    nodes: DataFrame
    edges: DataFrame

    def of(self, *types: str) -> DataFrame:
        """Nodes of the types."""
        return self.nodes.where(F.col("type").isin(*types))

    def links(self, *types: str) -> DataFrame:
        """Edges of the types, or all."""
        return self.edges.where(F.col("type").isin(*types)) if types else self.edges


def fold_nodes(facts: DataFrame) -> DataFrame:
    """Nodes from facts: the first fact gives name and type; of each metadata key the last value stays."""
    heads = facts.groupBy("id").agg(F.min_by("name", "seq").alias("name"), F.min_by("type", "seq").alias("type"))
    keys = facts.select("id", "seq", F.explode("metadata").alias("k", "v"))
    lasts = keys.groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    maps = lasts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))
    none = F.create_map().cast("map<string,string>")
    return heads.join(maps, "id", "left").select("id", "name", "type", F.coalesce("metadata", none).alias("metadata"))


def node_labels(facts: DataFrame) -> DataFrame:
    """Every type that was ever asserted for an id."""
    return facts.select("id", "type").distinct()


def fold_edges(facts: DataFrame) -> DataFrame:
    """Edges are a set of (source, target, type)."""
    return facts.select("source_id", "target_id", "type").distinct()


def remove_file(graph: Graph, files: DataFrame) -> Graph:
    """Without the nodes of the files (column source_file) and their edges."""
    gone = graph.nodes.withColumn("source_file", F.col("metadata")["sourceFile"]).join(files, "source_file").select("id").distinct()
    edges = graph.edges
    for end in ("source_id", "target_id"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges.select("source_id", "target_id", "type"))


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row with the highest seq of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
