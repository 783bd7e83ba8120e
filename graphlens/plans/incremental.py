"""A project that follows its files: only changed files are read and parsed, and the graph takes over what differs.

Kept are fingerprints, declarations, texts that resolvers read, and which file's names lead to which other
files. A refresh drops the rows of changed and removed files, adds those of the new texts, and resolves the
tables again: that part is joins over declarations, without any source. The graph is stored in layers by
type: a refresh writes the types whose rows differ, and the others stay in the layer that they are in.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions import meta
from graphlens.model import Graph, fold_edges, fold_nodes
from graphlens.plans import analysis
from graphlens.resolvers import symbols
from graphlens.sources import java
from graphlens.storage import settle

#: Layers above which a refresh writes the whole table again.
LAYERS = 8


@dataclass(frozen=True)
class Layers:
    """A table by type: layers, and for each type the number of the layer that holds it."""

    layers: tuple[DataFrame, ...] = ()
    of: dict[str, int] = field(default_factory=dict)

    def table(self) -> DataFrame:
        parts = []
        for n, rows in enumerate(self.layers):
            kinds = [k for k, at in self.of.items() if at == n]
            if kinds:
                parts.append(rows.where(F.col("type").isin(*kinds)))
        return reduce(DataFrame.unionByName, parts) if parts else self.layers[0].where("false")


@dataclass(frozen=True)
class Project:
    """What is known of a project; graph is the stored one."""

    prints: DataFrame
    types: DataFrame
    texts: DataFrame
    uses: DataFrame
    nodes: Layers
    edges: Layers
    options: dict

    @property
    def graph(self) -> Graph:
        return Graph(self.nodes.table(), self.edges.table())


def _prints(files: DataFrame) -> DataFrame:
    return files.select("file", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def uses(types: DataFrame) -> DataFrame:
    """(file, on_file): files whose names lead to types that other files declare."""
    owners = types.select(F.col("fqn").alias("full"), F.col("file").alias("on_file")).distinct()
    names = symbols.resolved_names(types).where("declared").select("file", "full").distinct()
    return names.join(owners, "full").where("file <> on_file").select("file", "on_file").distinct()


def _written(layers: Layers, rows: DataFrame, touched: list[str] | None, name: str) -> Layers:
    """The layers with the rows of the touched types (all: None) from a new table."""
    if touched is None or len(layers.layers) >= LAYERS:
        new = settle(rows, name, "type")
        return Layers((new,), {r["type"]: 0 for r in new.select("type").distinct().collect()})
    if not touched:
        return layers
    new = settle(rows.where(F.col("type").isin(*touched)), name, "type")
    # a type without rows in the new table has none any more
    there = {r["type"] for r in new.select("type").distinct().collect()}
    of = {k: n for k, n in layers.of.items() if k not in touched} | dict.fromkeys(there, len(layers.layers))
    return Layers((*layers.layers, new), of)


def _graph(types: DataFrame, texts: DataFrame, options: dict) -> Graph:
    found = analysis.facts_from(types, texts, **options)
    return Graph(fold_nodes(found.nodes), fold_edges(found.edges))


def open_project(files: DataFrame, **options) -> Project:
    """The project of files (file, text); options as in analysis.facts_from()."""
    types, texts = settle(java.types(files), "types"), settle(analysis.kept_texts(files), "texts")
    graph = _graph(types, texts, options)
    nodes, edges = _written(Layers(), graph.nodes, None, "nodes"), _written(Layers(), graph.edges, None, "edges")
    return Project(settle(_prints(files), "prints"), types, texts, settle(uses(types), "uses"), nodes, edges, options)


def file_changes(project: Project, files: DataFrame) -> DataFrame:
    """(file, change): added, modified and deleted files, and dependent ones, whose names lead to these before the change."""
    a, b = project.prints.withColumnRenamed("sha256", "a"), _prints(files).withColumnRenamed("sha256", "b")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    own = settle(a.join(b, "file", "full").select("file", change.alias("change")).where("change is not null"), "changes")
    near = project.uses.join(own.select(F.col("file").alias("on_file")), "on_file", "left_semi").select("file").distinct()
    return own.unionByName(near.join(own, "file", "left_anti").select("file", F.lit("dependent").alias("change")))


def _touched(before: DataFrame, after: DataFrame, key: list[str], mark) -> list[str]:
    """The types with rows that differ."""
    a, b = before.select(*key, "type", mark.alias("a")), after.select(*key, "type", mark.alias("b"))
    rows = a.join(b, [*key, "type"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return [r["type"] for r in rows.select("type").distinct().collect()]


def refresh(project: Project, files: DataFrame) -> tuple[Project, DataFrame]:
    """The project after its files (file, text) changed, and file_changes(). The graph equals that of a new project.

    Of unchanged files nothing but the fingerprint is taken.
    """
    changes = settle(file_changes(project, files), "changes")
    own = changes.where("change <> 'dependent'").select("file")
    if own.isEmpty():
        return project, changes
    new = settle(files.join(own, "file", "left_semi").select("file", "text"), "new-files")

    def taken(kept: DataFrame, made: DataFrame, name: str) -> DataFrame:
        return settle(kept.join(own, "file", "left_anti").select(*kept.columns).unionByName(made.select(*kept.columns)), name)

    types = taken(project.types, java.types(new), "types")
    texts = taken(project.texts, analysis.kept_texts(new), "texts")
    prints = taken(project.prints, _prints(new), "prints")
    graph = _graph(types, texts, project.options)
    graph = Graph(settle(graph.nodes, "new-nodes"), settle(graph.edges, "new-edges"))
    node = F.xxhash64("name", meta.canonical())
    nodes = _written(project.nodes, graph.nodes, _touched(project.graph.nodes, graph.nodes, ["id"], node), "nodes")
    edges = _written(project.edges, graph.edges, _touched(project.graph.edges, graph.edges, ["source_id", "target_id"], F.lit(1)), "edges")
    return replace(project, prints=prints, types=types, texts=texts, uses=settle(uses(types), "uses"), nodes=nodes, edges=edges), changes
