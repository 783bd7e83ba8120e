"""From a source tree to its graph: files, declarations, beans, then the resolvers in the order in which they need each other."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.model import Graph, fold_edges, fold_nodes
from graphlens.resolvers import beans, builds, persistence, registry, runtime, symbols, transfers, web
from graphlens.resolvers.base import Facts, together
from graphlens.sources import files as source_files
from graphlens.sources import java
from graphlens.storage import settle

#: Resolvers whose facts are written at the same time.
AT_ONCE = 8
KINDS = "*.{java,sql,xml,yaml,yml,json,properties,gradle,kts}"


def _properties(files: DataFrame, names: str) -> DataFrame:
    """(key, value) of the property files with such names; of a key in several the last file's value."""
    rows = source_files.properties(files.where(F.regexp_extract("file", r"([^/]+)$", 1).rlike(names)))
    return rows.groupBy("key").agg(F.max_by("value", "file").alias("value"))


def facts(
    spark: SparkSession,
    root: str,
    profiles: tuple[str, ...] = (),
    class_root: str | None = None,
    **options: bool,
) -> Facts:
    """All facts of a source tree; class_root adds the proxies among class files; options as in facts_of()."""
    files = settle(source_files.text_files(spark, root, KINDS), "files")
    return facts_of(files, root, profiles, builds.class_files(spark, class_root) if class_root else None, **options)


def facts_of(
    files: DataFrame,
    root: str = "/",
    profiles: tuple[str, ...] = (),
    heads: DataFrame | None = None,
    by_simple_name: bool = False,
    by_field_type: bool = False,
    match_if_missing: bool = False,
    by_import: bool = False,
) -> Facts:
    """All facts of files (file, text); heads are class files (builds.class_files).

    The options mend what a plain reading of names misses: injections of types by their simple names,
    calls on fields by the fields' types, and conditions that match missing properties. by_import reads
    every type's name as the language does (symbols), instead of the first two, and adds what endpoints
    accept and return (transfers).
    """
    # texts are few bytes and reading declarations is much work: dealt out, however few files of the table hold them
    dealt = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    types = settle(java.types(dealt), "types")
    return facts_from(types, settle(kept_texts(files), "texts"), root, profiles, heads, by_simple_name, by_field_type, match_if_missing, by_import)


def kept_texts(files: DataFrame) -> DataFrame:
    """(file, text): what the resolvers read beside declarations: all of other files, of Java files lines with web clients."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(runtime.CLIENTS))
    return files.select("file", F.when(F.col("file").endswith(".java"), F.array_join(lines, "\n")).otherwise(F.col("text")).alias("text"))


def facts_from(
    types: DataFrame,
    files: DataFrame,
    root: str = "/",
    profiles: tuple[str, ...] = (),
    heads: DataFrame | None = None,
    by_simple_name: bool = False,
    by_field_type: bool = False,
    match_if_missing: bool = False,
    by_import: bool = False,
) -> Facts:
    """All facts of declared types (java.types) and kept texts; the rest as in facts_of()."""
    if by_import:
        types = settle(symbols.qualified(types), "types")
    classes = types.where("kind in ('class', 'interface')")
    found = settle(beans.beans(classes, _properties(files, r"^application\.(properties|ya?ml)$"), profiles, match_if_missing), "beans")
    if by_import:
        found = settle(beans.with_supertypes(found, symbols.supertypes(types)), "beans")
    wired = beans.wiring(classes, found, by_simple_name, by_field_type, (types, symbols.receivers(classes)) if by_import else None)
    wired = Facts(settle(wired.nodes, "wired-nodes"), settle(wired.edges, "wired-edges"))
    present = settle(fold_nodes(wired.nodes).select("id", "name", "type"), "present")
    through = beans.proxies(classes, found, wired.edges)
    calls = wired.edges.unionByName(through.edges).distinct()
    ends = web.endpoints(classes)
    ends = Facts(settle(ends.nodes, "endpoints"), ends.edges)
    data, made = persistence.data(classes, by_import), persistence.schema(files)
    made = Facts(settle(made.nodes, "schema"), made.edges)
    entities = fold_nodes(wired.nodes.unionByName(data.nodes)).select("id", "name", "type")
    parts = [
        builds.modules(files, root), wired, through, ends, web.security(classes, present, ends.nodes), data, made,
        persistence.correlated(classes, entities, made.nodes), runtime.messaging(classes, by_field_type or by_import),
        runtime.configuration(classes, present, _properties(files.where(F.col("file").contains("src/main/resources/")), "^application")),
        runtime.remote_calls(classes, files.where(F.col("file").endswith(".java")), present), runtime.tests(classes, present, by_import),
        runtime.observability(classes, present), runtime.performance(classes, present, calls), runtime.native(classes, present),
        web.contracts(classes, ends.nodes, builds.specification(files)),
    ]
    if by_import:
        parts.append(transfers.transfers(types, ends.nodes, data.nodes))
    if heads is not None:
        parts.append(builds.generated_proxies(heads))
    return together(_concurrently(parts + registry.resolved(types, files)))


def _concurrently(parts: list[Facts]) -> list[Facts]:
    """Each resolver's facts written to the shared folder, several resolvers at a time: their plans are long and their rows few."""

    def write(part: Facts) -> Facts:
        return Facts(settle(part.nodes, "facts"), settle(part.edges, "fact-edges"))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(write, parts))


def graph_of(found: Facts) -> Graph:
    """The graph that facts fold into, written to the shared folder."""
    return Graph(settle(fold_nodes(found.nodes), "nodes", "type"), settle(fold_edges(found.edges), "edges", "type"))


def analyze(spark: SparkSession, root: str, **options) -> Graph:
    """The graph of a source tree; options as in facts()."""
    return graph_of(facts(spark, root, **options))
