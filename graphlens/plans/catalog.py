"""The graph queries by name, each over the whole projected graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.model import Graph
from graphlens.operators import audit, diff, health, index, projects, search, traversal
from graphlens.plans import code
from graphlens.plans.projection import endpoint_id, project
from graphlens.sources import graph_files
from graphlens.storage import settle

Query = Callable[[SparkSession, str], DataFrame]


@lru_cache(maxsize=8)
def stored(spark: SparkSession, sf_dir: str) -> Graph:
    """The whole projected graph in the shared folder, once a session and folder, by type.

    A filter on type then reads only its own partitions.
    """
    graph = project(spark, sf_dir)
    nodes, edges = (settle(rows, name, "type") for rows, name in ((graph.nodes, "nodes"), (graph.edges, "edges")))
    return Graph(nodes, edges)


@lru_cache(maxsize=8)
def indexed(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of all nodes of the stored graph."""
    return index.build(stored(spark, sf_dir).nodes)


def _search(query: str) -> Query:
    return lambda spark, sf_dir: index.search(indexed(spark, sf_dir), stored(spark, sf_dir).nodes, query)


def _graph(f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(stored(spark, sf_dir))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _middle(orders: DataFrame) -> DataFrame:
    """The middle of the order dates: the time of the earlier snapshot, as one row."""
    seconds = (F.unix_micros(F.min(F.col("o_orderdate").cast("timestamp"))) + F.unix_micros(F.max(F.col("o_orderdate").cast("timestamp")))) / 2
    return orders.agg(F.timestamp_micros(F.floor(seconds)).alias("mid"))


def config_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _table(spark, sf_dir, "nation").where("n_nationkey = 3").first()["n_name"]
    return audit.config_property(stored(spark, sf_dir), f"app.{name}")


def dto_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = _table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return audit.dto_lineage(stored(spark, sf_dir), brand)


def injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    beans = rows.select(
        F.concat(F.lit("class:s"), F.col("s_suppkey").cast("string")).alias("qualified_name"),
        F.col("s_name").alias("bean_name"),
        F.array("n_name").alias("interfaces"),
        (F.col("s_suppkey") % 11 == 0).alias("is_primary"),
        F.col("s_name").alias("qualifier"),
    )
    wanted = _table(spark, sf_dir, "nation").where("n_nationkey = 3").first()["n_name"]
    return audit.simulate_injection(beans, wanted)


def git_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    signature = F.when(F.col("role") == "user", "GPG").when(F.col("role") == "assistant", "SSH")
    rows = _table(spark, sf_dir, "conversations")
    return audit.provenance(rows.select(F.md5(key.cast("binary")).alias("hash"), F.col("text").alias("message"), signature.alias("signature")))


def list_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, nations = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    root = F.concat(F.lit("/src/"), F.col("r_name"))
    known = projects.register(spark.createDataFrame([], "id string, name string, root string, status string"), regions.select(root.alias("root"), F.col("r_name").alias("name")))
    owned = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(projects.project_id(root).alias("project_id"))
    return projects.listing(known, owned)


def refresh_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    dated = orders.join(F.broadcast(_middle(orders))).withColumn("early", F.col("o_orderdate").cast("timestamp") < F.col("mid"))
    row = lambda sha: [F.col("o_orderkey").alias("path"), F.lit(0).alias("modified"), F.col("o_totalprice").alias("size"), sha.alias("sha256")]
    status = F.col("o_orderstatus")
    before = dated.where(F.col("early") | (status == "O")).select(*row(F.when(F.col("early"), status).otherwise("O")))
    after = orders.where(status != "P").select(*row(status))
    return diff.diff_counts(diff.file_changes(before, after))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, orders = stored(spark, sf_dir), _table(spark, sf_dir, "orders")
    late = orders.join(F.broadcast(_middle(orders))).where(F.col("o_orderdate").cast("timestamp") >= F.col("mid")).select(endpoint_id().alias("id"))
    before = Graph(graph.nodes.join(late, "id", "left_anti"), graph.edges.join(late.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select("source_id", "target_id", "type"))
    return diff.diff_counts(diff.diff(before, graph))


def request_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _table(spark, sf_dir, "orders").where("o_orderkey = 1").select(endpoint_id().alias("e")).first()["e"]
    _, verb, path, _ = first.split(":")
    return traversal.request_flow(stored(spark, sf_dir), verb, path)


def string_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return audit.string_usage(docs.select(F.col("doc_id").cast("string").alias("file"), "text"), "License")


def custom_rule(graph: Graph) -> DataFrame:
    rules = health.add_rule(health.standard_rules(graph.nodes.sparkSession), "OWN-001", "WARNING", "CALLS", "CONTROLLER", "SERVICE")
    return health.rule_violations(graph, rules)


def queries() -> dict[str, Query]:
    """Query name -> function of (spark, sf_dir)."""
    return code.queries() | {
        "graph_summary": _graph(audit.graph_summary),
        "api_surface": _graph(audit.api_surface),
        "trace_message_flow": _graph(lambda g: audit.message_flow(g, "purchase")),
        "module_dependency_graph": _graph(audit.module_graph),
        "cross_module_violations": _graph(lambda g: audit.module_violations(g, "america,a,e")),
        "audit_security_boundaries": _graph(audit.unsecured_endpoints),
        "security_filter_chain": _graph(audit.filter_chains),
        "trace_config_property": config_property,
        "audit_undefined_properties": _graph(audit.undefined_properties),
        "undocumented_endpoints": _graph(audit.undocumented_endpoints),
        "dto_lineage": dto_lineage,
        "service_topology": _graph(audit.service_topology),
        "resilience_gaps": _graph(audit.resilience_gaps),
        "test_coverage_map": _graph(audit.coverage_map),
        "untested_components": _graph(audit.untested_components),
        "observability_map": _graph(audit.observability_map),
        "uninstrumented_services": _graph(audit.uninstrumented),
        "architecture_rules": _graph(lambda g: health.rule_violations(g, health.standard_rules(g.nodes.sparkSession))),
        "custom_rule": _graph(custom_rule),
        "performance_antipatterns": _graph(audit.antipatterns),
        "entity_schema": _graph(audit.entity_schema),
        "migration_timeline": _graph(audit.migration_timeline),
        "native_compatibility": _graph(audit.native_compatibility),
        "find_by_annotation": _graph(lambda g: audit.by_annotation(g, "@Transactional")),
        "dead_components": _graph(audit.dead_components),
        "deprecated_usage": _graph(audit.deprecated_usage),
        "string_usage": string_usage,
        "simulate_dependency_injection": injection,
        "git_provenance": git_provenance,
        "list_projects": list_projects,
        "refresh_changes": refresh_changes,
        "snapshot_diff": snapshot_diff,
        "export_dot": _graph(lambda g: graph_files.export(g, "dot")),
        "export_cypher": _graph(lambda g: graph_files.export(g, "cypher")),
        "dependency_cycles": _graph(traversal.cycles),
        "cyclic_classes": _graph(traversal.on_cycles),
        "authorization_rules": _graph(audit.auth_rules),
        "instrumented_services": _graph(audit.instrumentation),
        "rule_counts": _graph(lambda g: health.rule_counts(health.rule_violations(g, health.standard_rules(g.nodes.sparkSession)))),
        "provenance_summary": lambda spark, sf_dir: audit.provenance_summary(git_provenance(spark, sf_dir)),
        "node_by_name": _graph(lambda g: audit.by_name(g, "order 1").select("id", "name", "type")),
        "architectural_health": _graph(health.health),
        "remediation_backlog": _graph(health.backlog),
        "fix_context": _graph(lambda g: health.fix_context(g, "class:s3", "untested")),
        "blast_radius": _graph(lambda g: traversal.blast_radius(g, "c0", 3)),
        "transaction_boundaries": _graph(lambda g: traversal.transaction_boundaries(g, "c0", 5)),
        "transaction_scope": _graph(lambda g: traversal.transaction_scope(g, "c0")),
        "transaction_risk": _graph(lambda g: traversal.transaction_risk(g, "s3")),
        "request_flow": request_flow,
        "data_flow": _graph(lambda g: traversal.data_flow(g, "order 1", 5)),
        "search_boolean": _search("+type:service^2 +metadata:transactional -(name:000000003 OR name:000000006)"),
        "search_phrase": _search('name:"proxy of"^3 OR type:module'),
        "search_prefix": _search("name:suppl* AND metadata:true"),
        "search_near": _search("name:ordr~1 AND NOT metadata:post"),
        "search_architecture": _graph(lambda g: search.search(g, "transactional service true")),
    }
