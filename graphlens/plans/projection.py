"""Architecture graph of the relational tables, so that every operator has data at any scale."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions import meta
from graphlens.model import Graph
from graphlens.storage import settle

# HTTP verbs that stand for the five order priorities.
VERBS = {"1-URGENT": "POST", "2-HIGH": "PUT", "3-MEDIUM": "GET", "4-NOT SPECIFIED": "DELETE", "5-LOW": "PATCH"}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that the projection reads."""
    names = "region nation customer supplier part orders lineitem events documents labels conversations".split()
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _id(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(prefix), *(F.col(c).cast("string") for c in columns))


def verb() -> Column:
    return F.coalesce(*(F.when(F.col("o_orderpriority") == k, v) for k, v in VERBS.items()), F.lit("GET"))


def endpoint_id() -> Column:
    return F.concat(F.lit("endpoint:"), verb(), F.lit(":/orders/"), F.col("o_orderkey").cast("string"), F.lit(":get"))


def _nodes(rows: DataFrame, node_id: Column, name: Column, kind: str | Column, metadata: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(
        node_id.alias("id"),
        name.cast("string").alias("name"),
        kind.alias("type"),
        (meta.empty() if metadata is None else metadata).alias("metadata"),
    )


def _edges(rows: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    return rows.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"))


@lru_cache(maxsize=8)
def project(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph; unions of narrow branches, of which a filter on type leaves only its own.

    The plan is kept for a session and folder; rows are read again by every query.
    """
    t = tables(spark, sf_dir)
    yes = lambda c: F.when(c, F.lit("true"))
    k = F.col("s_suppkey")
    stereotypes = F.concat_ws(",", F.when(k % 3 == 0, F.lit("TRANSACTION_INTERCEPTOR")), F.when(k % 5 == 0, F.lit("RETRY_INTERCEPTOR")))
    proxied = t["supplier"].where((k % 3 == 0) | (k % 5 == 0))
    size = F.col("p_size") % 3
    part_type = F.when(size == 0, "REPOSITORY").when(size == 1, "COMPONENT").otherwise("DATA_REPOSITORY")
    tens = spark.range(10).withColumn("k", F.col("id").cast("string"))
    events = t["events"]
    marked = t["labels"].join(t["documents"].select("doc_id", "lang"), "doc_id")
    native = F.coalesce(
        *(F.when(F.col("lang") == a, b) for a, b in (("de", "Uses reflection"), ("fr", "Creates dynamic proxies"), ("es", "Loads resources"))),
        F.lit("Custom scope"),
    )
    nation_key = F.col("n_nationkey")
    nodes = [
        _nodes(t["region"], _id("module:r", "r_regionkey"), F.col("r_name"), "MODULE", meta.pack(artifactId=F.col("r_name"))),
        _nodes(t["nation"], _id("module:n", "n_nationkey"), F.col("n_name"), "MODULE", meta.pack(artifactId=F.col("n_name"))),
        _nodes(t["customer"], _id("class:c", "c_custkey"), F.col("c_name"), "CONTROLLER", meta.pack(
            sourceFile=F.concat("c_mktsegment", F.lit(".java")),
            annotations=F.concat(F.lit("RestController"), F.when(F.col("c_custkey") % 10 == 0, ",Deprecated").otherwise("")),
        )),
        _nodes(t["supplier"], _id("class:s", "s_suppkey"), F.col("s_name"), "SERVICE", meta.pack(
            annotations=F.concat(F.lit("Service"), F.when(k % 3 == 0, ",Transactional").otherwise("")),
            instrumented=yes(F.col("s_acctbal") > 5000),
        )),
        _nodes(t["part"], _id("class:p", "p_partkey"), F.col("p_name"), part_type),
        _nodes(proxied, _id("proxy:s", "s_suppkey"), _id("proxy of ", "s_name"), "PROXY", meta.pack(PROXY_STEREOTYPE=stereotypes)),
        _nodes(t["orders"], endpoint_id(), _id("order ", "o_orderkey"), "CONTROLLER_ENDPOINT", meta.pack(
            httpVerb=verb(), path=_id("/orders/", "o_orderkey"), hasOpenApiSpec=yes(F.col("o_orderstatus") == "F"),
        )),
        _nodes(spark.range(1), F.lit("auth_rule:O"), F.lit("open orders"), "AUTH_RULE"),
        _nodes(t["region"], _id("security_filter_chain:r", "r_regionkey"), F.col("r_name"), "SECURITY_FILTER_CHAIN"),
        _nodes(t["region"].where("r_regionkey % 2 = 0"), _id("security_flag:csrf_r", "r_regionkey"), F.lit("CSRF_DISABLED"), "SECURITY_FLAG"),
        _nodes(t["nation"], _id("external_service:n", "n_nationkey"), F.col("n_name"), "EXTERNAL_SERVICE"),
        _nodes(t["part"].where("p_partkey % 7 = 0"), _id("test:p", "p_partkey"), _id("test of p", "p_partkey"), "TEST"),
        _nodes(t["supplier"].where("s_suppkey % 5 = 0"), _id("test:s", "s_suppkey"), _id("test of s", "s_suppkey"), "TEST"),
        _nodes(tens, _id("metric:", "k"), _id("metric ", "k"), "METRIC"),
        _nodes(tens, _id("trace_span:", "k"), _id("span ", "k"), "TRACE_SPAN"),
        _nodes(events.select("event_type").distinct(), _id("message_topic:", "event_type"), F.col("event_type"), "MESSAGE_TOPIC"),
        _nodes(t["nation"], _id("config_key:n", "n_nationkey"), _id("app.", "n_name"), "CONFIG_KEY", meta.pack(
            hasDefault=F.when(nation_key % 2 == 0, "true").otherwise("false"),
        )),
        _nodes(t["nation"].where("n_nationkey % 3 <> 0"), _id("config_value:n", "n_nationkey"), F.col("n_name"), "CONFIG_VALUE"),
        _nodes(t["part"].select("p_brand").distinct(), _id("dto:", "p_brand"), F.col("p_brand"), "DATA_TRANSFER_OBJECT"),
        _nodes(t["part"].select("p_type").distinct(), _id("persistence_entity:", "p_type"), F.col("p_type"), "PERSISTENCE_ENTITY"),
        _nodes(t["region"], _id("schema_migration:r", "r_regionkey"), _id("V", "r_regionkey"), "SCHEMA_MIGRATION", meta.pack(version=F.col("r_regionkey"))),
        _nodes(t["nation"], _id("schema_table:n", "n_nationkey"), F.col("n_name"), "SCHEMA_TABLE"),
        _nodes(t["nation"], _id("schema_column:n", "n_nationkey"), _id("id_", "n_name"), "SCHEMA_COLUMN"),
        _nodes(marked.where("quality = 0"), _id("perf:issue:", "doc_id"), F.lit("N+1 query"), "PERFORMANCE_ISSUE", meta.pack(severity=F.lit("HIGH"))),
        _nodes(marked.where("quality = 1"), _id("perf:hint:", "doc_id"), F.lit("cacheable"), "PERFORMANCE_HINT", meta.pack(severity=F.lit("LOW"))),
        _nodes(marked.where("toxic = 1"), _id("compat_issue:", "doc_id"), native, "COMPATIBILITY_ISSUE", meta.pack(issue=native)),
    ]
    # the one large join, read by five kinds of edges; its few rows are written once
    picked = t["lineitem"].where("l_quantity >= 49").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    joined = settle(t["orders"].select("o_orderkey", "o_custkey", "o_orderpriority").join(picked, F.col("o_orderkey") == F.col("l_orderkey")), "order-lines")
    custs, supps, parts = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("class:c", "o_custkey"), ("class:s", "l_suppkey"), ("class:p", "l_partkey")))
    many = joined
    with_part = joined.where("l_quantity = 50").join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    svc, proxy = _id("class:s", "s_suppkey"), _id("proxy:s", "s_suppkey")
    ext = t["customer"].where("c_mktsegment = 'MACHINERY'")
    edges = [
        _edges(t["nation"], _id("module:n", "n_nationkey"), _id("module:r", "n_regionkey"), "DEPENDS_ON"),
        _edges(t["orders"], endpoint_id(), _id("class:c", "o_custkey"), "ROUTES_TO"),
        _edges(t["orders"].where("o_orderstatus = 'O'"), endpoint_id(), F.lit("auth_rule:O"), "SECURED_BY"),
        _edges(t["region"].where("r_regionkey % 2 = 0"), _id("security_filter_chain:r", "r_regionkey"), _id("security_flag:csrf_r", "r_regionkey"), "CONFIGURED_BY"),
        _edges(many, custs, supps, "CALLS").distinct(),
        _edges(many.join(proxied.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")), custs, proxy, "CALLS").distinct(),
        _edges(proxied, proxy, svc, "CALLS"),
        _edges(t["lineitem"].where("l_quantity >= 49"), supps, parts, "INJECTS").distinct(),
        _edges(t["lineitem"].where("l_quantity <= 1 and l_returnflag = 'R'"), parts, supps, "INJECTS").distinct(),
        _edges(joined.where("l_quantity = 50 and l_returnflag = 'A'"), custs, parts, "INJECTS").distinct(),
        _edges(t["supplier"], svc, _id("external_service:n", "s_nationkey"), "CALLS_REMOTE"),
        _edges(ext, _id("class:c", "c_custkey"), _id("external_service:n", "c_nationkey"), "CALLS_REMOTE"),
        _edges(t["part"].where("p_partkey % 7 = 0"), _id("test:p", "p_partkey"), _id("class:p", "p_partkey"), "TESTS"),
        _edges(t["supplier"].where("s_suppkey % 5 = 0"), _id("test:s", "s_suppkey"), svc, "MOCKS"),
        _edges(t["supplier"].where("s_suppkey % 7 = 0"), _id("test:s", "s_suppkey"), svc, "TESTS"),
        _edges(t["supplier"].where("s_suppkey % 2 = 0"), svc, F.concat(F.lit("metric:"), (k % 10).cast("string")), "MEASURES"),
        _edges(t["supplier"].where("s_suppkey % 4 = 0"), svc, F.concat(F.lit("trace_span:"), (k % 10).cast("string")), "TRACES"),
        _edges(events.where("event_type in ('purchase', 'signup')"), _id("class:c", "user_id"), _id("message_topic:", "event_type"), "PUBLISHES_TO").distinct(),
        _edges(events.where("event_type not in ('purchase', 'signup')"), _id("message_topic:", "event_type"), _id("class:c", "user_id"), "SUBSCRIBES_FROM").distinct(),
        _edges(t["nation"].where("n_nationkey % 3 <> 0"), _id("config_key:n", "n_nationkey"), _id("config_value:n", "n_nationkey"), "RESOLVES_TO"),
        _edges(t["supplier"], svc, _id("config_key:n", "s_nationkey"), "USES_CONFIG"),
        _edges(with_part, endpoint_id(), _id("dto:", "p_brand"), "ACCEPTS").distinct(),
        _edges(with_part.where("l_returnflag = 'R'"), endpoint_id(), _id("dto:", "p_brand"), "RETURNS").distinct(),
        _edges(t["part"].where("p_size = 50"), _id("dto:", "p_brand"), _id("persistence_entity:", "p_type"), "MAPS_TO").distinct(),
        _edges(t["nation"], _id("schema_migration:r", "n_regionkey"), _id("schema_table:n", "n_nationkey"), "CONTAINS"),
        _edges(t["nation"], _id("schema_table:n", "n_nationkey"), _id("schema_column:n", "n_nationkey"), "CONTAINS"),
        _edges(t["part"].where("p_size < 25"), _id("persistence_entity:", "p_type"), _id("schema_table:n", "p_size"), "SCHEMA_MAPS_TO").distinct(),
    ]
    return Graph(_union(nodes), _union(edges))


def _union(parts: list[DataFrame]) -> DataFrame:
    """Union as a balanced tree: each step analyses its plan again."""
    while len(parts) > 1:
        parts = [a.union(b[0]) if b else a for a, *b in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    return parts[0]
