"""Lookups, coverage audits and reports over a graph: semi, anti and outer equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions import meta
from graphlens.model import Graph
from graphlens.operators.traversal import joined

STATE_CHANGING = ("POST", "PUT", "DELETE", "PATCH")
RESILIENT = ("RETRY", "CIRCUIT_BREAKER", "BULKHEAD", "TIME_LIMITER")


def _ends(edges: DataFrame, end: str) -> DataFrame:
    return edges.select(F.col(end).alias("id")).distinct()


def _flag(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column: whether id is among ids."""
    return rows.join(ids.withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _holds(column: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(column, F.lit("")).rlike("|".join(words))


def graph_summary(graph: Graph) -> DataFrame:
    """(kind, type, n) of nodes and edges."""
    nodes = graph.nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    edges = graph.edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n")
    return nodes.unionByName(edges)


def api_surface(graph: Graph) -> DataFrame:
    """Endpoints with controller, by path and verb."""
    routes = graph.links("ROUTES_TO").select(F.col("source_id").alias("id"), F.col("target_id").alias("controller"))
    rows = graph.of("CONTROLLER_ENDPOINT").join(routes, "id", "left")
    return rows.select("id", meta.get("path", "/").alias("path"), meta.get("httpVerb", "GET").alias("verb"), F.coalesce("controller", F.lit("unknown")).alias("controller")).orderBy("path", "verb")


def message_flow(graph: Graph, topic: str) -> DataFrame:
    """(role, id, name) of the producers and consumers of a topic."""
    node = f"message_topic:{topic}"
    out = graph.links("PUBLISHES_TO").where(F.col("target_id") == node).select(F.lit("producer").alias("role"), F.col("source_id").alias("id"))
    into = graph.links("SUBSCRIBES_FROM").where(F.col("source_id") == node).select(F.lit("consumer").alias("role"), F.col("target_id").alias("id"))
    return out.unionByName(into).join(graph.nodes.select("id", "name"), "id", "left").select("role", "id", "name")


def module_graph(graph: Graph) -> DataFrame:
    """(id, artifact, depends_on) of every module."""
    names = graph.of("MODULE").select(F.col("id").alias("target_id"), "name")
    deps = graph.links("DEPENDS_ON").join(names, "target_id", "left")
    lists = deps.groupBy(F.col("source_id").alias("id")).agg(joined(F.coalesce("name", F.lit("unknown"))).alias("depends_on"))
    return graph.of("MODULE").join(lists, "id", "left").select("id", F.coalesce(meta.get("artifactId"), "name").alias("artifact"), F.coalesce("depends_on", F.lit("")).alias("depends_on"))


def layer_of(name: Column, layers: list[str]) -> Column:
    """Position of the first layer contained in the lower-cased name, null if none is."""
    return F.coalesce(*(F.when(F.lower(name).contains(x.strip().lower()), F.lit(i)) for i, x in enumerate(layers)))


def module_violations(graph: Graph, layers: str) -> DataFrame:
    """Module dependencies on a layer above: (source, target, source_layer, target_layer)."""
    order = layers.split(",")
    mods = graph.of("MODULE").select("id", "name", layer_of(F.col("name"), order).cast("long").alias("layer"))
    a, b = mods.toDF("source_id", "source", "source_layer"), mods.toDF("target_id", "target", "target_layer")
    rows = graph.links("DEPENDS_ON").join(a, "source_id").join(b, "target_id").where("target_layer < source_layer")
    return rows.select("source", "target", "source_layer", "target_layer")


def unsecured_endpoints(graph: Graph) -> DataFrame:
    """Endpoints without a SECURED_BY edge at either end: (id, verb, path, severity)."""
    edges = graph.links("SECURED_BY")
    rows = graph.of("CONTROLLER_ENDPOINT").join(_ends(edges, "source_id"), "id", "left_anti").join(_ends(edges, "target_id"), "id", "left_anti")
    verb = meta.get("httpVerb", "GET")
    return rows.select("id", verb.alias("verb"), meta.get("path", "").alias("path"), F.when(F.upper(verb).isin(*STATE_CHANGING), "CRITICAL").otherwise("HIGH").alias("severity"))


def filter_chains(graph: Graph) -> DataFrame:
    """(id, name, flags) of security filter chains."""
    flags = graph.of("SECURITY_FLAG").select(F.col("id").alias("target_id"), F.col("name").alias("flag"))
    lists = graph.links("CONFIGURED_BY").join(flags, "target_id").groupBy(F.col("source_id").alias("id")).agg(joined(F.col("flag")).alias("flags"))
    return graph.of("SECURITY_FILTER_CHAIN").join(lists, "id", "left").select("id", "name", F.coalesce("flags", F.lit("")).alias("flags"))


def config_property(graph: Graph, key: str) -> DataFrame:
    """Consumers and definitions of a property: (role, id, undefined).

    It is undefined if it has consumers, no default and no definition.
    """
    keys = graph.of("CONFIG_KEY").where(F.col("name") == key)
    ids = keys.select(F.col("id").alias("key"), meta.is_true("hasDefault").alias("has_default"))
    used = graph.links("USES_CONFIG").join(ids, F.col("target_id") == F.col("key")).select(F.lit("consumer").alias("role"), F.col("source_id").alias("id"), "has_default")
    told = graph.links("RESOLVES_TO").join(ids, F.col("source_id") == F.col("key")).select(F.lit("definition").alias("role"), F.col("target_id").alias("id"), "has_default")
    # one row: whether any definition is there
    defined = told.agg((F.count("*") > 0).alias("defined"))
    return used.unionByName(told).join(F.broadcast(defined)).select("role", "id", (~F.col("defined") & ~F.col("has_default")).alias("undefined"))


def undefined_properties(graph: Graph) -> DataFrame:
    """Configuration keys without default and definition."""
    rows = graph.of("CONFIG_KEY").where(~meta.is_true("hasDefault")).join(_ends(graph.links("RESOLVES_TO"), "source_id"), "id", "left_anti")
    return rows.select("id", "name", F.lit("STARTUP_FAILURE").alias("risk"))


def undocumented_endpoints(graph: Graph) -> DataFrame:
    """Endpoints without an OpenAPI annotation or specification."""
    rows = graph.of("CONTROLLER_ENDPOINT").where(~meta.is_true("hasOpenApiAnnotation") & ~meta.is_true("hasOpenApiSpec"))
    return rows.select("id", meta.get("path", "").alias("path"), meta.get("httpVerb", "GET").alias("verb"))


def dto_lineage(graph: Graph, name: str) -> DataFrame:
    """(direction, relation, id) around the transfer objects of a name."""
    dto = graph.of("DATA_TRANSFER_OBJECT").where(F.col("name") == name).select(F.col("id").alias("dto"))
    into = graph.links("ACCEPTS", "RETURNS").join(dto, F.col("target_id") == F.col("dto")).select(
        F.when(F.col("type") == "ACCEPTS", "input").otherwise("output").alias("direction"), F.col("type").alias("relation"), F.col("source_id").alias("id"))
    out = graph.links("MAPS_TO").join(dto, F.col("source_id") == F.col("dto")).select(F.lit("mapping").alias("direction"), F.col("type").alias("relation"), F.col("target_id").alias("id"))
    return into.unionByName(out)


def service_topology(graph: Graph) -> DataFrame:
    """External services and their callers: (id, name, n_callers, callers)."""
    calls = graph.links("CALLS_REMOTE").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_callers"), joined(F.col("source_id")).alias("callers"))
    rows = graph.of("EXTERNAL_SERVICE").join(calls, "id", "left")
    return rows.select("id", "name", F.coalesce("n_callers", F.lit(0)).cast("long").alias("n_callers"), F.coalesce("callers", F.lit("")).alias("callers"))


def resilience_gaps(graph: Graph) -> DataFrame:
    """Remote calls whose caller calls no resilient proxy: (source_id, target_id)."""
    proxies = graph.of("PROXY").where(_holds(meta.get("PROXY_STEREOTYPE"), RESILIENT)).select(F.col("id").alias("target_id"))
    safe = graph.links("CALLS").join(proxies, "target_id", "left_semi").select("source_id").distinct()
    real = graph.nodes.select("id")
    rows = graph.links("CALLS_REMOTE").join(safe, "source_id", "left_anti")
    for end in ("source_id", "target_id"):
        rows = rows.join(real.withColumnRenamed("id", end), end, "left_semi")
    return rows.select("source_id", "target_id")


def coverage_map(graph: Graph) -> DataFrame:
    """(tested, mocked_only, untested): counts of nodes that are no tests, proxies or modules."""
    rows = graph.nodes.where(~F.col("type").isin("TEST", "PROXY", "MODULE")).select("id")
    rows = _flag(_flag(rows, _ends(graph.links("TESTS"), "target_id"), "tested"), _ends(graph.links("MOCKS"), "target_id"), "mocked")
    n = lambda c: F.count(F.when(c, 1))
    t, m = F.col("tested"), F.col("mocked")
    return rows.agg(n(t).alias("tested"), n(~t & m).alias("mocked_only"), n(~t & ~m).alias("untested"))


def untested_components(graph: Graph) -> DataFrame:
    """Services, repositories and components that no test names."""
    return graph.of("SERVICE", "REPOSITORY", "COMPONENT").join(_ends(graph.links("TESTS"), "target_id"), "id", "left_anti").select("id", "name", "type")


def observability_map(graph: Graph) -> DataFrame:
    """(kind, id, watched_by): metrics and spans with the classes they watch."""
    watch = graph.links("MEASURES", "TRACES").groupBy(F.col("target_id").alias("id")).agg(joined(F.col("source_id")).alias("watched_by"))
    kinds = graph.of("METRIC", "TRACE_SPAN", "HEALTH_INDICATOR").join(watch, "id", "left")
    return kinds.select(F.lower("type").alias("kind"), "id", F.coalesce("watched_by", F.lit("")).alias("watched_by"))


def uninstrumented(graph: Graph) -> DataFrame:
    """Services and controllers without instrumentation flags, metrics and spans."""
    rows = graph.of("SERVICE", "CONTROLLER").where(~meta.is_true("instrumented") & ~meta.is_true("hasMeterRegistry") & ~meta.is_true("hasTracerInjection"))
    return rows.join(_ends(graph.links("MEASURES", "TRACES"), "source_id"), "id", "left_anti").select("id", "name", "type")


def antipatterns(graph: Graph) -> DataFrame:
    """Performance issues, then hints."""
    return graph.of("PERFORMANCE_ISSUE", "PERFORMANCE_HINT").select("id", F.lower(F.substring_index("type", "_", -1)).alias("kind"), "name", meta.get("severity", "MEDIUM").alias("severity"))


def entity_schema(graph: Graph) -> DataFrame:
    """Mapped, unmapped entities and tables, and a score: one row."""
    edges = graph.links("SCHEMA_MAPS_TO")
    ents = _flag(graph.of("PERSISTENCE_ENTITY").select("id"), _ends(edges, "source_id"), "mapped")
    tabs = _flag(graph.of("SCHEMA_TABLE").select("id"), _ends(edges, "target_id"), "mapped")
    e = ents.agg(F.count(F.when(F.col("mapped"), 1)).alias("mapped"), F.count(F.when(~F.col("mapped"), 1)).alias("unmapped_entities"))
    u = tabs.agg(F.count(F.when(~F.col("mapped"), 1)).alias("unmapped_tables"))
    score = F.when((F.col("mapped") == 0) & (F.col("unmapped_entities") == 0), 100).otherwise(
        F.greatest(F.lit(0), 100 - 15 * F.col("unmapped_entities") - 5 * F.col("unmapped_tables"))
    )
    return e.join(u).withColumn("score", score.cast("long"))


def migration_timeline(graph: Graph) -> DataFrame:
    """Migrations by version with the tables and columns they made."""
    holds = graph.links("CONTAINS").select("source_id", "target_id")
    tabs = graph.of("SCHEMA_TABLE").select(F.col("id").alias("target_id"), F.col("name").alias("tab"))
    cols = graph.of("SCHEMA_COLUMN").select(F.col("id").alias("target_id"), F.col("name").alias("col"))
    made = holds.join(tabs, "target_id").select(F.col("source_id").alias("id"), F.col("target_id").alias("tid"), "tab")
    inner = holds.join(cols, "target_id").select(F.col("source_id").alias("tid"), "col")
    lists = made.join(inner, "tid", "left").groupBy("id").agg(joined(F.col("tab")).alias("tables"), joined(F.col("col")).alias("columns"))
    rows = graph.of("SCHEMA_MIGRATION").join(lists, "id", "left")
    return rows.select("id", meta.get("version").cast("long").alias("version"), F.coalesce("tables", F.lit("")).alias("tables"), F.coalesce("columns", F.lit("")).alias("columns")).orderBy("version", "id")


def native_compatibility(graph: Graph) -> DataFrame:
    """Counts of native-image issues by kind, readiness and label: one row."""
    issue = F.lower(F.coalesce(meta.get("issue"), F.lit("")))
    n = lambda w: F.count(F.when(issue.contains(w), 1))
    rows = graph.of("COMPATIBILITY_ISSUE").agg(
        n("reflect").alias("reflection"), n("prox").alias("proxies"), n("resource").alias("resources"), n("scope").alias("scopes"), n("lazy").alias("lazies"))
    aot = graph.nodes.agg(F.count(F.when(meta.is_true("hasAotHints"), 1)).alias("aot"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.expr("100 - 15*reflection - 12*proxies - 8*resources - 10*scopes - 10*lazies + 5*aot")))
    out = rows.join(aot).withColumn("readiness", score.cast("long"))
    label = F.when(F.col("readiness") >= 80, "Near-ready").when(F.col("readiness") >= 50, "Work needed").otherwise("Not ready")
    return out.withColumn("label", label)


def by_annotation(graph: Graph, name: str) -> DataFrame:
    """Nodes that carry an annotation, with or without its @."""
    return graph.nodes.where(F.array_contains(meta.names(meta.get("annotations", "")), name.removeprefix("@"))).select("id", "name", "type")


USES = ("INJECTS", "CALLS", "IMPLEMENTS", "EXTENDS", "PUBLISHES_TO", "SUBSCRIBES_FROM", "CALLS_REMOTE", "USES_CONFIG")


def dead_components(graph: Graph) -> DataFrame:
    """Components that nothing uses: (id, name, type, tested)."""
    rows = graph.of("SERVICE", "REPOSITORY", "COMPONENT", "CONTROLLER").join(_ends(graph.links(*USES), "target_id"), "id", "left_anti")
    return _flag(rows.select("id", "name", "type"), _ends(graph.links("TESTS"), "target_id"), "tested")


def deprecated_usage(graph: Graph) -> DataFrame:
    """Deprecated nodes and their callers: (id, caller), caller null if there is none."""
    old = by_annotation(graph, "Deprecated").select("id")
    calls = graph.links("CALLS").select(F.col("target_id").alias("id"), F.col("source_id").alias("caller"))
    return old.join(calls, "id", "left")


def simulate_injection(beans: DataFrame, interface: str, qualifier: str | None = None) -> DataFrame:
    """Candidates for an injection point and which one is taken.

    beans has qualified_name, bean_name, interfaces, is_primary, qualifier. A single candidate is
    taken; else the one whose qualifier or bean name is asked for; else the primary one.
    """
    fits = beans.where((F.col("qualified_name") == interface) | F.array_contains("interfaces", interface))
    asked = F.lit(False) if not (qualifier or "").strip() else (F.col("qualifier") == qualifier) | (F.col("bean_name") == qualifier)
    order = F.struct(F.when(F.coalesce(asked, F.lit(False)), 1).when(F.col("is_primary"), 2).otherwise(3).alias("rank"), "qualified_name")
    # one row: the best candidate and how many there are
    best = fits.agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 0")
    settled = (F.col("n") == 1) | (F.col("best.rank") < 3)
    rows = fits.join(F.broadcast(best))
    return rows.select("qualified_name", "bean_name", "is_primary", (settled & (F.col("qualified_name") == F.col("best.qualified_name"))).alias("resolved"), (~settled).alias("ambiguous"))


def provenance(commits: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Commits against the signing policy: (hash8, message, violation), compliant ones left out.

    commits has hash, message, signature (GPG, SSH or null) and, where keys are allowed only from a
    list, key. GPG is forbidden, SSH is required; an empty list takes every key.
    """
    v = F.when(F.col("signature") == "GPG", "GPG_FORBIDDEN").when(F.coalesce("signature", F.lit("")) != "SSH", "MISSING_SIGNATURE")
    if allowed:
        v = F.coalesce(v, F.when(~F.coalesce(F.col("key").isin(*allowed), F.lit(False)), "UNAUTHORIZED_KEY"))
    return commits.select(F.substring("hash", 1, 8).alias("hash8"), "message", v.alias("violation")).where("violation is not null")


def provenance_summary(violations: DataFrame) -> DataFrame:
    """(violation, n, compliant) of provenance(): counts by kind, or one row `NONE` that says compliant."""
    counts = violations.groupBy("violation").agg(F.count("*").alias("n"))
    none = violations.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("NONE").alias("violation"), "n", F.lit(True).alias("compliant"))
    return counts.withColumn("compliant", F.lit(False)).unionByName(none)


def recent_commits(commits: DataFrame, n: int) -> DataFrame:
    """The n latest commits (at, then hash): how many is the feature."""
    return commits.orderBy(F.desc("at"), "hash").limit(n)


def string_usage(lines: DataFrame, pattern: str, limit: int | None = 500) -> DataFrame:
    """Lines that hold a text, or match `regex:` + a pattern: (file, line, content).

    lines has file and text; line numbers start at 1; limit rows by file and line are the feature.
    """
    rows = lines.select("file", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    hit = F.col("raw").rlike(pattern[6:].strip()) if pattern.startswith("regex:") else F.col("raw").contains(pattern)
    out = rows.where(hit).select("file", (F.col("at") + 1).cast("long").alias("line"), F.trim("raw").alias("content"))
    return out.orderBy("file", "line").limit(limit) if limit else out


# Field types whose mutable use in singletons is a risk, by severity.
RISKY = {
    "HIGH": ("HashMap",),
    "MEDIUM": (
        "ArrayList", "HashSet", "LinkedList", "ArrayDeque", "StringBuilder", "SimpleDateFormat", "DateFormat", "Random", "Integer", "Long", "Double",
        "Float", "Boolean",
    ),
    "LOW": ("int", "long", "double", "float", "boolean", "String", "Date"),
}


def thread_safety(lines: DataFrame, singletons: DataFrame) -> DataFrame:
    """Mutable private fields of singleton classes: (file, line, class, field_type, severity).

    lines has file and text, singletons a column class of names, with or without packages.
    """
    rows = lines.select("file", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    named = F.nullif(F.regexp_extract("raw", r"\bclass\s+(\w+)", 1), F.lit(""))
    order = Window.partitionBy("file").orderBy("at")
    rows = rows.withColumn("class", F.last(named, ignorenulls=True).over(order))
    types = "|".join(t for group in RISKY.values() for t in group)
    field = F.regexp_extract("raw", rf"\bprivate\s+(?!(?:\w+\s+)*final\b)(?:(?:static|volatile|transient)\s+)*({types})\b(?:<[^=;]*>)?\s+\w+", 1)
    kind = F.coalesce(*(F.when(F.col("field_type").isin(*v), k) for k, v in RISKY.items()))
    simple = singletons.select(F.substring_index("class", ".", -1).alias("class")).distinct()
    hits = rows.withColumn("field_type", field).where("field_type <> ''").join(simple, "class", "left_semi")
    return hits.select("file", (F.col("at") + 1).cast("long").alias("line"), "class", "field_type", kind.alias("severity"))


def singletons(graph: Graph) -> DataFrame:
    """Classes of which there is one instance: (class)."""
    return graph.of("SERVICE", "COMPONENT", "CONTROLLER").select(F.col("name").alias("class"))


def auth_rules(graph: Graph) -> DataFrame:
    """(id, name, annotation, expression) of authorisation rules."""
    return graph.of("AUTH_RULE").select("id", "name", meta.get("annotation").alias("annotation"), meta.get("expression").alias("expression"))


def instrumentation(graph: Graph) -> DataFrame:
    """(instrumented, total) of services and controllers: one row."""
    return graph.of("SERVICE", "CONTROLLER").agg(F.count(F.when(meta.is_true("instrumented"), 1)).alias("instrumented"), F.count("*").alias("total"))


def lookup(graph: Graph, node_id: str) -> DataFrame:
    """The node of an id."""
    return graph.nodes.where(F.col("id") == node_id)


def by_name(graph: Graph, name: str) -> DataFrame:
    """The nodes of a name, by id: the first is the one that single lookups take."""
    return graph.nodes.where(F.col("name") == name).orderBy("id")


def websocket(topics: tuple[str, ...] = ("/topic/graph-updates", "/topic/health-updates", "/topic/analysis-progress")) -> dict:
    """Where live events would be subscribed to: fixed facts of the interface."""
    return {"endpoint": "/ws", "protocol": "STOMP", "topics": list(topics)}
