"""Architecture rules and the seven health dimensions as one issues table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions import meta
from graphlens.model import EDGE_TYPES, NODE_TYPES, Graph
from graphlens.operators import audit, traversal

RULE = "rule_id string, severity string, forbidden_edge string, source_type string, target_type string, description string, rationale string"
# The standard rules.
STANDARD_RULES = (
    ("ARCH-001", "ERROR", "INJECTS", "CONTROLLER", "REPOSITORY", "Controllers do not inject repositories", "Services stand between"),
    ("ARCH-002", "ERROR", "INJECTS", "CONTROLLER", "DATA_REPOSITORY", "Controllers do not inject data repositories", "Services stand between"),
    ("ARCH-003", "ERROR", "INJECTS", "REPOSITORY", "SERVICE", "Repositories do not inject services", "Layers depend downwards"),
    ("ARCH-004", "WARNING", "PUBLISHES_TO", "CONTROLLER", "MESSAGE_TOPIC", "Controllers do not publish messages", "Services own messages"),
    ("ARCH-005", "WARNING", "CALLS_REMOTE", "CONTROLLER", "EXTERNAL_SERVICE", "Controllers call no external services", "Services own remote calls"),
)
# Dimensions in their order.
DIMENSIONS = (
    "DEPENDENCY_HEALTH", "SECURITY_HEALTH", "RESILIENCE_HEALTH", "TEST_HEALTH", "OBSERVABILITY_HEALTH", "CONTRACT_HEALTH",
    "ARCHITECTURE_RULES_HEALTH",
)


#: Which of the branches of issues() watch observability.
WATCHING = (0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0)


def standard_rules(spark: SparkSession) -> DataFrame:
    """The rules that always hold."""
    return spark.createDataFrame(list(STANDARD_RULES), RULE)


def add_rule(rules: DataFrame, rule_id: str, severity: str, edge: str, source: str, target: str, description: str = "", rationale: str = "") -> DataFrame:
    """The rules and one more; unknown types are an error."""
    if edge not in EDGE_TYPES or source not in NODE_TYPES or target not in NODE_TYPES:
        raise ValueError(f"unknown type in rule {rule_id}")
    return rules.unionByName(rules.sparkSession.createDataFrame([(rule_id, severity, edge, source, target, description, rationale)], RULE))


def remove_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    """The rules without those of an id."""
    return rules.where(F.col("rule_id") != rule_id)


def list_rules(rules: DataFrame) -> DataFrame:
    """The rules by id."""
    return rules.orderBy("rule_id", "severity")


def rule_violations(graph: Graph, rules: DataFrame) -> DataFrame:
    """(rule_id, severity, source_id, target_id): edges of a forbidden type between forbidden types."""
    kinds = graph.nodes.select("id", "type")
    rows = graph.edges.join(rules, F.col("type") == F.col("forbidden_edge"))
    rows = rows.join(kinds.toDF("source_id", "source_type"), ["source_id", "source_type"], "left_semi")
    rows = rows.join(kinds.toDF("target_id", "target_type"), ["target_id", "target_type"], "left_semi")
    return rows.select("rule_id", "severity", "source_id", "target_id")


def rule_counts(violations: DataFrame) -> DataFrame:
    """(violations, errors, warnings) of rule_violations(): one row."""
    n = lambda level: F.count(F.when(F.col("severity") == level, 1))
    return violations.agg(F.count("*").alias("violations"), n("ERROR").alias("errors"), n("WARNING").alias("warnings"))


def _issues(rows: DataFrame, dimension: int, node: Column, reason: str, penalty: Column | int, risk: Column | int, level: Column | str) -> DataFrame:
    penalty, risk, level = (v if isinstance(v, Column) else F.lit(v) for v in (penalty, risk, level))
    return rows.select(
        F.lit(DIMENSIONS[dimension]).alias("dimension"), node.alias("node_id"), F.lit(reason).alias("reason"),
        penalty.cast("long").alias("penalty"), risk.cast("long").alias("risk"), level.alias("level"),
    )


def issues(graph: Graph, longest_cycle: int = 4) -> DataFrame:
    """Every finding with its penalty: (dimension, node_id, reason, penalty, risk, level)."""
    ids, src = F.col("id"), F.col("source_id")
    open_ends = audit.unsecured_endpoints(graph)
    critical, error = F.col("severity") == "CRITICAL", F.col("severity") == "ERROR"
    short = traversal.cycles(graph, longest_cycle)
    # components that no listed cycle lies in: their cycles are longer
    knotted = traversal.on_cycles(graph)
    listed = short.select(F.explode(F.split("path", " -> ")).alias("id")).distinct()
    seen = knotted.join(listed, "id", "left_semi").select("component").distinct()
    long = knotted.join(seen, "component", "left_anti").select("component").distinct()
    watched = graph.links("MEASURES", "TRACES").select(F.col("source_id").alias("id")).distinct()
    classes = graph.of("SERVICE", "CONTROLLER")
    retry = graph.of("PROXY").where(F.coalesce(meta.get("PROXY_STEREOTYPE"), F.lit("")).rlike("RETRY|CIRCUIT_BREAKER_INTERCEPTOR"))
    guarded = graph.links("CALLS").join(retry.select(ids.alias("source_id")), "source_id", "left_semi").select("target_id").distinct()
    remote = graph.links("CALLS_REMOTE")
    unguarded = remote.join(guarded.select(F.col("target_id").alias("source_id")), "source_id", "left_anti").join(
        graph.nodes.select(ids.alias("target_id")), "target_id", "left_semi")
    traced = graph.links("TRACES").select("source_id").distinct()
    indicators = graph.of("HEALTH_INDICATOR").select(ids.alias("target_id"))
    healthy = graph.links("IMPLEMENTS").join(indicators, "target_id", "left_semi").select(src.alias("id")).distinct()
    flags = graph.of("SECURITY_FLAG").where(F.col("name") == "CSRF_DISABLED")
    rules = rule_violations(graph, standard_rules(graph.nodes.sparkSession))
    parts = [
        _issues(short, 0, F.col("path"), "dependency cycle", 20, 40, "MEDIUM"),
        _issues(long, 0, F.col("component"), "long dependency cycle", 20, 40, "MEDIUM"),
        _issues(open_ends, 1, ids, "unsecured endpoint", F.when(critical, 25).otherwise(15), F.when(critical, 90).otherwise(70), F.col("severity")),
        _issues(flags, 1, ids, "CSRF disabled", 20, 75, "HIGH"),
        _issues(unguarded, 2, src, "remote call without retry", 15, 55, "MEDIUM"),
        _issues(audit.untested_components(graph), 3, ids, "untested", 5, 35, "MEDIUM"),
        _issues(classes.join(watched, "id", "left_anti"), 4, ids, "no metrics or traces", 8, 8, "MEDIUM"),
        _issues(classes.where(~meta.is_true("hasMeterRegistry") & ~meta.is_true("instrumented")), 4, ids, "not instrumented", 5, 5, "MEDIUM"),
        _issues(graph.of("DATA_REPOSITORY").join(healthy, "id", "left_anti"), 4, ids, "no health indicator", 10, 10, "HIGH"),
        _issues(remote.join(traced, "source_id", "left_anti"), 4, src, "untraced remote call", 12, 12, "HIGH"),
        _issues(audit.undocumented_endpoints(graph), 5, ids, "undocumented endpoint", 10, 30, "LOW"),
        _issues(audit.undefined_properties(graph), 5, ids, "undefined property", 8, 80, "HIGH"),
        _issues(rules, 6, src, "rule violation", F.when(error, 20).otherwise(10), F.when(error, 20).otherwise(10), F.when(error, "HIGH").otherwise("MEDIUM")),
    ]
    if classes.isEmpty():
        # nothing to observe
        parts = [p for p, n in zip(parts, WATCHING, strict=True) if not n]
    return reduce(DataFrame.unionByName, parts)


def dimension_scores(found: DataFrame) -> DataFrame:
    """(dimension, n_issues, score): 100 less all penalties, not under 0."""
    spark = found.sparkSession
    all_of = spark.createDataFrame([(i, d) for i, d in enumerate(DIMENSIONS)], "ord int, dimension string")
    sums = found.groupBy("dimension").agg(F.sum("penalty").alias("p"), F.count("*").alias("n"))
    score = F.greatest(F.lit(0), 100 - F.coalesce("p", F.lit(0)))
    return all_of.join(sums, "dimension", "left").select("dimension", F.coalesce("n", F.lit(0)).cast("long").alias("n_issues"), score.cast("long").alias("score"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def health(graph: Graph, longest_cycle: int = 4) -> DataFrame:
    """Dimension rows with advice, and an OVERALL row with the grade: (dimension, n_issues, score, note)."""
    scores = dimension_scores(issues(graph, longest_cycle))
    advice = F.when(F.col("score") < 60, "CRITICAL").when(F.col("score") < 80, "IMPROVE").otherwise("healthy")
    total = scores.agg(F.sum("n_issues").alias("n_issues"), F.round(F.avg("score")).cast("long").alias("score"))
    overall = total.select(F.lit("OVERALL").alias("dimension"), "n_issues", "score", grade(F.col("score")).alias("note"))
    return scores.withColumn("note", advice).unionByName(overall)


def recommendations(scores: DataFrame) -> DataFrame:
    """(dimension, advice) of the dimensions under 80, or one line that says that all are healthy; scores as dimension_scores()."""
    poor = scores.where("score < 80")
    text = F.format_string("%s: %s score is %d — address %d issues", F.when(F.col("score") < 60, "CRITICAL").otherwise("IMPROVE"), "dimension", "score", "n_issues")
    fine = scores.agg(F.min("score").alias("least")).where("least >= 80")
    return poor.select("dimension", text.alias("advice")).unionByName(fine.select(F.lit("ALL").alias("dimension"), F.lit("Architecture is healthy").alias("advice")))


def gate(graph: Graph, least: int = 65, longest_cycle: int = 4) -> DataFrame:
    """A health report for a build: (passed, report), report as JSON with score, counts, dimensions, critical issues and advice."""
    found = issues(graph, longest_cycle)
    scores = dimension_scores(found)
    dims = scores.agg(F.round(F.avg("score")).cast("long").alias("overallScore"), F.array_sort(F.collect_list(F.struct("dimension", "score"))).alias("dimensions"))
    top = found.where("level = 'CRITICAL'").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("nodeId"), "reason", F.col("risk").alias("score"), "level"))).alias("criticalIssues"))
    advice = recommendations(scores).agg(F.array_sort(F.collect_list("advice")).alias("recommendations"))
    counts = graph.nodes.agg(F.count("*").alias("nodeCount")).join(graph.edges.agg(F.count("*").alias("edgeCount")))
    # one row each
    row = dims.join(counts).join(top).join(advice)
    return row.select((F.col("overallScore") >= least).alias("passed"), F.to_json(F.struct(*row.columns)).alias("report"))


def backlog(graph: Graph, levels: tuple[str, ...] | None = None, longest_cycle: int = 4) -> DataFrame:
    """Issues to remediate, the worst dimensions first, with the words a fixer is given.

    levels picks some levels; None takes all.
    """
    found = issues(graph, longest_cycle)
    rows = (found if levels is None else found.where(F.col("level").isin(*levels))).join(dimension_scores(found).select("dimension", "score"), "dimension")
    ask = F.format_string("Fix %s of %s (%s, penalty %d).", F.col("reason"), F.col("node_id"), F.lower("dimension"), F.col("penalty"))
    return rows.select("dimension", "score", "node_id", "reason", "level", ask.alias("prompt")).orderBy("score", "dimension", "node_id")


def fix_context(graph: Graph, node_id: str, issue: str) -> DataFrame:
    """The words a fixer is given for one node: its neighbours and the issue."""
    near = traversal.neighbours(graph, node_id)
    lines = near.select(F.format_string("%s %s %s", "direction", "type", "other_id").alias("line"))
    text = F.array_join(F.array_sort(F.collect_list("line")), "; ")
    return lines.agg(text.alias("t")).select(F.lit(node_id).alias("node_id"), F.format_string(f"{issue} at {node_id}: %s", "t").alias("prompt"))
