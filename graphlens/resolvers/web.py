"""Endpoints, security rules and filter chains, and API contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.resolvers.base import Facts, argument, class_id, edges, first, has, known, literal, methods, nodes, nothing, unite, unquoted
from graphlens.resolvers.beans import mapped

# Annotations that map a method to a verb.
VERBS = {
    "RequestMapping": "REQUEST", "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE",
    "PatchMapping": "PATCH",
}
# Annotations that secure a class or method.
SECURING = ("PreAuthorize", "PostAuthorize", "Secured", "RolesAllowed")


def joined_path(base: Column, path: Column) -> Column:
    """A class's and a method's path with one slash between them."""
    tail = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(base == "", path).when(path.isin("", "/"), base).otherwise(F.concat(F.regexp_replace(base, "/$", ""), tail))


def endpoints(classes: DataFrame) -> Facts:
    """An endpoint for each mapping annotation of a controller's methods."""
    rows = methods(classes.where(has(F.col("annotations"), "RestController", "Controller")))
    base = F.coalesce(literal(argument(first(F.col("annotations"), "RequestMapping"), "value", "path", "")), F.lit(""))
    rows = rows.select("file", "fqn", "method", base.alias("base"), F.explode("marks").alias("a"))
    rows = rows.withColumn("verb", mapped(F.col("a.name"), VERBS)).where("verb is not null")
    a = F.col("a")
    path = F.filter(F.transform(F.filter(a["args"], lambda p: p["key"] == "path"), lambda p: literal(p["value"])), lambda v: v.isNotNull())
    value = F.filter(F.transform(F.filter(a["args"], lambda p: p["key"].isin("value", "")), lambda p: literal(p["value"])), lambda v: v != "")
    own = F.coalesce(F.nullif(F.get(F.reverse(path), F.lit(0)), F.lit("")), F.get(value, F.lit(0)), F.lit("/"))
    rows = rows.withColumn("path", joined_path(F.col("base"), own))
    node = F.concat_ws(":", F.lit("endpoint"), "verb", "path", "method")
    made = nodes(
        rows, node, F.concat_ws(" ", "verb", "path"), "CONTROLLER_ENDPOINT", 3, httpVerb=F.col("verb"), path=F.col("path"), methodName=F.col("method"),
        controllerClass=F.col("fqn"), sourceFile=F.col("file"), produces=literal(argument(a, "produces")), consumes=literal(argument(a, "consumes")),
    )
    return Facts(made, edges(rows, node, class_id(), "ROUTES_TO").distinct())


def security(classes: DataFrame, present: DataFrame, found: DataFrame) -> Facts:
    """Authorisation rules of classes and their endpoints, filter chains and their flags.

    present holds the ids of class nodes, found the endpoint facts: rules wait for both.
    """
    marks = F.concat("annotations", F.flatten(F.transform("methods", lambda m: m["annotations"])))
    rows = classes.select("file", "fqn", F.explode(marks).alias("a")).where(F.col("a.name").isin(*SECURING))
    said = F.regexp_replace(F.coalesce(argument(F.col("a"), "", "value"), F.lit("")), '^"|"$', "")
    rule = F.concat(F.lit("auth_rule:"), "fqn", F.lit("."), "a.name")
    rules = nodes(rows, rule, F.concat("a.name", F.lit(" on "), "fqn"), "AUTH_RULE", 4, annotation=F.col("a.name"), expression=said, sourceFile=F.col("file"))
    of_class = known(edges(rows, class_id(), rule, "SECURED_BY"), present, "source_id")
    ends = found.select(F.col("id").alias("endpoint"), F.col("metadata")["controllerClass"].alias("fqn"))
    of_end = edges(rows.join(ends, "fqn"), F.col("endpoint"), rule, "SECURED_BY")
    every = methods(classes)
    about = F.concat_ws(" ", F.coalesce("body", F.lit("")), "returns", F.array_join(F.transform("params", lambda p: p["type"]), " "))
    chains = every.where(F.col("body").isNotNull() & about.rlike("SecurityFilterChain|HttpSecurity"))
    chain = F.concat(F.lit("security_filter_chain:"), "fqn", F.lit("."), "method")
    made = nodes(chains, chain, F.concat(F.lit("SecurityFilterChain-"), "method"), "SECURITY_FILTER_CHAIN", 4, configurationClass=F.col("fqn"), method=F.col("method"))
    csrf = F.col("body").contains(".csrf().disable()") | F.col("body").contains(".csrf(AbstractHttpConfigurer::disable)")
    matchers = F.filter(F.split("body", "\n"), lambda x: x.contains("requestMatchers") & x.contains("hasRole"))

    def flag(key: Column | str, label: str, rule: Column | None = None) -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        rule = F.lit(None).cast("string") if rule is None else rule
        return F.struct(key.alias("key"), F.lit(label).alias("label"), rule.alias("rule"))

    flags = F.array_compact(F.concat(
        F.array(F.when(csrf, flag("CSRF_DISABLED", "CSRF_DISABLED")), F.when(F.col("body").contains("STATELESS"), flag("STATELESS", "STATELESS_SESSION"))),
        F.transform(matchers, lambda x, i: flag(F.concat(F.lit("AUTH_MATCHER_"), F.col("method"), F.lit("_"), i.cast("string")), "AuthMatcher", F.trim(x))),
    ))
    rows = chains.select("file", "fqn", "method", F.explode(flags).alias("f"))
    node = F.concat(F.lit("security_flag:"), "fqn", F.lit("."), "f.key")
    set_ = nodes(rows, node, F.col("f.label"), "SECURITY_FLAG", 4, flag=F.when(F.col("f.rule").isNull(), F.col("f.key")), rule=F.col("f.rule"), source=F.col("fqn"))
    configured = unite(
        edges(rows, F.concat(F.lit("security_filter_chain:"), "fqn", F.lit("."), "method"), node, "CONFIGURED_BY"),
        known(edges(chains, class_id(), chain, "CONFIGURED_BY"), present, "source_id"),
    )
    return Facts(unite(rules, made, set_), unite(of_class, of_end, configured).distinct())


def contracts(classes: DataFrame, found: DataFrame, spec: DataFrame) -> Facts:
    """What annotations and a specification say about endpoints (facts in found), and transfer objects.

    spec has path and verb; annotated methods meet endpoints by the method's name.
    """
    every = methods(classes)
    m = F.col("marks")
    ends = found.select("id", F.col("name").alias("label"), "metadata")
    operation = first(m, "Operation", "ApiOperation")
    code = F.coalesce(argument(first(m, "ApiResponse"), "responseCode", "code"))
    rows = every.where(has(m, "Operation", "ApiOperation", "ApiResponse")).join(ends, F.col("method") == F.col("metadata")["methodName"])
    text = lambda key: F.nullif(literal(argument(operation, key)), F.lit(""))
    told = nodes(
        rows, F.col("id"), F.col("label"), "CONTROLLER_ENDPOINT", 9, operationSummary=text("summary"), operationId=text("operationId"),
        hasOpenApiAnnotation=F.when(has(m, "Operation", "ApiOperation"), "true"), responseCode=unquoted(code),
    )
    listed = ends.join(spec.select("path", F.upper("verb").alias("verb")).distinct(), (F.col("path") == F.col("metadata")["path"]) & (F.col("verb") == F.upper(F.col("metadata")["httpVerb"])))
    stated = nodes(listed, F.col("id"), F.col("label"), "CONTROLLER_ENDPOINT", 9, hasOpenApiSpec=F.lit("true"))
    objects = every.where(has(m, "Schema")).select("file", "fqn", "name").distinct()
    made = nodes(objects, F.concat(F.lit("dto:"), "fqn"), F.col("name"), "DATA_TRANSFER_OBJECT", 9)
    return Facts(unite(told, stated, made), nothing(classes.sparkSession).edges)
