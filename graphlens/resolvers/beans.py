"""Beans that an application context would hold: component scan, profiles and conditions; classes, injections, calls and proxies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.model import latest
from graphlens.resolvers.base import (
    Facts,
    argument,
    class_id,
    edges,
    first,
    has,
    last_name,
    listed,
    methods,
    nodes,
    unite,
    unquoted,
)

# Annotations that make a class a bean, and the node type they give it.
STEREOTYPES = {
    "RestController": "CONTROLLER", "Controller": "CONTROLLER", "Service": "SERVICE", "Repository": "REPOSITORY",
    "Component": "COMPONENT", "Configuration": "CONFIGURATION",
}
# Conditions by annotation.
CONDITIONS = {
    "ConditionalOnProperty": "ON_PROPERTY", "ConditionalOnClass": "ON_CLASS", "ConditionalOnMissingBean": "ON_MISSING_BEAN",
    "ConditionalOnBean": "ON_BEAN", "ConditionalOnExpression": "ON_EXPRESSION",
}
# Annotations that a proxy intercepts, with the interceptor's name.
INTERCEPTORS = {
    "Transactional": "TRANSACTION_INTERCEPTOR", "Cacheable": "CACHE_INTERCEPTOR", "CacheEvict": "CACHE_INTERCEPTOR",
    "CachePut": "CACHE_INTERCEPTOR", "Async": "ASYNC_INTERCEPTOR", "PreAuthorize": "SECURITY_INTERCEPTOR",
    "PostAuthorize": "SECURITY_INTERCEPTOR", "Secured": "SECURITY_INTERCEPTOR", "RolesAllowed": "SECURITY_INTERCEPTOR",
    "Retryable": "RETRY_INTERCEPTOR", "Recover": "RETRY_INTERCEPTOR", "Scheduled": "SCHEDULED_INTERCEPTOR",
    "Locked": "LOCK_INTERCEPTOR",
}


def mapped(name: Column, table: dict[str, str]) -> Column:
    """The table's value for a name, null if it has none."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), name)


def stereotype() -> Column:
    """Node type by the first annotation that gives one."""
    kinds = F.filter(F.transform("annotations", lambda a: mapped(a["name"], STEREOTYPES)), lambda x: x.isNotNull())
    return F.coalesce(F.get(kinds, F.lit(0)), F.when(F.col("kind") == "interface", "INTERFACE").otherwise("CLASS"))


def kind_of_type(name: Column) -> Column:
    """Node type by how a bean's type is named."""
    simple = F.substring_index(last_name(F.regexp_extract(name, r"^([\w$.]*)", 1)), "<", 1)
    return (
        F.when(simple.rlike("(Repository|Dao|DAO)$"), "REPOSITORY")
        .when(simple.endswith("Service"), "SERVICE")
        .when(simple.endswith("Controller"), "CONTROLLER")
        .when(simple.rlike("(Configuration|Config)$"), "CONFIGURATION")
        .otherwise("COMPONENT")
    )


def decapitalized(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def _strings(annotation: Column) -> Column:
    return F.coalesce(F.array_distinct(listed(argument(annotation, "", "value"))), F.array().cast("array<string>"))


def holds(expected: Column, actual: Column, match_if_missing: bool = False) -> Column:
    """Whether a property condition is met: by any value but a false one where none is expected."""
    truthy = (F.trim(actual) != "") & (F.lower(actual) != "false") & (actual != "0")
    met = F.when(F.trim(F.coalesce(expected, F.lit(""))) == "", truthy).otherwise(F.lower(expected) == F.lower(actual))
    return F.coalesce(met, F.lit(match_if_missing))


def scanned(classes: DataFrame) -> DataFrame:
    """The classes that the component scans of the boot and configuration classes reach; all without such."""
    roots = classes.where(has(F.col("annotations"), "SpringBootApplication", "Configuration"))
    scan = first(F.col("annotations"), "ComponentScan")
    named = listed(argument(scan, "basePackages"))
    by_class = F.transform(listed(argument(scan, "basePackageClasses")), lambda c: F.regexp_replace(c, r"\.class$", ""))
    packages = F.transform(F.filter(by_class, lambda c: c.contains(".")), lambda c: F.regexp_replace(c, r"\.[^.]*$", ""))
    none = F.array().cast("array<string>")
    every = F.concat(F.array("package"), F.coalesce(named, none), F.coalesce(packages, none))
    wanted = roots.select(F.explode(every).alias("prefix")).distinct()
    # a package lies in each package that begins it
    parts = F.split("package", r"\.")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    rows = classes.withColumn("_row", F.xxhash64("file", "fqn", "at"))
    inside = rows.select("_row", F.explode(F.concat(begins, F.array(F.lit("")))).alias("prefix")).join(wanted, "prefix", "left_semi")
    unrooted = wanted.agg((F.count("*") == 0).alias("_all"))
    filters = {
        key: roots.select(F.explode(F.flatten(F.transform(
            F.regexp_extract_all(argument(scan, key), F.lit(r"classes\s*=\s*\{?([^})]+)"), 1), lambda c: listed(F.replace(c, F.lit(".class"), F.lit("")))
        ))).alias("f")).agg(F.collect_set("f").alias(f"_{key}"))
        for key in ("includeFilters", "excludeFilters")
    }
    # one row each: no filter, or the few that the scans name
    flagged = rows.join(inside.select("_row").distinct().withColumn("_in", F.lit(True)), "_row", "left").join(F.broadcast(unrooted))
    for f in filters.values():
        flagged = flagged.join(F.broadcast(f))
    begun = lambda key: F.exists(F.col(f"_{key}"), lambda f: F.startswith(F.col("fqn"), f))
    kept = (F.col("_in") | F.col("_all")) & ((F.size("_includeFilters") == 0) | begun("includeFilters")) & ~begun("excludeFilters")
    return flagged.where(kept).select(*classes.columns)


def beans(classes: DataFrame, properties: DataFrame, profiles: tuple[str, ...] = (), match_if_missing: bool = False) -> DataFrame:
    """The active beans, one a qualified name: the last one registered stays.

    Configuration classes and their bean methods come first, then what the scan finds. A bean with
    profiles needs an active one, if any are active; a property condition must hold. properties has
    key and value. match_if_missing makes conditions that say so hold for missing properties.
    """
    marks = F.col("annotations")
    config = classes.where(has(marks, "SpringBootApplication", "Configuration"))
    none = F.array().cast("array<string>")
    condition = "array<struct<type:string,key:string,expected_value:string>>"
    own = F.coalesce(*(unquoted(argument(first(marks, a), "")) for a in ("Component", "Service", "Repository")), decapitalized(F.col("name")))

    def shaped(rows: DataFrame, step: int, **columns: Column) -> DataFrame:
        values = {
            "qualified_name": F.col("fqn"), "bean_name": own, "stereotype": F.lit("CONFIGURATION"), "interfaces": none, "is_primary": F.lit(False),
            "qualifier": F.lit(None).cast("string"), "scope": F.lit("singleton"), "profiles": none, "conditions": F.array().cast(condition),
        } | columns
        order = F.lit(step).cast("long") * F.lit(1 << 60) + F.pmod(F.xxhash64("file", "fqn", values["bean_name"]), F.lit(1 << 60))
        return rows.select(*(c.alias(n) for n, c in values.items()), order.alias("seq"))

    m = F.col("marks")
    made = methods(config).where(has(m, "Bean"))
    named = F.coalesce(unquoted(argument(first(m, "Bean"), "", "value", "name")), F.col("method"))
    by_method = shaped(
        made, 1, qualified_name=F.col("returns"), bean_name=named, stereotype=kind_of_type(F.col("returns")), is_primary=has(m, "Primary"),
        qualifier=unquoted(argument(first(m, "Qualifier"), "")), profiles=_strings(first(m, "Profile")),
    )
    scope = (
        F.when(has(marks, "PrototypeScope"), "prototype").when(has(marks, "RequestScope"), "request").when(has(marks, "SessionScope"), "session")
        .otherwise(F.coalesce(unquoted(argument(first(marks, "Scope"), "")), F.lit("singleton")))
    )
    conditions = F.transform(
        F.filter(marks, lambda a: a["name"].isin(*CONDITIONS)),
        lambda a: F.struct(
            mapped(a["name"], CONDITIONS).alias("type"),
            F.coalesce(unquoted(argument(a, "name", "value")), F.lit("")).alias("key"),
            F.coalesce(unquoted(argument(a, "havingValue", "matchIfMissing")), F.lit("")).alias("expected_value"),
        ),
    )
    found = scanned(classes).where(has(marks, *STEREOTYPES))
    by_scan = shaped(
        found, 2, stereotype=stereotype(), interfaces=F.transform("implements", lambda i: F.substring_index(i, "<", 1)), is_primary=has(marks, "Primary"),
        qualifier=unquoted(argument(first(marks, "Qualifier"), "")), scope=scope, profiles=_strings(first(marks, "Profile")), conditions=conditions,
    )
    if profiles:
        active = F.array(*(F.lit(p) for p in profiles))
        by_scan = by_scan.where((F.size("profiles") == 0) | F.arrays_overlap("profiles", active))
    asked = by_scan.select("qualified_name", F.explode("conditions").alias("c")).where("c.type = 'ON_PROPERTY'")
    asked = asked.join(properties.select("key", "value"), F.col("c.key") == F.col("key"), "left")
    missing = F.col("value").isNull() & F.lit(match_if_missing) & (F.lower("c.expected_value") == "true")
    failed = asked.where(~(missing | holds(F.col("c.expected_value"), F.col("value")))).select("qualified_name").distinct()
    every = unite(shaped(config, 0), by_method, by_scan.join(failed, "qualified_name", "left_anti").select(*by_method.columns))
    return latest(every, "qualified_name", "seq").drop("seq")


def resolved(requests: DataFrame, beans: DataFrame, by_simple_name: bool = False) -> DataFrame:
    """(source_id, wanted, target): the bean that each request (source_id, wanted, qualifier) gets, if one does.

    Candidates are named or implement what is wanted. A single one is taken; else the one whose
    qualifier or bean name is asked for; else the primary one. by_simple_name also compares names
    without their packages.
    """
    names = F.concat(F.array("qualified_name"), "interfaces")
    if by_simple_name:
        names = F.concat(names, F.transform(names, last_name))
    offers = beans.select(F.explode(F.array_distinct(names)).alias("wanted"), "qualified_name", "bean_name", F.col("qualifier").alias("own"), "is_primary")
    rows = requests.select("source_id", "wanted", "qualifier").distinct().join(offers, "wanted")
    asked = F.trim(F.coalesce("qualifier", F.lit(""))) != ""
    fits = asked & ((F.col("own") == F.col("qualifier")) | (F.col("bean_name") == F.col("qualifier")))
    picked = rows.groupBy("source_id", "wanted", "qualifier").agg(
        F.countDistinct("qualified_name").alias("n"),
        F.min("qualified_name").alias("only"),
        F.min(F.when(fits, F.col("qualified_name"))).alias("asked"),
        F.min(F.when(F.col("is_primary"), F.col("qualified_name"))).alias("main"),
    )
    target = F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("asked", "main"))
    return picked.select("source_id", "wanted", target.alias("target")).where("target is not null")


def with_supertypes(found: DataFrame, above: DataFrame) -> DataFrame:
    """Beans that also offer every type above them; above has fqn and above (symbols.supertypes)."""
    more = above.groupBy(F.col("fqn").alias("qualified_name")).agg(F.collect_set("above").alias("_more"))
    every = F.array_union("interfaces", F.coalesce("_more", F.array().cast("array<string>")))
    return found.join(more, "qualified_name", "left").withColumn("interfaces", every).select(*found.columns)


def wiring(
    classes: DataFrame, found: DataFrame, by_simple_name: bool = False, by_field_type: bool = False, symbols: tuple[DataFrame, DataFrame] | None = None
) -> Facts:
    """Classes (the active beans only, if there are any) with what they inject and call.

    A call leads to the name that it is made on; by_field_type leads it to the field's type instead.
    symbols, of classes with full names, are the declared types (fqn) and the receivers of calls (file,
    fqn, head, kind): types that no bean offers are injected as they are, and a call leads to the bean
    that its receiver's type is injected with, else to that type.
    """
    rows = active(classes, found)
    extra = found.select(F.col("qualified_name").alias("fqn"), *(F.col(c).alias(f"_{c}") for c in ("bean_name", "is_primary", "qualifier", "scope", "profiles", "conditions")))
    rows = rows.join(extra, "fqn", "left")
    said = F.map_from_entries(F.transform(
        F.array_distinct(F.transform("_conditions", lambda c: c["type"])),
        lambda t: F.struct(F.concat(F.lit("CONDITION_"), t), F.element_at(F.transform(
            F.filter("_conditions", lambda c: c["type"] == t),
            lambda c: F.concat(c["key"], F.when(F.trim(c["expected_value"]) != "", F.concat(F.lit("="), c["expected_value"])).otherwise("")),
        ), -1)),
    ))
    made = nodes(
        rows, class_id(), F.col("fqn"), stereotype(), 1, sourceFile=F.col("file"),
        annotations=F.array_join(F.transform("annotations", lambda a: a["name"]), ","), beanName=F.col("_bean_name"),
        PRIMARY=F.when(F.col("_is_primary"), "TRUE"), QUALIFIER=F.when(F.trim("_qualifier") != "", F.col("_qualifier")),
        SCOPE=F.when(F.lower("_scope") != "singleton", F.col("_scope")), PROFILES=F.when(F.size("_profiles") > 0, F.array_join("_profiles", ",")),
    )
    told = nodes(rows.where(F.size("_conditions") > 0).withColumn("_said", said), class_id(), F.col("fqn"), stereotype(), 1).drop("metadata")
    told = told.join(rows.where(F.size("_conditions") > 0).select(class_id().alias("id"), said.alias("metadata")), "id").select(*made.columns)
    asks = F.concat(
        F.flatten(F.transform("constructors", lambda c: c["params"])),
        F.filter("fields", lambda f: has(f["annotations"], "Autowired")),
    )
    requests = rows.select("file", class_id().alias("source_id"), F.explode(asks).alias("p")).select(
        "file", "source_id", (F.regexp_extract("p.type", r"^([\w$.]*)", 1) if symbols else F.col("p.type")).alias("wanted"),
        F.when(has(F.col("p.annotations"), "Qualifier"), F.coalesce(unquoted(argument(first(F.col("p.annotations"), "Qualifier"), "")), F.lit("Qualifier"))).alias("qualifier"),
    )
    got = resolved(requests, found, by_simple_name)
    taken = edges(got, F.col("source_id"), class_id("target"), "INJECTS")
    # types that say their package: the platform's own, and all where there are no beans to look in
    left = requests.join(got, ["source_id", "wanted"], "left_anti")
    if symbols:
        left = left.join(symbols[0].select(F.col("fqn").alias("wanted")).distinct(), "wanted", "left_semi").select(*requests.columns)
    else:
        left = left if found.isEmpty() else left.where(F.col("wanted").rlike(r"^javax?\."))
    taken = unite(taken, edges(left, F.col("source_id"), class_id("wanted"), "INJECTS")).distinct()
    ends = unite(got.select(class_id("target").alias("id"), "wanted"), left.select(class_id("wanted").alias("id"), "wanted"))
    missing = ends.join(made.select("id"), "id", "left_anti").groupBy("id").agg(F.min("wanted").alias("wanted"))
    services = nodes(missing, F.col("id"), F.col("wanted"), "SERVICE", 1)
    if symbols:
        injected = got.groupBy(F.expr("substring(source_id, 7)").alias("fqn"), F.col("wanted").alias("kind")).agg(F.min("target").alias("bean"))
        called = symbols[1].join(rows.select("file", "fqn"), ["file", "fqn"], "left_semi").join(injected, ["fqn", "kind"], "left")
        calls = edges(called.select("fqn", F.coalesce("bean", "kind", "head").alias("to")).distinct(), class_id(), class_id("to"), "CALLS")
        return Facts(unite(made, told, services), unite(taken, calls))
    target = F.substring_index("scope", ".", 1)
    called = rows.select("fqn", "fields", F.explode(F.flatten(F.transform("methods", lambda m: m["calls"]))).alias("c")).select("fqn", "fields", "c.scope")
    called = called.where("scope is not null and scope <> 'this'")
    if by_field_type:
        bare = F.regexp_replace("scope", r"^this\.", "")
        called = called.withColumn("scope", bare)
        kind = F.get(F.filter("fields", lambda f: f["name"] == target), F.lit(0))["type"]
        by_name = found.select(F.explode(F.array_distinct(F.array("qualified_name", last_name(F.col("qualified_name"))))).alias("kind"), "qualified_name")
        called = called.select("fqn", target.alias("name"), F.substring_index(kind, "<", 1).alias("kind")).distinct()
        called = called.join(by_name.groupBy("kind").agg(F.min("qualified_name").alias("bean")), "kind", "left")
        called = called.select("fqn", F.coalesce("bean", "kind", "name").alias("to"))
    else:
        called = called.select("fqn", target.alias("to"))
    calls = edges(called.distinct(), class_id(), class_id("to"), "CALLS")
    return Facts(unite(made, told, services), unite(taken, calls))


def active(classes: DataFrame, found: DataFrame) -> DataFrame:
    """The classes that are active beans; all where there are no beans."""
    if found.isEmpty():
        return classes
    return classes.join(found.select(F.col("qualified_name").alias("fqn")), "fqn", "left_semi").select(*classes.columns)


def proxies(classes: DataFrame, found: DataFrame, calls: DataFrame) -> Facts:
    """Proxies of called classes that have intercepted methods, and the calls that lead through them.

    calls are edges; a call's target is compared with the class's name, else without packages and case.
    """
    names = F.flatten(F.transform("methods", lambda m: F.concat(m["annotations"], F.col("annotations"))))
    tags = F.array_distinct(F.filter(F.transform(names, lambda a: mapped(a["name"], INTERCEPTORS)), lambda x: x.isNotNull()))
    marked = active(classes, found).select("fqn", F.array_join(tags, ",").alias("tags")).where("tags <> ''")
    marked = marked.groupBy("fqn").agg(F.min("tags").alias("tags"))
    to = calls.where("type = 'CALLS' and target_id like 'class:%'").select("source_id", "target_id", F.expr("substring(target_id, 7)").alias("to"))
    simple = marked.groupBy(F.lower(last_name(F.col("fqn"))).alias("simple")).agg(F.min_by("tags", "fqn").alias("loose"))
    hit = to.join(marked.withColumnRenamed("fqn", "to"), "to", "left").withColumn("simple", F.lower(last_name(F.col("to")))).join(simple, "simple", "left")
    hit = hit.withColumn("tags", F.coalesce("tags", "loose")).where("tags is not null")
    proxy = F.concat(F.lit("proxy:"), "to")
    made = nodes(hit.select("to", "tags").distinct(), proxy, F.concat("to", F.lit("$Proxy")), "PROXY", 2, PROXY_STEREOTYPE=F.col("tags"), targetClass=F.col("to"), stereotypes=F.col("tags"))
    return Facts(made, unite(edges(hit, F.col("source_id"), proxy, "CALLS"), edges(hit, proxy, F.col("target_id"), "CALLS")).distinct())


