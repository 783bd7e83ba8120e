"""Messaging, configuration, remote calls, tests, observability, performance patterns and native-image risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.resolvers.base import (
    Facts,
    argument,
    class_id,
    edges,
    fields,
    first,
    has,
    known,
    last_name,
    literal,
    methods,
    nodes,
    nothing,
    plain,
    together,
    unite,
    unquoted,
)

# Listener annotations and sending templates, with their technology.
LISTENERS = {"KafkaListener": "kafka", "RabbitListener": "rabbitmq", "JmsListener": "jms", "StreamListener": "spring-cloud-stream"}
TEMPLATES = {"KafkaTemplate": "kafka", "RabbitTemplate": "rabbitmq", "JmsTemplate": "jms", "StreamBridge": "spring-cloud-stream"}
# Tests by annotation.
SLICES = ("WebMvcTest", "DataJpaTest", "JsonTest", "RestClientTest")
# Marks and types of logging, metrics and tracing.
LOGGERS, SPANS = ("Slf4j", "Log4j2", "CommonsLog"), ("NewSpan", "WithSpan")
BUILDERS = ("Counter", "Timer", "Gauge", "DistributionSummary", "LongTaskTimer")
# How repository calls are named.
READS = "^(find|get|read|load|query|save|update|delete|remove|count|exists|search)"
WRITES = "^(save|update|delete|remove|insert)|^persist$"
REPOSITORY = "(Repository|Repo|Dao|DAO)$|repository"
# Calls that a native image must be told of, and annotations that tell it.
REFLECTION = ("forName", "invoke", "getDeclaredMethod", "getDeclaredField", "newInstance")
RESOURCES = ("getResourceAsStream", "getSystemResourceAsStream", "getResource")
HINTS = ("RegisterReflectionForBinding", "ImportRuntimeHints", "Reflective")
SCOPES = ("SessionScope", "RequestScope", "PrototypeScope")
# Issues of a native image and what to do about them.
NATIVE = {
    "reflection": ("Uses reflection without explicit AOT hints", "Register the reflective access with runtime hints."),
    "proxy": ("Creates dynamic proxies", "List the proxies' interfaces in the proxy configuration."),
    "resource": ("Loads classpath resources", "Declare the resources in the resource configuration."),
    "scope": ("Non-singleton scope in AOT context", "Prefer singletons: scoped beans need proxies."),
    "lazy": ("Uses @Lazy injection", "Test the changed order of initialisation in native mode."),
}

#: Lines on which addresses of remote services are looked for.
CLIENTS = "WebClient|RestTemplate"


def _value(name: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), name)


def called(classes: DataFrame) -> DataFrame:
    """One row for each call of a method: file, fqn, annotations, method, marks, at and the call's columns."""
    rows = methods(classes).select("file", "fqn", "annotations", "method", "marks", F.posexplode("calls").alias("at", "c"))
    return rows.select("file", "fqn", "annotations", "method", "marks", "at", "c.*")


def _enriched(rows: DataFrame, present: DataFrame, stage: int, **metadata: Column) -> DataFrame:
    """Facts that add metadata to class nodes that there are; present has id, name, type."""
    own = present.select("id", F.col("name").alias("_label"), F.col("type").alias("_type"))
    met = rows.withColumn("_id", class_id()).join(own, F.col("_id") == F.col("id"))
    return nodes(met, F.col("_id"), F.col("_label"), F.col("_type"), stage, **metadata)


def messaging(classes: DataFrame, by_field_type: bool = False) -> Facts:
    """Listeners and senders with their topics, and stream functions of configuration classes.

    A sender is called on something named like a template; by_field_type looks at the field's type.
    """
    rows = methods(classes).select("file", "fqn", "method", F.explode("marks").alias("a")).withColumn("technology", _value(F.col("a.name"), LISTENERS))
    channel = plain(F.coalesce(*(argument(F.col("a"), *k) for k in (("topics",), ("queues", "destination"), ("value", "bindings"), ("",)))))
    rows = rows.where("technology is not null").withColumn("channel", channel).where("channel is not null")
    topic = F.concat(F.lit("message_topic:"), "channel")
    listeners = nodes(rows, class_id(), F.col("fqn"), "MESSAGE_CONSUMER", 3, sourceFile=F.col("file"), method=F.col("method"), channel=F.col("channel"), technology=F.col("technology"))
    heard = nodes(rows, topic, F.col("channel"), "MESSAGE_TOPIC", 3, technology=F.col("technology"), consumers=F.col("fqn"))
    sent = called(classes).where(F.col("name").isin("send", "convertAndSend")).withColumn("channel", literal(F.get("args", F.lit(0)))).where("channel is not null")
    if by_field_type:
        kinds = fields(classes).select("fqn", F.col("field").alias("scope"), F.substring_index("kind", "<", 1).alias("of"))
        sent = sent.withColumn("scope", F.regexp_replace("scope", r"^this\.", "")).join(kinds, ["fqn", "scope"], "left").withColumn("scope", F.coalesce("of", "scope"))
    template = F.coalesce(*(F.when(F.col("scope").contains(t), v) for t, v in TEMPLATES.items()))
    sent = sent.withColumn("technology", template).where("technology is not null")
    senders = nodes(sent, class_id(), F.col("fqn"), "MESSAGE_PRODUCER", 3, sourceFile=F.col("file"), method=F.col("method"), channel=F.col("channel"), technology=F.col("technology"))
    told = nodes(sent, topic, F.col("channel"), "MESSAGE_TOPIC", 3, technology=F.col("technology"), producers=F.col("fqn"))
    made = methods(classes.where(has(F.col("annotations"), "Configuration")))
    role = F.regexp_extract("returns", r"^(?:java\.util\.function\.)?(Function|Consumer|Supplier)<", 1)
    bean = F.coalesce(unquoted(argument(first(F.col("marks"), "Bean"), "value", "name", "")), F.col("method"))
    made = made.withColumns({"role": role, "bean": bean}).where("role <> ''")
    function = F.col("role") == "Function"
    streams = nodes(
        made, F.when(function, F.concat(F.lit("class:"), "fqn", F.lit("#"), "bean")).otherwise(class_id()), F.when(function, F.col("bean")).otherwise(F.col("fqn")),
        F.when(F.col("role") == "Supplier", "MESSAGE_PRODUCER").otherwise("MESSAGE_CONSUMER"), 3, sourceFile=F.col("file"), beanName=F.col("bean"),
        technology=F.lit("spring-cloud-stream"), method=F.when(~function, F.col("method")), role=F.when(function, "function"),
    )
    flows = unite(edges(rows, topic, class_id(), "SUBSCRIBES_FROM"), edges(sent, class_id(), topic, "PUBLISHES_TO"))
    return Facts(unite(listeners, heard, senders, told, streams), flows.distinct())


def configuration(classes: DataFrame, present: DataFrame, properties: DataFrame) -> Facts:
    """Property classes, keys with and without defaults, and the values that properties (key, value) give them."""
    mark = first(F.col("annotations"), "ConfigurationProperties")
    groups = classes.where(mark.isNotNull()).withColumn("prefix", F.coalesce(literal(argument(mark, "prefix", "")), F.lit("")))
    group = F.concat(F.lit("config_properties:"), "fqn")
    named = nodes(groups, group, F.concat(F.lit("ConfigProperties:"), "fqn"), "CONFIG_PROPERTIES", 3, prefix=F.col("prefix"), className=F.col("fqn"))
    cells = groups.select("file", "fqn", "prefix", F.explode("fields").alias("f")).withColumn("key", F.concat_ws(".", F.nullif("prefix", F.lit("")), "f.name"))
    key = F.concat(F.lit("config_key:"), "key")
    own = nodes(cells, key, F.col("key"), "CONFIG_KEY", 3, propertyKey=F.col("key"), definedIn=F.col("fqn"))
    params = F.flatten(F.transform(F.concat(F.transform("methods", lambda m: m["params"]), F.transform("constructors", lambda c: c["params"])), lambda p: p))
    marks = F.flatten(F.concat(
        F.array("annotations"), F.transform("fields", lambda f: f["annotations"]), F.transform("methods", lambda m: m["annotations"]),
        F.transform(params, lambda p: p["annotations"]),
    ))
    said = classes.select("file", "fqn", F.explode(marks).alias("a")).where("a.name = 'Value'").select("file", "fqn", unquoted(argument(F.col("a"), "", "value")).alias("e"))
    said = said.where(F.col("e").rlike(r"^\$\{.*\}$")).withColumn("inner", F.expr("substring(e, 3, length(e) - 3)"))
    default = F.col("inner").contains(":")
    said = said.select("file", "fqn", default.alias("d"), F.when(default, F.regexp_replace("inner", ":[^:]*$", "")).otherwise(F.col("inner")).alias("key"))
    read = nodes(said, key, F.col("key"), "CONFIG_KEY", 3, propertyKey=F.col("key"), definedIn=F.col("fqn"), hasDefault=F.col("d").cast("string"))
    keys = unite(cells.select("key"), said.select("key")).distinct().join(properties.select("key", "value"), "key")
    value = F.concat(F.lit("config_value:"), "key")
    values = nodes(keys, value, F.concat_ws("=", "key", "value"), "CONFIG_VALUE", 3, key=F.col("key"), value=F.col("value"))
    uses = unite(edges(groups, class_id(), group, "USES_CONFIG"), edges(said, class_id(), key, "USES_CONFIG"))
    links = unite(edges(cells, group, key, "CONTAINS"), known(uses, present, "source_id"), edges(keys, key, value, "RESOLVES_TO"))
    return Facts(unite(named, own, read, values), links.distinct())


def remote_calls(classes: DataFrame, files: DataFrame, present: DataFrame) -> Facts:
    """Feign clients, and hosts of addresses on lines that name a web client."""
    mark = first(F.col("annotations"), "FeignClient")
    feign = classes.where(mark.isNotNull()).withColumn("service", F.coalesce(literal(argument(mark, "name", "value", "")), F.when(F.size(mark["args"]) == 0, F.lower("fqn")), F.lit("unknown-service")))
    service, client = F.concat(F.lit("external_service:"), "service"), F.concat(F.lit("feign_client:"), "fqn")
    made = unite(
        nodes(feign, service, F.col("service"), "EXTERNAL_SERVICE", 3, protocol=F.lit("Feign")),
        nodes(feign, client, F.col("fqn"), "FEIGN_CLIENT", 3, serviceName=F.col("service")),
    )
    lines = files.select("file", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(CLIENTS))
    address = F.trim(unquoted(F.regexp_extract("line", r".\.uri\(([^)]+)\)", 1)))
    host = F.when(address.contains("://"), F.regexp_extract(address, r"://([^/]*)", 1)).otherwise(address)
    hosts = lines.select("file", host.alias("service")).where("service <> ''").distinct().join(classes.select("file", "fqn"), "file")
    found = nodes(hosts, service, F.col("service"), "EXTERNAL_SERVICE", 4, protocol=F.lit("WebClient/RestTemplate"))
    known_ = known(unite(edges(feign, class_id(), client, "CALLS_REMOTE"), edges(hosts, class_id(), service, "CALLS_REMOTE")), present, "source_id")
    return Facts(unite(made, found), unite(edges(feign, client, service, "CALLS_REMOTE"), known_).distinct())


def tests(classes: DataFrame, present: DataFrame, full_names: bool = False) -> Facts:
    """Tests of files that are named like tests, and the classes that they test or mock (by id, else by name, with or without packages).

    Where classes have full names, a class is found by its own only.
    """
    rows = classes.where(F.col("file").contains("Test") | F.col("file").contains("test"))
    marks = F.col("annotations")
    kinds = F.filter(F.transform(marks, lambda a: F.when(a["name"] == "SpringBootTest", "INTEGRATION").when(a["name"].isin(*SLICES), "SLICE")), lambda x: x.isNotNull())
    test = F.concat(F.lit("test:"), "fqn")
    made = nodes(rows, test, F.col("fqn"), "TEST", 3, testType=F.coalesce(F.get(kinds, F.lit(0)), F.lit("UNIT")))
    named = rows.select("fqn", F.explode(F.flatten(F.transform(F.filter(marks, lambda a: a["name"].contains("Test")), lambda a: F.transform(a["args"], lambda p: p["value"])))).alias("to"))
    named = named.select("fqn", F.lit("TESTS").alias("edge"), F.trim(F.replace("to", F.lit(".class"), F.lit(""))).alias("to"))
    held = fields(rows).select("fqn", F.when(has(F.col("marks"), "InjectMocks"), "TESTS").when(has(F.col("marks"), "Mock", "MockBean"), "MOCKS").alias("edge"), F.regexp_replace("kind", r"(\[\])+$", "").alias("to"))
    wanted = unite(named, held.where("edge is not null")).distinct()
    ids = present.select(class_id(F.regexp_replace("id", "^class:", "")).alias("id"), F.regexp_replace("id", "^class:", "").alias("to")).where("id is not null")
    if full_names:
        met = wanted.withColumn("to", F.regexp_extract("to", r"^([\w$.]*)", 1)).join(ids, "to")
        return Facts(made, edges(met, test, F.col("id"), F.col("edge")).distinct())
    names = present.select("id", F.explode(F.array_distinct(F.array("name", last_name(F.col("name"))))).alias("simple"))
    by_name = names.groupBy("simple").agg(F.min("id").alias("other"))
    met = wanted.join(ids, "to", "left").withColumn("simple", last_name(F.col("to"))).join(by_name, "simple", "left").withColumn("target", F.coalesce("id", "other"))
    return Facts(made, edges(met.where("target is not null"), test, F.col("target"), F.col("edge")).distinct())


def observability(classes: DataFrame, present: DataFrame) -> Facts:
    """Logging, metrics, health indicators and spans, and what they say about their classes."""
    marks = F.col("annotations")
    typed = lambda name: F.exists("fields", lambda f: last_name(F.substring_index(f["type"], "<", 1)) == name)
    own_timed, any_timed = has(marks, "Timed"), F.exists("methods", lambda m: has(m["annotations"], "Timed"))
    timed = own_timed | any_timed
    flags = classes.where(has(marks, *LOGGERS) | timed | typed("MeterRegistry") | typed("Tracer"))
    yes = lambda c: F.when(c, "true")
    told = _enriched(
        flags, present, 5, hasStructuredLogging=yes(has(marks, *LOGGERS)), hasMeterRegistry=yes(typed("MeterRegistry") & ~timed),
        hasTracerInjection=yes(typed("Tracer")), instrumented=yes(typed("MeterRegistry") | timed | typed("Tracer")),
    )
    by_class = classes.where(own_timed).withColumn("metric", F.coalesce(literal(argument(first(marks, "Timed"), "value", "")), F.concat("fqn", F.lit(".allMethods"))))
    of_method = first(F.col("marks"), "Timed")
    by_method = methods(classes).where(of_method.isNotNull()).withColumns({
        "metric": F.coalesce(literal(argument(of_method, "value", "")), F.concat_ws(".", "fqn", "method")), "percentiles": argument(of_method, "percentiles"),
        "description": literal(argument(of_method, "description")),
    })
    built = classes.select("file", "fqn", F.explode("calls").alias("c")).where("c.name = 'register'")
    built = built.withColumn("metric", F.regexp_extract("c.scope", rf'^(?:{"|".join(BUILDERS)})\.builder\("([^"]*)"', 1)).where("metric <> ''")
    metric = F.concat(F.lit("metric:"), "metric")
    metrics = unite(
        nodes(by_class, metric, F.col("metric"), "METRIC", 3, measuredBy=F.col("fqn"), scope=F.lit("class")),
        nodes(by_method, metric, F.col("metric"), "METRIC", 3, percentiles=F.col("percentiles"), description=F.col("description"), measuredBy=F.col("fqn"), sourceMethod=F.col("method")),
        nodes(built, metric, F.col("metric"), "METRIC", 3, detectedVia=F.lit("MeterRegistry.builder"), measuredBy=F.col("fqn")),
    )
    measured = unite(*(edges(r, class_id(), metric, "MEASURES") for r in (by_class, by_method, built)))
    checks = classes.where(F.exists("implements", lambda i: last_name(i) == "HealthIndicator"))
    indicator = F.concat(F.lit("health_indicator:"), "fqn")
    health = nodes(checks, indicator, F.concat(F.lit("HealthIndicator:"), "fqn"), "HEALTH_INDICATOR", 3, implementedBy=F.col("fqn"), conditional=yes(has(marks, "ConditionalOnEnabledHealthIndicator")))
    traced = methods(classes).select("file", "fqn", "method", F.explode("marks").alias("a")).where(F.col("a.name").isin(*SPANS))
    traced = traced.withColumn("span", F.coalesce(literal(argument(F.col("a"), "value", "")), F.concat_ws(".", "fqn", "method")))
    span = F.concat(F.lit("trace_span:"), "span")
    spans = nodes(traced, span, F.col("span"), "TRACE_SPAN", 3, tracedBy=F.col("fqn"), sourceMethod=F.col("method"))
    return Facts(unite(told, metrics, health, spans), unite(measured, edges(checks, class_id(), indicator, "IMPLEMENTS"), edges(traced, class_id(), span, "TRACES")).distinct())


def performance(classes: DataFrame, present: DataFrame, calls: DataFrame) -> Facts:
    """Repository calls in loops, default fetching, writes without a transaction, and results worth caching.

    calls are the graph's CALLS edges.
    """
    marks = F.col("annotations")
    busy = called(classes.where(has(marks, "Service", "Component", "RestController", "Controller"))).where(has(F.col("marks"), "Transactional"))
    busy = busy.where(F.col("name").rlike(READS) & F.col("scope").rlike(REPOSITORY)).select("file", "fqn", "method", "at", "text", F.explode("loops").alias("l"))
    # the last loop that holds such a call names the issue
    loops = busy.groupBy("file", "fqn", "method", "l").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), ",").alias("texts"))
    loops = loops.groupBy("file", "fqn", "method").agg(F.max_by(F.struct("l.type", "texts"), "l.n").alias("w")).select("file", "fqn", "method", "w.*")
    name = F.concat_ws(".", "fqn", "method")
    issue = lambda rows, key, label, **more: nodes(rows, F.concat(F.lit(f"perf:{key}:"), name), F.concat(F.lit(label), name), "PERFORMANCE_ISSUE", 4, className=F.col("fqn"), **more)
    n_plus_one = issue(loops, "n_plus_one", "N+1 Query Risk: ", methodName=F.col("method"), antiPattern=F.lit("N+1_QUERY"), loopType=F.col("type"), repositoryCallsInLoop=F.col("texts"), severity=F.lit("HIGH"))
    many = first(F.col("marks"), "OneToMany")
    lazy = fields(classes.where(has(marks, "Entity", "Document"))).where(many.isNotNull() & ~F.exists(many["args"], lambda p: p["key"] == "fetch")).withColumn("method", F.col("field"))
    fetch = issue(lazy, "fetch_strategy", "Lazy fetch: ", fieldName=F.col("field"), antiPattern=F.lit("FETCH_STRATEGY"), issue=F.lit("default LAZY fetch — potential LazyInitializationException"), severity=F.lit("MEDIUM"))
    noted = _enriched(lazy.select("file", "fqn").distinct(), present, 5, lazyLoadingMissing=F.lit("true"))
    writes = called(classes.where(has(marks, "Service"))).where(~has(F.col("marks"), "Transactional") & F.col("name").rlike(WRITES) & F.col("scope").rlike(REPOSITORY))
    writes = writes.groupBy("file", "fqn", "method").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])), ",").alias("texts"), F.countDistinct("text").alias("n")).where("n >= 2")
    bare = issue(writes, "missing_transaction", "Missing @Transactional: ", methodName=F.col("method"), antiPattern=F.lit("MISSING_TRANSACTION"), repositoryOperations=F.col("texts"), severity=F.lit("HIGH"))
    risks = unite(*(edges(r, class_id(), F.concat(F.lit(f"perf:{k}:"), name), "PERFORMANCE_RISK") for r, k in ((loops, "n_plus_one"), (lazy, "fetch_strategy"), (writes, "missing_transaction"))))
    entities = classes.where(has(marks, "Entity", "Table", "Document")).select(F.explode(F.array("fqn")).alias("entity"))
    served = methods(classes.where(has(marks, "Service"))).where(~has(F.col("marks"), "Cacheable", "CachePut", "CacheEvict"))
    words = served.select("file", "fqn", "method", "returns", F.explode(F.split("returns", r"[^\w$.]+")).alias("entity")).join(entities, "entity", "left_semi")
    held = served.where(F.col("returns").rlike("^(List|Set|Collection|Optional)<")).select("file", "fqn", "method", "returns")
    cached = unite(held, words.select("file", "fqn", "method", "returns")).groupBy("file", "fqn", "method").agg(F.array_join(F.array_sort(F.collect_set("returns")), ",").alias("returns"))
    counts = calls.where("type = 'CALLS'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 2")
    hot = cached.withColumn("id", class_id()).join(counts, "id")
    hint = F.concat(F.lit("perf:cacheable_hint:"), name)
    hints = nodes(hot, hint, F.concat(F.lit("Cacheable candidate: "), name), "PERFORMANCE_HINT", 4, className=F.col("fqn"), methodName=F.col("method"), antiPattern=F.lit("MISSING_CACHEABLE"), callCount=F.col("n"), returnType=F.col("returns"), severity=F.lit("LOW"))
    return Facts(unite(n_plus_one, fetch, noted, bare, hints), unite(risks, known(edges(hot, class_id(), hint, "PERFORMANCE_RISK"), present, "source_id")).distinct())


def native(classes: DataFrame, present: DataFrame) -> Facts:
    """Reflection, proxies, resources, scopes and lazy injection of class nodes that there are, and hints for them."""
    marks = F.col("annotations")
    rows = called(classes)
    details = lambda names, text: rows.where(F.col("name").isin(*names)).groupBy("file", "fqn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", "at", text.alias("t")))), lambda x: x["t"]), ", ").alias("details"))
    path = F.coalesce(literal(F.get(F.filter("args", lambda a: a.startswith('"')), F.lit(0))), F.lit("unknown"))
    none = F.lit(None).cast("string").alias("details")
    lazy = F.exists("fields", lambda f: has(f["annotations"], "Lazy")) | F.exists("methods", lambda m: has(m["annotations"], "Lazy") | F.exists(m["params"], lambda p: p["type"] == "Lazy"))
    found = {
        "reflection": (details(REFLECTION, F.concat("method", F.lit(" calls "), "name")), {"usesReflection": "true", "reflectionDetails": None}),
        "proxy": (details(("newProxyInstance",), F.concat("method", F.lit(" creates dynamic proxy: "), "name")), {"createsDynamicProxy": "true", "proxyDetails": None}),
        "resource": (details(RESOURCES, F.concat("method", F.lit(" loads resource: "), path)), {"loadsResources": "true", "resourceDetails": None}),
        "scope": (classes.where(has(marks, *SCOPES)).select("file", "fqn", none), {"nativeRiskScope": "true"}),
        "lazy": (classes.where(lazy).select("file", "fqn", none), {"nativeRiskLazy": "true"}),
    }
    parts = [nothing(classes.sparkSession)]
    for key, (hit, notes) in found.items():
        issue, advice = NATIVE[key]
        hit = known(hit.withColumn("id", class_id()), present)
        node = F.concat(F.lit(f"compat_issue:{key}:"), "fqn")
        told = _enriched(hit.drop("id"), present, 5, **{k: F.lit(v) if v else F.col("details") for k, v in notes.items()})
        made = nodes(hit, node, F.concat("fqn", F.lit(f" — {issue[:40]}")), "COMPATIBILITY_ISSUE", 4, className=F.col("fqn"), issue=F.lit(issue), recommendation=F.lit(advice))
        parts.append(Facts(unite(told, made), edges(hit, class_id(), node, "COMPATIBILITY_RISK")))
    hinted = classes.where(has(marks, *HINTS)).withColumn("hints", F.array_join(F.filter(F.transform(marks, lambda a: a["name"]), lambda n: n.isin(*HINTS)), ", "))
    told = _enriched(hinted, present, 5, hasAotHints=F.lit("true"), aotAnnotations=F.col("hints"))
    return together([*parts, Facts(told, nothing(classes.sparkSession).edges)])
