"""Names of types as the language reads them: enclosing types, imports, the own package, wildcard imports, full names.

Every name that a class writes becomes a few candidates, each a full name with a rank by its scope. One
equi-join with the declared types keeps those that exist; the best rank of each name stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.operators.traversal import reach
from graphlens.resolvers.base import last_name

#: A type's text as names and what stands between them.
TERM = r"[\w$]+(?:\.[\w$]+)*|[^\w$]+"
#: Where a class is in its file.
KEY = ["file", "at"]
# ranks of scopes; enclosing types count from the innermost one
IMPORT, PACKAGE, WILDCARD, FULL = 1000, 2000, 3000, 4000


def candidates(name: Column) -> Column:
    """array<struct<rank, full>> for a name in a class with columns package, fqn and imports."""
    head, rest = F.substring_index(name, ".", 1), F.expr("substring(_name, length(substring_index(_name, '.', 1)) + 1)")
    prefix = F.when(F.col("package") == "", F.lit("")).otherwise(F.concat("package", F.lit(".")))
    own = F.split(F.expr("substring(fqn, if(package = '', 1, length(package) + 2))"), r"\.")
    depth = F.size(own)
    scope = lambda rank, full: F.struct(rank.cast("int").alias("rank"), full.alias("full"))
    enclosing = F.transform(F.sequence(F.lit(1), depth), lambda n: scope(depth - n, F.concat(prefix, F.array_join(F.slice(own, 1, n), "."), F.lit("."), name)))
    # a class is known inside itself by its own name, wherever it is nested
    itself = F.transform(F.filter(F.sequence(F.lit(1), depth), lambda n: F.get(own, n - 1) == head), lambda n: scope(depth - n, F.concat(prefix, F.array_join(F.slice(own, 1, n), "."), rest)))
    plain = F.transform("imports", lambda i: F.regexp_replace(i, r"^static\s+", ""))
    single = F.transform(F.filter(plain, lambda i: last_name(i) == head), lambda i: scope(F.lit(IMPORT), F.concat(i, rest)))
    package = F.array(scope(F.lit(PACKAGE), F.concat(prefix, name)))
    wide = F.transform(F.filter(plain, lambda i: i.endswith(".*")), lambda i: scope(F.lit(WILDCARD), F.concat(F.regexp_replace(i, r"\*$", ""), name)))
    return F.concat(enclosing, itself, single, package, wide, F.array(scope(F.lit(FULL), name)))


def names(types: DataFrame) -> DataFrame:
    """(file, at, name): every name that a type's declaration, its calls and its marks use for types."""
    parts = lambda t: F.regexp_extract_all(t, F.lit(r"([\w$]+(?:\.[\w$]+)*)"), 1)
    held = lambda column, get: F.flatten(F.transform(column, lambda x: parts(get(x))))
    marks = lambda a: F.flatten(F.transform(a, lambda m: F.flatten(F.transform(m["args"], lambda p: F.regexp_extract_all(p["value"], F.lit(r"([\w$.]+)\.class\b"), 1)))))
    kind = lambda x: x["type"]
    calls = F.filter(F.transform("calls", lambda c: F.regexp_extract(c["scope"], r"^([A-Z][\w$]*)(?:\.|$)", 1)), lambda h: h != "")
    every = F.concat(
        held("extends", lambda x: x), held("implements", lambda x: x), held("fields", kind),
        F.flatten(F.transform("constructors", lambda c: held(c["params"], kind))),
        F.flatten(F.transform("methods", lambda m: F.concat(parts(m["type"]), held(m["params"], kind), held(m["locals"], kind), marks(m["annotations"])))),
        marks("annotations"), F.flatten(F.transform("fields", lambda f: marks(f["annotations"]))), calls,
    )
    return types.select(*KEY, F.explode(F.array_distinct(every)).alias("name"))


def resolved_names(types: DataFrame) -> DataFrame:
    """(file, at, name, full, declared): what the names of each type stand for.

    A name that no declared type has stands for what a single import says, if one does, and is not declared.
    """
    scopes = types.select(*KEY, "package", "fqn", "imports")
    asked = names(types).join(scopes, KEY).withColumn("_name", F.col("name"))
    options = asked.select(*KEY, "name", F.inline(candidates(F.col("_name"))))
    known = types.select(F.col("fqn").alias("full")).distinct()
    best = options.join(known, "full").groupBy(*KEY, "name").agg(F.min(F.struct("rank", "full")).alias("best")).select(*KEY, "name", F.col("best.full").alias("full"))
    imported = options.where(F.col("rank") == IMPORT).groupBy(*KEY, "name").agg(F.min("full").alias("outside"))
    both = best.join(imported, [*KEY, "name"], "full_outer")
    return both.select(*KEY, "name", F.coalesce("full", "outside").alias("full"), F.col("full").isNotNull().alias("declared"))


def qualified(types: DataFrame) -> DataFrame:
    """The types with full names wherever they name a declared type; marks' `X.class` included.

    `heads` is added: a map from the capitalised heads of calls to declared types.
    """
    found = resolved_names(types).where("declared").groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("name", "full"))).alias("_full"))
    rows = types.join(found, KEY, "left").withColumn("_full", F.coalesce("_full", F.create_map().cast("map<string,string>")))
    full = lambda t: F.coalesce(F.element_at("_full", t), t)
    term = lambda t: F.when(t.isNotNull(), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(f"({TERM})"), 1), full), ""))
    value = lambda v: F.when(
        v.contains(".class"),
        F.array_join(F.transform(F.regexp_extract_all(v, F.lit(r"([\w$]+(?:\.[\w$]+)*\.class\b|[\w$]+|[^\w$]+)"), 1), lambda x: F.when(
            x.endswith(".class"), F.concat(full(F.regexp_replace(x, r"\.class$", "")), F.lit(".class"))).otherwise(x)), ""),
    ).otherwise(v)
    marks = lambda a: F.transform(a, lambda m: m.withField("args", F.transform(m["args"], lambda p: p.withField("value", value(p["value"])))))
    cells = lambda c: F.transform(c, lambda f: f.withField("type", term(f["type"])).withField("annotations", marks(f["annotations"])))
    params = lambda c: F.transform(c, lambda p: p.withField("type", term(p["type"])))
    out = rows.withColumns({
        "extends": F.transform("extends", term), "implements": F.transform("implements", term), "annotations": marks("annotations"), "fields": cells("fields"),
        "constructors": F.transform("constructors", lambda c: c.withField("params", params(c["params"]))),
        "methods": F.transform("methods", lambda m: m.withField("type", term(m["type"])).withField("params", params(m["params"])).withField("locals", params(m["locals"]))
                               .withField("annotations", marks(m["annotations"]))),
        "heads": F.col("_full"),
    })
    return out.select(*types.columns, "heads")


def supertypes(types: DataFrame) -> DataFrame:
    """(fqn, above): every declared type above a type, however far; types are qualified()."""
    steps = types.select(F.col("fqn").alias("source_id"), F.explode(F.concat("extends", "implements")).alias("up"))
    steps = steps.select("source_id", F.regexp_extract("up", r"^([\w$.]*)", 1).alias("target_id"))
    steps = steps.join(types.select(F.col("fqn").alias("target_id")).distinct(), "target_id", "left_semi").select("source_id", "target_id")
    up = reach(steps, steps.select(F.col("source_id").alias("id")).distinct(), None)
    return up.where("depth > 0").select(F.col("seed").alias("fqn"), F.col("id").alias("above")).distinct()


def receivers(types: DataFrame) -> DataFrame:
    """(file, fqn, head, kind): the types of what methods call on; types are qualified().

    A head is looked up among the method's variables and parameters, the fields, then declared types.
    kind is a raw type, null where the head is none of these.
    """
    raw = lambda t: F.regexp_extract(t, r"^([\w$.]*)", 1)
    own = lambda cells, head: F.get(F.transform(F.filter(cells, lambda x: x["name"] == head), lambda x: raw(x["type"])), F.lit(0))
    rows = types.select("file", "fqn", "fields", "heads", F.explode("methods").alias("m"))
    rows = rows.select("file", "fqn", "fields", "heads", "m", F.explode(F.array_distinct(F.transform("m.calls", lambda c: c["scope"]))).alias("scope"))
    bare = F.regexp_replace("scope", r"^this\.", "")
    head = F.substring_index(bare, ".", 1)
    rows = rows.where("scope is not null and scope not in ('this', 'super')").withColumn("head", head)
    # `this.x` is the field, whatever the method calls x
    local = F.when(~F.col("scope").startswith("this."), F.coalesce(own(F.col("m.locals"), F.col("head")), own(F.col("m.params"), F.col("head"))))
    kind = F.coalesce(local, own(F.col("fields"), F.col("head")), F.element_at("heads", F.col("head")))
    return rows.select("file", "fqn", "head", kind.alias("kind")).distinct()
