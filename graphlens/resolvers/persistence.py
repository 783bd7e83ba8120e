"""Repositories, entities and converters, and database schemas from migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.resolvers.base import Facts, argument, class_id, edges, fields, first, has, known, last_name, literal, nodes, unite

# Marks of entities, ids and converters.
ENTITIES, IDS, CONVERTERS = ("Entity", "Table", "Document", "Persistent"), ("Id", "EmbeddedId", "IdClass"), ("Converter", "WritingConverter", "ReadingConverter")
# Technologies by a part of a repository's super-interface.
TECHNOLOGIES = (
    ("Jpa|JPA", "jpa"), ("Mongo", "mongodb"), ("Cassandra", "cassandra"), ("Redis", "redis"), ("Jdbc|JDBC", "jdbc"),
    ("Elasticsearch", "elasticsearch"), ("Neo4j", "neo4j"), ("Couchbase", "couchbase"), ("DynamoDB", "dynamodb"), ("R2dbc|R2DBC", "r2dbc"),
)
# Technologies by an entity's annotation, and edges by a field's.
BY_MARK = {"Document": "mongodb", "Entity": "jpa", "Table": "jpa", "Persistent": "jdo"}
RELATIONS = {"OneToMany": "HAS_MANY", "ManyToOne": "BELONGS_TO"}
# Words that begin something other than a column.
NO_COLUMNS = ("primary", "foreign", "unique", "constraint", "index", "key", "check")


def technology(name: Column) -> Column:
    return F.coalesce(*(F.when(name.rlike(p), t) for p, t in TECHNOLOGIES), F.lit("generic"))


def element_type(kind: Column, full_names: bool = False) -> Column:
    """What a collection or array holds, else the type itself, without packages unless these are wanted."""
    inner = F.regexp_extract(kind, r"<(.*)>", 1)
    held = F.regexp_replace(F.when(inner != "", F.trim(inner)).otherwise(kind), r"\[\]$", "")
    return held if full_names else last_name(held)


def data(classes: DataFrame, full_names: bool = False) -> Facts:
    """Data repositories with their entities, entities with their relations, and converters.

    Where classes have full names, so have the ids of entities that relations lead to.
    """
    above = classes.where("kind = 'interface'").select("file", "fqn", F.explode("extends").alias("up"))
    name = last_name(F.regexp_extract("up", r"^([\w$.]*)", 1))
    repos = above.where(name.endswith("Repository")).withColumns({"technology": technology(name), "entity": F.regexp_extract("up", r"<\s*([^,<>]+(?:<[^>]*>)?)", 1)})
    repo, entity = F.concat(F.lit("data_repo:"), "fqn"), F.concat(F.lit("persistence_entity:"), "entity")
    made = nodes(repos, repo, F.col("fqn"), "DATA_REPOSITORY", 3, sourceFile=F.col("file"), technology=F.col("technology"))
    typed = repos.where("entity <> ''")
    held = nodes(typed, entity, F.col("entity"), "PERSISTENCE_ENTITY", 3, repository=F.col("fqn"), technology=F.col("technology"), sourceFile=F.col("file"))
    marks = F.col("annotations")
    is_entity = has(marks, *ENTITIES) | F.exists("fields", lambda f: has(f["annotations"], *IDS)) | F.exists("methods", lambda m: has(m["annotations"], *IDS))
    ents = classes.where(is_entity)
    own = F.concat(F.lit("persistence_entity:"), "fqn")
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in BY_MARK.items() for x in kv)), first(marks, *BY_MARK)["name"]), F.lit("unknown"))
    entities = nodes(ents, own, F.col("fqn"), "PERSISTENCE_ENTITY", 3, sourceFile=F.col("file"), technology=kind)
    related = fields(ents).select("fqn", "kind", F.explode("marks").alias("a"))
    related = related.withColumn("edge", F.element_at(F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv)), F.col("a.name"))).where("edge is not null")
    convert = has(marks, *CONVERTERS) | F.exists("implements", lambda i: last_name(F.substring_index(i, "<", 1)).isin("Converter", "AttributeConverter"))
    converters = classes.where(convert)
    return Facts(
        unite(made, held, entities, nodes(converters, F.concat(F.lit("data_converter:"), "fqn"), F.col("fqn"), "DATA_CONVERTER", 3, sourceFile=F.col("file"))),
        unite(
            edges(typed, repo, entity, "MAPS_TO"),
            edges(related, own, F.concat(F.lit("persistence_entity:"), element_type(F.col("kind"), full_names)), F.col("edge")),
        ).distinct(),
    )


def _migration_parts(files: DataFrame) -> DataFrame:
    """(file, migration, version, tool, table, column) of SQL and XML migrations; null where there is none."""
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    rows = files.withColumn("name", name)
    sql = rows.where(F.col("name").rlike(r"^V\d+.*\.sql$")).select("file", "name", F.regexp_extract("name", r"^V(\d+)", 1).alias("version"), F.lit("flyway").alias("tool"), "text")
    xml = rows.where(F.col("name").endswith(".xml") & F.col("text").contains("databaseChangeLog")).select("file", "name", F.col("name").alias("version"), F.lit("liquibase").alias("tool"), "text")
    word = r"[\"`]?(\w+)[\"`]?"
    # a statement ends at its semicolon: one table does not swallow the next
    heads = F.regexp_extract_all("text", F.lit(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+\s*\([^;]*)"), 1)
    added = F.regexp_extract_all("text", F.lit(r"(?is)(alter\s+table\s+[^;]*)"), 1)
    made = sql.select("file", F.explode(heads).alias("d")).select(
        "file", F.lower(last_name(F.regexp_replace(F.regexp_extract("d", r"^([\w.\"`]+)", 1), '["`]', ""))).alias("table"), F.regexp_extract("d", r"(?s)\((.*)\)", 1).alias("body"))
    cells = made.select("file", "table", F.explode(F.split(F.regexp_replace("body", r"\([^)]*\)", ""), ",")).alias("c"))
    cells = cells.select("file", "table", F.regexp_extract("c", rf"^\s*{word}\s+\w", 1).alias("column")).where((F.col("column") != "") & ~F.lower("column").isin(*NO_COLUMNS))
    alters = sql.select("file", F.explode(added).alias("d"))
    more = alters.select(
        "file", F.lower(F.regexp_extract("d", rf"(?is)alter\s+table\s+{word}", 1)).alias("table"),
        F.explode(F.regexp_extract_all("d", F.lit(rf"(?i)\badd\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?(?!constraint\b|primary\b|foreign\b|unique\b|index\b|key\b){word}"), 1)).alias("column"),
    )
    blocks = F.regexp_extract_all("text", F.lit(r"(?is)(<(?:createTable|addColumn)\b.*?</(?:createTable|addColumn)>|<createTable\b[^>]*/>)"), 1)
    tagged = xml.select("file", F.explode(blocks).alias("d")).select("file", F.lower(F.regexp_extract("d", r"tableName\s*=\s*\"(\w+)\"", 1)).alias("table"), "d").where("`table` <> ''")
    columns = tagged.select("file", "table", F.explode(F.regexp_extract_all("d", F.lit(r"<column\b[^>]*?\bname\s*=\s*\"(\w+)\""), 1)).alias("column"))
    nothing_ = F.lit(None).cast("string").alias("column")
    parts = unite(made.select("file", "table", nothing_), cells, more, tagged.select("file", "table", nothing_), columns).distinct()
    heads_ = unite(sql, xml).select("file", "name", "version", "tool")
    return heads_.join(parts, "file", "left")


def schema(files: DataFrame) -> Facts:
    """Migrations with the tables and columns that they make or add."""
    rows = _migration_parts(files)
    label = F.when(F.col("tool") == "flyway", F.col("version")).otherwise(F.regexp_replace("name", r"\.xml$", ""))
    mid, tid = F.concat(F.lit("schema_migration:"), label), F.concat(F.lit("schema_table:"), "table")
    cid = F.concat(F.lit("schema_column:"), "table", F.lit("."), "column")
    number = F.coalesce(F.col("version").try_cast("long"), F.lit((1 << 20) - 1))
    tables, columns = rows.where("`table` is not null"), rows.where("`column` is not null")
    made = nodes(rows.select("file", "name", "version", "tool").distinct(), mid, F.col("name"), "SCHEMA_MIGRATION", 3, version=F.col("version"), tool=F.col("tool"), file=F.col("name"))
    # the first migration that names a table or column has made it
    first_of = lambda r, *keys: r.groupBy(*keys).agg(F.min_by(F.struct("file", mid.alias("mid")), F.struct(number, "file")).alias("m")).select(*keys, "m.*")
    t, c = first_of(tables, "table"), first_of(columns, "table", "column")
    return Facts(
        unite(
            made,
            nodes(t, tid, F.col("table"), "SCHEMA_TABLE", 3, migrationId=F.col("mid")),
            nodes(c, cid, F.col("column"), "SCHEMA_COLUMN", 3, table=F.col("table"), migrationId=F.col("mid")),
        ),
        unite(edges(tables, mid, tid, "CONTAINS"), edges(c, tid, cid, "CONTAINS")).distinct(),
    )


def correlated(classes: DataFrame, present: DataFrame, made: DataFrame) -> Facts:
    """Entities meet their tables; missing tables and columns are noted on the class.

    present holds the class nodes (id, name, type), made the schema's node facts.
    """
    ents = classes.where(has(F.col("annotations"), "Entity", "Table", "Document"))
    mark = first(F.col("annotations"), "Table")
    rows = ents.select("file", "fqn", "fields", F.lower(F.coalesce(literal(argument(mark, "name", "")), F.col("name"))).alias("table"))
    tables = made.where("type = 'SCHEMA_TABLE'").select(F.col("name").alias("table")).distinct()
    # both the class and the entity node of that class stand for it
    ids = F.explode(F.array(class_id(), F.concat(F.lit("persistence_entity:"), "fqn")))
    linked = rows.join(tables, "table", "left_semi").select("table", ids.alias("id"))
    maps = known(edges(linked, F.col("id"), F.concat(F.lit("schema_table:"), "table"), "SCHEMA_MAPS_TO"), present, "source_id")
    own = present.select("id", F.col("name").alias("label"), F.col("type").alias("own"))
    lacking = rows.join(tables, "table", "left_anti").withColumn("id", class_id()).join(own, "id")
    notes = nodes(lacking, F.col("id"), F.col("label"), F.col("own"), 5, schemaMissing=F.lit("true"))
    columns = made.where("type = 'SCHEMA_COLUMN'").select(F.col("metadata")["table"].alias("table"), F.lower("name").alias("column")).distinct()
    said = rows.join(columns.select("table").distinct(), "table", "left_semi").select("file", "fqn", "table", F.explode("fields").alias("f"))
    said = said.select("file", "fqn", "table", literal(argument(first(F.col("f.annotations"), "Column"), "name")).alias("said")).where("said is not null")
    absent = said.withColumn("column", F.lower("said")).join(columns, ["table", "column"], "left_anti").withColumn("id", class_id()).join(own, "id")
    gone = nodes(absent, F.col("id"), F.col("label"), F.col("own"), 5, x=F.lit("true"))
    gone = gone.drop("metadata").join(absent.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("columnMissing:"), "said").alias("k"), F.lit("true").alias("v")))).alias("metadata")), "id")
    return Facts(unite(notes, gone.select(*notes.columns)), maps)
