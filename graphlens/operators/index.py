"""A stored inverted index over nodes: postings with positions in buckets of terms, and queries that read their terms' buckets.

Layers make it follow the graph: an update writes the postings of the nodes that changed, and what older
layers say of these nodes no longer counts. Totals of each field are kept beside the layers.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.operators.query_words import BadQuery, Group, Leaf, leaves, parse
from graphlens.operators.search import B, K1, _terms
from graphlens.storage import settle

#: Buckets that terms are dealt to; a query reads one for each of its terms.
BUCKETS = 64
#: Layers above which an update merges them.
LAYERS = 8
#: Weights of the fields that a word without a field is looked up in.
FIELDS = {"type": 4.0, "name": 2.0, "text": 1.0, "metadata": 1.0}
#: Fields that make up the text, in their order.
PARTS = ("name", "type", "metadata")


def _field(name: str) -> Column:
    # by key: a map has no order of its own
    values = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: e["value"]), " ")
    return values if name == "metadata" else F.coalesce(F.col(name), F.lit(""))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """Layers of postings (term, id, place, n_name, n_type, n_metadata, bucket) with the ids (id, field, dl) that each holds, and totals by field.

    A posting is one occurrence; its place in the text and the sizes of the parts tell its field. A query groups
    those of its words, so that building an index shuffles each occurrence once.
    """

    postings: tuple[DataFrame, ...]
    docs: tuple[DataFrame, ...]
    totals: dict[str, tuple[int, int]]

    def live(self, tables: tuple[DataFrame, ...], wanted: Column | None = None) -> DataFrame:
        """The rows of all layers that no later layer replaces."""
        parts = []
        for n, rows in enumerate(tables):
            rows = rows if wanted is None else rows.where(wanted)
            for later in self.docs[n + 1 :]:
                rows = rows.join(later.select("id").distinct(), "id", "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)


def _layer(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    # a node's text is its name, type and metadata in this order: their words are written once, with how many each has
    said = nodes.select("id", *(F.coalesce(_terms(_field(f)), F.array().cast("array<string>")).alias(f) for f in PARTS))
    sizes = {f: F.size(f) for f in PARTS} | {"text": sum((F.size(f) for f in PARTS[1:]), F.size(PARTS[0]))}
    docs = settle(said.select("id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), sizes[f].alias("dl")) for f in FIELDS)))), "index-docs")
    words = said.select("id", *(sizes[f].alias(f"n_{f}") for f in PARTS), F.posexplode(F.concat(*PARTS)).alias("place", "term"))
    return settle(words.withColumn("bucket", bucket(F.col("term"))), "postings", "bucket"), docs


def _by_field(rows: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Occurrences as rows (field, term, id, dl, place) of the whole text and of the part that holds them, of these fields."""
    entries, start = [], F.lit(0)
    for f in PARTS:
        at, size = F.col("place") - start, F.col(f"n_{f}")
        entries.append(F.when((at >= 0) & (at < size), F.struct(F.lit(f).alias("field"), size.alias("dl"), at.alias("place"))))
        start = start + size
    entries.append(F.struct(F.lit("text").alias("field"), start.alias("dl"), F.col("place")))
    return rows.select("term", "id", F.inline(F.array_compact(F.array(*entries)))).where(F.col("field").isin(*fields))


def _totals(docs: DataFrame) -> dict[str, tuple[int, int]]:
    """Nodes that say anything in a field, and how many words they say. A row for each field."""
    rows = docs.where("dl > 0").groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).collect()
    return {r["field"]: (r["n"], r["words"]) for r in rows}


def build(nodes: DataFrame) -> Index:
    """The index of nodes."""
    postings, docs = _layer(nodes)
    return Index((postings,), (docs,), _totals(docs))


def update(index: Index, nodes: DataFrame, gone: DataFrame | None = None) -> Index:
    """The index after nodes were added or changed, and others (ids in gone) removed."""
    postings, docs = _layer(nodes)
    if gone is not None:
        # a removed node is one that says nothing
        empty = gone.select("id", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"), F.lit(0).alias("dl"))
        docs = settle(docs.unionByName(empty), "index-docs")
    old = _totals(index.live(index.docs).join(docs.select("id").distinct(), "id", "left_semi"))
    new, none = _totals(docs), (0, 0)
    totals = {f: tuple(a - b + c for a, b, c in zip(index.totals.get(f, none), old.get(f, none), new.get(f, none), strict=True)) for f in FIELDS}
    out = Index((*index.postings, postings), (*index.docs, docs), totals)
    if len(out.docs) <= LAYERS:
        return out
    return Index((settle(out.live(out.postings), "postings", "bucket"),), (settle(out.live(out.docs), "index-docs"),), totals)


def _buckets(index: Index, terms: Iterable[str]) -> Column:
    """The buckets of terms, as literals: a scan then reads no others."""
    spark, terms = index.postings[0].sparkSession, sorted(set(terms))
    row = spark.range(1).select(*(bucket(F.lit(t)).alias(f"b{n}") for n, t in enumerate(terms))).first()
    return F.col("bucket").isin(*set(row)) & F.col("term").isin(*terms)


def _weights(leaf: Leaf) -> dict[str, float]:
    return {leaf.field: 1.0} if leaf.field else FIELDS


def _part(index: Index, tf: Column, idf: Column) -> Column:
    """BM25 of a frequency in a field."""
    mean = reduce(lambda c, f: c.when(F.col("field") == f, index.totals[f][1] / max(index.totals[f][0], 1)), index.totals, F.when(F.lit(False), 1.0))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / mean))


def _idf(index: Index, df: Column) -> Column:
    n = reduce(lambda c, f: c.when(F.col("field") == f, float(index.totals[f][0])), index.totals, F.when(F.lit(False), 1.0))
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _weight(leaf: Leaf) -> Column:
    return reduce(lambda c, fw: c.when(F.col("field") == fw[0], fw[1]), _weights(leaf).items(), F.when(F.lit(False), 1.0))


def _hits(index: Index, leaf: Leaf) -> DataFrame:
    """(id, score) of the nodes that a leaf meets. Prefixes and near terms count as much as their boost, wherever they are found."""
    if leaf.kind in ("prefix", "near"):
        word = leaf.words[0]
        fits = F.col("term").startswith(word) if leaf.kind == "prefix" else F.levenshtein("term", F.lit(word), leaf.edits) >= 0
        return _by_field(index.live(index.postings, fits), _weights(leaf)).select("id").distinct().withColumn("score", F.lit(leaf.boost))
    rows = _by_field(index.live(index.postings, _buckets(index, leaf.words)), _weights(leaf))
    rows = rows.groupBy("field", "term", "id", "dl").agg(F.array_sort(F.collect_list("place")).alias("places"))
    spread = rows.groupBy("field", "term").agg(F.count("*").alias("df"))
    # a row for each word of the query and field
    rows = rows.join(F.broadcast(spread), ["field", "term"])
    if leaf.kind == "term":
        scored = rows.withColumn("part", _part(index, F.size("places"), _idf(index, F.col("df"))) * _weight(leaf))
        return scored.groupBy("id").agg((F.sum("part") * leaf.boost).alias("score"))
    words = leaf.words
    places = [F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("places")))).alias(f"p{n}") for n, w in enumerate(words)]
    idf = sum((F.max(F.when(F.col("term") == w, _idf(index, F.col("df")))) for w in words[1:]), F.max(F.when(F.col("term") == words[0], _idf(index, F.col("df")))))
    met = rows.groupBy("id", "field", "dl").agg(*places, idf.alias("idf"))
    starts = F.filter("p0", lambda p: reduce(lambda a, b: a & b, (F.array_contains(f"p{n}", p + n) for n in range(1, len(words))), F.lit(True)))
    met = met.withColumn("tf", F.size(starts)).where("tf > 0").withColumn("part", _part(index, F.col("tf"), F.col("idf")) * _weight(leaf))
    return met.groupBy("id").agg((F.sum("part") * leaf.boost).alias("score"))


def _met(node: Leaf | Group, number: dict[int, int]) -> Column:
    if isinstance(node, Leaf):
        return F.col(f"s{number[id(node)]}").isNotNull()
    must, may, never = ([_met(p, number) for r, p in node.parts if r == role] for role in "+ -")
    if not must and not may:
        return F.lit(False)
    found = reduce(lambda a, b: a & b, must) if must else reduce(lambda a, b: a | b, may)
    return reduce(lambda a, b: a & ~b, never, found)


def _score(node: Leaf | Group, number: dict[int, int]) -> Column:
    if isinstance(node, Leaf):
        return F.coalesce(F.col(f"s{number[id(node)]}"), F.lit(0.0))
    total = reduce(lambda a, b: a + b, (_score(p, number) for r, p in node.parts if r != "-"), F.lit(0.0))
    return F.when(_met(node, number), total * node.boost).otherwise(0.0)


def matches(index: Index, query: str) -> DataFrame:
    """(id, score) of every node that a query meets; a text that is no query meets none.

    One grouping by id brings the scores of all words of a query together; what must, may and must not
    be there are conditions on them.
    """
    spark = index.docs[0].sparkSession
    try:
        root = parse(query, tuple(FIELDS))
    except BadQuery:
        return spark.createDataFrame([], "id string, score double")
    every = [x for x in leaves(root) if x.words]
    number = {id(x): n for n, x in enumerate(leaves(root))}
    if not every:
        return spark.createDataFrame([], "id string, score double")
    hits = reduce(DataFrame.unionByName, (_hits(index, x).withColumn("leaf", F.lit(number[id(x)])) for x in every))
    wide = hits.groupBy("id").agg(*(F.sum(F.when(F.col("leaf") == n, F.col("score"))).alias(f"s{n}") for n in range(len(number))))
    return wide.where(_met(root, number)).select("id", _score(root, number).alias("score"))


def search(index: Index, nodes: DataFrame, query: str, top: int = 10) -> DataFrame:
    """The best nodes for a query: (id, name, type, score); equal scores by id."""
    best = matches(index, query).select("id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "id").limit(top)
    return best.join(nodes.select("id", "name", "type"), "id").select("id", "name", "type", "score").orderBy(F.desc("score"), "id")
