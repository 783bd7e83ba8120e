"""Full-text search over nodes: BM25, of which only the query's words leave a node's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.model import Graph

K1, B = 1.2, 0.75
SPLIT = r"[^\p{L}\p{N}_]+"
#: Weights of the fields where names and types count more than other text.
BOOSTED = {"type": 4.0, "name": 2.0, "text": 1.0}


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda x: x != "")


def _field(name: str) -> Column:
    whole = F.concat_ws(" ", "name", "type", F.array_join(F.map_values("metadata"), " "))
    return whole if name == "text" else F.coalesce(F.col(name), F.lit(""))


def _scores(nodes: DataFrame, query: str, field: str, fuzzy: int) -> DataFrame:
    """(id, score) of one field. A word counts where a term equals it, or is within `fuzzy` edits."""
    words = F.array_distinct(_terms(F.lit(query)))
    near = lambda x, w: (x == w) | (F.levenshtein(x, w, fuzzy) >= 0) if fuzzy else x == w
    sized = nodes.select("id", _terms(_field(field)).alias("terms")).where(F.size("terms") > 0)
    # one row: how many nodes there are, and their mean length
    size = sized.agg(F.count("*").alias("docs"), F.avg(F.size("terms")).alias("avgdl"))
    met = F.filter(words, lambda w: F.exists("terms", lambda x: near(x, w)))
    hits = sized.select("id", "terms", F.size("terms").alias("dl"), F.explode(met).alias("term"))
    hits = hits.select("id", "dl", "term", F.size(F.filter("terms", lambda x: near(x, F.col("term")))).alias("tf"))
    spread = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # a row of totals and a row for each word of the query
    return hits.join(F.broadcast(spread), "term").join(F.broadcast(size)).groupBy("id").agg(F.sum(part).alias("score"))


def search(graph: Graph, query: str, top: int = 10, weights: dict[str, float] | None = None, fuzzy: int = 0) -> DataFrame:
    """The best nodes for a query: (id, name, type, score); equal scores by id.

    weights gives fields (text, name, type) a weight each; without it all text counts alike.
    """
    every = None
    for field, weight in (weights or {"text": 1.0}).items():
        found = _scores(graph.nodes, query, field, fuzzy).select("id", (F.col("score") * weight).alias("score"))
        every = found if every is None else every.unionByName(found)
    best = every.groupBy("id").agg(F.round(F.sum("score"), 4).alias("score")).orderBy(F.desc("score"), "id").limit(top)
    return best.join(graph.nodes.select("id", "name", "type"), "id").select("id", "name", "type", "score").orderBy(F.desc("score"), "id")


def nodes_of_type(graph: Graph, kind: str, top: int) -> DataFrame:
    """The first nodes of a type, by id: how many is the feature."""
    return graph.of(kind).orderBy("id").limit(top)


def edges_of_type(graph: Graph, kind: str, top: int) -> DataFrame:
    """The first edges of a type, by their ends."""
    return graph.links(kind).orderBy("source_id", "target_id").limit(top)
