"""What endpoints accept and return: transfer objects from the signatures of their methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.resolvers.base import Facts, edges, has, last_name, methods, nodes, unite

# Marks of parameters that do not come from a request's body.
NO_BODY = ("PathVariable", "RequestParam", "RequestHeader", "CookieValue", "AuthenticationPrincipal", "SessionAttribute", "RequestAttribute", "Value")


def _within(term: str) -> Column:
    """The names in a type's text."""
    return F.regexp_extract_all(term, F.lit(r"([\w$]+(?:\.[\w$]+)*)"), 1)


def transfers(types: DataFrame, endpoints: DataFrame, data: DataFrame) -> Facts:
    """ACCEPTS and RETURNS from endpoints (facts) to the declared types that their methods' signatures name.

    types have full names (symbols.qualified). A type between brackets counts like one alone, so a
    List<Order> returns orders. Parameters of the path, the query and the session are not accepted.
    Such a type MAPS_TO the entities (facts in data) that it is, or that its constructors and methods take.
    """
    ends = endpoints.select("id", F.col("metadata")["controllerClass"].alias("fqn"), F.col("metadata")["methodName"].alias("method")).distinct()
    signed = methods(types).select("fqn", "method", "returns", "params").join(ends, ["fqn", "method"])
    taken = signed.select("id", F.explode("params").alias("p")).where(~has(F.col("p.annotations"), *NO_BODY))
    said = unite(
        signed.select("id", F.lit("RETURNS").alias("edge"), F.explode(_within("returns")).alias("full")),
        taken.select("id", F.lit("ACCEPTS").alias("edge"), F.explode(_within("p.type")).alias("full")),
    )
    declared = types.select(F.col("fqn").alias("full"), "file").distinct()
    used = said.distinct().join(declared, "full")
    dto = F.concat(F.lit("dto:"), "full")
    made = nodes(used.select("full", "file").distinct(), dto, last_name(F.col("full")), "DATA_TRANSFER_OBJECT", 9)
    entities = data.where("type = 'PERSISTENCE_ENTITY'").select(F.expr("substring(id, length('persistence_entity:') + 1)").alias("entity")).distinct()
    own = used.select("full").distinct()
    takes = F.concat(F.flatten(F.transform("constructors", lambda c: c["params"])), F.flatten(F.transform("methods", lambda m: m["params"])))
    mentions = types.select(F.col("fqn").alias("full"), F.explode(takes).alias("p")).select("full", F.explode(_within("p.type")).alias("entity")).join(own, "full", "left_semi")
    mapped = unite(own.select("full", F.col("full").alias("entity")), mentions.select("full", "entity")).distinct().join(entities, "entity", "left_semi")
    return Facts(made, unite(edges(used, F.col("id"), dto, F.col("edge")), edges(mapped, dto, F.concat(F.lit("persistence_entity:"), "entity"), "MAPS_TO")).distinct())
