"""Traversals: frontier joins with visited ids removed by an anti-join. Edges are bucketed once, so a hop shuffles its front only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.model import Graph
from graphlens.storage import bucketed, settle


def resolve_id(graph: Graph, name: str) -> DataFrame:
    """The id of a class: `class:` + name if there is such a node, else the least id with that name."""
    hits = graph.nodes.where((F.col("id") == f"class:{name}") | (F.col("name") == name))
    return hits.select("id", (F.col("id") == f"class:{name}").alias("own")).orderBy(F.desc("own"), "id").limit(1).select("id")


def _steps(edges: DataFrame, both_ways: bool) -> DataFrame:
    out = edges.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"))
    back = edges.select(F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"))
    return (out.union(back) if both_ways else out).distinct()


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None, both_ways: bool = False, expand: DataFrame | None = None, per_seed: bool = True) -> DataFrame:
    """(seed, id, depth): ids within `hops` of each seed, the seed at depth 0; None: until nothing new is met.

    seeds has column id. expand, if given, holds the ids (column id) from which the walk goes on.
    Dangling ids are walked through like any others. Without per_seed an id comes once, with its
    distance from the nearest seed, and seed is null: the walk then never holds more rows than ids.
    """
    steps = bucketed(_steps(edges, both_ways), "steps", "from_id")
    seed = F.col("id") if per_seed else F.lit(None).cast("string")
    key = ["seed", "id"] if per_seed else ["id"]
    front = settle(seeds.select(seed.alias("seed"), "id", F.lit(0).cast("long").alias("depth")).distinct(), "front")
    parts, hop = [front], 0
    while hops is None or hop < hops:
        hop += 1
        going = front if expand is None or hop == 1 else front.join(expand, "id", "left_semi")
        found = going.join(steps, F.col("id") == F.col("from_id")).select("seed", F.col("to_id").alias("id")).distinct()
        seen = reduce(DataFrame.union, parts).select(*key)
        front = settle(found.join(seen, key, "left_anti").withColumn("depth", F.lit(hop).cast("long")).select("seed", "id", "depth"), "front")
        if front.isEmpty():
            break
        parts.append(front)
        if len(parts) > 16:
            # long walks read their past as one table
            parts = [settle(reduce(DataFrame.union, parts), "walked")]
    return reduce(DataFrame.union, parts)


def reach_of_several(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, depth, other): ids within `hops` of any seed, and whether a seed other than the id itself reaches it.

    Each id keeps the two nearest of the seeds that reach it: they decide both, so the walk holds at
    most two rows an id however many seeds there are.
    """
    steps = bucketed(_steps(edges, True), "steps", "from_id")
    held = settle(seeds.select("id", F.col("id").alias("seed"), F.lit(0).cast("long").alias("depth")).distinct(), "held")
    front = held
    for hop in range(1, hops + 1):
        found = front.join(steps, F.col("id") == F.col("from_id")).groupBy(F.col("to_id").alias("id")).agg(F.min("seed").alias("a"), F.max("seed").alias("b"))
        found = found.select("id", F.explode(F.array_distinct(F.array("a", "b"))).alias("seed"))
        full = held.groupBy("id").agg(F.count("*").alias("n"), F.min("seed").alias("one"))
        new = found.join(full, "id", "left").where(F.col("n").isNull() | (F.col("n") == 1) & (F.col("seed") != F.col("one")))
        new = new.groupBy("id", "n").agg(F.min("seed").alias("a"), F.max("seed").alias("b"))
        new = new.select("id", F.explode(F.when(F.col("n") == 1, F.array("a")).otherwise(F.array_distinct(F.array("a", "b")))).alias("seed"))
        front = settle(new.withColumn("depth", F.lit(hop).cast("long")), "front")
        if front.isEmpty():
            break
        held = settle(held.unionByName(front), "held")
    return held.groupBy("id").agg(F.min("depth").alias("depth"), F.max(F.col("seed") != F.col("id")).alias("other"))


def _details(graph: Graph, ids: DataFrame) -> DataFrame:
    return ids.join(graph.nodes.select("id", "name", "type"), "id")


def blast_radius(graph: Graph, name: str, depth: int = 3) -> DataFrame:
    """Existing nodes around a class and what its calls lead to: (id, name, type).

    The class is first closed over IMPLEMENTS, EXTENDS and CALLS; every member of the closure then
    looks `depth` edges around in both directions and does not count itself.
    """
    closure = reach(graph.links("IMPLEMENTS", "EXTENDS", "CALLS"), resolve_id(graph, name), None, per_seed=False).select("id")
    around = reach_of_several(graph.edges, closure, depth)
    return _details(graph, around.where("other").select("id"))


def transaction_boundaries(graph: Graph, name: str, depth: int = 5) -> DataFrame:
    """Transactional proxies on the calls of a class: (id, depth), the depth of the calling node."""
    calls = graph.links("CALLS")
    callers = reach(calls, resolve_id(graph, name), depth, per_seed=False).select("id", "depth")
    proxies = graph.of("PROXY").where(F.coalesce(F.col("metadata")["PROXY_STEREOTYPE"], F.lit("")).contains("TRANSACTION_INTERCEPTOR"))
    hits = callers.join(calls, F.col("id") == F.col("source_id")).select(F.col("target_id").alias("id"), "depth")
    return hits.join(proxies.select("id"), "id", "left_semi").groupBy("id").agg(F.min("depth").alias("depth"))


def transaction_scope(graph: Graph, name: str) -> DataFrame:
    """What runs inside the transaction of a class: (id, name, type, depth, remote_calls).

    The walk follows CALLS and goes on from services and proxies only.
    """
    through = graph.of("SERVICE", "PROXY").select("id")
    ids = reach(graph.links("CALLS"), resolve_id(graph, name), None, expand=through, per_seed=False).select("id", "depth")
    remote = graph.links("CALLS_REMOTE").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("remote_calls"))
    return _details(graph, ids).join(remote, "id", "left").withColumn("remote_calls", F.coalesce("remote_calls", F.lit(0)).cast("long"))


def transaction_risk(graph: Graph, name: str) -> DataFrame:
    """One row about the transaction of a class: (id, transactional, remote, exceptions, distributed_risk, performance_issues).

    It is transactional if a transactional proxy calls it, and at risk if remote calls run inside.
    """
    start = resolve_id(graph, name)
    marked = graph.of("PROXY").where(F.coalesce(F.col("metadata")["PROXY_STEREOTYPE"], F.lit("")).contains("TRANSACTION_INTERCEPTOR"))
    calls = graph.links("CALLS").join(marked.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    proxied = start.join(calls.select(F.col("target_id").alias("id")), "id", "left_semi").agg((F.count("*") > 0).alias("transactional"))
    walked = reach(graph.links("CALLS"), start, None, expand=graph.of("SERVICE", "PROXY").select("id"), per_seed=False).select("id", "depth")
    # what the walk only touches, repositories and others, does not add its own calls
    inside = walked.join(graph.of("SERVICE", "PROXY").select("id"), "id", "left_semi").select("id").union(start).distinct().withColumnRenamed("id", "source_id")
    real = graph.nodes.select(F.col("id").alias("target_id"))
    out = graph.links("CALLS_REMOTE", "THROWS").join(inside, "source_id", "left_semi").join(real, "target_id", "left_semi")
    counts = out.agg(F.count(F.when(F.col("type") == "CALLS_REMOTE", 1)).alias("remote"), F.count(F.when(F.col("type") == "THROWS", 1)).alias("exceptions"))
    slow = graph.of("PERFORMANCE_ISSUE").where(F.col("metadata")["className"] == name).agg(F.count("*").alias("performance_issues"))
    # one row each
    row = start.join(proxied).join(counts).join(slow)
    return row.select("id", "transactional", "remote", "exceptions", (F.col("transactional") & (F.col("remote") > 0)).alias("distributed_risk"), "performance_issues")


def request_flow(graph: Graph, verb: str, path: str, depth: int | None = None) -> DataFrame:
    """Nodes that a request passes, from its endpoint on: (id, name, type, depth, transactional).

    depth bounds the hops; None walks to the end.
    """
    start = graph.of("CONTROLLER_ENDPOINT").where(
        (F.upper(F.col("metadata")["httpVerb"]) == verb.upper()) & (F.col("metadata")["path"] == path)
    )
    ids = reach(graph.links("ROUTES_TO", "CALLS", "INJECTS", "IMPLEMENTS"), start.select("id"), depth, per_seed=False).select("id", "depth")
    marked = F.coalesce(F.col("metadata")["PROXY_STEREOTYPE"], F.lit("")).contains("TRANSACTION_INTERCEPTOR") | F.coalesce(
        F.col("metadata")["annotations"], F.lit("")
    ).contains("Transactional")
    return ids.groupBy("id").agg(F.min("depth").alias("depth")).join(graph.nodes, "id").select("id", "name", "type", "depth", marked.alias("transactional"))


def data_flow(graph: Graph, name: str, depth: int = 5) -> DataFrame:
    """Where data goes from nodes whose name holds `name`: (id, name, type, depth, sink)."""
    starts = graph.nodes.where(F.col("name").contains(name)).select("id")
    real = graph.nodes.select("id")
    edges = graph.links("MAPS_TO", "CALLS", "RETURNS", "ACCEPTS")
    edges = edges.join(real.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "type")
    ids = reach(edges, starts, depth, per_seed=False).select("id", "depth")
    sinks = graph.links("RETURNS", "MAPS_TO").select(F.col("target_id").alias("id")).distinct().withColumn("sink", F.lit(True))
    return _details(graph, ids).join(sinks, "id", "left").withColumn("sink", F.coalesce("sink", F.lit(False)) & (F.col("depth") > 0))


def cycles(graph: Graph, longest: int = 4, kind: str = "INJECTS") -> DataFrame:
    """Simple cycles of at most `longest` edges: (length, path), each once, from its least id on."""
    steps = graph.links(kind).select("source_id", "target_id").distinct()
    paths = steps.select(F.col("source_id").alias("first"), F.col("target_id").alias("last"), F.array("source_id").alias("path"))
    # a cycle starts at its least id, so that each is found once
    paths = paths.where(F.col("last") >= F.col("first"))
    found = []
    for length in range(1, longest + 1):
        done = F.col("last") == F.col("first")
        found.append(paths.where(done).select(F.lit(length).cast("long").alias("length"), "path"))
        if length < longest:
            on = paths.where(~done & ~F.array_contains("path", F.col("last")))
            paths = on.join(steps, F.col("last") == F.col("source_id")).where(F.col("target_id") >= F.col("first")).select(
                "first", F.col("target_id").alias("last"), F.array_append("path", F.col("last")).alias("path")
            )
    every = reduce(DataFrame.unionByName, found)
    return every.select("length", F.concat(F.array_join("path", " -> "), F.lit(" -> "), F.get("path", F.lit(0))).alias("path")).distinct()


def _sorted(rows: DataFrame) -> DataFrame:
    """rows as a side of a sort-merge join: many rounds of small broadcasts would all pass the driver."""
    return rows.hint("merge")


def _spread(steps: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, v): the least key that reaches each key along steps (a, b), its own included."""
    now = keys.select("k", F.col("k").alias("v"))
    while True:
        before = now
        for _ in range(2):
            lower = steps.join(_sorted(now), F.col("a") == F.col("k")).groupBy(F.col("b").alias("k")).agg(F.min("v").alias("w"))
            now = now.join(_sorted(lower), "k", "left").select("k", F.coalesce(F.least("v", "w"), "v").alias("v"))
        now = settle(now, "spread")
        if now.join(_sorted(before.withColumnRenamed("v", "w")), "k").where("v <> w").isEmpty():
            return now


def _swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _without(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges that none of the keys (k) is an end of."""
    for end in ("a", "b"):
        edges = edges.join(_sorted(keys.select(F.col("k").alias(end))), end, "left_anti")
    return edges.select("a", "b")


def _dead_ends(edges: DataFrame, count: int) -> DataFrame:
    """(k): nodes from which only one way leads on, to a node that nothing leaves. Ways double in length each round."""
    out = edges.groupBy(F.col("a").alias("k")).agg(F.count("*").alias("n"), F.min("b").alias("p"))
    ends = edges.select(F.col("b").alias("k")).distinct().join(_sorted(out), "k", "left_anti").select("k", F.col("k").alias("p"), F.lit(True).alias("end"))
    ways = settle(out.select("k", F.when(F.col("n") == 1, F.col("p")).otherwise(F.col("k")).alias("p"), F.lit(False).alias("end")).unionByName(ends), "ways")
    for _ in range(0, count.bit_length() + 1, 2):
        now = ways
        for _ in range(2):
            now = now.select("k", "p").join(_sorted(now.select(F.col("k").alias("p"), F.col("p").alias("q"), "end")), "p").select("k", F.col("q").alias("p"), "end")
        now = settle(now, "ways")
        still = now.join(_sorted(ways.select("k", F.col("p").alias("q"))), "k").where("p <> q").isEmpty()
        ways = now
        if still:
            break
    return ways.where("end").select("k")


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (a, b) without those that no cycle can hold, and how many there are.

    Nodes that nothing enters or leaves go, round by round while many do; then whole paths that end in such.
    """
    rest, count, before = edges, edges.count(), None
    while count and (before is None or count < 0.9 * before):
        before = count
        entered, left = rest.select(F.col("b").alias("a")).distinct(), rest.select(F.col("a").alias("b")).distinct()
        rest = settle(rest.join(_sorted(entered), "a", "left_semi").join(_sorted(left), "b", "left_semi").select("a", "b"), "cycle-edges")
        count = rest.count()
        if count and 0.9 * before <= count < before:
            for turned in (rest, _swapped(rest)):
                rest = settle(_without(rest, _dead_ends(turned, count)), "cycle-edges")
            count = rest.count()
    return rest, count


def _rings(edges: DataFrame, count: int) -> DataFrame:
    """(k, v): nodes on the cycles that are made by each node's least successor, with the cycle's least key.

    Ways double in length each round. Once their ends stay the same nodes, these are the nodes on cycles; once
    neighbours on a cycle have met the same least key, it is the cycle's.
    """
    first = settle(edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("f")), "ways")
    ways, ends = first.select("k", "f", F.col("f").alias("p"), F.least("k", "f").alias("v")), None
    for _ in range(0, count.bit_length() + 1, 2):
        for _ in range(2):
            on = ways.select(F.col("k").alias("p"), F.col("p").alias("q"), F.col("v").alias("w"))
            ways = ways.join(_sorted(on), "p").select("k", "f", F.col("q").alias("p"), F.least("v", "w").alias("v"))
        ways = settle(ways, "ways")
        ringed = ways.join(_sorted(ways.select(F.col("p").alias("k")).distinct()), "k", "left_semi")
        known = ringed.join(_sorted(ways.select(F.col("k").alias("f"), F.col("v").alias("w"))), "f")
        n, open_ = known.agg(F.count("*"), F.count(F.when(F.col("v") != F.col("w"), 1))).first()
        if n == ends and not open_:
            break
        ends = n
    return ringed.select("k", "v")


def _coloured(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (k, v) of the least key that reaches each node, and the edges that may be in others.

    The least key that reaches a node is its colour; nodes that reach that key inside the colour are its
    component. Edges between colours are on no cycle.
    """
    keys = rest.select(F.col("a").alias("k")).union(rest.select("b")).distinct()
    colours = _spread(rest, keys)
    a, b = colours.toDF("a", "from_colour"), colours.toDF("b", "to_colour")
    same = settle(rest.join(_sorted(a), "a").join(_sorted(b), "b").where("from_colour = to_colour").select("a", "b"), "cycle-same")
    back = _spread(_swapped(same), keys).withColumnRenamed("v", "w")
    found = settle(back.join(_sorted(colours), "k").where("v = w").select("k", "v"), "cycle-found")
    return found, _without(same, found)


#: Edges up to which a task of its own finds their components: some MB, whatever the graph.
FEW = 200_000


def knots(pairs: list[tuple]) -> list[tuple]:
    """(node, least node of its component) of the nodes on cycles of a few edges: a depth-first search with low links."""
    out, loops = {}, {a for a, b in pairs if a == b}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order, low, waiting, on, found = {}, {}, [], set(), []
    for root in out:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        waiting.append(root)
        on.add(root)
        path = [(root, iter(out[root]))]
        while path:
            node, rest = path[-1]
            new = None
            for x in rest:
                if x not in order:
                    new = x
                    break
                if x in on:
                    low[node] = min(low[node], order[x])
            if new is not None:
                order[new] = low[new] = len(order)
                waiting.append(new)
                on.add(new)
                path.append((new, iter(out[new])))
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[node])
            if low[node] == order[node]:
                members = []
                while not members or members[-1] != node:
                    members.append(waiting.pop())
                on.difference_update(members)
                if len(members) > 1 or node in loops:
                    least = min(members)
                    found += [(m, least) for m in members]
    return found


def _few(edges: DataFrame, kind: str) -> DataFrame:
    """(k, v): knots() of edges (a, b) that are known to be few; k and v of a type."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = [p for f in frames for p in zip(f["a"].tolist(), f["b"].tolist(), strict=True)]
        yield pd.DataFrame(knots(pairs), columns=["k", "v"])

    return edges.repartition(1).mapInPandas(task, f"k {kind}, v {kind}")


def on_cycles(graph: Graph, kind: str = "INJECTS", few: int = FEW) -> DataFrame:
    """(id, component): every node on a cycle of any length, with the least id of its strongly connected component.

    Cycles along single successors are contracted first, in rounds that grow with the logarithm of their
    length; where that leaves most nodes, as among many edges, whole components are found by colours
    instead. Both go on with what is left; edges that no cycle can hold go before each round. As soon as
    at most `few` edges are left, one task finds their components.
    """
    named = settle(graph.links(kind).select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct(), "cycle-edges")
    none = graph.edges.sparkSession.createDataFrame([], "id string, component string")
    rest, count = named, named.count()
    if count > few:
        rest, count = _trimmed(named)
    if not count:
        return none
    if count <= few:
        return settle(_few(rest, "string").toDF("id", "component"), "cycle-components")
    nodes = lambda e: e.select(F.col("a").alias("k")).union(e.select("b")).distinct()
    ids = settle(nodes(rest).select(F.col("k").alias("id"), F.monotonically_increasing_id().alias("k")), "cycle-keys")
    for end in ("a", "b"):
        rest = rest.join(_sorted(ids.toDF(end, f"_{end}")), end)
    rest = settle(rest.select(F.col("_a").alias("a"), F.col("_b").alias("b")), "cycle-edges")
    loops = rest.where("a = b").select(F.col("a").alias("k")).distinct()
    rest, roots, n = rest.where("a <> b"), ids.select("k", F.col("k").alias("root")), ids.count()
    rest, count = _trimmed(settle(rest, "cycle-edges"))

    def merged(roots: DataFrame, found: DataFrame) -> DataFrame:
        return settle(roots.join(_sorted(found.select(F.col("k").alias("root"), "v")), "root", "left").select("k", F.coalesce("v", "root").alias("root")), "cycle-roots")

    while count > few:
        found = settle(_rings(rest, count), "cycle-rings")
        roots = merged(roots, found)
        for end in ("a", "b"):
            rest = rest.join(_sorted(found.select(F.col("k").alias(end), F.col("v").alias("_v"))), end, "left").withColumn(end, F.coalesce("_v", end)).drop("_v")
        rest, count = _trimmed(settle(rest.select("a", "b").where("a <> b").distinct(), "cycle-edges"))
        before, n = n, nodes(rest).count() if count else 0
        if count > few and n > before / 2:
            found, left = _coloured(rest)
            roots = merged(roots, found)
            rest, count = _trimmed(settle(left, "cycle-edges"))
            n = nodes(rest).count() if count else 0
    if count:
        roots = merged(roots, settle(_few(rest, "long"), "cycle-few"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    knotted = roots.join(_sorted(sizes), "root").join(_sorted(loops.withColumn("loop", F.lit(True))), "k", "left").where((F.col("n") > 1) | F.col("loop"))
    members = settle(knotted.join(_sorted(ids), "k").select("id", "root"), "cycle-components")
    return members.join(_sorted(members.groupBy("root").agg(F.min("id").alias("component"))), "root").select("id", "component")


def neighbours(graph: Graph, node_id: str) -> DataFrame:
    """Edges at a node: (direction, other_id, type)."""
    out = graph.edges.where(F.col("source_id") == node_id).select(F.lit("out").alias("direction"), F.col("target_id").alias("other_id"), "type")
    into = graph.edges.where(F.col("target_id") == node_id).select(F.lit("in").alias("direction"), F.col("source_id").alias("other_id"), "type")
    return out.unionByName(into)


def joined(column: Column) -> Column:
    """Sorted, distinct values as one text."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")
