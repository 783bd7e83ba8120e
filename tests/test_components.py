"""Strongly connected components against a plain search, and their rounds on long cycles."""

import random

import pytest

from graphlens import model
from graphlens.operators import traversal


def graph(spark, pairs):
    nodes = spark.createDataFrame([], model.NODE)
    return model.Graph(nodes, spark.createDataFrame([(a, b, "INJECTS") for a, b in pairs], "source_id string, target_id string, type string"))


def plain(pairs):
    """Components by who reaches whom."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), list(out.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += out.get(y, ())
        return seen

    after = {x: reach(x) for x in out}
    return {(x, min(y for y in after[x] if x in after.get(y, ()))) for x in out if x in after[x]}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_plain_search(spark, seed):
    rnd = random.Random(seed)
    n = 30 + 20 * seed
    pairs = {(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(int(n * (0.8 + 0.2 * seed)))}
    assert {tuple(r) for r in traversal.on_cycles(graph(spark, pairs), few=0).collect()} == plain(pairs)
    assert {tuple(r) for r in traversal.on_cycles(graph(spark, pairs), few=9).collect()} == plain(pairs)
    assert set(traversal.knots(sorted(pairs))) == plain(pairs)


def test_a_long_cycle_takes_few_rounds(spark, monkeypatch):
    n, written = 10_000, []
    settle = traversal.settle
    monkeypatch.setattr(traversal, "settle", lambda df, name, by=None: written.append(name) or settle(df, name, by))
    ring = [(f"n{i:05d}", f"n{(i + 1) % n:05d}") for i in range(n)]
    found = traversal.on_cycles(graph(spark, ring), few=0)
    assert found.count() == n and {r.component for r in found.select("component").distinct().collect()} == {"n00000"}
    assert len(written) < 30, written


def test_a_long_cycle_in_one_task():
    ring = [(i, (i + 1) % 50_000) for i in range(50_000)]
    assert {v for _, v in traversal.knots(ring)} == {0}


def test_nothing_is_walked_without_cycles(spark, monkeypatch):
    written = []
    settle = traversal.settle
    monkeypatch.setattr(traversal, "settle", lambda df, name, by=None: written.append(name) or settle(df, name, by))
    assert traversal.on_cycles(graph(spark, [("a", "b"), ("b", "c"), ("a", "c")]), few=0).count() == 0
    assert not {"spread", "ways"} & set(written)


def test_a_long_path_between_cycles(spark, monkeypatch):
    n, written = 3000, []
    settle = traversal.settle
    monkeypatch.setattr(traversal, "settle", lambda df, name, by=None: written.append(name) or settle(df, name, by))
    path = [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(n)]
    pairs = [*path, ("a", "b"), ("b", "a"), ("b", "p0000"), (f"p{n:04d}", "c"), ("c", "d"), ("d", "c")]
    assert {tuple(r) for r in traversal.on_cycles(graph(spark, pairs), few=0).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
    assert len(written) < 60, written


def test_rounds_send_no_tables_through_the_driver(spark, monkeypatch):
    plans, settle = [], traversal.settle
    monkeypatch.setattr(traversal, "settle", lambda df, name, by=None: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or settle(df, name, by))
    rnd = random.Random(5)
    pairs = {(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(70)}
    found = traversal.on_cycles(graph(spark, pairs), few=0)
    plans.append(("last", found._jdf.queryExecution().executedPlan().toString()))
    assert len(plans) > 9 and not [name for name, plan in plans if "Broadcast" in plan]
    assert {tuple(r) for r in found.collect()} == plain(pairs)
