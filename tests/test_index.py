"""The stored index: every form of a query against plain Python, updates, and what a query reads."""

import math
import random
import re

import pytest

from graphlens import model
from graphlens.operators import index
from graphlens.operators.query_words import BadQuery, Leaf, parse

NODES = [
    ("a", "order service", "SERVICE", {"k": "handles new order"}), ("b", "order", "CONTROLLER", {"k": "service of order"}), ("c", "Payment-Service_2", "SERVICE", {}),
    ("d", "paymants", "CLASS", {"k": "order order order", "m": "new"}), ("e", "new order service", "SERVICE", {"x": "y"}), ("f", None, "CLASS", {}),
]


def text(n, field):
    values = " ".join(v for _, v in sorted(n[3].items()))
    whole = {"name": n[1] or "", "type": n[2], "metadata": values, "text": " ".join(x for x in (n[1], n[2], values) if x is not None)}[field]
    return [w for w in re.split(r"[^\w]+", whole.lower()) if w]


def near(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(nodes, node):
    """id -> score of one leaf or group."""
    docs = {f: [n for n in nodes if text(n, f)] for f in index.FIELDS}
    if isinstance(node, Leaf):
        out = {}
        for f, weight in ({node.field: 1.0} if node.field else index.FIELDS).items():
            mean = sum(len(text(n, f)) for n in docs[f]) / max(len(docs[f]), 1)
            idf = 0
            for w in node.words:
                df = sum(w in text(n, f) for n in nodes)
                idf += math.log(1 + (len(docs[f]) - df + 0.5) / (df + 0.5))
            for n in nodes:
                words = text(n, f)
                if node.kind in ("prefix", "near"):
                    if any(w.startswith(node.words[0]) if node.kind == "prefix" else near(w, node.words[0]) <= node.edits for w in words):
                        out[n[0]] = node.boost
                    continue
                tf = sum(words[i : i + len(node.words)] == node.words for i in range(len(words)))
                if tf:
                    out[n[0]] = out.get(n[0], 0) + weight * node.boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        return out
    found = [(r, plain(nodes, p)) for r, p in node.parts]
    must, may, never = ([s for r, s in found if r == role] for role in "+ -")
    ids = set.intersection(*(set(s) for s in must)) if must else set().union(*(set(s) for s in may))
    ids -= set().union(*(set(s) for s in never))
    return {i: node.boost * sum(s.get(i, 0) for r, s in found if r != "-") for i in ids}


QUERIES = [
    "order", "order service", "+order +service", "order AND service", "order AND NOT new", "name:order", 'name:"order service"', '"new order"', "pay*", "payments~", "payments~1",
    "type:service^3 new", "(new OR payment) AND order", "+(name:order type:class) -metadata:new", "service_2", "order && !service", "-order", "new-order", "ORDER",
]


def frame(spark, nodes):
    return spark.createDataFrame([(i, n, t, m) for i, n, t, m in nodes], model.NODE)


def test_every_form_equals_plain_python(spark):
    made = index.build(frame(spark, NODES))
    for query in QUERIES:
        want = plain(NODES, parse(query, tuple(index.FIELDS)))
        got = {r.id: r.score for r in index.matches(made, query).collect()}
        assert got.keys() == want.keys(), query
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want), query


@pytest.mark.parametrize("query", ["", "(order", "order)", "AND order", "order AND", "colour:red", '"order', "~ order", "+", "()", "a ^2"])
def test_errors_give_no_rows(query):
    with pytest.raises(BadQuery):
        parse(query, tuple(index.FIELDS))


def test_error_and_order_of_results(spark):
    made, nodes = index.build(frame(spark, NODES)), frame(spark, NODES)
    assert index.search(made, nodes, "(order").count() == 0
    found = index.search(made, nodes, "order", top=2).collect()
    assert len(found) == 2 and found[0].score >= found[1].score


def test_updates_equal_a_new_index(spark, monkeypatch):
    monkeypatch.setattr(index, "LAYERS", 2)
    rnd, nodes = random.Random(3), {n[0]: n for n in NODES}
    made = index.build(frame(spark, NODES))
    for step in range(2):
        changed = [(i, f"order {rnd.choice(['new', 'payment'])}", "CLASS", {"k": "service"}) for i in rnd.sample([*nodes, "x", "y"], 2)]
        gone = rnd.choice(sorted(nodes.keys() - {c[0] for c in changed}))
        nodes |= {c[0]: c for c in changed}
        del nodes[gone]
        made = index.update(made, frame(spark, changed), spark.createDataFrame([(gone,)], "id string"))
        assert len(made.docs) == (2 if step == 0 else 1)
        for query in ("order new", '"order new"', "+service -pay*"):
            want = plain(list(nodes.values()), parse(query, tuple(index.FIELDS)))
            got = {r.id: r.score for r in index.matches(made, query).collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want), query


def test_a_query_reads_the_buckets_of_its_terms_only(spark):
    made = index.build(frame(spark, NODES))
    rows = made.live(made.postings, index._buckets(made, ["order", "new"]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    wanted = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "bucket" in wanted and len(set(re.findall(r"\d+", re.sub(r"#\d+", "", wanted)))) <= 2
    files = {f for f in rows.inputFiles()}
    assert all(re.search(r"bucket=(\d+)", f) for f in files)


def test_words_are_written_once_and_keep_their_places_in_each_field(spark):
    nodes = spark.createDataFrame(
        [("a", "Red red, blue", "SERVICE", {"k": "blue Red", "j": None}), ("b", None, "TEST", {}), ("c", "", "", None)],
        "id string, name string, type string, metadata map<string,string>",
    )
    built = index.build(nodes)
    # one row an occurrence, however many fields hold it
    assert built.postings[0].count() == 7
    rows = index._by_field(built.postings[0], index.FIELDS).where("id = 'a'").collect()
    got = {(r.field, r.term): (r.dl, sorted(x.place for x in rows if (x.field, x.term) == (r.field, r.term))) for r in rows}
    text = ["red", "red", "blue", "service", "blue", "red"]
    want = {(f, t): (len(ws), [i for i, w in enumerate(ws) if w == t]) for f, ws in {"name": text[:3], "type": text[3:4], "metadata": text[4:], "text": text}.items() for t in ws}
    assert got == want
    assert {(r.id, r.field): r.dl for r in built.docs[0].where("id <> 'a'").collect()} == {(i, f): int(i == "b" and f in ("type", "text")) for i in "bc" for f in index.FIELDS}
    assert [r.id for r in index.search(built, nodes, '"blue service"').collect()] == ["a"]
    assert index.search(built, nodes, 'name:"blue service"').count() == 0
