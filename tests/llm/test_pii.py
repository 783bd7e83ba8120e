"""Operator 13: base spans against the patterns as written, messages against enumeration, added spans on planted texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from graphlens.llm import pii

SPELT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    odd = [int(d) for d in digits[::-1][::2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def plain_base(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return {
            "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
        }[kind]()

    return [(k, m.start(), m.end()) for k, p in SPELT.items() for m in re.finditer(p, text) if good(k, m.group())]


def card(rnd, n=16):
    body = "".join(str(rnd.randrange(10)) for _ in range(n - 1))
    return next(body + str(d) for d in range(10) if plain_luhn(body + str(d)))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(4)
    pieces = ["a", "Z9", "@", "@@", ".", "..", "-", "+", " ", "x.y", "1", "22", "255", "256", "000", "1.2.3.4", "+1 (743) 555-3824", "é", "_", "%", "(", ")"]
    for _ in range(6000):
        text = "".join(rnd.choice(pieces + [card(rnd), card(rnd)[:8]]) for _ in range(rnd.randrange(18)))
        assert [(pii.LABELS[k], s, e) for k, s, e in pii.base_spans(text)] == plain_base(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 10**6 + "@", "1" * 10**6, "1." * 10**6, "+1" + " " * 10**6, "a@" * 10**5, "@" * 10**5, "1 " * 10**5):
        pii.field(text)
    assert pii.base_spans("x " * 10**6 + "me@a.bc") == [(1, 2 * 10**6, 2 * 10**6 + 7)]


def exact(unary, ends, kinds, pairs):
    n, out = len(unary), np.zeros_like(unary)
    for labels in itertools.product(range(pii.L), repeat=n):
        score = sum(unary[i, y] for i, y in enumerate(labels)) + sum(pairs[k, labels[a], labels[b]] for (a, b), k in zip(ends, kinds, strict=True))
        for i, y in enumerate(labels):
            out[i, y] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_messages_equal_enumeration_on_trees_and_stay_near_on_loops():
    rnd = np.random.default_rng(2)
    pairs = rnd.normal(size=(2, pii.L, pii.L))
    tree = np.array([(0, 1), (1, 2), (3, 1), (4, 3)])
    unary, kinds = rnd.normal(size=(5, pii.L)), np.array([0, 0, 1, 1])
    assert np.abs(pii.beliefs(unary, tree, kinds, pairs) - exact(unary, tree, kinds, pairs)).max() < 1e-3
    loop, kinds = np.array([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)]), np.array([0, 0, 1, 0, 0])
    assert np.abs(pii.beliefs(unary, loop, kinds, pairs * 0.5) - exact(unary, loop, kinds, pairs * 0.5)).max() < 0.1


def corpus(n=400, seed=8):
    """Texts with matches of the patterns beside numbers, years, versions and failing cards that are none."""
    rnd, out = random.Random(seed), []
    words = "the of stone river many under light over quiet number".split()
    for _ in range(n):
        line = [rnd.choice(words) for _ in range(30)]
        for make in rnd.sample([
            lambda: f"user{rnd.randrange(99)}.{rnd.choice(words)}@mail{rnd.randrange(9)}.example.com", lambda: card(rnd),
            lambda: f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}", lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
            lambda: str(rnd.randrange(1900, 2030)), lambda: f"v{rnd.randrange(9)}.{rnd.randrange(9)}", lambda: str(rnd.randrange(99)),
            lambda: "".join(str(rnd.randrange(10)) for _ in range(12)), lambda: f"({rnd.randrange(1900, 2030)})", lambda: f"{rnd.randrange(300, 999)}.1.2.3",
            lambda: "x" + "".join(rnd.choice("0123456789abcdef") for _ in range(40)),
        ], 5):
            line.insert(rnd.randrange(len(line)), make())
        out.append(" ".join(line))
    return out


@pytest.fixture(scope="module")
def model():
    return pii.fit(pii.counted(corpus()))


def added(text, model):
    base, more = next(pii.spans_of([text], model))
    return [(pii.LABELS[k], text[s:e]) for k, s, e in more]


def test_added_spans(model):
    a, b = card(random.Random(1)), card(random.Random(2))
    assert added(f"paid by {a} {b} today", model) == [("card", a), ("card", b)]  # one run of 32 digits has no match
    assert added("call +1 (743) 555-3824 or the number of (743) 555-3824 at night", model) == [("phone", "(743) 555-3824")]
    assert added("write to quartz.77x@mail3.example.com and the user quartz.77x will read it", model) == [("email", "quartz.77x")]
    assert added("the user quartz.77x will read it", model) == []


def test_far_repeats_agree_whatever_lies_between(model):
    text = "quartz.77x@mail3.example.com " + "many stones and rivers " * 20000 + "quartz.77x"
    assert added(text, model) == [("email", "quartz.77x")]


def test_clean_texts_stay_alone(model):
    for text in ("in 2019 and (1987) of v1.2 the 14 rivers", "300.1.2.3 under 4111 1111 1111 1112", "a@localhost 12345678901234", "+12 34", ""):
        assert added(text, model) == []
    for text in corpus(60, 99):
        # a number beside a card or a phone makes one run of digits that is neither: the field finds them again
        found = [(k, re.sub("[^0-9]", "", t)) for k, t in added(text, model)]
        assert all(k == "card" and len(d) == 16 and plain_luhn(d) or k == "phone" and len(d) == 10 and d[3:6] == "555" for k, d in found)


def test_rows_nulls_repeats_and_clashing_names(spark):
    texts = [None, "", "mail me@a.bc", "mail me@a.bc", *corpus(40, 3), "é " + corpus(1, 5)[0]]
    rows = [(n if n % 3 else None, t, "s", "i", 1, "a", 2) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, id string, kind int, a string, n int").repartition(3)
    got = sorted(map(tuple, pii.digest(pii.find(docs)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        base = plain_base(t or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        want.append((i, *(sum(k == x for k, _, _ in base) for x in pii.KINDS), hashlib.sha256(said.encode()).hexdigest()))
    assert [g[:6] for g in got] == sorted(want, key=str)
    for r in pii.find(docs).collect():
        spots = [(s.start, s.stop) for s in r.spans if s.added]
        assert all(e <= s.start or s.stop <= b for b, e in spots for s in r.spans if not s.added)
    assert pii.digest(pii.find(docs.limit(0))).count() == 0
    one = pii.mask(docs.where("text = 'mail me@a.bc' or text is null")).select("text").distinct().collect()
    assert {r.text for r in one} == {"mail [EMAIL]", None}


def test_sums_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(corpus(60))], "doc_id long, text string")
    a, b = (pii.learn(docs.repartition(n)) for n in (1, 5))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.pairs, b.pairs)
    assert np.allclose(a.weights, pii.fit(pii.counted(corpus(60))).weights)
