import random

import pytest
from pyspark.sql import functions as F

from graphlens.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, s, n):
    for _ in range(n):
        p = rnd.randrange(len(s) + 1)
        s = rnd.choice([s[:p] + rnd.choice("abé ") + s[p:], s[:p] + s[p + 1 :], s[:p] + rnd.choice("xyß") + s[p + 1 :]])
    return s


@pytest.mark.parametrize("t", [1, 2, 3])
def test_banded_distance(spark, t):
    rnd = random.Random(t)
    pairs = [("", ""), ("", "a"), ("ab", ""), ("abc", "abc"), ("ab", "ba")]
    for _ in range(250):
        a = "".join(rnd.choices("abcé", k=rnd.randint(0, 30)))
        pairs.append((a, edited(rnd, a, rnd.randint(0, t + 2))))
    df = spark.createDataFrame([(a, b, list(a), list(b)) for a, b in pairs], "a string, b string, x array<string>, y array<string>")
    for r in df.select("a", "b", line_dedup.edit_distance(F.col("x"), F.col("y"), t).alias("d")).collect():
        want = distance(r.a, r.b)
        assert (r.d == want) if want <= t else (r.d > t), (r, want)


@pytest.mark.parametrize("t", [1, 2, 3])
def test_distance_of_what_is_not_in_common(spark, t):
    rnd = random.Random(t)
    pairs = [("", ""), ("abc", "abc"), ("ab", "cab"), ("ab", "abab"), ("", "abc"), ("aaaa", "aaa")]
    for _ in range(400):
        a = "".join(rnd.choices("abcé ", k=rnd.choice([1, 3, 8, 30, 60, 150])))
        pairs.append((a, rnd.choice([edited(rnd, a, rnd.randint(0, 5)), a[::-1], a[3:] + a[:3]])))
    df = spark.createDataFrame(pairs, "x string, y string")
    for r in df.select("x", "y", line_dedup.distance(F.col("x"), F.col("y"), t).alias("d")).collect():
        want = distance(r.x, r.y)
        assert r.d == (want if want <= t else -1), (r, want)


def classes(lines, t):
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= t and distance(a, b) <= t:
                root[find(a)] = find(b)
    return find


def brute(docs, t, least):
    every = sorted({x for _, text in docs if text for x in text.split("\n") if len(x) >= least})
    find, first, out = classes(every, t), {}, {}
    for i, text in sorted((d for d in docs if d[1] is not None)):
        keep = []
        for x in text.split("\n"):
            if len(x) >= least:
                if find(x) in first:
                    continue
                first[find(x)] = i
            keep.append(x)
        out[i] = "\n".join(keep)
    return out


@pytest.mark.parametrize(("t", "crowd"), [(1, 300), (2, 300), (2, 2)])
def test_equals_brute_force(spark, t, crowd):
    rnd = random.Random(7 + t)
    base = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(8, 40))) for _ in range(25)]
    docs = []
    for i in range(60):
        docs.append((i, "\n".join(edited(rnd, rnd.choice(base), rnd.randint(0, t + 1)) for _ in range(5))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, t, 12, crowd).collect()}
    assert got == brute(docs, t, 12)


def test_edges(spark):
    long = "z" * 100_000
    rows = [
        (1, None, "a", 9), (2, "", "b", 9), (3, "tiny\n\ntiny", "c", 9), (4, f"{long}\nmore than twenty-four chars", "d", 9),
        (5, f"{long}\nshort", "e", 9), (5, f"{long}\nshort", "e", 9), (None, "more than twenty-four chars\nq", None, 9),
        (None, "nobody else has said this line", None, 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string, n_lines int")
    out = sorted(line_dedup.dedup_lines(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    assert [r.text for r in out] == [
        None, "", "tiny\n\ntiny", f"{long}\nmore than twenty-four chars", "short", "short", "nobody else has said this line", "q",
    ]
    assert [r.n_dropped for r in out] == [0, 0, 0, 0, 1, 1, 0, 1] and out[0].n_lines == 0 and out[3].place == "d"
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_edits_follow_length_and_short_lines_repeat(spark):
    rnd = random.Random(3)
    docs, at = [], 0
    for n in (30, 79, 80, 81, 159, 160, 161, 300):
        for e in (1, 2, 3, 4):
            base = "".join(rnd.choices("abcdefgh ", k=n))
            # e replaced letters, far from each other
            other = "".join("Z" if i in [k * (n // 5) + 2 for k in range(e)] else c for i, c in enumerate(base))
            docs += [(at, base, None), (at + 1, other, e > (1 if n < 80 else 2 if n < 160 else 3))]
            at += 2
    rows = [(i, t) for i, t, _ in docs] + [(900, "tiny\n\n \nown"), (901, "tiny\n\n \nelse")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, bands=line_dedup.BANDS, exact_chars=1).collect()}
    assert all((got[i] != "") == stays for i, _, stays in docs if stays is not None)
    assert got[900] == "tiny\n\n \nown" and got[901] == "\n \nelse"


def test_shared_starts_and_ends_refine(spark):
    rnd = random.Random(11)
    start, end = "".join(rnd.choices("abcdef ", k=30)), "".join(rnd.choices("abcdef ", k=24))
    texts = set()
    while len(texts) < 200:
        core = "".join(rnd.choices("0123", k=rnd.choice([0, 1, 2, 5, 6, 7, 8, 9])))
        texts.add(edited(rnd, rnd.choice([start + core + end, core + start + end, start + end + core]), rnd.choice([0, 0, 1])))
    docs = [(i, t) for i, t in enumerate(sorted(texts))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, 2, 12, 8).collect()}
    assert got == brute(docs, 2, 12)


def test_numbered_lines_make_few_candidates(spark, monkeypatch):
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    ends = {"".join(rnd.choices(letters, k=9)) for _ in range(20_000)}
    made = []
    plain = line_dedup._verified

    def counted(pairs, lines, bands):
        made.append(pairs.distinct().count())
        return plain(pairs, lines, bands)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    rows = [(i, f"This is the record with number {e}") for i, e in enumerate(sorted(ends))]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("n_dropped > 0").count() == 0
    # each line meets a leader or a few lines a level
    assert sum(made) <= 12 * len(ends), made


def test_near_copies_fetch_few_texts(spark, monkeypatch):
    rnd = random.Random(9)
    base = "".join(rnd.choices("abcdefgh ", k=400))
    copies = {base[:p] + rnd.choice("xyz") + base[p + 1 :] for p in range(400)}
    fetched, plain = [], line_dedup._with_texts

    def counted(rows, *more):
        fetched.append(rows.count())
        return plain(rows, *more)

    monkeypatch.setattr(line_dedup, "_with_texts", counted)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(copies))], "doc_id long, text string")
    out = line_dedup.dedup_lines(df, bands=line_dedup.BANDS)
    assert out.where("n_dropped = 0").count() == 1
    # both lines of a pair with a leader, not every entry of a line
    assert sum(fetched) <= 8 * len(copies), fetched


def test_text_ids_and_clashing_names(spark):
    line = "a line of more than twenty-four letters"
    rows = [("b", line, 1, 2, 3), ("a", f"{line}\nown", 4, 5, 6), (None, line, 7, 8, 9), ("10", "x", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, place int, own int, gone int")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert (out["a"].text, out["b"].text, out[None].text) == (f"{line}\nown", "", "")
    assert (out["a"].place, out["a"].own, out["a"].gone) == (4, 5, 6)
    assert line_dedup.dedup_lines(df).columns == [*df.columns, "n_lines", "n_dropped"]
    with pytest.raises(ValueError, match="longer than their edits"):
        line_dedup.dedup_lines(df, max_edits=2, min_chars=2)
