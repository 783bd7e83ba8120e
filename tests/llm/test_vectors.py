"""Operators 11 and 12 against plain Python, with nulls, ties, repeated rows and numbers of any size."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from compare import differences

from graphlens.llm import codebooks, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, id string, part int, now binary"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "i", 2, b"n") for i, v, c in rows], SCHEMA).repartition(3)


def sample(n, width, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(10**12), [rnd.gauss(0, 0.1) for _ in range(width)], rnd.choice([None, 0, 0, 0, 1, 2])) for _ in range(n)]
    rows += rows[:5] + [(None, rows[7][1], 1), (3, None, 1), (4, [None, *rows[0][1][1:]], 1), (5, [float("nan"), *rows[0][1][1:]], 1)]
    return rows + [(6, [float("-inf"), *rows[0][1][1:]], 1), (7, [], 1), (8, rows[0][1][1:], 1)]


def whole(rows, width):
    return [(i, np.array(v, dtype=np.float32), c) for i, v, c in rows if v and len(v) == width and None not in v and np.isfinite(v).all()]


def brute_codes(rows, width, parts, entries, rounds):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v], label) for i, v, label in whole(rows, width)]
    s = width // parts
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    firsts = [min(v for j, v, _ in kept if j == i) for i in ids]
    books = [[f[p * s : p * s + s] for f in firsts] for p in range(parts)]

    def assign(v, p):
        cut = v[p * s : p * s + s]
        return min((sum((a - b) ** 2 for a, b in zip(cut, e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = [assign(v, p)[1] for _, v, _ in kept]
            for e in range(len(firsts)):
                inside = [v[p * s : p * s + s] for (_, v, _), o in zip(kept, of, strict=True) if o == e]
                new = [sum(c) // len(inside) for c in zip(*inside, strict=True)] if inside else books[p][e]
                books[p] = books[p][:e] + [new] + books[p][e + 1 :]
    coded = []
    for i, v, label in kept:
        best = [assign(v, p) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, t, e, sum(x for _, _, x, m in coded if m == c), digest) for i, t, e, c in coded), key=str)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 2), (16, 64, 3), (2, 3, 5)])
def test_codes_equal_brute_force(spark, parts, entries, rounds):
    rows = sample(90, 16, seed=parts)
    got = codebooks.compress(frame(spark, rows), parts, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows, 16, parts, entries, rounds)


def test_codes_of_many_labels_and_ties(spark):
    rows = [(n, [float(n % 3)] * 4, n if n % 2 else None) for n in range(2500)]
    got = codebooks.compress(frame(spark, rows), 2, 4, 1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows, 4, 2, 4, 1)
    assert {r.code for r in got.collect()} == {"0000", "0101", "0202"}


def test_only_changed_parts_move(spark):
    moved = spark.createDataFrame([([1, 2, 3, 4], b"\0\1", b"\0\0"), ([5, 6, 7, 8], None, b"\1\1")], "x array<long>, was binary, now binary")
    got = {(r.part, r.entry, r.place): r.value for r in codebooks.changes(moved, 2, 2, 2).where("value <> 0").collect()}
    first = {(0, 1, -1): 1, (0, 1, 0): 5, (0, 1, 1): 6, (1, 0, -1): 1, (1, 0, 0): 3, (1, 0, 1): 4}
    assert got == first | {(1, 1, 0): 4, (1, 1, 1): 4}  # plus (7, 8), minus (3, 4); the count stays


def test_codes_without_rows_and_beyond_reach(spark):
    for rows in ([], [(1, None, 1)], [(None, [1.0] * 16, 1)]):
        assert codebooks.compress(frame(spark, rows)).count() == 0
    with pytest.raises(ValueError):
        codebooks.compress(frame(spark, [(1, [1.0] * 15, 1)]))
    with pytest.raises(ValueError):
        codebooks.compress(frame(spark, [(1, [1e30] * 16, 1)]))


def test_codes_same_rows_as_sql(spark):
    assert differences(spark, "/root/testdata/sf0.001", queries.op11_vector_codes, codebooks.ORACLE_SQL) == ""


def brute_white(rows, width, most):
    kept = [(i, [int(np.floor(1024 * float(c))) + 100000 for c in v]) for i, v, _ in whole(rows, width)]
    n, sums = len(kept), [sum(c) for c in zip(*(v for _, v in kept), strict=True)]
    cov = [[float(Fraction(n * sum(v[a] * v[b] for _, v in kept) - sums[a] * sums[b], n * n)) for b in range(width)] for a in range(width)]
    values, axes = np.linalg.eigh(np.array(cov))
    order = np.argsort(-values)[:most]
    out = {}
    for at, (i, v) in enumerate(kept):
        off = [n * c - s for c, s in zip(v, sums, strict=True)]
        out[at] = (i, sum(o * o for o in off), (np.array(off) / n) @ axes[:, order] / np.sqrt(values[order]))
    return n, out, values[order] / np.trace(np.array(cov))


def test_whitened_equals_plain_python(spark):
    rows = sample(60, 12, seed=5)
    got = whitening.whiten(frame(spark, rows)).collect()
    n, want, share = brute_white(rows, 12, 8)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    assert sorted(str((r.vec_id, r.deviation)) for r in got if r.component == 1) == sorted(str(w[:2]) for w in want.values())
    for k in range(8):
        mine = {(str(r.vec_id), r.deviation): r.whitened for r in got if r.component == k + 1}
        theirs = {(str(i), d): w[k] for i, d, w in want.values()}
        sign = 1 if all(abs(mine[x] - theirs[x]) < 1e-7 for x in mine) else -1
        assert all(abs(mine[x] - sign * theirs[x]) < 1e-7 for x in mine)
        assert {round(r.explained, 9) for r in got if r.component == k + 1} == {round(share[k], 9)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_sums_of_any_size_are_exact():
    rnd = random.Random(3)
    for reach in (5, 2**20, 2**31, 2**40, 2**62):
        x = np.array([[rnd.randint(-reach, reach) for _ in range(5)] for _ in range(40)])
        want = [[sum(int(r[a]) * int(r[b]) for r in x) for b in range(5)] for a in range(5)]
        assert whitening.cross_products(x).tolist() == want


def test_large_components_keep_their_deviation(spark):
    rows = [(n, [v, -v / 3, 1.0], 1) for n, v in enumerate([1e30, -3e37, 2.5, 1e12])]
    got = {r.vec_id: r for r in whitening.whiten(frame(spark, rows)).where("component = 1").collect()}
    xs = [[max(-(2**62), min(2**62, int(np.floor(1024 * float(np.float32(c)))))) + 100000 for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    for n, x in enumerate(xs):
        exact = sum((4 * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        assert got[n].deviation is None and got[n].deviation_exact == (exact if exact < 10**38 else None)


def test_whitening_without_variance_or_rows(spark):
    same = whitening.whiten(frame(spark, [(n, [1.0, 2.0], 1) for n in range(4)])).collect()
    assert len(same) == 8 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error is None for r in same)
    line = whitening.whiten(frame(spark, [(n, [float(n), 2.0 * n, 0.0], 1) for n in range(4)])).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 4
    assert whitening.whiten(frame(spark, [(1, None, 1), (2, [], 2)])).count() == 0
