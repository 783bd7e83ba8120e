import random

import pytest

from graphlens.llm import simhash


def brute(prints, bits):
    """component of each print by brute force: smallest index reachable."""
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize(("bits", "crowd"), [(2, 1000), (2, 3), (3, 2), (5, 3)])
def test_links_equal_brute_force(spark, bits, crowd):
    rnd = random.Random(bits)
    prints = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(9):
            x = base
            for p in rnd.sample(range(64), rnd.randint(0, 3)):
                x ^= 1 << p
            prints.add(signed(x))
    prints = sorted(prints)
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), bits, crowd).collect()
    pairs = {tuple(sorted((r.a, r.b))) for r in got}
    want = {
        (a, b)
        for i, b in enumerate(prints)
        for a in prints[:i]
        if bin((a ^ b) & (2**64 - 1)).count("1") <= bits
    }
    assert pairs == {tuple(sorted(p)) for p in want}
    assert len(got) == len(pairs)


def test_entries_of_few_fingerprints_are_dealt_out_and_not_broadcast(spark, tmp_path):
    spark.range(20_000).selectExpr("xxhash64(id) as fp").write.parquet(str(tmp_path / "prints"))
    distinct = spark.read.parquet(str(tmp_path / "prints")).groupBy("fp").count().select("fp")
    plan = simhash.links(distinct)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert "REPARTITION_BY_NUM" in plan


def test_rows_nulls_copies_and_extra_columns(spark):
    texts = ["the quick brown fox jumps", None, "", "The Quick brown  fox\njumps", "one two", "zzz", None]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "zzz", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    out = {(r.doc_id): r for r in simhash.near_duplicates(docs).collect()}
    assert len(out) == 8
    assert out[0].component_id == out[3].component_id == 0
    assert out[1].fingerprint == "0" * 16 and out[1].component_id == out[2].component_id == out[6].component_id == 1
    assert out[None].component_id == 5
    prints = [simhash.fingerprint(t) for t in texts]
    assert [out[i].component_id for i in range(7)] == brute(prints, 2)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint_by_definition():
    import xxhash

    text = "A b c a B c d " * 9
    words = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) == signed(want)
    assert simhash.fingerprint("x" * 300_000) == signed(xxhash.xxh64_intdigest("x" * 300_000, 42))
