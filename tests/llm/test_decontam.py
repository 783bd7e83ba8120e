import numpy as np

from graphlens.llm import decontam
from graphlens.llm.common import table

SF = "/root/testdata/sf0.01"


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rnd = np.random.default_rng(2)
    for _ in range(60):
        a, b = (list(rnd.choice(list("abcde"), rnd.integers(1, 70))) for _ in "12")
        got = decontam.common_subsequence(decontam._places(a), len(a), b).bit_count()
        assert got == slow(a, b)


def test_recall_against_brute_force(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    found = {r.doc_id: set(r["items"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert len(found) == docs.count()
    items = [decontam.Item(r.item_id, decontam.words_of(r.text)) for r in bench.collect()]
    brute = set()
    for r in docs.collect():
        words = decontam.words_of(r.text)
        for item in items:
            m = len(item.words)
            for s in range(0, max(1, len(words) - 16), 16):
                if decontam.is_leak(*item.covered(words[max(0, s - m) : s + 32 + m])):
                    brute.add((r.doc_id, item.item_id))
                    break
    hits = {(d, i) for d, got in found.items() for i in got}
    assert brute and hits <= brute and len(hits) >= 0.9 * len(brute)
    flat = {i.item_id: " ".join(map(str, i.words)) for i in items}
    verbatim = {(r.doc_id, i) for r in docs.collect() for i, t in flat.items() if t in " ".join(map(str, decontam.words_of(r.text)))}
    assert verbatim <= hits


def test_paraphrase_and_edges(spark):
    item = "which river flows through the old capital before it meets the sea the answer is the silver brook"
    para = "which broad river flows slowly through our capital before it meets the cold sea the answer is the silver brook"
    filler = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, f"{filler} {item.upper()}! {filler}"), (2, f"{filler} {para} {filler}"), (3, filler), (4, None), (5, ""),
        (None, item), (1, filler), (6, "which river"), (7, ("lorem ipsum " * 60_000) + item),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(9, item), (10, None), (None, filler), (11, " "), (9, item)], "item_id long, text string")
    out = decontam.find_leaks(docs, bench).collect()
    assert len(out) == len(rows)
    assert sorted(str(r.doc_id) for r in out if r.contaminated) == ["1", "2", "7", "None"]
    assert all(r["items"] == [9] for r in out if r.contaminated)
    kept = decontam.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 5
    assert decontam.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0


def test_recall_on_a_large_benchmark(spark):
    rnd = np.random.default_rng(4)
    vocabulary = np.array([f"w{i}" for i in range(6000)])
    say = lambda n: rnd.choice(vocabulary, n).tolist()
    items = [say(rnd.integers(15, 60)) for _ in range(1200)]
    docs, held = [], {}
    for i in range(300):
        words = list(items[4 * i])
        if i % 2:  # a paraphrase: one word in five is another
            for at in range(0, len(words) - max(3, len(words) // 4), 5):
                words[at] = say(1)[0]
        docs.append((i, " ".join(say(90) + words + say(90))))
        held[i] = 4 * i
    docs += [(300 + i, " ".join(say(200))) for i in range(100)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r["items"] for r in decontam.find_leaks(table, bench).collect()}
    exact = sum(held[i] in found[i] for i in range(0, 300, 2))
    said_again = sum(held[i] in found[i] for i in range(1, 300, 2))
    assert exact == 150 and said_again == 150, (exact, said_again)
    assert not any(found[300 + i] for i in range(100))
