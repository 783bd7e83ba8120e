from collections import Counter

from test_line_dedup import distance

import corpus_pipeline
from graphlens.llm import decontam, packing, simhash, similar
from graphlens.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    columns, seen, frames = docs.columns, set(), {}
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.sparkSession.createDataFrame([(None, None, None, None, None)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = written(stage(spark, docs, SF), name)
        frames[name] = docs.toPandas()
        assert docs.columns == columns
        assert set(frames[name].doc_id.dropna()) <= before
    good, lines = frames["quality_classifier"], frames["line_dedup"]
    whole = {i: t for i, t in zip(good.doc_id, good.text) if t is not None}
    for i, t in zip(lines.doc_id, lines.text):
        if t:
            kept, have = Counter(t.split("\n")), Counter(whole[i].split("\n"))
            assert kept <= have
            seen.update(x for x in kept if len(x) >= 24)
    lost = {x for t in whole.values() for x in t.split("\n") if len(x) >= 24} - seen
    others = {x for t in whole.values() for x in t.split("\n")}
    assert all(any(x != y and abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1 for y in others) for x in lost)
    once = frames["simhash_near_dedup"]
    assert once.doc_id.dropna().is_unique and once.text.dropna().is_unique
    said = lambda t: " ".join(map(str, decontam.words_of(t)))
    bench = [said(r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = frames["benchmark_decontamination"]
    assert not any(b in said(t) for t in clean.text.dropna() for b in bench)
    gone = once[~once.doc_id.isin(clean.doc_id)]
    assert len(clean) >= 0.8 * len(once) and len(gone) < 0.2 * len(once)
    packed = corpus_pipeline.packed(spark, docs, SF).toPandas()
    words = packing.WordIds(__import__("public_tokenizers").path(packing.TOKENIZER))
    want = sum(len(words.encode(t or "")) + 1 for t in clean.text)
    assert packed.length.sum() == want and set(packed.doc_id.dropna()) == set(clean.doc_id.dropna())
    assert (packed.groupby("sequence_id").length.sum() <= 4096).all()


def test_near_copies_by_fingerprint_by_similarity_and_by_chains_of_both(spark):
    said = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    often = lambda name: f"{said('often', 9)} " * 300 + said(name, 20)
    # 1 and 2 have one fingerprint, but few different shingles in common; 3 is similar to 2 only
    third = f"{said('often', 9)} " * 2 + said("b", 20)
    texts = [often("a"), often("b"), third, said("own", 60), said("other", 60)]
    prints = [simhash.fingerprint(t) for t in texts]
    sets = [set(similar.shingles(t, 5).tolist()) for t in texts]
    far = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert far(0, 1) <= 2 and alike(0, 1) < 0.8
    assert far(0, 2) > 2 < far(1, 2) and alike(0, 2) < 0.8 <= alike(1, 2)
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    kept = lambda d: sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, d, SF).collect())
    assert kept(docs.where("doc_id <> 3")) == [1, 4, 5]
    assert kept(docs) == [1, 4, 5]
    assert kept(docs.limit(0)) == []
