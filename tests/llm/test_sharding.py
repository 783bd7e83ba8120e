import zlib
from collections import Counter, defaultdict

from graphlens.llm import sharding


def test_shards_are_even_gapless_and_whole(spark):
    rows = [(i, "text %d" % (i % 7), "x") for i in range(1000)] + [(7, "again", "x")] * 500
    rows += [(None, None, "x"), (1001, "", None), (1002, "ß" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    out = sharding.shards(docs, 24, seed=3, bucket_bytes=4000).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((a, b) for a, b, _ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    hot = Counter(r.shard for r in out if r.doc_id == 7)
    assert max(hot.values()) < 60
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None and r.doc_id != 7]
    assert order != sorted(order)
    assert sharding.shards(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(100).selectExpr("id doc_id", "cast(id as string) text")
    sharding.write_shards(sharding.shards(docs, 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


def test_places_equal_plain_python(spark, monkeypatch):
    # small ranges, so that bases of ranges and starts inside them both count
    monkeypatch.setattr(sharding, "RANGE", 4)
    texts = {i: "é" * (i % 70) if i % 9 else None for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    buckets = sharding.shuffled_buckets(docs, 7, bucket_bytes=500).collect()
    order = sorted(buckets, key=lambda r: (r.bucket, r.place))
    assert len({r.bucket for r in order}) > 3 * 4
    for bucket in {r.bucket for r in order}:
        places = [r.place for r in order if r.bucket == bucket]
        assert places == list(range(len(places)))
    raw = {i: (t or "").encode() for i, t in texts.items()}
    want = {(r.doc_id, len(raw[r.doc_id]) + 8, zlib.crc32(raw[r.doc_id]), at % 5, at // 5) for at, r in enumerate(order)}
    got = sharding.shards(docs, 5, 7, bucket_bytes=500).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert len(got) == len(texts) and {tuple(r) for r in got} == want
