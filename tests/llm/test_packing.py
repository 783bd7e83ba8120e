import random
import zlib
from collections import defaultdict

import numpy as np

from graphlens.llm import packing


def test_bfd_and_bounds_on_known_cases():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        lengths = rnd.integers(1, 101, 60)
        bins, offsets, free = packing.best_fit_decreasing(lengths, 100)
        used = np.zeros(len(free), dtype=int)
        for b, n in zip(bins, lengths):
            used[b] += n
        assert (used == 100 - free).all() and used.max() <= 100
        assert packing.lower_bound(lengths, 100) <= len(free)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34, 34, 34, 67]), 100) == 3
    assert packing.lower_bound(np.array([], dtype=int), 100) == 0
    # lengths over a third and up to a half: two fit together, three do not
    assert packing.lower_bound(np.array([40] * 6), 100) == 3


def check(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_whole_pack_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    words = ["the", "Straße", "don't", "x&y", "ñandú", "12,345", "WORLD!!"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([1, 7, 40, 300]))) for _ in range(120)]
    texts += [None, "", " \n ", "ΟΔΥΣΣΕΥΣ <|endoftext|> x", "é   y\x1cz", "w " * 9000, "q" * 20_000]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[0], 5), (None, "lost id", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = packing.pack_documents(docs, per_partition=40).collect()
    n_bins = check(out, 4096)
    token = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = token.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[i], key=lambda r: (r.piece, r.offset))
        if i == 0:
            assert len(parts) == 2
            continue
        assert [p.piece for p in parts] == list(range(-(-len(ids) // 4096)))
        for p in parts:
            cut = ids[p.start : p.start + p.length]
            assert p.length == min(4096, len(ids) - p.start)
            assert p.ids_crc32 == zlib.crc32(np.array(cut, dtype="<u4").tobytes())
    total = sum(r.length for r in out)
    assert n_bins <= -(-total // 4096) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_gap_partitions_exchange(spark):
    rows = [(i, 0, 0, n, 0) for i, n in enumerate([60, 40] * 300)]
    found = spark.createDataFrame(rows, packing.PIECES.format(id="long"))
    out = packing.pack(found, capacity=100, per_partition=50).collect()
    assert len(out) == 600
    assert check(out, 100) <= 303
