import hashlib
import random
import zlib

from graphlens.llm import media_chunks


def slow_cuts(data, least, average, most):
    ends, start, bits = [], 0, average.bit_length() - 1
    h = 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(media_chunks.GEAR[b])) & 0xFFFFFFFF
        window = sum(int(media_chunks.GEAR[data[i - k]]) << k for k in range(min(bits, i + 1)))
        if i - start + 1 > most:
            start += most
            ends.append(start)
        if window % average == 0 and i + 1 - start >= least:
            start = i + 1
            ends.append(start)
    if start < len(data) or not ends:
        ends.append(len(data))
    return ends


def test_cuts_equal_a_byte_loop_and_survive_inserts():
    rnd = random.Random(5)
    data = bytes(rnd.choices(b"abcdefgh \n", k=20_000))
    assert media_chunks.cuts(data, 64, 256, 1024) == slow_cuts(data, 64, 256, 1024)
    assert media_chunks.cuts(b"", 64, 256, 1024) == [0]
    same = bytes(5000)
    ends = media_chunks.cuts(same, 64, 256, 1024)
    assert ends[-1] == 5000 and max(b - a for a, b in zip([0, *ends], ends)) <= 1024
    moved = data[:7000] + b"inserted" + data[7000:]
    a = {c for _, _, c in media_chunks.chunks_of(data)}
    b = {c for _, _, c in media_chunks.chunks_of(moved)}
    assert len(a & b) >= len(a) - 4


def test_round_trip_and_sharing(spark):
    rnd = random.Random(6)
    base = "".join(rnd.choices("abcdefgh \n", k=30_000))
    texts = [base, base, base[:9000] + "new" + base[9000:], base[15_000:], None, "", "x", "ß" * 64, "y" * 64, base[:5000]]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, base, "clash"), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunks string").repartition(4)
    out = media_chunks.media_features(docs).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        medium = media_chunks.medium_of(padded)
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(padded), len(medium))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_sha256 == hashlib.sha256(medium).hexdigest()
    assert by_id[0][1:] == by_id[1][1:] and by_id[4][1:] == by_id[5][1:]
    media, table = media_chunks.store(docs)
    shared = media.selectExpr("inline(chunks)").where("n < 0")
    assert table.count() == shared.select("hi", "lo").distinct().count() < shared.count()
    assert media_chunks.media_features(docs.limit(0)).count() == 0
