"""Operator 3: content-defined chunking of media payloads with deduplicated chunks.

A payload becomes a medium (a binary greyscale image, 64 eight-bit samples a row, losslessly), and
the medium is cut where a rolling gear hash of its last bytes has its low bits zero. Chunk digests
are counted over all media. Chunks that occur once are stored in the row of their medium; chunks
that occur more often are stored in a chunk table only, once by their digest. Every medium keeps its
ordered chunk list. Reading back joins the lists of media with shared chunks to the chunk table,
puts each medium together in order, verifies its digest, and only then reads samples and features.

Which chunks occur more than once is passed to the storing job as a fixed-size bit map of digest
hashes. A false hit only sends a single chunk through the chunk table, so results never depend on
its size; at any scale the driver holds `FILTER_BITS` bits. Media with equal bytes are put together
once, and rows meet their medium again by its digest, so a text copied a billion times is one medium.

Defined results: null text counts as empty (one row of zero samples); repeated rows come back once
each; null ids are kept; an empty table gives an empty result; other columns are ignored. A medium
whose chunks do not give its digest back raises an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm.common import written

ROW = 64
#: Chunk sizes in bytes: least, average (a power of two) and most.
LEAST, AVERAGE, MOST = 512, 2048, 8192
#: Bits of the map of repeated digests.
FILTER_BITS = 1 << 23
GEAR = np.random.default_rng(1729).integers(0, 1 << 32, 256, dtype=np.uint32)

STORED = (
    "n_bytes long, media_bytes long, media_sha256 string, whole boolean,"
    " chunks array<struct<hi:long,lo:long,n:int,data:binary>>"
)
#: Media that read a shared chunk for each of its copies in the join that puts them together.
COPY_EVERY = 1000
READ = (
    "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, stored_bytes long,"
    " stored_sha256 string, feature string"
)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes with zeros up to a positive multiple of 64, and the bytes' number."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def medium_of(payload: bytes) -> bytes:
    """The payload as a binary greyscale image."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def samples_of(medium: bytes) -> bytes:
    """The samples of such an image."""
    kind, size, depth, samples = medium.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a stored medium")
    return samples


def cuts(data: bytes, least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> list[int]:
    """End offsets of the chunks: gear-hash cuts, no chunk under least or over most bytes.

    The hash's low bits depend on the last log2(average) bytes only, so all positions are hashed
    by as many shifted additions of the whole array.
    """
    bits = average.bit_length() - 1
    gear = GEAR[np.frombuffer(data, dtype=np.uint8)]
    rolling = gear.copy()
    for back in range(1, min(bits, len(gear))):
        rolling[back:] += gear[:-back] << np.uint32(back)
    ends, start = [], 0
    for at in np.flatnonzero((rolling & np.uint32(average - 1)) == 0).tolist():
        at += 1
        while at - start > most:
            start += most
            ends.append(start)
        if at - start >= least:
            start = at
            ends.append(start)
    while len(data) - start > most:
        start += most
        ends.append(start)
    if start < len(data) or not ends:
        ends.append(len(data))
    return ends


def chunks_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(hi, lo, bytes) of every chunk in order: two halves of a 128-bit digest."""
    start = 0
    for end in cuts(data):
        chunk = data[start:end]
        digest = hashlib.blake2b(chunk, digest_size=16).digest()
        yield int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), chunk
        start = end


def _slot(lo: int) -> int:
    return lo & (FILTER_BITS - 1)


def repeated_map(docs: DataFrame) -> np.ndarray:
    """The bit map, as bytes, of digests that occur in more than one place."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: dict[tuple[int, int], int] = {}
            for text in frame["t"]:
                for hi, lo, _ in chunks_of(medium_of(payload_of(text)[0])):
                    seen[hi, lo] = seen.get((hi, lo), 0) + 1
            yield pd.DataFrame([(h, x, n) for (h, x), n in seen.items()], columns=["hi", "lo", "n"])

    counts = docs.mapInPandas(batches, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    slots = counts.where("n > 1").select(F.col("lo").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(slot & 31))) as b"))
    found = words.toPandas()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[found["w"].to_numpy(dtype=np.int64)] = found["b"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes media and chunk table to the shared folder: (media rows, chunk table).

    A media row holds the bytes of its own chunks only; of a shared one it holds the digest, and the
    bytes are in the chunk table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    repeated = rows.sparkSession.sparkContext.broadcast(repeated_map(rows.select("t")))
    schema = T.StructType([*rows.select("id").schema.fields, *T.StructType.fromDDL(STORED).fields])
    chunk = pa.list_(pa.struct({"hi": pa.int64(), "lo": pa.int64(), "n": pa.int32(), "data": pa.binary()}))
    kinds = {"n_bytes": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "whole": pa.bool_(), "chunks": chunk}

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, bits = zstandard.ZstdCompressor(level=3), repeated.value
        for table in tables:
            out, lent = [], {}
            for text in table.column("t").to_pylist():
                payload, n = payload_of(text)
                medium = medium_of(payload)
                parts, whole = [], True
                for hi, lo, data in chunks_of(medium):
                    slot = _slot(lo)
                    shared = bool(bits[slot >> 5] >> np.uint32(slot & 31) & 1)
                    whole &= not shared
                    if shared and (hi, lo) not in lent:
                        lent[hi, lo] = squeeze.compress(data)
                    parts.append((hi, lo, -len(data), None) if shared else (hi, lo, len(data), squeeze.compress(data)))
                out.append((n, len(medium), hashlib.sha256(medium).hexdigest(), whole, _chunks(parts)))
            # rows without a digest carry the shared chunks, each once a batch
            out += [(None, None, None, None, _chunks([(hi, lo, -1, data)])) for (hi, lo), data in lent.items()]
            ids = table.column("id")
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids, pa.nulls(len(lent), ids.type)]), *columns], names=["id", *kinds])

    made = written(rows.mapInArrow(batches, schema), "media-rows")
    shared = made.where("media_sha256 is null").select(F.explode("chunks").alias("c"))
    table = shared.groupBy("c.hi", "c.lo").agg(F.first("c.data").alias("data"))
    return made.where("media_sha256 is not null"), written(table, "media-chunks")


def _chunks(parts: list[tuple]) -> list[dict]:
    return [dict(zip(("hi", "lo", "n", "data"), p, strict=True)) for p in parts]


def _facts(medium: bytes) -> tuple:
    """What is read from a verified medium: its samples' digests and features."""
    payload = samples_of(medium)
    samples = np.frombuffer(payload, dtype=np.uint8)
    shares = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    step = int(np.abs(np.diff(samples.astype(np.int16))).sum()) // max(1, len(samples) - 1)
    feature = f"rows={len(samples) // ROW};mean={int(samples.sum(dtype=np.int64)) * 100 // len(samples)};step={step};hist=" + ",".join(map(str, shares))
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(medium),
        hashlib.sha256(medium).hexdigest(), feature,
    )


def _read_back(rows: DataFrame) -> DataFrame:
    """Facts of media given as (media_sha256, chunks in order with their bytes)."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_up = zstandard.ZstdDecompressor()
        for frame in frames:
            out = []
            for sha, parts in zip(frame["media_sha256"], frame["chunks"], strict=True):
                medium = b"".join(open_up.decompress(bytes(p)) for p in parts)
                if hashlib.sha256(medium).hexdigest() != sha:
                    raise ValueError(f"chunks of {sha} do not give it back")
                out.append((sha, *_facts(medium)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")])

    return rows.mapInPandas(batches, READ)


def read(media: DataFrame, table: DataFrame) -> DataFrame:
    """One row per distinct medium with what was read from its verified bytes."""
    alone = media.where("whole").select("media_sha256", F.transform("chunks", lambda c: c["data"]).alias("chunks"))
    mixed = media.where("not whole")
    # equal media: one of the equal chunk lists, chosen without moving the bytes of the others
    lists = mixed.select(
        "media_sha256", F.transform("chunks", lambda c: F.struct(c["hi"], c["lo"], c["n"])).alias("list")
    ).groupBy("media_sha256").agg(F.first("list").alias("list"))
    spots = lists.select("media_sha256", F.posexplode("list").alias("at", "c")).select("media_sha256", "at", "c.hi", "c.lo", "c.n")
    own = mixed.select("media_sha256", F.posexplode("chunks").alias("at", "c")).where("c.n > 0").groupBy("media_sha256", "at").agg(
        F.first("c.data").alias("data")
    )
    lent = spots.where("n < 0").select("media_sha256", "at", "hi", "lo")
    # a chunk that many media share has as many copies as spread them out
    wanted = lent.groupBy("hi", "lo").agg((F.floor(F.count("*") / COPY_EVERY) + 1).cast("int").alias("copies"))
    copies = table.join(wanted, ["hi", "lo"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    salted = lent.join(wanted.where("copies > 1"), ["hi", "lo"], "left").withColumn(
        "copy", F.coalesce(F.pmod(F.xxhash64("media_sha256"), F.col("copies")), F.lit(0)).cast("int")
    )
    lent = salted.join(copies, ["hi", "lo", "copy"]).select("media_sha256", "at", "data")
    ordered = F.array_sort(F.collect_list(F.struct("at", "data")))
    joined = own.select("media_sha256", "at", "data").unionByName(lent).groupBy("media_sha256").agg(ordered.alias("parts"))
    together = joined.select("media_sha256", F.transform("parts", lambda p: p["data"]).alias("chunks"))
    facts = _read_back(alone.unionByName(together))
    return facts.groupBy("media_sha256").agg(*(F.first(c).alias(c) for c in facts.columns[1:]))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its medium's sizes, digests and feature, read back from the stored chunks."""
    media, table = store(docs, id_col, text_col)
    facts = written(read(media, table), "media-facts")
    return media.select("id", "n_bytes", "media_sha256").join(facts, "media_sha256").select(
        F.col("id").alias(id_col),
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.col("stored_bytes").alias("media_bytes"),
        F.col("stored_sha256").alias("media_sha256"),
        "feature",
    )
