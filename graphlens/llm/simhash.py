"""Operator 10: SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into max_bits // 2 + 1 segments. When two fingerprints differ in at
most max_bits bits, one segment differs in at most one bit (pigeonhole). Each segment is indexed
once as it is and once for each of its bits with that bit masked out. Equal segments meet in the
exact entry; segments one bit apart meet in the entry that masks this bit, one with the bit clear
and one with it set, so no pair of equal segments is made again there. What meets is verified on
the whole fingerprint, and links become components.

Only distinct fingerprints are indexed, so a text copied a billion times is one index entry.
Index entries that more than `crowd` fingerprints share are not joined as they are: their members
get longer keys (the segment entry together with an equal or one-bit-apart half of the rest), which
finds the same links among them without making all pairs of the entry.

Defined results: a null or blank text has fingerprint zero and is linked like any other; repeated
rows come back once each; null ids are kept, and component_id is the smallest id that is not null
(null if there is none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import components, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SEED = 42
BLOCK = 1 << 15
#: Members above which an index entry is refined instead of joined as it is.
CROWD = 1000


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    if len(words) < width:
        shingles = [" ".join(words)]
    else:
        shingles = [" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for start in range(0, len(shingles), BLOCK):
        raw = b"".join([digest(s, SEED) for s in shingles[start : start + BLOCK]])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row, fp a signed 64-bit fingerprint."""

    # only texts enter Python: an id beside null ones would become a double there
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in texts), dtype=np.int64, count=len(texts)))

    return docs.select(F.col(id_col).alias("id"), prints(F.col(text_col).cast("string")).alias("fp"))


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each of the parts of a word, lowest first."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _variants(fp: Column, shift: int, width: int, slot: int) -> list[Column]:
    """Entries (slot, key, side) of one segment; side -1: exact, else the masked bit's value."""
    value = _part(fp, shift, width)
    entry = lambda s, k, side: F.struct(
        F.lit(s).cast("int").alias("slot"), k.alias("key"), side.cast("byte").alias("side")
    )
    masked = [
        entry(slot + 1 + p, value.bitwiseAND(F.lit(~(1 << p) & ((1 << width) - 1))), _part(fp, shift + p, 1))
        for p in range(width)
    ]
    return [entry(slot, value, F.lit(-1)), *masked]


def _met(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b) of fingerprints that meet in an index entry.

    Sizes are estimated before entries are made of fingerprints, so without the hint some MB of these would
    be broadcast as 66 times the rows.
    """
    left = entries.where("side <= 0").select(*keys, F.col("side").alias("ls"), F.col("fp").alias("a"))
    right = entries.where("side <> 0").select(*keys, F.col("side").alias("rs"), F.col("fp").alias("b"))
    both = left.hint("merge").join(right, keys).where("(ls = -1 and rs = -1 and a < b) or (ls = 0 and rs = 1)")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _near(max_bits: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits


def links(distinct: DataFrame, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) that differ in 1 to max_bits bits."""
    fp, parts = F.col("fp"), _cuts(64, max(2, max_bits // 2 + 1))
    entries = [e for i, (s, w) in enumerate(parts) for e in _variants(fp, s, w, i * 65)]
    # fingerprints are few bytes and their entries many: deal them out before they are made, and not
    # by fp alone: where they are grouped by it already, that would be left out and all end in one task
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.hash("fp"))
    index = dealt.select("fp", F.inline(F.array(*entries)))
    sizes = index.groupBy("slot", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    crowded = written(sizes.select("slot", "key"), "simhash-crowded")
    if crowded.isEmpty():
        return _met(index, ["slot", "key"]).where(_near(max_bits)).distinct()
    calm = _met(index.join(crowded, ["slot", "key"], "left_anti"), ["slot", "key"])
    members = written(index.join(crowded, ["slot", "key"], "left_semi").select("fp").distinct(), "simhash-members")
    return calm.unionByName(_refined(members, parts, max_bits)).where(_near(max_bits)).distinct()


def _refined(members: DataFrame, parts: list[tuple[int, int]], max_bits: int) -> DataFrame:
    """Candidate pairs among members by longer keys.

    A pair whose segment i is equal has at most max_bits differing bits elsewhere; one whose
    segment i differs in one bit has at most max_bits - 1. The rest of the word, cut again into
    two pieces per segment, then has a piece that differs in at most one bit: the second key.
    """
    fp, out = F.col("fp"), None
    for i, (s, w) in enumerate(parts):
        rest = [c for j, (s2, w2) in enumerate(parts) if j != i for c in [(s2, w2 // 2), (s2 + w2 // 2, w2 - w2 // 2)]]
        first = members.select("fp", F.inline(F.array(*_variants(fp, s, w, i * 65))))
        second = [e for j, (s2, w2) in enumerate(rest) for e in _variants(fp, s2, w2, j * 65)]
        both = first.select(
            "fp", "slot", "key", "side", F.inline(F.array(*second)).alias("slot2", "key2", "side2")
        )
        left = both.where("side <= 0").select("slot", "key", "slot2", "key2", F.col("side").alias("ls"), F.col("side2").alias("ls2"), F.col("fp").alias("a"))
        right = both.where("side <> 0").select("slot", "key", "slot2", "key2", F.col("side").alias("rs"), F.col("side2").alias("rs2"), F.col("fp").alias("b"))
        met = left.hint("merge").join(right, ["slot", "key", "slot2", "key2"]).where(
            "((ls = -1 and rs = -1 and a < b) or (ls = 0 and rs = 1))"
            " and ((ls2 = -1 and rs2 = -1) or (ls2 <> -1 and rs2 <> -1 and ls2 <> rs2))"
        )
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(_near(max_bits)).distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out


def near_duplicates(
    docs: DataFrame,
    width: int = 3,
    max_bits: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    crowd: int = CROWD,
) -> DataFrame:
    """One row per document: (id_col, fingerprint as 16 hex digits, component_id)."""
    prints = written(fingerprints(docs, width, id_col, text_col), "simhash-prints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    linked = written(links(least.select("fp"), max_bits, crowd), "simhash-links")
    roots = components(linked, "simhash")
    rooted = least.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(rooted.join(heads, "root").select("fp", "component_id"), "simhash-labels")
    return prints.join(labels, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
