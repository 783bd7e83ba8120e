"""Operator 7: two-pass external shuffle of records into equal shards, DataFrame functions only.

Pass one scatters records uniformly into buckets of about `bucket_bytes` by a seeded hash of the
id and the row's place in the scan, so equal ids or texts spread like any others. Pass two takes
each bucket, which fits in memory by construction, puts it in a defined order, Fisher-Yates
shuffles it (`shuffle` with a seed) and writes it. Bucket sizes, read back from what was written,
give every record its place in the global permutation; place modulo the number of shards is its
shard, so shard counts differ by one at most (law `rows`).

The scatter runs once and its outcome is committed with the written buckets; a task that is lost
and repeated never moves a record that another task has already placed. The same seed gives the same
order for the same files read in the same splits.

Defined results: null texts count as no bytes; repeated rows are placed once each; null ids are
kept; an empty table gives an empty result; other columns travel along unless their names clash
with the added ones (size, text_crc32, bucket, place, shard, slot), which then replace them or go.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import utf8_bytes, written

#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 8 << 20
#: Bytes that a record counts besides its text.
OVERHEAD = 8
#: Buckets whose sizes are summed together.
RANGE = 4096
ADDED = ("size", "text_crc32", "bucket", "place", "shard", "slot")


def bucket_count(docs: DataFrame, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets that keep the average bucket at bucket_bytes."""
    total = docs.agg(F.sum(utf8_bytes(F.col(text_col)) + OVERHEAD)).first()[0] or 0
    return max(1, math.ceil(total / bucket_bytes))


def shuffled_buckets(
    docs: DataFrame,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """The written buckets: every record with size, text_crc32, bucket and its place in the bucket."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    records = docs.drop(*(c for c in ADDED if c not in (id_col, text_col)))
    n = bucket_count(docs, text_col, bucket_bytes)
    rank = F.xxhash64(F.lit(seed), F.col(id_col), F.monotonically_increasing_id())
    scattered = records.select(
        F.pmod(rank, F.lit(n)).alias("bucket"),
        F.struct(
            F.xxhash64(rank, F.lit(1)).alias("rank"),
            F.struct(*(F.col(c) for c in records.columns)).alias("record"),
            (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ).alias("item"),
    )
    whole = scattered.groupBy("bucket").agg(F.collect_list("item").alias("items"))
    ordered = F.array_sort("items", lambda a, b: F.when(a.rank < b.rank, -1).when(a.rank > b.rank, 1).otherwise(0))
    mixed = whole.select("bucket", F.posexplode(F.shuffle(ordered, F.lit(seed))).alias("place", "item"))
    return written(
        mixed.select("item.record.*", "item.size", "item.text_crc32", "bucket", F.col("place").cast("long")),
        "sharding-buckets",
    )


def shards(
    docs: DataFrame,
    n_shards: int = 24,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Every record with its shard and its gapless slot there, after the two passes."""
    buckets = shuffled_buckets(docs, seed, id_col, text_col, bucket_bytes)
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    # sums of ranges of buckets first: the one window that sees all of them sees a row a range
    sizes = written(sizes.withColumn("range", F.floor(F.col("bucket") / RANGE)), "sharding-sizes")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("n")).select("range", before(Window.orderBy("range")).alias("base"))
    inside = sizes.withColumn("start", before(Window.partitionBy("range").orderBy("bucket")))
    starts = written(inside.join(F.broadcast(ranges), "range").select("bucket", (F.col("base") + F.col("start")).alias("start")), "sharding-starts")
    spot = F.col("start") + F.col("place")
    return (
        buckets.join(starts, "bucket")
        .withColumn("shard", F.pmod(spot, F.lit(n_shards)).cast("int"))
        .withColumn("slot", F.floor(spot / F.lit(n_shards)).cast("long"))
        .drop("bucket", "place", "start")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes each shard as one folder of Parquet, in slot order inside its files."""
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
