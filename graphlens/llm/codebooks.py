"""Operator 11: vector code compression with codebooks kept by deltas.

Vectors of integers are cut into equal parts, and each part position has a codebook, found by Lloyd's
rounds. The table of a round holds every vector's previous and present codes. Only parts whose code
changed move their numbers: minus from the entry that they left, plus to the one that they joined,
added up inside each task first, so that what is shuffled is at most the size of the codebooks a task.
The running integer sums and counts are a table, too: a round adds its deltas to them. Codebooks have a
fixed size (entries * dimension) and go to the tasks with the job.

Defined results: vectors that are null, empty or hold null or non-finite components are left out, and
so are those of another length than the commonest (the longer of two), which must be a multiple of the
number of parts (ValueError). Codebooks start from the smallest ids that are not null, of a repeated
id the smallest vector; with fewer ids than entries they are shorter. Null and repeated ids are coded
like any other row; ties go to the lower entry. A table without any id that is not null gives an empty
result, like an empty one. Integers beyond +-2**22, where squares would no longer be exact, stop the
job (ValueError). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import written
from graphlens.llm.vectors import commonest_length, integers, matrix

UNIT = 256
#: Largest integer whose squared distances are exact in doubles, for parts of up to 256 numbers.
REACH = 1 << 22
#: Labels with a larger share of the rows than one of so many are joined by broadcast: there are fewer than this.
HOT = 1000
SUMS = "part int, entry int, place int, value long"


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared error) of integer vectors; books is (parts, entries, numbers of a part)."""
    parts, _, width = books.shape
    codes, error = np.empty((len(x), parts), dtype=np.uint8), np.zeros(len(x))
    cut, entries = x.reshape(len(x), parts, width).astype(np.float64), books.astype(np.float64)
    for p in range(parts):
        own = (cut[:, p] ** 2).sum(axis=1)
        away = (entries[p] ** 2).sum(axis=1) - 2 * cut[:, p] @ entries[p].T
        codes[:, p] = away.argmin(axis=1)
        error += own + away[np.arange(len(x)), codes[:, p]]
    return codes, error.astype(np.int64)


def _assigned(rows: DataFrame, books: np.ndarray, name: str) -> DataFrame:
    """The rows with their present codes (now) beside the previous ones (was, null at first)."""
    width = books.shape[0] * books.shape[2]
    names = ["id", "label", "x", "was", "now"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _ = nearest(matrix(batch.column("x"), width), books)
            now = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), now], names=names)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = f"id {kind['id']}, label {kind['label']}, x array<long>, was binary, now binary"
    return written(rows.select(*names[:4]).mapInArrow(task, shape), name)


def changes(moved: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """SUMS of the parts whose codes changed: place -1 counts them, the others are their numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), parts * width).reshape(-1, parts, width)
            now = np.frombuffer(b"".join(batch.column("now").to_pylist()), dtype=np.uint8).reshape(-1, parts)
            olds = batch.column("was").to_pylist()
            known = np.array([w is not None for w in olds], dtype=bool)
            was = np.frombuffer(b"".join(w or bytes(parts) for w in olds), dtype=np.uint8).reshape(-1, parts)
            for p in range(parts):
                here = ~known | (was[:, p] != now[:, p])
                counted = np.hstack([np.ones((len(x), 1), dtype=np.int64), x[:, p]])
                np.add.at(sums[p], now[here, p], counted[here])
                left = here & known
                np.subtract.at(sums[p], was[left, p], counted[left])
        p, e, w = sums.nonzero()
        columns = [pa.array(a.astype(np.int32)) for a in (p, e, w - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sums[p, e, w])], names=["part", "entry", "place", "value"])

    partial = moved.select("x", "was", "now").mapInArrow(task, SUMS)
    return partial.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))


def updated(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Entries with parts become floor(sum / count); the others stay."""
    parts, entries, width = books.shape
    table = np.zeros((parts, entries, width + 1), dtype=np.int64)
    # as many rows as the codebooks have numbers
    for r in sums.collect():
        table[r["part"], r["entry"], r["place"] + 1] = r["value"]
    count = table[:, :, :1]
    return np.where(count > 0, table[:, :, 1:] // np.maximum(count, 1), books)


def _starts(rows: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the smallest ids."""
    ids = [r["id"] for r in rows.where("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    if not ids:
        return []
    firsts = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("x").alias("x")).orderBy("id")
    return [r["x"] for r in firsts.collect()]


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, unit: int = UNIT,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256): codes by rounds of Lloyd, errors by vector and by label."""
    spark, none = vectors.sparkSession, F.lit(None)
    every = written(integers(vectors.select(id_col, vector_col, F.col(label_col).alias("label")), unit, 0, id_col, vector_col, "label"), "codes-rows")
    width = commonest_length(every)
    rows = every.where(F.size("x") == width)
    starts = _starts(rows, entries) if width else []
    kind = vectors.schema[id_col].dataType.simpleString()
    if not starts:
        return spark.createDataFrame([], f"{id_col} {kind}, code string, error long, label_error long, codebooks_sha256 string")
    if width % parts:
        raise ValueError(f"vectors of {width} numbers cannot be cut into {parts} equal parts")
    least, most = rows.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if max(-least, most) > REACH:
        raise ValueError(f"components beyond {REACH // unit} have no exact errors")
    books = np.array(starts, dtype=np.int64).reshape(len(starts), parts, width // parts).transpose(1, 0, 2)
    table, sums = rows.withColumn("now", none.cast("binary")), None
    for n in range(1, rounds + 1):
        table = _assigned(table.withColumn("was", F.col("now")), books, f"codes-{n}")
        deltas = changes(table.where("was is null or was <> now"), *books.shape)
        if sums is not None:
            deltas = sums.unionByName(deltas).groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
        sums = written(deltas, f"codes-sums-{n}")
        books = updated(books, sums)
    return _reported(_coded(table, books), books, id_col)


def _coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) by the final codebooks."""
    width = books.shape[0] * books.shape[2]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = nearest(matrix(batch.column("x"), width), books)
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), text, pa.array(error)], names=["id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in table.schema}
    shape = f"id {kind['id']}, label {kind['label']}, code string, error long"
    return written(table.select("id", "label", "x").mapInArrow(task, shape), "codes-final")


def _reported(coded: DataFrame, books: np.ndarray, id_col: str) -> DataFrame:
    """Errors summed by label beside each row.

    Labels with a large share of the rows are few, whatever the input: they are joined by broadcast,
    so no task gets all rows of one; the others meet by key.
    """
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    totals = written(by_label, "codes-labels")
    every = totals.agg(F.sum("n")).first()[0]
    hot = totals.where(F.col("n") > every / HOT).select(F.col("label").alias("hot"), F.col("label_error").alias("hot_error"))
    rows = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot")), "left")
    cold = totals.where(F.col("n") <= every / HOT).select("label", "label_error")
    if not cold.isEmpty():
        known = rows.where("hot_error is not null").withColumn("label_error", F.col("hot_error"))
        meet = rows.where("hot_error is null").join(cold.withColumnRenamed("label", "_l"), F.col("label").eqNullSafe(F.col("_l")))
        rows = known.unionByName(meet.drop("_l"))
    else:
        rows = rows.withColumn("label_error", F.col("hot_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


# The oracle packs a distance and an entry into one number, so that the least one has the lowest entry.
def _round_sql(n: int, books: str) -> str:
    return f"""a{n} AS (
  SELECT r, p, vec_id, label, v, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m
  FROM parts JOIN {books} USING (p) GROUP BY ALL)"""


def _update_sql(n: int, books: str) -> str:
    return f"""s{n} AS (
  SELECT p, CAST(m % 64 AS INT) AS e, i, CAST(floor(sum(v[i + 1]) / count(*)) AS BIGINT) AS x
  FROM a{n}, range(len(v)) AS t(i) GROUP BY ALL),
m{n} AS (SELECT p, e, list(x ORDER BY i) AS c FROM s{n} GROUP BY ALL),
b{n} AS (SELECT p, e, coalesce(m{n}.c, o.c) AS c FROM {books} AS o LEFT JOIN m{n} USING (p, e))"""


ORACLE_SQL = f"""WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS (SELECT r, p, vec_id, label, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS v FROM kept, range(16) AS t(p)),
b0 AS (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INT) AS e, v AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_round_sql(1, "b0")}, {_update_sql(1, "b0")}, {_round_sql(2, "b1")}, {_update_sql(2, "b1")}, {_round_sql(3, "b2")},
codes AS (
  SELECT r, vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a3 GROUP BY ALL),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, digest"""
