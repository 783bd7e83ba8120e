"""Operator 12: embedding whitening from an exact integer scatter.

Components become integers. Every task subtracts a shift, which no covariance sees, and sums its
vectors and their cross-products without rounding: products of halves or quarters of the numbers in
floats while they are exact there, put together as Python integers. Sums travel as 32-bit limbs, which
Spark adds as longs. From the totals, n * X'X - S S' is formed exactly on the driver (its size is the
square of the dimension, whatever the number of rows); only then it becomes floats, and eigh
decomposes it. A second pass projects the rows, a third one measures the covariance of what came out.

Defined results: vectors that are null, empty or hold null or non-finite components are left out, and
so are those of another length than the commonest (the longer of two). Ids may be null or repeated:
every row counts. An empty table gives an empty result. A component without variance (eigenvalue below
dimension * 2**-52 of the largest) has whitened null, explained 0 and no part in identity_error, which is
null where no component has any. deviation is null where it does not fit a long; deviation_exact
(38 digits) holds it. Integers are held at +-2**62. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import written
from graphlens.llm.vectors import commonest_length, integers, matrix

#: Rows of one exact product, bits of one limb of a factor: rows * 2**(2 * bits) stays below 2**53.
ROWS, BITS = 8192, 20
#: Bits of one limb of a sum on its way through Spark, and how many there are.
LIMB, LIMBS = 32, 5
UNIT, SHIFT = 1024, 100_000
RESULT = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
)


def cross_products(x: np.ndarray) -> np.ndarray:
    """X'X of an integer matrix as Python integers, exactly."""
    if x.size == 0 or float(np.abs(x).max()) ** 2 * len(x) < 2.0**53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    out = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for start in range(0, len(x), ROWS):
        rest, limbs = x[start : start + ROWS], []
        while True:
            high = rest >> BITS
            if not (high + 1 >> 1).any():  # what is left is -1 or 0: one signed limb holds it
                limbs.append(rest.astype(np.float64))
                break
            limbs.append((rest - (high << BITS)).astype(np.float64))
            rest = high
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out += (a.T @ b).astype(np.int64).astype(object) << BITS * (i + j)
    return out


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Python integers as limbs, lowest first; the last one has the sign."""
    mask = (1 << LIMB) - 1
    low = [((values >> LIMB * k) & mask).astype(np.int64) for k in range(LIMBS - 1)]
    return [*low, (values >> LIMB * (LIMBS - 1)).astype(np.int64)]


def _from_limbs(row) -> int:
    return sum(int(row[f"l{k}"]) << LIMB * k for k in range(LIMBS))


@dataclass(frozen=True)
class Scatter:
    """n vectors, their sums and n * X'X - S S', all exact (Python integers)."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        """Divisor n; each entry is the float next to the exact quotient."""
        return (self.scatter / self.n**2).astype(np.float64)


def scatter(rows: DataFrame, width: int, shift: int = 0) -> Scatter:
    """Exact scatter of the vectors x, all of one width."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, sums = 0, np.zeros((width, width), dtype=object), np.zeros(width, dtype=object)
        for batch in batches:
            x = matrix(batch.column(0), width) - shift
            n += len(x)
            # halves of a long, so that no sum of a batch overflows
            sums += ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            total += cross_products(x)
        if n:
            i, j = np.triu_indices(width)
            values = np.concatenate([np.array([n], dtype=object), sums, total[i, j]])
            ids = np.concatenate([[-1], np.full(width, -1), i]), np.concatenate([[-1], np.arange(width), j])
            columns = [*(pa.array(v.astype(np.int32)) for v in ids), *(pa.array(v) for v in _limbs(values))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *(f"l{k}" for k in range(LIMBS))])

    schema = "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
    parts = rows.select("x").mapInArrow(partial, schema)
    totals = parts.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)))
    values = {(r["i"], r["j"]): _from_limbs(r) for r in totals.collect()}
    n, sums = values[-1, -1], [values[-1, j] for j in range(width)]
    out = np.zeros((width, width), dtype=object)
    for i in range(width):
        for j in range(i, width):
            out[i, j] = out[j, i] = n * values[i, j] - sums[i] * sums[j]
    return Scatter(n, [s + n * shift for s in sums], out)


def decompose(found: Scatter, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors in columns, trace) of the covariance, the largest first."""
    values, vectors = np.linalg.eigh(found.covariance)
    trace = sum(int(found.scatter[i, i]) for i in range(len(values))) / found.n**2
    return values[::-1][:most].copy(), vectors[:, ::-1][:, :most].copy(), trace


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, pa.Array]:
    """(n * x - S as floats, sum of its squares): exact before it is rounded once."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if reach < 1 << 62 and reach**2 * x.shape[1] < 1 << 63:
        off = x * np.int64(n) - np.array(sums, dtype=np.int64)
        return off.astype(np.float64), pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
    off = x.astype(object) * n - np.array(sums, dtype=object)
    squares = [int(s) for s in (off * off).sum(axis=1)]
    return off.astype(np.float64), pa.array([str(s) if s < 10**38 else None for s in squares]).cast(pa.decimal128(38, 0))


def whiten(
    vectors: DataFrame, most: int = 8, unit: int = UNIT, add: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """A row for each kept vector and each of the first components: see RESULT."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    every = written(integers(vectors, unit, add, id_col, vector_col), "whiten-rows")
    width = commonest_length(every)
    if not width:
        return spark.createDataFrame([], f"{id_col} {kind}, {RESULT}")
    rows = every.where(F.size("x") == width)
    found = scatter(rows, width, add)
    values, axes, trace = decompose(found, most)
    alive = values > values[0] * width * 2.0**-52 if values[0] > 0 else np.zeros(len(values), dtype=bool)
    scale = np.where(alive, 1 / (found.n * np.sqrt(np.where(alive, values, 1))), np.nan)
    n, sums = found.n, found.sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, squares = deviations(matrix(batch.column("x"), width), n, sums)
            white = (off @ axes) * scale
            names = ["id", "squares", *(f"w{k}" for k in range(len(values)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), squares, *(pa.array(w) for w in white.T)], names=names)

    doubles = [f"w{k}" for k in range(len(values))]
    schema = f"id {kind}, squares decimal(38,0), " + ", ".join(f"{w} double" for w in doubles)
    white = written(rows.mapInArrow(project, schema), "whiten-projected")
    error = _identity_error(white, [k for k in range(len(values)) if alive[k]])
    share = [float(v / trace) if ok else 0.0 for v, ok in zip(values, alive, strict=True)]
    parts = F.array(*(
        F.struct(F.lit(k + 1).alias("component"), F.nanvl(F.col(f"w{k}"), F.lit(None)).alias("whitened"), F.lit(share[k]).alias("explained"))
        for k in range(len(values))
    ))
    fits = F.col("squares") <= F.lit(2**63 - 1)
    return white.select("id", "squares", F.inline(parts)).select(
        F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), F.when(fits, F.col("squares")).cast("long").alias("deviation"),
        "whitened", "explained", F.lit(error).cast("double").alias("identity_error"), F.col("squares").alias("deviation_exact"),
    )


def _identity_error(white: DataFrame, alive: list[int]) -> float | None:
    """Largest absolute entry of the whitened rows' covariance (centred, divisor n) minus the identity."""
    pairs = [(i, j) for i in alive for j in alive if i <= j]
    if not pairs:
        return None
    row = white.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
