"""Vectors as integers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers beyond this are held at it, so that sums of a few stay longs.
LARGEST = 1 << 62


def integers(vectors: DataFrame, unit: int, add: int, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(id, x, *more): floor(unit * component) + add of every vector without null or non-finite components."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(c.cast("double") * unit)))
    return vectors.where(v.isNotNull() & whole).select(
        F.col(id_col).alias("id"), F.transform(v, lambda c: held(c) + F.lit(add)).alias("x"), *(F.col(m) for m in more)
    )


def commonest_length(rows: DataFrame) -> int:
    """The length that most vectors x have, the longer of two; 0 where there are none but empty ones."""
    sizes = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrow lists of one width as an integer matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
