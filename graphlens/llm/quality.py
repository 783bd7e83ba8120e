"""Operator 4: quality scores from random Fourier features, ridge regression and isotonic calibration.

Every text becomes a vector of document statistics (lengths, character classes, repetition). A
fixed set of random cosines approximates a Gaussian kernel over the standardised statistics. Each
partition sums its part of the normal equations; the sums meet row by row in a grouped job, and
only the finished square matrix reaches the driver. An isotonic curve, fitted on labelled rows
that the ridge did not see, turns raw scores into probabilities.

Labels are the only thing learnt from; ids, sources and languages never enter a vector.

Defined results: null text counts as empty, and every text gets a score; repeated label rows for
one id count as their mean, null labels and null ids are left out of the fit; without labelled
rows of both classes every score is 0.5; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm.common import written

RANDOM_FEATURES = 256
SEED = 20240607
RIDGE = 1e-3
#: Kernel width as a share of the square root of the number of statistics.
WIDTH = 0.8
CURVE_BINS = 1024
#: One labelled row in this many is kept from the ridge to fit the curve.
CALIBRATION_SHARE = 4
CLIP = 6.0
#: Ids of labelled rows that are broadcast at most (8 bytes each); beyond it, a shuffle join.
BROADCAST_IDS = 2_000_000

def _classes() -> np.ndarray:
    kinds = np.zeros((256, 8))
    for b in range(256):
        c = chr(b)
        kind = (
            0 if "a" <= c <= "z" or b >= 128
            else 1 if "A" <= c <= "Z"
            else 2 if "0" <= c <= "9"
            else 3 if c in " \t"
            else 4 if c in "\r\n"
            else 5 if c in ".,;:'\"()-"
            else 6 if c in "!?"
            else 7
        )
        kinds[b, kind] = 1
    return kinds


CLASSES = _classes()
STATISTICS = 8 + 15


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text, all finite."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256).astype(float)
    size = max(1.0, counts.sum())
    shares = counts @ CLASSES / size
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    seen = Counter(words)
    distinct = len(seen)
    pairs = len(set(zip(words, words[1:], strict=False)))
    threes = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    p = counts[counts > 0] / size
    top = max(seen.values(), default=0) / n
    odd = sum(not w[-1].isalnum() for w in words)
    upper = sum(w.isupper() for w in words)
    return np.array(
        [
            *shares,
            np.log1p(size),
            np.log1p(len(words)),
            lengths.mean(),
            lengths.std(),
            np.log1p(lengths.max()),
            distinct / n,
            np.log1p(distinct) / np.log1p(n),
            1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
            1 - threes / max(1, len(words) - 2) if len(words) > 2 else 0.0,
            1 - len(set(full)) / max(1, len(full)),
            np.log1p(size / max(1, len(full))),
            -(p * np.log2(p)).sum(),
            odd / n,
            upper / n,
            top,
        ]
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t).astype(np.float32) for t in texts])


@dataclass
class Model:
    """A fitted scorer; None weights score 0.5."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    curve_x: np.ndarray | None = None
    curve_y: np.ndarray | None = None
    n_features: int = RANDOM_FEATURES
    seed: int = SEED

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """Standardised statistics and their random Fourier features, with a constant."""
        z = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        rnd = np.random.default_rng(self.seed)
        d = z.shape[1]
        spin = rnd.normal(size=(d, self.n_features)) / (WIDTH * np.sqrt(d))
        phase = rnd.uniform(0, 2 * np.pi, self.n_features)
        cosines = np.sqrt(2 / self.n_features) * np.cos(z @ spin + phase)
        return np.hstack([np.ones((len(z), 1)), z, cosines])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        sure = np.interp(raw, self.curve_x, self.curve_y)
        # a trace of the raw score keeps the order inside the curve's flat parts
        return np.clip(0.999 * sure + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["stats"].to_numpy()).astype(float) if len(frame) else np.zeros((0, STATISTICS))


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums Z'Z and Z'y: partitions add up their rows, then each matrix row is summed on its own."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                z = model.lift(_matrix(frame))
                part = z.T @ np.hstack([z, frame["y"].to_numpy()[:, None]])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "v": [np.sum(np.stack(frame["v"].to_numpy()), axis=0)]})

    schema = "i long, v array<double>"
    sums = rows.mapInPandas(partial, schema).groupBy("i").applyInPandas(add, schema).orderBy("i").toPandas()
    both = np.stack(sums["v"].to_numpy())
    return both[:, :-1], both[:, -1]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points sorted by x: the blocks' mean x and mean y."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _held(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", n_features: int = RANDOM_FEATURES) -> Model:
    """Fits on (id, stats) rows whose id has a label and is not held out."""
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("double").alias("q"))
        .where("id is not null and q is not null")
        .groupBy("id")
        .agg((F.avg("q") >= 0.5).cast("double").alias("y"))
        .where(~_held(F.col("id")))
    )
    rows = written(
        stats.join(known, "id").withColumn("curve", F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(CALIBRATION_SHARE)) == 0),
        "quality-labelled",
    )
    fold = rows.where("not curve")
    moments = fold.select("y", F.posexplode("stats").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("p")
    ).orderBy("i").collect()
    model = Model(n_features=n_features)
    if not moments or not 0 < moments[0]["p"] < 1:
        return model
    model.mean = np.array([r["m"] for r in moments])
    model.scale = np.array([max(r["s"], 1e-6) for r in moments])
    gram, moment = _normal_equations(fold, model)
    ridge = RIDGE * gram[0, 0] * np.eye(len(gram))
    ridge[0, 0] = 0
    model.weights = np.linalg.solve(gram + ridge, moment)

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"raw": model.raw(_matrix(frame)), "y": frame["y"].to_numpy()})

    curve = rows.where("curve").mapInPandas(raw, "raw double, y double")
    step = F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) + 0.5) * (CURVE_BINS / 2))
    bins = curve.groupBy(step.alias("b")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    points = bins.orderBy("b").toPandas()
    if points.empty:
        model.curve_x, model.curve_y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        model.curve_x, model.curve_y = isotonic(*(points[c].to_numpy(dtype=float) for c in ("x", "y", "n")))
    return model


def scorer(model: Model):
    """A pandas UDF from statistics to a score."""

    @F.pandas_udf(T.DoubleType())
    def score(stats: pd.Series) -> pd.Series:
        if not len(stats):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.stack(stats.to_numpy()).astype(float)))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, held_out, score, predicted)."""
    stats = written(
        docs.select(F.col(id_col).alias("id"), statistics_of(F.col(text_col).cast("string")).alias("stats")),
        "quality-statistics",
    )
    model = fit(stats, labels)
    return stats.select("id", scorer(model)("stats").alias("score")).select(
        F.col("id").alias(id_col),
        _held(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least threshold, with their own columns only.

    Statistics are made of labelled documents for the fit, and then of each document once for its score.
    """
    known = labels.where("doc_id is not null").select("doc_id").distinct()
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    texts = docs.join(known, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), statistics_of(F.col("text").cast("string")).alias("stats"))
    score = scorer(fit(written(texts, "quality-statistics"), labels))
    return docs.where(score(statistics_of(F.col("text").cast("string"))) >= threshold)
