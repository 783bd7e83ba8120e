import zlib

import numpy as np

from graphlens.llm import quality
from graphlens.llm.common import table

SF = "/root/testdata/sf0.01"


def test_isotonic_is_the_best_monotone_fit():
    x, y, w = np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6)
    bx, by = quality.isotonic(x, y, w)
    assert (np.diff(by) > 0).all()
    assert np.allclose(by, [0, 0.5, 2 / 3]) and np.allclose(bx, [0, 1.5, 4])


def test_held_out_accuracy_and_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = quality.score_documents(docs, labels).toPandas()
    assert len(out) == docs.count()
    assert out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    truth = labels.toPandas().merge(out[out.held_out], on="doc_id")
    assert (truth.predicted == truth.quality).mean() > 0.95
    good, bad = truth[truth.quality == 1].score.to_numpy(), truth[truth.quality == 0].score.to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) > 0.97


def test_held_out_labels_change_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn(
        "quality",
        F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")),
    )
    a = quality.score_documents(docs, labels).toPandas().set_index("doc_id").score
    b = quality.score_documents(docs, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(a, b.loc[a.index], atol=1e-9)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (3, "x" * 400_000, None), (3, "x", None), (None, "y y", "z")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    out = quality.score_documents(docs, labels).collect()
    assert len(out) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in out)
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_ridge_and_scores_equal_numpy(spark):
    rnd = np.random.default_rng(8)
    stats = rnd.normal(size=(300, quality.STATISTICS)).astype(np.float32)
    y = (stats[:, 0] + 0.3 * stats[:, 1] ** 2 > 0).astype(float)
    rows = spark.createDataFrame([(s.tolist(), float(v)) for s, v in zip(stats, y, strict=True)], "stats array<float>, y double").repartition(5)
    model = quality.Model(mean=stats.mean(axis=0).astype(float), scale=stats.std(axis=0).astype(float))
    gram, moment = quality._normal_equations(rows, model)
    d = stats.shape[1]
    rng = np.random.default_rng(quality.SEED)
    z = np.clip((stats.astype(float) - model.mean) / model.scale, -quality.CLIP, quality.CLIP)
    spin, phase = rng.normal(size=(d, quality.RANDOM_FEATURES)) / (quality.WIDTH * np.sqrt(d)), rng.uniform(0, 2 * np.pi, quality.RANDOM_FEATURES)
    wide = np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / quality.RANDOM_FEATURES) * np.cos(z @ spin + phase)])
    assert np.allclose(gram, wide.T @ wide) and np.allclose(moment, wide.T @ y)
    # the random features stand for a Gaussian kernel
    a, b = z[:40], z[40:80]
    kernel = np.exp(-((a - b) ** 2).sum(axis=1) / (2 * quality.WIDTH**2 * d))
    assert np.abs((wide[:40, 1 + d :] * wide[40:80, 1 + d :]).sum(axis=1) - kernel).mean() < 0.08


def test_fit_equals_least_squares(spark):
    rnd = np.random.default_rng(9)
    stats = rnd.normal(size=(600, quality.STATISTICS)).astype(np.float32)
    y = (stats[:, 0] > 0).astype(int)
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(stats)], "id long, stats array<float>").repartition(4)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    from pyspark.sql import functions as F

    ids = frame.select("id").withColumn("curve", F.pmod(F.xxhash64("id", F.lit(quality.SEED)), F.lit(quality.CALIBRATION_SHARE)) == 0).collect()
    own = sorted(r.id for r in ids if not r.curve and zlib.crc32(str(r.id).encode()) % 3 != 1)
    wide, want = model.lift(stats[own].astype(float)), y[own].astype(float)
    ridge = quality.RIDGE * len(own) * np.eye(wide.shape[1])
    ridge[0, 0] = 0
    assert np.allclose(model.weights, np.linalg.solve(wide.T @ wide + ridge, wide.T @ want), atol=1e-6)
