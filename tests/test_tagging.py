import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightbox.operators import tagging as J

DIM = 64


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def library(spark, n_labelled=15, n_neg=80, n_hidden=5):
    rng = np.random.default_rng(11)
    pos = np.zeros((n_labelled + n_hidden, DIM))
    pos[:, 0], pos[:, 1] = 1.0, 0.5
    neg = np.zeros((n_neg, DIM))
    neg[:, 0], neg[:, 1] = -1.0, -0.5
    m = np.vstack([pos, neg]) + 0.1 * rng.normal(size=(n_labelled + n_hidden + n_neg, DIM))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")
    tags = spark.createDataFrame(
        [(i, "cat", False, None) for i in range(n_labelled)] + [(50, "rare", False, None), (60, "rare", True, 0.5), (61, "cat", True, 0.5)],
        "media_id long, tag string, is_auto boolean, confidence double",
    )
    models = spark.createDataFrame([], "tag string, weights array<double>, bias double, platt_a double, platt_b double, trained_at_count long, version long")
    return vectors, tags, models


def test_dual_solution_is_optimal():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(80, 20)))
    y = np.where(rng.random(80) < 0.3, 1.0, -1.0)
    cost = np.where(y > 0, (y < 0).sum() / (y > 0).sum(), 1.0)

    def objective(w, b):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w - b))).sum()

    w, b = J.solve_dual(x, y, cost, 1e-4)
    best = objective(w, b)
    for _ in range(300):
        assert objective(w + 0.02 * rng.normal(size=20), b + 0.02 * rng.normal()) >= best - 1e-3
    loose = objective(*J.solve_dual(x, y, cost))
    assert loose <= best * 1.01 + 1e-6


def test_solver_needs_no_kernel_matrix_and_shrinks():
    rng = np.random.default_rng(8)
    n = 6000
    y = np.where(np.arange(n) < n // 3, 1.0, -1.0)
    x = unit(rng.normal(size=(n, 32)) + 0.8 * y[:, None] * np.eye(32)[0])
    cost = np.where(y > 0, 2.0, 1.0)
    tracemalloc.start()
    w, b, dual = J.solve_dual(x, y, cost, with_dual=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w - b))).sum()
    assert -1e-6 <= (primal - dual) / primal < 0.02
    # A tight cache and no shrinking reach the same optimum.
    x, y, cost = x[::10], y[::10], cost[::10]
    values = [J.solve_dual(x, y, cost, 1e-4, c, e, True)[2] for c, e in ((0, 50), (1 << 25, 50), (1 << 25, 10**9))]
    assert values == pytest.approx([values[0]] * 3, rel=1e-5)


def test_gap_and_slopes_from_returned_models(spark):
    vectors, tags, _ = library(spark)
    training = J.training_set(tags, vectors)
    models = J.train_models(training, with_dual=True)
    row = J.duality_gaps(models, training).first()
    assert row["tag"] == "cat" and -1e-6 <= row["gap"] < 0.02 and row["n_margin"] > 0
    worse = models.withColumn("weights", F.transform("weights", lambda v: v * 0.5))
    assert J.duality_gaps(worse, training).first()["gap"] > 0.05
    slopes = J.platt_slopes(models, training).first()
    assert slopes["n_fit"] == row["n_pos"] + min(row["n_pos"], row["n_neg"])
    assert abs(slopes["slope_a"]) < 1e-3 and abs(slopes["slope_b"]) < 1e-3
    moved = J.platt_slopes(models.withColumn("platt_b", F.col("platt_b") + 1), training).first()
    assert abs(moved["slope_b"]) > 0.1


def test_platt_is_the_minimum_and_orders_scores():
    rng = np.random.default_rng(4)
    score = np.concatenate([rng.normal(1, 1, 50), rng.normal(-1, 1, 50)])
    pos = np.arange(100) < 50
    a, b = J.fit_platt(score, pos)
    assert a < 0
    p = 1 / (1 + np.exp(a * score + b))
    assert p[pos].mean() > 0.7 > 0.3 > p[~pos].mean()
    t = np.where(pos, 51 / 52, 1 / 52)

    def loss(a, b):
        q = 1 / (1 + np.exp(a * score + b))
        return -(t * np.log(q) + (1 - t) * np.log(1 - q)).sum()

    for da, db in [(0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)]:
        assert loss(a + da, b + db) > loss(a, b)


def test_training_time_bound():
    rng = np.random.default_rng(0)
    pos = np.zeros((20, 1280))
    pos[:, 0] = 1
    m = np.vstack([pos, -np.vstack([pos] * 10)]) + 0.1 * rng.normal(size=(220, 1280))
    start = time.time()
    w, b, a, c = J.train_one(m[:20], m[20:])
    assert time.time() - start < 30
    raw = unit(m) @ w - b
    assert (raw[:20] > 0).all() and (raw[20:] < 0).all() and a < 0


def test_scores(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], [0.1, -0.2], 0.75), ([1.0], [0.1, -0.2], 0.75)],
        "v array<double>, w array<double>, b double",
    )
    got = df.select(J.predict_score(F.col("v"), F.col("w"), F.col("b")).alias("s"))
    scores = [r["s"] for r in got.collect()]
    assert scores == [pytest.approx(0.06 - 0.16 - 0.75), -999.0]
    p = got.select(J.platt_probability(F.col("s"), F.lit(-2.0), F.lit(0.0)).alias("p")).collect()
    assert p[0]["p"] == pytest.approx(1 / (1 + np.exp(1.7))) and p[1]["p"] == 0.0
    far = spark.range(1).select(
        J.platt_probability(F.lit(5000.0), F.lit(-2.0), F.lit(0.0)), J.platt_probability(F.lit(-990.0), F.lit(-2.0), F.lit(0.0))
    ).first()
    assert far[0] == 1.0 and far[1] == pytest.approx(0.0)


def test_predict_paths_agree(spark):
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(50, 6)))], "id long, embedding array<float>")
    m = spark.createDataFrame([(f"t{i}", [float(x) for x in r], 0.1, -2.0, 0.0) for i, r in enumerate(rng.normal(size=(7, 6)))],
                              "tag string, weights array<double>, bias double, platt_a double, platt_b double")
    want = {(r["media_id"], r["tag"]): r["raw"] for r in J.batch_predict(v, m).collect()}
    blocked = J.batch_predict(v, m, broadcast_bytes=250)
    got = {(r["media_id"], r["tag"]): r["raw"] for r in blocked.collect()}
    assert len(want) == 350 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    odd = v.unionByName(spark.createDataFrame([(99, [1.0] * 9)], v.schema)).coalesce(1)
    mixed = {(r["media_id"], r["tag"]): r for r in J.batch_predict(odd, m).collect()}
    assert all(mixed[k]["raw"] == pytest.approx(want[k]) for k in want)
    assert mixed[99, "t0"]["raw"] == -999.0 and mixed[99, "t0"]["confidence"] == 0.0
    kept = J.batch_predict(v, m, min_raw=0.0).collect()
    assert {(r["media_id"], r["tag"]) for r in kept} == {k for k, s in want.items() if s > 0}


def test_auto_tagging_end_to_end(spark):
    vectors, tags, models = library(spark)
    first = J.run_auto_tagging(tags, models, vectors)
    auto = {r["media_id"]: r["confidence"] for r in first.media_tags.where("is_auto and tag = 'cat'").collect()}
    assert set(auto) == {15, 16, 17, 18, 19}
    assert all(0 < c < 1 for c in auto.values())
    assert first.media_tags.where("tag = 'rare' and is_auto").count() == 0
    assert first.media_tags.where("not is_auto").count() == 16
    assert (first.before, first.after, first.models_processed) == (2, 5, 1)
    saved = first.models.where("tag = 'cat'").first()
    assert (saved["trained_at_count"], saved["version"]) == (15, 1)
    # labels unchanged: the stored model serves again
    again = J.run_auto_tagging(first.media_tags, first.models, vectors)
    assert again.models.where("tag = 'cat'").first()["version"] == 1 and again.after == 5
    assert J.stale_models(tags, first.models).where("tag = 'cat'").count() == 0


def test_scope_and_failures(spark):
    vectors, tags, models = library(spark)
    members = spark.createDataFrame([("f", 15), ("f", 70)], "folder_id string, media_id long")
    run = J.run_auto_tagging(tags, models, vectors, members, "f")
    auto = {r["media_id"] for r in run.media_tags.where("is_auto and tag = 'cat'").collect()}
    assert auto == {15, 61} and (run.before, run.after) == (0, 1)
    empty = J.run_auto_tagging(tags, models, vectors, members, "none")
    assert (empty.before, empty.after, empty.models_processed) == (0, 0, 0)
    with pytest.raises(LookupError):
        J.learn_tag("unknown", tags, models, vectors)
    with pytest.raises(ValueError):
        J.learn_tag("rare", tags, models, vectors)


def test_fit_rows_of_a_tag_are_bounded(spark):
    vectors, tags, _ = library(spark)
    training = J.training_set(tags, vectors)
    few = J.fit_sample(training, max_rows=5).groupBy("tag", F.col("part") == "pos").count().collect()
    assert few and all(r["count"] <= 5 for r in few)
    assert J.fit_sample(training).count() == training.count()
    again = [J.train_models(training.repartition(n), max_rows=5).first() for n in (1, 4)]
    assert again[0] == again[1]


def test_models_score_in_slices_and_by_length(spark):
    rng = np.random.default_rng(11)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "id long, embedding array<double>")
    fields = "tag string, weights array<double>, bias double, platt_a double, platt_b double"
    m = spark.createDataFrame([(f"t{i}", rng.normal(size=4).tolist(), 0.1, -1.0, 0.0) for i in range(9)] + [("odd", [1.0] * 5, 0.0, -1.0, 0.0)], fields)
    rows = [sorted(map(tuple, J.batch_predict(v, m, broadcast_bytes=n).collect())) for n in (1 << 20, 200)]
    assert len(rows[0]) == len(rows[1]) == 300
    assert all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:]) for a, b in zip(*rows))
    assert {(r[2], round(r[3], 6)) for r in rows[0] if r[1] == "odd"} == {(-999.0, 0.0)}


def test_large_tags_are_fitted_on_all_of_their_rows(spark):
    """Over many tasks: the optimum of all rows is proved by gap and slopes, and is that of the solver of one task."""
    rng = np.random.default_rng(13)
    m = rng.normal(size=(700, 12))
    m[:400, 0] += 1.0
    parts = ["pos"] * 400 + ["hard"] * 20 + ["rand"] * 80 + ["pos"] * 60 + ["rand"] * 140
    training = spark.createDataFrame(
        [("many" if i < 500 else "few", p, i % 100, i, unit(m[i : i + 1])[0].tolist()) for i, p in enumerate(parts)],
        "tag string, part string, ord long, id long, embedding array<double>",
    )
    wide, narrow = (J.train_models(training, n, with_dual=True).persist() for n in (50, 4000))
    gaps = {r["tag"]: r for r in J.duality_gaps(wide, training).collect()}
    assert {t: (r["n_pos"], r["n_neg"]) for t, r in gaps.items()} == {"many": (400, 100), "few": (60, 140)}
    assert all(-1e-6 <= r["gap"] < 2e-3 for r in gaps.values())
    slopes = {r["tag"]: r for r in J.platt_slopes(wide, training).collect()}
    assert {t: r["n_fit"] for t, r in slopes.items()} == {"many": 500, "few": 120}
    assert all(abs(r["slope_a"]) < 1e-3 and abs(r["slope_b"]) < 1e-3 for r in slopes.values())
    one = {r["tag"]: r for r in narrow.collect()}
    for r in wide.collect():
        assert r["dual"] == pytest.approx(one[r["tag"]]["dual"], rel=0.02)
        assert np.allclose(r["weights"], one[r["tag"]]["weights"], atol=0.1)


def test_calibration_of_many_rows_goes_on_until_its_slopes_vanish():
    """The sum over many rows rounds away the last decreases of the loss; steps must not end there."""
    rng = np.random.default_rng(1)
    n, m = 150_000, 50_000
    x = np.concatenate([rng.normal(0.9, 1.0, n), rng.normal(0.0, 1.0, m)])[:, None]
    y = np.where(np.arange(n + m) < n, 1.0, -1.0)
    walk = J._Descent(np.array([0.0, np.log((m + 1.0) / (n + 1.0))]))
    for _ in range(100):
        value, g1, g2, h11, h12, h22 = J._platt_sums(
            x, y, y != 0, np.ones(1), 0.0, *walk.trial(), (n + 1) / (n + 2), 1 / (m + 2)
        )
        taken = walk.take(value, np.array([g1, g2]), np.array([[h11, h12], [h12, h22]]), smooth=True)
        if taken and walk.steep < 1e-5 or walk.stuck:
            break
    slopes = J._platt_sums(x, y, y != 0, np.ones(1), 0.0, *walk.at, (n + 1) / (n + 2), 1 / (m + 2))[1:3]
    assert np.abs(slopes).max() < 1e-5
