"""Per-tag classifiers: training sets, training, scoring, write-back.

All tags are handled in one plan keyed by tag. Models are linear, so scoring a
batch of vectors against many models is one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightbox.functions import vectors as V
from lightbox.operators import catalog as C
from lightbox.operators import changes as L
from lightbox.operators import similarity as I
from lightbox.plans.cells import BLOCK_ROWS, slices
from lightbox.session import durable
from lightbox.sources.tables import last_trained_count, save_models

# How a training set is put together.
MIN_POSITIVES = 3
HARD_NEGATIVES = 20
HARD_MIN_DISTANCE = 0.05
RANDOM_LOW, RANDOM_HIGH, RANDOM_PER_POSITIVE = 30, 100, 3
SOLVER_TOLERANCE = 1e-2
RAW_THRESHOLD = 0.0

# Positives, and negatives, up to which one task fits a tag; a larger tag is fitted over many tasks.
MAX_FIT_ROWS = 4000
# A large tag is fitted until its relative duality gap is below this.
WIDE_GAP = 1e-3
# A set of models up to this size may travel to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Kernel columns that a solver keeps.
KERNEL_CACHE_BYTES = 32 * 1024 * 1024
# Scores held in memory at once by a task.
SCORES_AT_ONCE = 4_000_000

MODEL_FIELDS = "weights array<double>, bias double, platt_a double, platt_b double"


# --- scores ------------------------------------------------------------------


def predict_score(vector: Column, weights: Column, bias: Column) -> Column:
    """Unit vector times weights, minus bias; a fixed low score when lengths differ."""

    @F.arrow_udf("double")
    def product(v: pa.Array, w: pa.Array) -> pa.Array:
        return V.paired(v, w, lambda x, y: V.row_dots(V.unit_rows(x), y))

    return F.coalesce(product(vector, weights) - bias, F.lit(V.MISMATCH))


def platt_probability(score: Column, a: Column, b: Column) -> Column:
    """1 / (1 + exp(a s + b)) without overflow; zero for a mismatch."""
    f = a * score + b
    return (
        F.when(score <= V.MISMATCH, 0.0)
        .when(f >= 0, F.exp(-f) / (1 + F.exp(-f)))
        .otherwise(1 / (1 + F.exp(f)))
    )


def _score_batch(ids, col, tags, weights, bias, min_raw):
    matrix, ok = V.to_matrix(col, weights.shape[1])
    raw = np.full((len(matrix), len(tags)), V.MISMATCH)
    raw[ok] = V.unit_rows(matrix[ok]) @ weights.T - bias
    keep = np.ones(raw.shape, bool) if min_raw is None else raw > min_raw
    i, j = np.nonzero(keep)
    return {
        "media_id": ids.take(pa.array(i)), "tag": tags.take(pa.array(j)), "raw": pa.array(raw[i, j]),
    }


def batch_predict(
    vectors: DataFrame, models: DataFrame, min_raw: float | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(media_id, tag, raw, confidence) of every item under every model.

    Models go to the executors in slices of at most about ``broadcast_bytes`` and the
    vectors are scored where they lie, in one map-only pass per slice. With
    ``min_raw`` lower scores never leave the task.
    """
    spark = vectors.sparkSession
    out_schema = f"media_id {vectors.schema['id'].dataType.simpleString()}, tag string, raw double"
    packed = models.select("tag", "weights", "bias")
    size = models.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("weights") + 64), F.lit(0)).alias("bytes"),
        F.count_distinct(F.size("weights")).alias("dims"),
    ).first()
    if size["dims"] > 1:
        # A model scores vectors of another length as a mismatch; each length is one pass.
        dims = [r[0] for r in models.select(F.size("weights")).distinct().collect()]
        return reduce(DataFrame.unionByName, [
            batch_predict(vectors, models.where(F.size("weights") == d), min_raw, broadcast_bytes) for d in dims
        ])
    slices_of_models = max(1, -(-size["bytes"] // broadcast_bytes))

    def one_pass(i: int) -> DataFrame:
        mine = packed.where(F.pmod(F.xxhash64("tag"), F.lit(slices_of_models)) == i) if slices_of_models > 1 else packed
        table = mine.toArrow()
        weights, _ = V.to_matrix(table.column("weights"))
        shared = spark.sparkContext.broadcast(
            (table.column("tag").to_pylist(), weights, table.column("bias").to_numpy())
        )

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, w, bias = shared.value
            tags = pa.array(names, pa.string())
            for batch in slices(batches, max(SCORES_AT_ONCE // max(len(names), 1), 1)):
                yield pa.record_batch(
                    _score_batch(batch.column(0), batch.column(1), tags, w, bias, min_raw)
                )

        return vectors.select("id", "embedding").mapInArrow(score, out_schema)

    scored = reduce(DataFrame.unionByName, [one_pass(i) for i in range(slices_of_models)])
    calibration = models.select("tag", "platt_a", "platt_b")
    return scored.join(calibration, "tag").select(
        "media_id", "tag", "raw",
        platt_probability(F.col("raw"), F.col("platt_a"), F.col("platt_b")).alias("confidence"),
    )


# --- training sets -----------------------------------------------------------


def stale_models(media_tags: DataFrame, models: DataFrame) -> DataFrame:
    """(tag, n, trained_at_count) of tags whose label count moved since training."""
    counts = C.tag_counts(media_tags, is_auto=False)
    known = last_trained_count(counts, models)
    return counts.join(known, "tag").where(F.col("n") != F.col("trained_at_count"))


def training_rows(
    media_tags: DataFrame, unit: DataFrame, seed: int = 42, tags: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(tag, part, ord, id) of every tag that can be trained; ``unit`` holds unit vectors.

    ``pos``: manually tagged items with a vector, outliers dropped. ``hard``: the
    items without the tag nearest to the centroid. ``rand``: items of a seeded
    draw, those with the tag removed after the draw. An item may be both hard
    and random.
    """
    manual = media_tags.where(~F.col("is_auto")).select("tag", F.col("media_id").alias("id"))
    if tags is not None:
        manual = manual.join(tags.select("tag"), "tag", "left_semi")
    labelled = manual.join(unit, "id")
    centers = durable(
        I.centroids(labelled, "tag").where(F.col("n") >= MIN_POSITIVES).select("tag", "embedding")
    )
    numbered = I.positions(centers, [], [F.col("tag")], "tag_no")
    kept = durable(_without_outliers(labelled, centers))
    sizes = kept.groupBy("tag").agg(F.count("*").alias("n_pos"))

    names = numbered.select("tag", "tag_no")
    tagged = durable(
        media_tags.select("tag", F.col("media_id").alias("id")).distinct().join(names, "tag")
    )
    barred = tagged.groupBy("tag_no").agg(F.count("*").alias("barred"))
    # One item's tags: bounded by the dictionary, not by the data.
    own = tagged.groupBy("id").agg(F.collect_set("tag_no").alias("skip"))
    corpus = unit.join(own, "id", "left")
    asks = numbered.select(F.col("tag_no").alias("id"), "embedding").join(
        barred.withColumnRenamed("tag_no", "id"), "id"
    )
    near = I.knn_join(
        asks, corpus, HARD_NEGATIVES, skip_same_id=False, block_rows=block_rows, skip="skip"
    )
    hard = (
        near.where(F.col("distance") > HARD_MIN_DISTANCE)
        .join(names, near["query_id"] == names["tag_no"])
        .select("tag", F.lit("hard").alias("part"), F.col("rank").cast("long").alias("ord"), "id")
    )
    # At most RANDOM_HIGH rows, the same draw for every tag.
    draw = C.random_sample_n(unit.select("id"), RANDOM_HIGH, seed)
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), F.col("id")]
    draw = I.positions(draw, [], order, "ord")
    wanted = F.least(
        F.greatest(RANDOM_PER_POSITIVE * F.col("n_pos"), F.lit(RANDOM_LOW)), F.lit(RANDOM_HIGH)
    )
    rand = (
        sizes.select("tag", F.explode(F.sequence(F.lit(1).cast("long"), wanted.cast("long"))).alias("ord"))
        .join(F.broadcast(draw), "ord")
        .join(tagged.select("tag", "id"), ["tag", "id"], "left_anti")
        .select("tag", F.lit("rand").alias("part"), "ord", "id")
    )
    positives = kept.select("tag", F.lit("pos").alias("part"), F.lit(0).cast("long").alias("ord"), "id")
    return positives.unionByName(hard).unionByName(rand)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.where(~V.is_zero(F.col("embedding"))).select(
        "id", V.l2_normalize(F.col("embedding")).alias("embedding")
    )


def training_set(
    media_tags: DataFrame, vectors: DataFrame, seed: int = 42, tags: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """:func:`training_rows` with the unit vector of each row.

    The rows are narrow and made durable; each use then costs one join.
    """
    # Scaled once; the cell joins, centroids and draws below all read it.
    unit = durable(unit_vectors(vectors))
    rows = durable(training_rows(media_tags, unit, seed, tags, block_rows))
    return rows.join(unit, "id").select("tag", "part", "ord", "id", "embedding")


def _without_outliers(labelled: DataFrame, centers: DataFrame) -> DataFrame:
    scored = I.distances_to_centroid(labelled, centers, "tag").drop("embedding")
    stats = scored.groupBy("tag").agg(F.count("*").alias("_n"), F.avg("distance").alias("_avg"))
    far = (F.col("_n") > 5) & (F.col("distance") > 3 * F.col("_avg"))
    return scored.join(stats, "tag").where(~far).select("tag", "id")


# --- training ----------------------------------------------------------------


class _KernelColumns:
    """Columns of ``x @ x.T`` computed when asked for; the latest ones are kept, up to a number of bytes."""

    def __init__(self, x: np.ndarray, cache_bytes: int):
        self.x, self.room = x, max(2, cache_bytes // max(1, 8 * len(x)))
        self.held: dict[int, np.ndarray] = {}

    def __getitem__(self, i: int) -> np.ndarray:
        column = self.held.pop(i, None)
        if column is None:
            if len(self.held) >= self.room:
                self.held.pop(next(iter(self.held)))
            column = self.x @ self.x[i]
        self.held[i] = column
        return column


def _free_ends(y: np.ndarray, alpha: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose signed dual variable may grow, and rows whose may fall."""
    below, above = alpha < cost, alpha > 0
    return np.where(y > 0, below, above), np.where(y > 0, above, below)


def solve_dual(
    x: np.ndarray, y: np.ndarray, cost: np.ndarray, eps: float = SOLVER_TOLERANCE,
    cache_bytes: int = KERNEL_CACHE_BYTES, shrink_every: int = 1_000, with_dual: bool = False,
):
    """(weights, bias) of the linear support-vector machine with per-row cost, and the dual value if asked for.

    Sequential minimal optimisation on the dual: the row violating optimality most is paired with the
    one promising the largest decrease. Kernel columns are computed when a row is chosen. Every
    ``shrink_every`` steps rows that rest at a bound and cannot be chosen leave the working set; once that
    is optimal, slopes of all rows follow from the weights, and the search goes on over all rows until
    none violates optimality.
    """
    n = len(y)
    diag = np.einsum("ij,ij->i", x, x)
    alpha, steps, most = np.zeros(n), 0, max(10_000, 100 * n)
    while True:
        # Over all rows: slopes from the weights, so nothing that was left out stays unseen.
        work = np.arange(n)
        grad = y * (x @ ((alpha * y) @ x)) - 1.0
        if _optimal(y, grad, alpha, cost, eps):
            break
        columns = _KernelColumns(x, cache_bytes)
        while True:
            yw, cw, dw = y[work], cost[work], diag[work]
            score = -yw * grad
            up, low = _free_ends(yw, alpha[work], cw)
            i = int(np.argmax(np.where(up, score, -np.inf)))
            gain = score[i] - score
            # Down to half the tolerance, so the check over all rows is met in spite of rounding.
            if gain[low].max(initial=-np.inf) < eps / 2 or not up.any():
                break
            if steps == most:
                raise RuntimeError("the solver did not converge")
            steps += 1
            at = columns[i]
            curve = np.maximum(dw[i] + dw - 2 * at, 1e-12)
            j = int(np.argmax(np.where(low & (gain > 0), gain**2 / curve, -np.inf)))
            a, b = work[i], work[j]
            step = gain[j] / curve[j]
            step = min(step, cost[a] - alpha[a] if y[a] > 0 else alpha[a])
            step = min(step, alpha[b] if y[b] > 0 else cost[b] - alpha[b])
            alpha[a] += y[a] * step
            alpha[b] -= y[b] * step
            grad += yw * step * (at - columns[j])
            if steps % shrink_every == 0:
                keep = _may_be_chosen(yw, grad, alpha[work], cw)
                if keep.sum() < 0.9 * len(work):
                    work, grad = work[keep], grad[keep]
                    columns = _KernelColumns(x[work], cache_bytes)
    weights = (alpha * y) @ x
    signed = y * grad
    free = (alpha > 0) & (alpha < cost)
    if free.any():
        bias = signed[free].mean()
    else:
        up, low = _free_ends(y, alpha, cost)
        bias = -((-signed)[up].max() + (-signed)[low].min()) / 2
    if with_dual:
        return weights, float(bias), float(alpha.sum() - 0.5 * weights @ weights)
    return weights, float(bias)


def _optimal(y: np.ndarray, grad: np.ndarray, alpha: np.ndarray, cost: np.ndarray, eps: float) -> bool:
    score = -y * grad
    up, low = _free_ends(y, alpha, cost)
    return not up.any() or not low.any() or score[up].max() - score[low].min() < eps


def _may_be_chosen(y: np.ndarray, grad: np.ndarray, alpha: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Rows between their bounds, and those at one that still lie between the two extremes of the others."""
    score = -y * grad
    up, low = _free_ends(y, alpha, cost)
    if not up.any() or not low.any():
        return np.ones(len(y), bool)
    return (up & low) | (up & (score >= score[low].min())) | (low & (score <= score[up].max()))


def fit_platt(score: np.ndarray, positive: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of the sigmoid 1 / (1 + exp(a s + b)) by damped Newton steps on smoothed targets."""
    n_pos, n_neg = int(positive.sum()), int((~positive).sum())
    target = np.where(positive, (n_pos + 1.0) / (n_pos + 2.0), 1.0 / (n_neg + 2.0))
    a, b = 0.0, float(np.log((n_neg + 1.0) / (n_pos + 1.0)))

    def loss(a: float, b: float) -> float:
        f = a * score + b
        return float(np.sum(target * f + np.logaddexp(0.0, -f)))

    value = loss(a, b)
    for _ in range(rounds):
        f = a * score + b
        p = np.exp(-np.logaddexp(0.0, f))
        slope, weight = target - p, p * (1 - p)
        g = np.array([slope @ score, slope.sum()])
        if np.abs(g).max() < 1e-5:
            break
        h12 = weight @ score
        h = np.array([[weight @ score**2, h12], [h12, weight.sum()]]) + 1e-12 * np.eye(2)
        move = -np.linalg.solve(h, g)
        rate = 1.0
        while rate >= 1e-10:
            trial = loss(a + rate * move[0], b + rate * move[1])
            if trial < value + 1e-4 * rate * (g @ move):
                a, b, value = a + rate * move[0], b + rate * move[1], trial
                break
            rate /= 2
        else:
            break
    return float(a), float(b)


def train_one(positives: np.ndarray, negatives: np.ndarray, with_dual: bool = False):
    """(weights, bias, a, b) of one tag, and the dual value if asked for; rare positives weigh as much as all negatives."""
    n_pos, n_neg = len(positives), len(negatives)
    x = V.unit_rows(np.vstack([positives, negatives]).astype(np.float64))
    y = np.concatenate([np.ones(n_pos), -np.ones(n_neg)])
    cost = np.where(y > 0, n_neg / n_pos, 1.0)
    weights, bias, dual = solve_dual(x, y, cost, with_dual=True)
    few = min(n_pos, n_neg)
    a, b = fit_platt(x[: n_pos + few] @ weights - bias, y[: n_pos + few] > 0)
    return (weights, bias, a, b, dual) if with_dual else (weights, bias, a, b)


def fit_sample(training: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """At most ``max_rows`` positives and ``max_rows`` negatives of each tag, in seeded hash order.

    The rank filter is a window limit: tasks cut their rows before the shuffle.
    """
    order = Window.partitionBy("tag", F.col("part") == "pos").orderBy(F.xxhash64("id", F.lit(29)), "id", "part", "ord")
    return training.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= max_rows).drop("_row")


def train_models(training: DataFrame, max_rows: int = MAX_FIT_ROWS, with_dual: bool = False) -> DataFrame:
    """(tag, weights, bias, platt_a, platt_b), and ``dual`` if asked for, of every tag with both kinds of rows.

    Every tag is fitted on all of its rows. Tags of up to ``max_rows`` rows of a kind train in parallel, one
    to a task; :func:`_train_wide` fits the larger ones together, each over many tasks.
    """
    schema = f"tag string, {MODEL_FIELDS}, dual double"

    def fit(table: pa.Table) -> pa.Table:
        x, _ = V.to_matrix(table.column("embedding"))
        part = np.asarray(table.column("part").to_pylist(), dtype=object)
        key = np.lexsort(
            [table.column("id").to_numpy(), table.column("ord").to_numpy(), part == "rand", part != "pos"]
        )
        x, part = x[key], part[key]
        pos = part == "pos"
        rows = {"tag": [], "weights": [], "bias": [], "platt_a": [], "platt_b": [], "dual": []}
        if pos.any() and not pos.all():
            w, bias, a, b, dual = train_one(x[pos], x[~pos], with_dual=True)
            rows = {
                "tag": [table.column("tag")[0].as_py()], "weights": [w.tolist()], "bias": [bias],
                "platt_a": [a], "platt_b": [b], "dual": [dual],
            }
        return pa.table(rows, pa.schema([
            ("tag", pa.string()), ("weights", pa.list_(pa.float64())), ("bias", pa.float64()),
            ("platt_a", pa.float64()), ("platt_b", pa.float64()), ("dual", pa.float64()),
        ]))

    sized = _kinds(training).where(F.greatest("n_pos", "n_neg") > max_rows)
    # At most one row for every ``max_rows`` of the training set.
    wide = {r["tag"]: r for r in sized.collect()}
    narrow = training
    if wide:
        names = training.sparkSession.createDataFrame([(t,) for t in wide], "tag string")
        narrow = training.join(F.broadcast(names), "tag", "left_anti")
    models = narrow.groupBy("tag").applyInArrow(fit, schema)
    both = {t: r for t, r in wide.items() if r["n_pos"] and r["n_neg"]}
    if both:
        fitted = _train_wide(training.join(F.broadcast(names), "tag", "left_semi"), both, max_rows)
        models = models.unionByName(training.sparkSession.createDataFrame(fitted, schema))
    return models if with_dual else models.drop("dual")


def _kinds(training: DataFrame) -> DataFrame:
    """(tag, n_pos, n_neg, dim) of every tag."""
    pos = F.col("part") == "pos"
    return training.groupBy("tag").agg(
        F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"), F.max(F.size("embedding")).alias("dim")
    )


def _calibrating(rows: DataFrame) -> DataFrame:
    """Of (tag, part, ord, id, n_pos, n_neg): the positives, and as many of the first negatives, at most one for each."""
    many = (F.col("part") != "pos") & (F.col("n_neg") > F.col("n_pos"))
    order = [F.col("part") == "rand", F.col("ord"), F.col("id")]
    first = I.positions(rows.where(many), ["tag"], order, "_at").where(F.col("_at") <= F.col("n_pos")).drop("_at")
    return rows.where(~many).unionByName(first.select(*rows.columns))


def _sums(packed: DataFrame, state: dict, fn) -> dict:
    """Sums over all rows of ``fn(x, y, used, *state[tag])``, an array, for every tag of ``state``; tasks add up their own blocks."""
    dims = {tag: x[0] for tag, x in state.items()}

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                tag = batch.column(0)[i].as_py()
                if tag not in state:
                    continue
                x, y, used = (np.asarray(batch.column(k)[i].values) for k in (2, 3, 4))
                part = fn(x.reshape(-1, dims[tag]), y, used > 0, *state[tag][1:])
                first, so_far = total.get(tag, (batch.column(1)[i].as_py(), 0.0))
                total[tag] = (first, so_far + part)
        yield pa.record_batch({
            "tag": pa.array(list(total), pa.string()), "block": pa.array([b for b, _ in total.values()], pa.int32()),
            "value": pa.array([v for _, v in total.values()], pa.list_(pa.float64())),
        })

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        value, _ = V.to_matrix(table.column("value"))
        return pa.table({"tag": table.column("tag").slice(0, 1), "value": pa.array([value.sum(axis=0)], pa.list_(pa.float64()))})

    parts = packed.mapInArrow(own, "tag string, block int, value array<double>")
    rows = parts.groupBy("tag").applyInArrow(together, "tag string, value array<double>").collect()
    return {r["tag"]: np.asarray(r["value"]) for r in rows}


def _hinge_sums(x, y, used, z, smooth, cost) -> np.ndarray:
    """(smoothed loss, loss, sum of duals, duals times signed rows, curvature) at ``z``, weights and bias."""
    signed = y[:, None] * np.hstack([x, np.full((len(x), 1), -1.0)])
    c = np.where(y > 0, cost, 1.0)
    t = 1.0 - signed @ z
    share = np.clip(t / smooth, 0.0, 1.0)
    dual = c * share
    loss = c * np.where(share < 1.0, np.maximum(t, 0.0) ** 2 / (2 * smooth), t - smooth / 2)
    band = signed[(t > 0) & (t < smooth)] * np.sqrt(c[(t > 0) & (t < smooth)])[:, None]
    return np.concatenate([
        [loss.sum(), c @ np.maximum(t, 0.0), dual.sum()], dual @ signed, (band.T @ band / smooth).ravel(),
    ])


def _platt_sums(x, y, used, w, bias, a, b, high, low) -> np.ndarray:
    """(loss, slopes, curvature) of the sigmoid over the rows that it is fitted on."""
    score = x[used] @ w - bias
    target = np.where(y[used] > 0, high, low)
    f = a * score + b
    p = np.exp(-np.logaddexp(0.0, f))
    slope, weight = target - p, p * (1 - p)
    return np.array([
        np.sum(target * f + np.logaddexp(0.0, -f)), slope @ score, slope.sum(),
        weight @ score**2, weight @ score, weight.sum(),
    ])


@dataclass
class _Descent:
    """Damped Newton steps towards a minimum, one trial point a pass."""

    at: np.ndarray
    step: np.ndarray | None = None
    value: float = np.inf
    slope: float = 0.0
    rate: float = 1.0
    stuck: bool = False
    steep: float = np.inf

    def trial(self) -> np.ndarray:
        return self.at if self.step is None else self.at + self.rate * self.step

    def take(self, value: float, gradient: np.ndarray, curvature: np.ndarray, smooth: bool = False) -> bool:
        """Judge the trial point; whether it was taken.

        The rounding of a sum over many rows hides the last decreases. Of a ``smooth`` function the gradient tells them:
        its steps go on until it falls no further.
        """
        steep = float(np.abs(gradient).max())
        hidden = smooth and self.step is not None and -self.slope < 1e-9 * (1.0 + abs(value))
        if hidden and not steep < self.steep:
            self.stuck = True
            return False
        if self.step is not None and not hidden and not value < self.value + 1e-4 * self.rate * self.slope:
            # To the lowest point of the parabola through what is known, at most half the way.
            bend = value - self.value - self.rate * self.slope
            self.rate = float(np.clip(-self.slope * self.rate**2 / (2 * bend), self.rate / 20, self.rate / 2)) if bend > 0 else self.rate / 2
            self.stuck = self.rate < 1e-10
            return False
        self.at, self.value, self.rate, self.steep = self.trial(), value, 1.0, steep
        self.step = -np.linalg.solve(curvature + 1e-12 * np.eye(len(gradient)), gradient)
        self.slope = float(gradient @ self.step)
        self.stuck = not smooth and -self.slope < 1e-15 * (1.0 + abs(value))
        return True

    def anew(self) -> None:
        """Another function from here on."""
        self.step, self.value, self.rate, self.stuck = None, np.inf, 1.0, False


def _train_wide(training: DataFrame, sizes: dict, max_rows: int, most: int = 1000) -> list[tuple]:
    """Models of tags with more rows than one task fits, over all of their rows.

    The same problem as :func:`solve_dual`: Newton steps on a hinge rounded off over a shrinking width, whose
    minimum gives dual variables, until the duality gap of the unrounded problem is below :data:`WIDE_GAP`.
    Rows lie in blocks of about ``max_rows``; a pass sends weights to the blocks and brings sums back.
    """
    spark = training.sparkSession
    counts = spark.createDataFrame([(t, r["n_pos"], r["n_neg"]) for t, r in sizes.items()], "tag string, n_pos long, n_neg long")
    rows = durable(training.join(F.broadcast(counts), "tag"))
    key = ["tag", "part", "ord", "id"]
    used = _calibrating(rows.select(*key, "n_pos", "n_neg")).select(*key).distinct().withColumn("used", F.lit(True))
    blocks = F.ceil((F.col("n_pos") + F.col("n_neg")) / F.lit(max_rows))
    dims = {t: r["dim"] for t, r in sizes.items()}

    def pack(table: pa.Table) -> pa.Table:
        part = np.asarray(table.column("part").to_pylist(), dtype=object)
        order = np.lexsort([table.column("ord").to_numpy(), part == "rand", part != "pos", table.column("id").to_numpy()])
        tag = table.column("tag")[0].as_py()
        x = V.unit_rows(V.to_matrix(table.column("embedding"), dims[tag])[0])[order]
        kind = pa.list_(pa.float64())
        return pa.table({
            "tag": [tag], "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "x": pa.array([x.ravel()], kind),
            "y": pa.array([np.where(part[order] == "pos", 1.0, -1.0)], kind),
            "used": pa.array([np.asarray(table.column("used").fill_null(False))[order].astype(np.float64)], kind),
        })

    packed = durable(
        rows.join(used, key, "left").withColumn("block", F.pmod(F.xxhash64("id", F.lit(31)), blocks).cast("int"))
        .groupBy("tag", "block").applyInArrow(pack, "tag string, block int, x array<double>, y array<double>, used array<double>")
    )
    cost = {t: r["n_neg"] / r["n_pos"] for t, r in sizes.items()}
    walk = {t: _Descent(np.zeros(d + 1)) for t, d in dims.items()}
    smooth = dict.fromkeys(walk, 1.0)
    dual: dict[str, float] = {}
    for _ in range(most):
        if len(dual) == len(walk):
            break
        sums = _sums(packed, {t: (dims[t], w.trial(), smooth[t], cost[t]) for t, w in walk.items() if t not in dual}, _hinge_sums)
        for t, got in sums.items():
            d, w, z = dims[t], walk[t], walk[t].trial()
            pulled, curve = got[3 : d + 4], got[d + 4 :].reshape(d + 1, d + 1)
            weights = np.append(z[:d], 0.0)
            gradient = weights - pulled
            # Where no row bends the loss, half the slope of the bias keeps its step at two or less.
            curve += np.diag(np.append(np.ones(d), abs(gradient[d]) / 2))
            if not w.take(0.5 * weights @ weights + got[0], gradient, curve) and not w.stuck:
                continue
            if np.abs(gradient).max() < 1e-8 * (1.0 + got[2]) or w.stuck:
                primal = 0.5 * weights @ weights + got[1]
                value = got[2] - 0.5 * pulled[:d] @ pulled[:d]
                if abs(primal - value) <= WIDE_GAP * primal and abs(pulled[d]) < 1e-6 * (1.0 + got[2]):
                    dual[t] = float(value)
                else:
                    smooth[t] /= 2
                    w.anew()
    if len(dual) < len(walk):
        raise RuntimeError("the solver did not converge")
    models = {t: (w.at[:-1], float(w.at[-1])) for t, w in walk.items()}

    goal = {t: ((r["n_pos"] + 1) / (r["n_pos"] + 2), 1 / (min(r["n_pos"], r["n_neg"]) + 2)) for t, r in sizes.items()}
    few = {t: min(r["n_pos"], r["n_neg"]) for t, r in sizes.items()}
    platt = {t: _Descent(np.array([0.0, np.log((few[t] + 1.0) / (r["n_pos"] + 1.0))])) for t, r in sizes.items()}
    done: set = set()
    for _ in range(most):
        if len(done) == len(platt):
            break
        sums = _sums(packed, {t: (dims[t], *models[t], *p.trial(), *goal[t]) for t, p in platt.items() if t not in done}, _platt_sums)
        for t, (value, g1, g2, h11, h12, h22) in sums.items():
            p = platt[t]
            if p.take(value, np.array([g1, g2]), np.array([[h11, h12], [h12, h22]]), smooth=True) and p.steep < 1e-5 or p.stuck:
                done.add(t)
    if len(done) < len(platt):
        raise RuntimeError("the calibration did not converge")
    return [
        (t, [float(v) for v in models[t][0]], models[t][1], float(platt[t].at[0]), float(platt[t].at[1]), dual[t]) for t in sorted(models)
    ]


def _scored(models: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of the tags that have a model, with their score under it; rows meet the models, never each other."""
    score = V.dot(V.l2_normalize(F.col("embedding")), F.col("weights")) - F.col("bias")
    return rows.join(models.select("tag", "weights", "bias", "platt_a", "platt_b"), "tag").withColumn("score", score)


def duality_gaps(models: DataFrame, training: DataFrame) -> DataFrame:
    """(tag, n_pos, n_neg, n_margin, primal, dual, gap) of :func:`train_models` with ``dual``.

    The primal value is computed from the returned weights over the training rows alone, so a small
    ``gap``, relative to it, proves the weights near-optimal whatever the solver did. ``n_margin``
    counts rows on or inside the margin.
    """
    pos = F.col("part") == "pos"
    truth = F.when(pos, 1.0).otherwise(-1.0)
    slack = F.greatest(1 - truth * F.col("score"), F.lit(0.0))
    losses = _scored(models, training).groupBy("tag").agg(
        F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"), F.count_if(slack > 0).alias("n_margin"),
        F.sum(F.when(pos, slack).otherwise(0.0)).alias("_pos"), F.sum(F.when(pos, 0.0).otherwise(slack)).alias("_neg"),
    )
    norm = V.dot(F.col("weights"), F.col("weights"))
    loss = F.col("n_neg") / F.col("n_pos") * F.col("_pos") + F.col("_neg")
    return losses.join(models.select("tag", "dual", norm.alias("_norm")), "tag").withColumn(
        "primal", 0.5 * F.col("_norm") + loss
    ).withColumn("gap", (F.col("primal") - F.col("dual")) / F.col("primal")).drop("_norm", "_pos", "_neg")


def platt_slopes(models: DataFrame, training: DataFrame) -> DataFrame:
    """(tag, n_fit, slope_a, slope_b): the derivatives of the likelihood that :func:`fit_platt` has brought to zero.

    Fitted are the positives and as many of the first negatives, at most one for each positive.
    """
    few = F.least("n_pos", "n_neg")
    sized = training.join(F.broadcast(_kinds(training).drop("dim")), "tag")
    rows = _scored(models, _calibrating(sized))
    target = F.when(F.col("part") == "pos", (F.col("n_pos") + 1) / (F.col("n_pos") + 2)).otherwise(1 / (few + 2))
    off = target - platt_probability(F.col("score"), F.col("platt_a"), F.col("platt_b"))
    return rows.groupBy("tag").agg(
        F.count("*").alias("n_fit"), F.sum(off * F.col("score")).alias("slope_a"), F.sum(off).alias("slope_b")
    )


@dataclass
class AutoTagResult:
    """Next tables and the numbers of one run."""

    media_tags: DataFrame
    models: DataFrame
    before: int
    after: int
    models_processed: int


def _train_tags(media_tags, vectors, tags, seed) -> DataFrame:
    counts = C.tag_counts(media_tags, is_auto=False).withColumnRenamed("n", "trained_at_count")
    trained = train_models(training_set(media_tags, vectors, seed, tags))
    return durable(trained.join(counts, "tag"))


def _scope_ids(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").alias("media_id"))


def in_folder(vectors: DataFrame, folder_media: DataFrame | None, folder_id) -> DataFrame:
    return vectors if folder_id is None else C.filter_folder(vectors, folder_media, folder_id)


def apply_tag_model(
    tag: str, media_tags: DataFrame, models: DataFrame, vectors: DataFrame,
    folder_media: DataFrame | None = None, folder_id=None, seed: int = 42,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(media_tags, models, predictions) after training one tag and scoring the scope.

    Without a folder every automatic row of the tag is replaced.
    """
    wanted = media_tags.where(F.col("tag") == tag).select("tag").distinct()
    if wanted.isEmpty():
        raise LookupError(f"no tag {tag!r}")
    trained = _train_tags(media_tags, vectors, wanted, seed)
    if trained.isEmpty():
        raise ValueError(f"not enough labelled vectors for {tag!r} (need {MIN_POSITIVES})")
    scope = in_folder(vectors, folder_media, folder_id)
    found = durable(batch_predict(scope, trained, RAW_THRESHOLD))
    tagged = L.merge_auto_tags(
        media_tags, found.select("media_id", "tag", "confidence"), wanted,
        None if folder_id is None else _scope_ids(scope),
    )
    return tagged, save_models(models, trained), found


def learn_tag(
    tag: str, media_tags: DataFrame, models: DataFrame, vectors: DataFrame, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train one tag and apply it to the whole library."""
    return apply_tag_model(tag, media_tags, models, vectors, seed=seed)


def run_auto_tagging(
    media_tags: DataFrame, models: DataFrame, vectors: DataFrame,
    folder_media: DataFrame | None = None, folder_id=None, seed: int = 42,
) -> AutoTagResult:
    """Bring the automatic tags of the scope up to date, all tags in one job.

    Tags no longer trainable lose their automatic rows in scope. Tags whose
    label count moved are trained again, others use the stored model; a tag
    whose training fails keeps its rows.
    """
    def auto_rows(tags: DataFrame) -> int:
        if folder_id is None:
            return C.count_auto_tags(tags).first()["n"]
        members = folder_media.where(F.col("folder_id") == folder_id)
        row = C.count_auto_tags(tags, members).first()
        return row["n"] if row else 0

    before = auto_rows(media_tags)
    scope = in_folder(vectors, folder_media, folder_id)
    if scope.isEmpty():
        return AutoTagResult(media_tags, models, before, 0, 0)
    trainable = C.trainable_tags(media_tags)
    stale = stale_models(media_tags, models).join(trainable.select("tag"), "tag", "left_semi")
    trained = _train_tags(media_tags, vectors, stale.select("tag"), seed)
    cached = models.join(trainable.select("tag"), "tag", "left_semi").join(
        stale.select("tag"), "tag", "left_anti"
    )
    fields = ["tag", "weights", "bias", "platt_a", "platt_b"]
    active = durable(cached.select(*fields).unionByName(trained.select(*fields)))
    found = batch_predict(scope, active, RAW_THRESHOLD).select("media_id", "tag", "confidence")
    retired = media_tags.where("is_auto").select("tag").distinct().join(
        trainable.select("tag"), "tag", "left_anti"
    )
    processed = active.select("tag").unionByName(retired)
    tagged = durable(L.merge_auto_tags(media_tags, found, processed, _scope_ids(scope)))
    return AutoTagResult(
        tagged, save_models(models, trained), before, auto_rows(tagged), trainable.count()
    )
