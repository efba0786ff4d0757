import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lightbox.functions import vectors as V
from lightbox.operators import similarity as I
from lightbox.plans import cells, nearest
from lightbox.plans.components import connected_components


def frame(spark, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    return spark.createDataFrame(
        [(int(i), [float(x) for x in row]) for i, row in zip(ids, matrix)], "id long, embedding array<float>"
    )


@pytest.fixture(scope="module")
def matrix():
    """Clusters of several spreads, one crowded set of near copies, exact copies, zeros."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 12))
    parts = [c + s * rng.normal(size=(25, 12)) for c, s in zip(centres, np.linspace(0.02, 0.9, 8))]
    hot = centres[0] + 0.01 * rng.normal(size=(120, 12))
    copies = np.repeat(centres[1:2], 20, axis=0)
    m = np.vstack([*parts, hot, copies, np.zeros((3, 12))]).astype(np.float32)
    return m[rng.permutation(len(m))]


def cosine(matrix):
    m = matrix.astype(np.float64)
    norm = np.linalg.norm(m, axis=1)
    u = m / np.where(norm > 0, norm, 1)[:, None]
    return u @ u.T, norm > 0


@pytest.mark.parametrize("block_rows", [4096, 40, 15])
def test_pairs_are_exact_for_any_cut(spark, matrix, block_rows):
    dots, ok = cosine(matrix)
    for threshold in (0.05, 0.4):
        want = {
            (i, j) for i in range(len(matrix)) for j in range(i + 1, len(matrix))
            if ok[i] and ok[j] and dots[i, j] >= 1 - threshold
        }
        edge = {(i, j) for i, j in want if abs(dots[i, j] - 1 + threshold) < 1e-9}
        got = [(r["a"], r["b"]) for r in cells.pairs_within(frame(spark, matrix), threshold, block_rows=block_rows).collect()]
        assert len(got) == len(set(got))
        assert set(got) ^ want <= edge
        n = cells.pairs_within(frame(spark, matrix), threshold, "count", block_rows).agg(F.sum("n")).first()[0]
        assert n == len(got)


@pytest.mark.parametrize("block_rows", [4096, 15])
def test_components_from_forests(spark, matrix, block_rows):
    dots, ok = cosine(matrix)
    label = np.arange(len(matrix))
    link = (dots >= 1 - 0.1) & ok[:, None] & ok[None, :]
    for _ in range(len(matrix)):
        low = np.where(link, label[None, :], len(matrix)).min(axis=1)
        new = np.minimum(label, low)
        if (new == label).all():
            break
        label = new
    want = {i: int(label[i]) for i in range(len(matrix)) if (label == label[i]).sum() > 1}
    got = I.similarity_components(frame(spark, matrix), 0.1, block_rows).collect()
    assert {r["id"]: r["component"] for r in got} == want
    crowd = cells.pairs_within(frame(spark, matrix), 0.1, "forest", block_rows).count()
    assert crowd < len(matrix) * 40


@pytest.mark.parametrize("block_rows", [4096, 40, 15])
def test_knn_join_is_exact(spark, matrix, block_rows):
    distinct = np.unique(matrix, axis=0)
    dots, ok = cosine(distinct)
    got = {}
    for r in I.knn_join(frame(spark, distinct), frame(spark, distinct), 6, block_rows=block_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    assert set(got) == set(np.flatnonzero(ok))
    for q, hits in got.items():
        d = 1 - dots[q]
        d[~ok] = np.inf
        d[q] = np.inf
        assert [h[2] for h in sorted(hits)] == pytest.approx(np.sort(d)[:6].clip(0), abs=1e-9)


def clustered(rng, clusters, members, dim, spread=0.1):
    return (np.repeat(rng.normal(size=(clusters, dim)), members, axis=0) + spread * rng.normal(size=(clusters * members, dim))).astype(np.float32)


def test_tree_bounds_lose_nothing():
    """Homes hold enough vectors, and every leaf with a vector within the bound is visited."""
    rng = np.random.default_rng(3)
    for matrix in (clustered(rng, 30, 20, 10), rng.normal(size=(600, 10))):
        units = V.unit_rows(matrix.astype(np.float64))
        tree = nearest.Tree(units[rng.permutation(600)[:40]])
        leaf, reach, top = tree.settle(units)
        used = np.unique(leaf)
        stats = {"cell": used, "n": np.bincount(leaf)[used]}
        for name, values, pick in (("near", reach, min), ("far", reach, max), ("top_near", top, min), ("top_far", top, max)):
            stats[name] = [pick(values[leaf == c]) for c in used]
        tree.know(pa.table(stats))
        wanted = rng.integers(1, 700, 600)
        for cells_of, w in zip(tree.homes(units, wanted), wanted):
            assert tree.size[cells_of].sum() >= min(w, 600) and len(set(cells_of)) == len(cells_of)
        apart = np.sqrt(np.maximum(2 - 2 * units @ units.T, 0))
        bound = rng.uniform(0, 1, 600)
        row, cell = tree.within(units, bound)
        visited = set(zip(row.tolist(), cell.tolist()))
        assert all((i, leaf[j]) in visited for i, j in zip(*np.nonzero(apart <= bound[:, None] - 1e-9)))


def test_knn_join_visits_few_leaves_of_clustered_data(spark):
    rng = np.random.default_rng(5)
    matrix = clustered(rng, 40, 50, 16)
    tree = nearest.choose_tree(frame(spark, matrix), len(matrix), 16, 64)
    settled = nearest._settled(frame(spark, matrix), tree, 16, None)
    tree.know(settled.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("reach").alias("near"), F.max("reach").alias("far"),
        F.min("top_reach").alias("top_near"), F.max("top_reach").alias("top_far"),
    ).toArrow())
    asked = nearest._at_home(frame(spark, matrix), tree, 16, 6, False)
    near = I.knn_join(frame(spark, matrix), frame(spark, matrix), 5, block_rows=64).where("rank = 5")
    more = nearest.further_visits(asked, near.select("query_id", F.col("distance").alias("bound")), tree, 16)
    assert len(tree.leaves) > 50 and more.count() < 12 * len(matrix)


def test_tiles_grow_with_the_root(spark):
    cut = spark.createDataFrame([(n,) for n in (1, 256, 257, 1024, 25_600, 10**9)], "n long").select(cells.tiles(F.col("n"), 256, 64))
    assert [r[0] for r in cut.collect()] == [1, 1, 2, 2, 10, max(1977, -(-(10**9) * 8 * 64 // cells.TILE_BYTES))]


def test_knn_join_with_barred_items(spark, matrix):
    distinct = np.unique(matrix, axis=0)
    dots, ok = cosine(distinct)
    corpus = frame(spark, distinct).withColumn(
        "skip", F.when(F.col("id") % 2 == 0, F.array(F.lit(900).cast("long"))))
    asks = frame(spark, distinct[-2:], [900, 901]).withColumn(
        "barred", F.when(F.col("id") == 900, (len(distinct) + 1) // 2).otherwise(0))
    for block_rows in (4096, 20):
        got = I.knn_join(asks, corpus, 5, skip_same_id=False, skip="skip", block_rows=block_rows).collect()
        for q, row in ((900, len(distinct) - 2), (901, len(distinct) - 1)):
            d = np.where(ok, 1 - dots[row], np.inf)
            if q == 900:
                d[::2] = np.inf
            assert sorted(r["distance"] for r in got if r["query_id"] == q) == pytest.approx(np.sort(d)[:5].clip(0), abs=1e-9)


def test_similar_pairs_fold_copies_into_stars(spark, rows):
    df = frame(spark, [[1, 0], [1, 0], [1, 0], [1, 0.01], [0, 1], [0, 0]])
    assert rows(I.similar_pairs(df, 0.1).select("a", "b")) == [(0, 1), (0, 2), (0, 3)]
    assert rows(I.similarity_components(df, 0.1)) == [(0, 0), (1, 0), (2, 0), (3, 0)]


@pytest.mark.parametrize("block_rows", [4096, 15])
def test_similar_items_count_copies(spark, matrix, block_rows):
    dots, ok = cosine(matrix)
    link = (dots >= 1 - 0.1) & ok[:, None] & ok[None, :] & ~np.eye(len(matrix), dtype=bool)
    out = I.similar_items(frame(spark, matrix), 0.1, block_rows).collect()
    assert {r["id"]: r["neighbours"] for r in out} == {i: n for i, n in enumerate(link.sum(axis=1).tolist()) if n}
    for r in out:
        assert r["nearest"] == pytest.approx(1 - dots[r["id"]][link[r["id"]]].max(), abs=1e-9)
    assert I.pair_guard(frame(spark, matrix), 0.1, block_rows=block_rows) == (len(matrix), int(link.sum()) // 2)


def test_groups_are_numbered_by_first_date(spark, rows):
    scope = spark.createDataFrame(
        [(1, "2020", [1.0, 0.0]), (5, "2024", [1.0, 0.0]), (2, "2021", [0.0, 1.0]), (3, "2019", [0.0, 1.0]), (4, "2022", [1.0, 1.0])],
        "id long, original_date string, embedding array<double>",
    )
    assert rows(I.group_similar(scope, 0.01)) == [(0, 2), (0, 3), (1, 1), (1, 5)]


def test_guard(spark, matrix):
    df = frame(spark, matrix)
    with pytest.raises(ValueError, match="items"):
        I.pair_guard(df, 0.1, max_items=10)
    with pytest.raises(ValueError, match="pairs"):
        I.pair_guard(df, 0.1, max_pairs=10)


@pytest.mark.parametrize("shape", ["chain", "hub", "mixed"])
def test_connected_components(spark, shape):
    n = 300
    if shape == "chain":
        edges = [(i, i + 1) for i in range(n)]
    elif shape == "hub":
        edges = [(500, i) for i in range(n)]
    else:
        rng = np.random.default_rng(1)
        edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (200, 2)) if a != b]
    low = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    df = spark.createDataFrame(edges, "u long, v long").repartition(16)
    assert {r["id"]: r["component"] for r in connected_components(df).collect()} == low


def test_vector_codec(spark):
    df = frame(spark, [[1.5, -2.0, 3.25]])
    raw = df.select(V.encode_vectors(F.col("embedding")).alias("raw"))
    assert raw.first()["raw"] == np.array([1.5, -2.0, 3.25], np.float32).tobytes()
    assert raw.select(V.decode_vectors(F.col("raw")).alias("v")).first()["v"] == [1.5, -2.0, 3.25]
    with pytest.raises(Exception, match="multiple"):
        raw.select(V.decode_vectors(F.expr("substring(raw, 1, 5)"))).collect()


def test_vector_functions(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "id long, v array<double>")
    got = {r["id"]: r["u"] for r in df.select("id", V.l2_normalize(F.col("v")).alias("u")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [1.0], 4: None}
    pair = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>")
    assert pair.select(V.dot(F.col("a"), F.col("b"))).first()[0] == 32.0
    odd = spark.createDataFrame(
        [(1, [1.0, 0.0], [0.0, 2.0]), (2, [1.0, 2.0, 3.0], [1.0]), (3, [2.0], [3.0]), (4, [0.0], [1.0]), (5, None, [1.0])],
        "id long, a array<double>, b array<double>",
    ).coalesce(1)
    both = [V.dot(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("b"))]
    assert [tuple(r) for r in odd.orderBy("id").select(*both).collect()] == [(0.0, 1.0), (None, None), (6.0, 0.0), (0.0, None), (None, None)]


def test_search_edges(spark, rows):
    df = frame(spark, [[1, 0], [0.9, 0.1], [0, 1], [0, 0]])
    assert [r["id"] for r in I.knn_by_id(df, 0, 5).collect()] == [1, 2]
    assert [r["id"] for r in I.knn(df, [1, 0], 5, 0.5).collect()] == [0, 1]
    with pytest.raises(LookupError):
        I.knn_by_id(df, 99, 5)


def test_outliers(spark, rows):
    pts = [[1, 0.01 * i] for i in range(9)] + [[-1, 0.2]]
    df = frame(spark, pts).withColumn("g", F.lit("t"))
    assert len(rows(I.outlier_filter(df, "g").select("id"))) == 9
    few = df.where("id >= 5")
    assert I.outlier_filter(few, "g").count() == 5


@pytest.mark.parametrize("block_rows", [4096, 15])
def test_undirected_and_odd_vectors_take_nothing_away(spark, matrix, block_rows):
    """Null, empty, zero and longer vectors, wherever the pivots are sampled, change no other pair."""
    clean = frame(spark, matrix)
    want = {(r["a"], r["b"]) for r in cells.pairs_within(clean, 0.2, block_rows=block_rows).collect()}
    near = {tuple(r) for r in I.knn_join(clean, clean, 3, block_rows=block_rows).select("query_id", "id").collect()}
    odd = [None, [], [0.0] * 12, [1.0] * 13, [1.0] * 13]
    mixed = clean.unionByName(spark.createDataFrame([(i + 1000 * j, v) for j in range(1, 12) for i, v in enumerate(odd)], clean.schema))
    got = {(r["a"], r["b"]) for r in cells.pairs_within(mixed, 0.2, block_rows=block_rows).collect()}
    assert {p for p in got if p[1] < 1000} == want
    assert len(got) - len(want) == 22 * 21 // 2
    found = {tuple(r) for r in I.knn_join(mixed, mixed, 3, block_rows=block_rows).select("query_id", "id").collect()}
    assert {p for p in found if p[0] < 1000} == near
    assert len({p for p in found if p[0] >= 1000}) == 22 * 3


@pytest.mark.parametrize("kind", ["float", "double"])
def test_codec_round_trip(spark, kind):
    """Bytes and back, nulls and empty vectors kept; equal bytes, equal digests."""
    data = [(0, [1.0, 2.5]), (1, None), (2, []), (3, [1.0, 2.5]), (4, [3.0])]
    df = spark.createDataFrame(data, f"id long, v array<{kind}>").coalesce(1)
    raw = df.select("id", V.encode_vectors(F.col("v"), kind == "double").alias("raw"), V.fingerprint(F.col("v")).alias("digest"))
    got = {r.id: r for r in raw.select("*", V.decode_vectors(F.col("raw"), kind == "double").alias("back")).collect()}
    dtype = np.float64 if kind == "double" else np.float32
    assert [got[i].back for i, _ in data] == [v for _, v in data]
    assert [got[i].raw for i, _ in data] == [None if v is None else bytearray(np.array(v, dtype).tobytes()) for _, v in data]
    assert got[0].digest == got[3].digest != got[4].digest and got[1].digest is None and len(got[2].digest) == 32


def test_spread_vectors_are_copied_as_in_one_grid(spark, monkeypatch):
    """Where bounds exclude nothing, rows go to the tiles of one grid, not to every cell; clusters keep their cells."""
    sent = []
    cut = cells._cut
    monkeypatch.setattr(cells, "_cut", lambda *a: sent.append(cut(*a)) or sent[-1])
    rng = np.random.default_rng(8)
    spread = rng.normal(size=(1500, 16)).astype(np.float32)
    dots, _ = cosine(spread)
    n = cells.pairs_within(frame(spark, spread), 0.6, "count", 32).agg(F.sum("n")).first()[0]
    assert n == (np.triu(dots, 1) >= 0.4).sum()
    assert sent[0].count() <= 7 * 1500
    monkeypatch.setattr(cells, "COPY_COST", 10)
    tight = clustered(rng, 40, 40, 16)
    cells.pairs_within(frame(spark, tight), 0.05, "count", 32)
    # A row meets its own block once in every cell that it goes to.
    assert sent[1].select("cell").distinct().count() > 5 and sent[1].where("lo = hi").count() < 6 * 1600


def test_tiles_emit_no_pair_lists_and_count_crowds(spark):
    """A crowd of near copies: every pair counted once, over several products and blocks, repeated ids left out."""
    rng = np.random.default_rng(2)
    crowd = (np.ones(8) + 0.01 * rng.normal(size=(1300, 8))).astype(np.float32)
    df = frame(spark, crowd).unionByName(frame(spark, crowd[:1] + 0.001, [5]))
    for block_rows in (4096, 200):
        got = {r["id"]: r["n"] for r in cells.pairs_within(df, 0.1, "degree", block_rows).groupBy("id").agg(F.sum("n").alias("n")).collect()}
        assert got == {i: 2 * 1299 if i == 5 else 1300 for i in range(1300)}
        edges = cells.pairs_within(df, 0.1, "forest", block_rows)
        assert edges.count() < 1301 * 4 and connected_components(edges).select("component").distinct().count() == 1


def test_knn_join_of_spread_vectors_is_one_grid(spark, monkeypatch):
    """Where bounds exclude nothing, queries go to the tiles of one grid, not to every leaf."""
    rng = np.random.default_rng(12)
    spread = rng.normal(size=(1200, 24)).astype(np.float32)
    asked = []
    answers = nearest._answers
    monkeypatch.setattr(nearest, "_answers", lambda *a: asked.append((a[2], a[3])) or answers(*a))
    got = I.knn_join(frame(spark, spread), frame(spark, spread), 5, block_rows=32).select("query_id", "id").collect()
    assert len(asked[-1][0]) == len(asked[-1][1]) == 1
    dots, _ = cosine(spread)
    np.fill_diagonal(dots, -2)
    want = {(q, int(i)) for q, row in enumerate(dots) for i in row.argsort()[-5:]}
    assert {tuple(r) for r in got} == want


def test_knn_grid_has_as_many_parts_as_cores_or_memory_ask_for():
    """Copies of a vector do not grow with the table while a part fits a task."""
    assert [nearest._sides(n, 4096, 64, 12) for n in (4_000, 120_000, 720_000, 1_200_000)] == [1, 6, 7, 7]
    assert nearest._sides(10_000_000, 4096, 64, 12) == 51
