import random

import pytest
from pyspark.sql import functions as F

from lightbox.operators import export as M
from lightbox.operators import catalog as C
from lightbox.plans.ordered import greedy_segments, positions, ranked_slice, running
from lightbox.streaming import windows as W


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(5)
    sizes = {"hot": 400, "b": 30, "one": 1, "c": 90}
    return [
        (plan, i, rnd.choice([0, 1, 5, 9, 30, 120, 7]), 3 * i + rnd.randint(0, 2))
        for plan, n in sizes.items() for i in range(n)
    ]


def fold(items, step):
    """(segment, rank) of every item by the sequential rule."""
    out, plan, state = {}, None, None
    for p, pos, size, at in sorted(items):
        if p != plan:
            plan, state, segment, rank = p, None, 0, 0
        opened, state = step(state, size, at)
        segment, rank = (segment + 1, 1) if opened else (segment, rank + 1)
        out[p, pos] = (segment, rank)
    return out


def by_size(span):
    def step(filled, size, at):
        if filled is None or filled + size > span:
            return True, size
        return False, filled + size
    return step


def by_time(span):
    def step(start, size, at):
        return (True, at) if start is None or at - start > span else (False, start)
    return step


@pytest.mark.parametrize("fold_rows", [10_000, 50, 9])
@pytest.mark.parametrize("mode, step, span", [("size", by_size, 40), ("at", by_time, 100)])
def test_segments_equal_the_sequential_rule(spark, items, fold_rows, mode, step, span):
    df = spark.createDataFrame(items, "plan string, pos long, size long, at long").repartition(7)
    got = greedy_segments(df, ["plan"], ["pos"], span, fold_rows=fold_rows, **{mode: mode})
    assert {(r["plan"], r["pos"]): (r["segment"], r["rank"]) for r in got.collect()} == fold(items, step(span))


def test_running_over_a_hot_group(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("g"),
        "id", (F.col("id") % 5).alias("v"),
    ).repartition(5)
    got = running(df, ["g"], [F.col("id").desc()], F.col("v")).collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r["g"], -r["id"])):
        n, total = seen.get(r["g"], (0, 0))
        seen[r["g"]] = n + 1, total + r["v"]
        assert (r["position"], r["total"]) == seen[r["g"]]
    assert sorted(r["sequence"] for r in got) == list(range(1, 2001))


def test_positions_without_groups(spark):
    df = spark.range(100).repartition(4)
    for fold_rows in (1000, 10):
        got = positions(df, [], [F.col("id").desc()], "n", fold_rows).collect()
        assert len(got) == 100 and all(r["n"] == 100 - r["id"] for r in got)


def test_entry_names(spark, rows):
    names = ["a.jpg", "a.jpg", "../a.jpg", "a_1.jpg", "b", "b", "x.tar.gz", "x.tar.gz"]
    df = spark.createDataFrame([("p", i, i, n) for i, n in enumerate(names)], "plan string, pos long, id long, original_filename string")
    got = [r["entry_name"] for r in M.unique_entry_names(df).orderBy("pos").collect()]
    assert got == ["a.jpg", "a_1.jpg", "..a.jpg", "a_1.jpg", "b", "b_1", "x.tar.gz", "x.tar_1.gz"]


def test_plan_names_and_oversized_items(spark, rows):
    df = spark.createDataFrame(
        [("p", 0, 10, 50), ("p", 1, 11, 500), ("p", 2, 12, 60), ("p", 3, 13, 40), ("q", 0, 14, 1)],
        "plan string, pos long, id long, size_bytes long",
    )
    names = spark.createDataFrame([("p", "P"), ("q", "Q")], "plan string, base_name string")
    parts, members = M.export_plan(df, names, "T", cap=100)
    assert rows(parts, "plan", "part", "filename", "size_estimate") == [
        ("p", 1, "P_part1_T.zip", 50), ("p", 2, "P_part2_T.zip", 500), ("p", 3, "P_part3_T.zip", 100),
        ("q", 1, "Q_T.zip", 1),
    ]
    assert rows(members, "id", "part") == [(10, 1), (11, 2), (12, 3), (13, 3), (14, 1)]


@pytest.mark.parametrize("fold_rows", [10_000, 5])
def test_attempt_windows_reset_after_whole_seconds(spark, fold_rows):
    start = 1_700_000_000_000_000
    offsets = [0] * 12 + [300, 300.9, 301, 302]
    df = spark.createDataFrame([("ip", i, start + int(o * 1_000_000)) for i, o in enumerate(offsets)], "ip string, seq long, us long")
    df = df.select("ip", "seq", F.timestamp_micros("us").alias("ts"))
    got = [r["allowed"] for r in W.attempt_limiter(df, "ip", fold_rows=fold_rows).orderBy("seq").collect()]
    assert got == [True] * 10 + [False] * 4 + [True, True]


@pytest.mark.parametrize("fold_rows", [10_000, 3])
def test_gap_sessions(spark, fold_rows):
    rnd = random.Random(2)
    events = [(rnd.choice("ab"), rnd.randint(0, 400_000)) for _ in range(300)]
    df = spark.createDataFrame(events, "k string, ms long").select("k", F.timestamp_millis("ms").alias("ts"))
    want = []
    for k in "ab":
        times = sorted(ms for key, ms in events if key == k)
        run = [times[0]]
        for t in times[1:] + [None]:
            if t is None or t - run[-1] > 2000:
                want.append((k, run[0] * 1000, run[-1] * 1000, len(run)))
                run = []
            run.append(t)
    got = W.gap_sessions(df, ["k"], 2000, fold_rows=fold_rows).collect()
    assert sorted((r["k"], r["started_us"], r["last_us"], r["n"]) for r in got) == sorted(want)


@pytest.mark.parametrize("fold_rows", [1000, 5])
def test_null_keys_stay_on_every_path(spark, fold_rows):
    rows = spark.range(40).select(
        F.when(F.col("id") % 2 == 0, "a").alias("k"), F.col("id").alias("pos"), F.lit(3).cast("long").alias("size"),
        F.timestamp_seconds(F.col("id") * 1000).alias("ts"),
    )
    got = positions(rows, ["k"], [F.col("pos")], fold_rows=fold_rows).collect()
    assert sorted((str(r.k), r.position) for r in got) == sorted((k, i) for k in ("a", "None") for i in range(1, 21))
    cut = greedy_segments(rows, ["k"], ["pos"], 10, size="size", fold_rows=fold_rows).collect()
    assert sorted((str(r.k), r.segment, r.rank) for r in cut) == sorted(
        (k, i // 3 + 1, i % 3 + 1) for k in ("a", "None") for i in range(20)
    )
    assert W.gap_sessions(rows, ["k"], 500, fold_rows=fold_rows).count() == 40


def test_ranked_slice(spark):
    """Slices over block borders, of hot, small and null groups, with ties on the key; beyond the end nothing."""
    rnd = random.Random(8)
    groups = {"hot": 900, "b": 30, None: 120, "one": 1}
    data = [(g, i, rnd.randint(0, 5)) for g, n in groups.items() for i in range(n)]
    frame = spark.createDataFrame(data, "g string, id long, k long").repartition(5)
    order = [F.col("k").desc(), F.col("id").asc()]
    for first, last in ((0, 3), (28, 33), (110, 130), (640, 700), (899, 950), (2_000, 2_010)):
        want = []
        for g in groups:
            ordered = sorted(((k, i) for h, i, k in data if h == g), key=lambda r: (-r[0], r[1]))
            want += [(g, i, k, n) for n, (k, i) in enumerate(ordered, 1) if first < n <= last]
        got = [tuple(r) for r in ranked_slice(frame, ["g"], order, first, last).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        whole = sorted(((k, g, i) for g, i, k in data), key=lambda r: (-r[0], str(r[1]), r[2]))
        flat = ranked_slice(frame, [], [F.col("k").desc(), F.coalesce("g", F.lit("None")), F.col("id")], first, last)
        assert sorted((r["rank"], r["g"], r["id"]) for r in flat.collect()) == [
            (n, g, i) for n, (k, g, i) in enumerate(whole, 1) if first < n <= last
        ]


def test_deep_pages(spark):
    """Deep and shallow ways agree; the ranking of a deep page reads blocks, not what lies before it."""
    items = spark.range(4_000).select(
        "id", (F.col("id") % 17).alias("size_bytes"), F.timestamp_seconds(F.col("id") % 400).cast("timestamp_ntz").alias("original_date")
    )
    members = items.select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 50)).alias("folder_id"), F.col("id").alias("media_id"))
    for sort_by, ascending in (("date", False), ("size", True)):
        for page in (1, 9, 20, 21):
            ways = [[r.id for r in C.page(items, page, 200, sort_by, ascending, deep_rows=d).collect()] for d in (0, 10**9)]
            assert ways[0] == ways[1] and len(ways[0]) == (200 if page < 21 else 0)
        ways = [
            sorted((r.folder_id, r["rank"], r.id) for r in C.page_per_folder(items, members, 5, 200, sort_by, ascending, deep_rows=d).collect())
            for d in (0, 10**9)
        ]
        assert ways[0] == ways[1] and len(ways[0]) == 200
