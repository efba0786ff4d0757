"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Every source's documents are shuffled by a hash and cut into blocks of equal token
counts. Points of the golden-ratio sequence, mapped through the cumulative slot
weights, say which source each slot of the schedule takes; slots are ranked per
source, and the r-th slot takes the r-th block, starting over after the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightbox.session import durable

BLOCK_WORDS = 256
# Blocks of one source at most, so that positions times blocks fit 64 bits up to 7e13 words.
MAX_BLOCKS = 131_072
PASSES = 3
CHUNK = 1_024
# Columns of :func:`mix` and :func:`stream`; a carried column of such a name gets another.
OWN_COLUMNS = (
    "doc_id", "source", "size", "source_size", "target", "taken", "slices", "slot", "rank", "offset", "begin", "end",
)
# Fixed value: the fractional part of the golden ratio.
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(spaced, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES) -> DataFrame:
    """(source, source_size, target): shares of the whole by weight, none above ``passes`` times its source.

    ``sizes`` has source and source_size, one row per source. Sources in the
    order of their names, null last, take ``weights`` in turn. Resharing an
    excess by weight ends at one level: target = min(passes * size, level * weight).
    The level is found over the sources in the order of size per weight. One
    window holds one row per source.
    """
    names = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    numbered = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % len(weights) + 1))
    ).withColumn("cap", F.lit(passes) * F.col("source_size"))
    whole = Window.partitionBy(F.lit(0))
    filling = whole.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    )
    # The first source in this order whose cap is not below the level fixes it for all from there on.
    levelled = numbered.withColumn("level", level)
    fits = F.col("cap") >= F.col("level") * F.col("weight")
    final = F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(whole)
    target = F.when(
        final.isNotNull() & (F.col("cap") / F.col("weight") >= final["at"]), final["level"] * F.col("weight")
    ).otherwise(F.col("cap").cast("double"))
    return levelled.withColumn("target", target).select("source", "source_size", "weight", "target")


def _plan(targets: DataFrame, block_words: int) -> DataFrame:
    """Blocks, words to take and slots of every source, with its place in the cumulative slot weights."""
    size, goal = F.col("source_size"), F.col("goal")
    planned = targets.withColumn("goal", F.round("target").cast("long")).withColumn(
        "blocks", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.expr(f"source_size div {block_words}"))).cast("long")
    )
    safe = F.greatest(size, F.lit(1))
    planned = planned.withColumn("full", F.floor(goal / safe).cast("long")).withColumn("rest", goal - F.col("full") * safe)
    planned = planned.withColumn(
        "rest_block", F.when(F.col("rest") > 0, F.expr("((rest - 1) * blocks) div greatest(source_size, 1)"))
    )
    planned = planned.withColumn(
        "slots", F.when(size > 0, F.col("full") * F.col("blocks") + F.coalesce(F.col("rest_block") + 1, F.lit(0))).otherwise(0).cast("long")
    )
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    return planned.withColumns({
        "slots_before": F.coalesce(F.sum("slots").over(before), F.lit(0)).cast("long"),
        "all_slots": F.sum("slots").over(whole).cast("long"),
        "source_no": F.row_number().over(whole.orderBy(F.asc_nulls_last("source"))).cast("long"),
    })


def schedule(plan: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(slot, source_no, rank, block): which block of which source each slot takes.

    Slot i falls to the source whose stretch of the cumulative slot weights holds
    frac((i + 0.5) * golden ratio). A source's ranks beyond its number of slots are
    left out; those it has not reached (a few, by the discrepancy of the
    sequence) follow after the last slot, so every source gets its exact number.
    """
    spark = plan.sparkSession
    total = plan.agg(F.max("all_slots")).first()[0] or 0
    points = spark.range(total).select(
        F.col("id").alias("slot"),
        F.floor(((F.col("id") + 0.5) * GOLDEN % 1.0) * F.lit(total)).cast("long").alias("at"),
    )
    # Stretches are looked up by grid cell: each cell names the stretches that meet it.
    cell = max(1, total // 1_000)
    stretches = plan.where("slots > 0").select("source_no", F.col("slots_before").alias("lo"), (F.col("slots_before") + F.col("slots")).alias("hi"))
    grid = stretches.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))))
    placed = points.withColumn("cell", F.expr(f"at div {cell}")).join(grid, "cell").where("at >= lo and at < hi").select(
        "slot", "source_no", F.expr(f"slot div {chunk}").alias("chunk")
    )
    # Ranks in two steps: totals of whole chunks, then row numbers inside a chunk.
    totals = placed.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = placed.withColumn("row", F.row_number().over(inside)).join(offsets, ["source_no", "chunk"]).select(
        "slot", "source_no", (F.col("offset") + F.col("row")).alias("rank")
    )
    counts = totals.groupBy("source_no").agg(F.sum("n").alias("reached"))
    missing = plan.where("slots > 0").join(counts, "source_no", "left").where(
        F.col("slots") > F.coalesce("reached", F.lit(0))
    ).select(
        F.lit(total).cast("long").alias("slot"), "source_no",
        F.explode(F.sequence(F.coalesce("reached", F.lit(0)) + 1, F.col("slots"))).alias("rank"),
    )
    small = plan.select("source_no", "slots", "blocks")
    return ranked.unionByName(missing).join(small, "source_no").where(F.col("rank") <= F.col("slots")).select(
        "slot", "source_no", "rank", ((F.col("rank") - 1) % F.col("blocks")).alias("block")
    )


def _stream(rows: DataFrame) -> DataFrame:
    """Add ``start``: words before a document in the shuffled stream of its source.

    The order is that of an md5 of id and text. Its leading digits are uniform, so
    they cut any source, however large, into buckets of about equal size; the
    windows hold one bucket, or one total per bucket.
    """
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))
    )
    return joined.withColumn("start", F.col("inner") + F.col("offset")).drop("inner", "offset", "o_source", "o_bucket")


def _slices(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """(row_no, slot, rank, offset, begin, end): the words [begin, end) of a document that a slot takes.

    ``offset`` counts the words of the slot's block before the slice.
    """
    # The blocks that a document reaches into.
    covered = placed.where("size > 0").select(
        "row_no", "source_no", "start", (F.col("start") + F.col("size")).alias("stop"), "source_size", "blocks", "slots", "rest", "rest_block",
        F.explode(F.expr("sequence((start * blocks) div source_size, ((start + size - 1) * blocks) div source_size)")).alias("block"),
    )
    used = covered.join(slots.select("source_no", "block", "slot", "rank"), ["source_no", "block"]).withColumns({
        "block_begin": F.expr("(block * source_size + blocks - 1) div blocks"),
        "block_end": F.expr("((block + 1) * source_size + blocks - 1) div blocks"),
        # The last slot of a source may take only the beginning of its block.
        "partial": (F.col("rank") == F.col("slots")) & F.coalesce(F.col("block") == F.col("rest_block"), F.lit(False)),
    })
    lo = F.greatest("start", "block_begin")
    hi = F.least("stop", "block_end", F.when(F.col("partial"), F.col("rest")))
    return used.where(hi > lo).select(
        "row_no", "slot", "rank", (lo - F.col("block_begin")).alias("offset"), (lo - F.col("start")).alias("begin"), (hi - F.col("start")).alias("end")
    )


def carried_names(carry: tuple[str, ...]) -> list[str]:
    """What carried columns are called in the result: ``size`` becomes ``size_carried``. Case does not tell names apart."""
    used, names = {c.lower() for c in OWN_COLUMNS}, []
    for name in carry:
        while name.lower() in used:
            name += "_carried"
        used.add(name.lower())
        names.append(name)
    return names


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = (), slices: bool = False,
) -> DataFrame:
    """Per row: doc_id, ``carry``, source, size, source_size, target, taken and, if asked for, slices.

    ``slices`` holds a (slot, rank, offset, begin, end) for every time the schedule takes words
    [begin, end) of the document, in the order of slots; :func:`stream` lays them out as rows.
    ``taken`` is their number of words, repeats
    counted: each source's sum is its target rounded to whole words, and no
    document is taken more than three times. Null texts have size 0 and, like
    sources without words, nothing is taken of them. Equal inputs give equal results;
    rows alike in every column may swap theirs. An empty table gives an empty result. Carried columns
    that are called like one of the result's come back under :func:`carried_names`; other columns are not read.
    """
    names = carried_names(carry)
    shuffle = F.md5(F.concat_ws("|", F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    rows = durable(
        docs.select(
            F.monotonically_increasing_id().alias("row_no"), F.col(id).alias("doc_id"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried") if carry else F.lit(0).alias("carried"),
            F.col(source).alias("source"), word_count(F.col(text)).alias("size"), shuffle.alias("shuffle"),
        )
    )
    narrow = rows.drop("carried")
    n = narrow.count()
    # Hexadecimal digits that cut the rows into buckets of some thousands.
    digits = max(1, len(f"{max(1, n // 2_000):x}"))
    narrow = narrow.withColumn("bucket", F.substring("shuffle", 1, digits))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = durable(_plan(source_targets(sizes, weights), block_words))
    slots = durable(schedule(plan))

    per_source = plan.select(
        F.col("source").alias("p_source"), "source_no", "source_size", "target", "blocks", "slots", "rest", "rest_block"
    )
    placed = durable(_stream(narrow).join(per_source, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source"))
    found = [F.sum(F.col("end") - F.col("begin")).cast("long").alias("taken")]
    if slices:
        found.append(F.array_sort(F.collect_list(F.struct("slot", "rank", "offset", "begin", "end"))).alias("slices"))
    out = placed.join(_slices(placed, slots).groupBy("row_no").agg(*found), "row_no", "left")
    if carry:
        out = out.join(rows.select("row_no", "carried"), "row_no")
    kept = ["slices"] if slices else []
    return out.withColumns({"taken": F.coalesce("taken", F.lit(0)).cast("long")} | {c: F.coalesce(c, F.array()) for c in kept}).select(
        "doc_id", *[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(names)], "source", "size", "source_size", "target", "taken", *kept
    )


def stream(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mixed stream itself: one row per slot and document slice, from a :func:`mix` that carries ``text``, with slices.

    Columns are slot, rank, offset, begin and end, the other columns of ``mixed`` but its counts, and
    ``text``, the slice with the white space after its words. The order of the stream is
    (slot, source, rank, offset); only slots after the last drawn one may name several ranks.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), 0)
    counts = {text, "slices", "size", "source_size", "target", "taken"}
    others = [c for c in mixed.columns if c not in counts]

    def pieces(split: Column) -> Column:
        def cut(s: Column) -> Column:
            taken = F.slice(split, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))
            return F.struct(*[s[c].alias(c) for c in ("slot", "rank", "offset", "begin", "end")], F.array_join(taken, "").alias("piece"))

        return F.transform("slices", cut)

    # Slices are cut before rows are made, so no row holds more than its own words; a text is split once.
    cuts = F.flatten(F.transform(F.array(words), pieces))
    rows = mixed.where(F.size("slices") > 0).select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("doc"), F.explode(cuts).alias("cut")
    )
    return rows.select(
        *[F.col(f"cut.{c}") for c in ("slot", "rank", "offset", "begin", "end")],
        *[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(others)], F.col("cut.piece").alias(text),
    )
