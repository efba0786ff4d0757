"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits link when at most ``radius`` bits differ. The bits form
a ring of m = 2 * radius + 1 segments. If at most ``radius`` bits differ, some
chain of consecutive segments keeps every prefix of l segments within the
proportional budget floor(l * radius / m): its first two segments are equal and
at most one bit differs in the next two, so one of those is equal as well. Each
fingerprint is therefore keyed by the 2 * m triples (segment i, segment i + 1, and
either i + 2 or i + 3); fingerprints that share a key are candidates, pruned by the
budgets of the longer prefixes before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lightbox.llm.batches import pieces, whole_row
from lightbox.plans.components import connected_components, forest
from lightbox.session import durable

BITS = 64
# Keys with more distinct fingerprints than this are compared block by block.
BLOCK = 16_384
SHINGLES_AT_ONCE = 65_536
# Crowds of one key are compared in blocks of so many nodes, and one node meets so many in a task.
CROWD = 4_096
BINS = 1_024  # of the signatures that prune the pairs of a crowded key
ROUNDS = 4  # in which each node of such a key is compared with its likeliest partner only
# Rows named by so short a list are joined with it by broadcast (its rows are two longs), so their texts stay in place.
LISTED = 2_000_000
RECALL = 0.998  # of the bands, at the similarity asked for


def band_plan(similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): a pair of Jaccard similarity s shares a band of r min-hashes with probability
    1 - (1 - s ** r) ** bands. The longest rows, five at most, that reach ``recall`` in 32 bands."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    for rows in (5, 4, 3, 2, 1):
        hit = min(similarity**rows, 1 - 1e-9)
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))
        if bands <= 32 or rows == 1:
            return bands, rows


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle in order, repeats included; empty without words.

    A-Z are lower-cased and words are split at ASCII white space. A text of
    fewer words is one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Majority of the XXH64 bits over all word shingles; a text without words has fingerprint 0."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """The columns of ``docs`` but a plain ``text``, and fp, in one pass without a shuffle.

    ``text`` is a column, or a field ``row.name`` of a struct column ``row``.
    """
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in kept]
        for batch, texts in pieces(batches, text):
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(fps)], [*names, "fp"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the 2 * radius + 1 segments that make up the ring."""
    if not 2 <= radius <= 15:
        raise ValueError("the radius must be 2 to 15 bits")
    m = 2 * radius + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def _segment(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def ring_keys(fp, radius: int) -> list:
    """The 2 * m hashed keys (start, choice, three equal segments)."""
    ring = segments(radius)
    m = len(ring)
    return [
        F.xxhash64(F.lit(2 * i + j - 2), *[_segment(fp, *ring[x % m]) for x in (i, i + 1, i + j)])
        for i in range(m) for j in (2, 3)
    ]


def _masks(radius: int) -> list[list[tuple[np.uint64, int]]]:
    """For each start: (bits of the first l segments, their budget), longest prefix last."""
    ring = segments(radius)
    m = len(ring)
    out = []
    for i in range(m):
        mask, chain = 0, []
        for step in range(1, m + 1):
            shift, width = ring[(i + step - 1) % m]
            mask |= ((1 << width) - 1) << shift
            if step >= 4:
                chain.append((np.uint64(mask), step * radius // m))
        out.append(chain)
    return out


def within_chain(a: np.ndarray, b: np.ndarray | np.uint64, chain: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Indices of the pairs that keep every prefix budget; the last budget is the Hamming bound."""
    x = a ^ b
    at = np.arange(len(x))
    for mask, budget in chain:
        ok = np.bitwise_count(x & mask) <= budget
        at, x = at[ok], x[ok]
        if not len(at):
            break
    return at


def _crowd_links(fp: np.ndarray, chain) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect what a crowded key links: every reached fingerprint is
    compared once with all that nothing has reached yet."""
    u, v, rest = [], [], fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            hit = within_chain(rest, here, chain)
            if len(hit):
                u.append(rest[hit])
                v.append(np.full(len(hit), here))
                queue.extend(rest[hit])
                rest = np.delete(rest, hit)
    return u, v


def link_partition(key: np.ndarray, start: np.ndarray, fp: np.ndarray, radius: int, small: int = 48):
    """Edges (u, v) between fingerprints of equal key within ``radius`` bits: a forest of them."""
    chains = _masks(radius)
    order = np.lexsort((fp, key))
    key, start, fp = key[order], start[order], fp[order].view(np.uint64)
    cut = np.flatnonzero(np.diff(key)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
    size = np.repeat(end - begin, end - begin)
    u, v = [], []
    for i in range(len(chains)):
        mine = np.flatnonzero((start == i) & (size <= small) & (size > 1))
        gap, k, f = 1, key[mine], fp[mine]
        while len(mine) > gap:
            same = np.flatnonzero(k[gap:] == k[:-gap])
            if not len(same):
                break
            hit = same[within_chain(f[same], f[same + gap], chains[i])]
            u.append(f[hit + gap])
            v.append(f[hit])
            gap += 1
    for a, b in zip(begin, end):
        if b - a > small:
            x, y = _crowd_links(fp[a:b], chains[start[a]])
            u += x
            v += y
    if not u:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64))


def fingerprint_links(distinct: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints linked by chains of
    at most ``radius`` differing bits. ``distinct`` has one column, fp, without repeats.

    Keys that hold more than ``block`` fingerprints are cut into blocks, and each
    pair of blocks is compared in a task of its own; nothing is left out.
    """
    m = 2 * radius + 1
    rows = distinct.select(F.posexplode(F.array(*ring_keys(F.col("fp"), radius))).alias("slot", "key"), "fp").select(
        "key", F.expr("slot div 2").cast("int").alias("start"), "fp"
    )
    crowded = (
        rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    crowded = durable(crowded)
    if not crowded.isEmpty():
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        split = rows.join(crowded, "key").withColumn("mine", mine).select(
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "mine", "key", "start", "fp"
        ).select(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "start", "fp"
        )
        rows = rows.join(crowded, "key", "left_anti").unionByName(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        columns = [np.concatenate([b.column(i).to_numpy() for b in table]) for i in range(3)]
        u, v = link_partition(*columns, radius)
        yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})

    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * m)
    return rows.repartition(parts, "key").mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest id reachable over links, null only if no row
    of the component has an id. Null and empty texts have fingerprint 0, which
    links like any other. Copies share a fingerprint and are compared once.
    """
    rows = durable(fingerprints(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", shingle))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(nodes.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    named = durable(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "component").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def min_hash_bands(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band: a hash of its number and of the least values of ``rows`` seeded orders; none without shingles."""
    if not len(shingles):
        return np.empty(0, np.int64)
    xor, odd = np.random.default_rng(42).integers(0, 1 << 64, (2, bands * rows, 1), np.uint64)
    odd |= np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2_048):
        values = (shingles[None, at : at + 2_048] ^ xor) * odd
        values ^= values >> np.uint64(29)
        values *= odd
        np.minimum(least, values.min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(bands, rows))]
    return np.array(keys, np.uint64).view(np.int64)


def sketches(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(row_no, doc_id, fp, node, bands) of (row_no, doc_id, text): fingerprint, a hash of the shingle set,
    equal for equal sets, and its min-hash keys, all from one hashing of the text."""
    bands, rows = band_plan(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            fps, nodes, keys = np.empty(len(texts), np.int64), np.empty(len(texts), np.uint64), []
            for i, t in enumerate(texts):
                hashes = shingle_hashes(t, shingle)
                fps[i] = majority(hashes)
                shingles = np.unique(hashes)
                nodes[i] = xxhash.xxh64_intdigest(shingles.tobytes())
                keys.append(min_hash_bands(shingles, bands, rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_no"), batch.column("doc_id"), pa.array(fps), pa.array(nodes.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                ["row_no", "doc_id", "fp", "node", "bands"],
            )

    return docs.mapInArrow(run, "row_no long, doc_id long, fp long, node long, bands array<long>")


def shingle_sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(node, shingles) of docs with node and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, sets)])
            values = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), values.cast(pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def similar_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v, meets) whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    ``meets`` bounds how many partners v has: from ``CROWD`` on its set is copied, so no
    task compares one node with more than about that many others.
    """
    parts = F.ceil(F.col("meets") / CROWD).cast("int")
    salted = pairs.select("u", "v", F.pmod(F.xxhash64("u"), parts).cast("int").alias("part"))
    hubs = pairs.where(F.col("meets") > CROWD).groupBy("v").agg(F.max(parts).alias("parts"))
    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    other = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    copies = other.join(hubs, "v", "left").select(
        "v", "b", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    )
    both = F.size(F.array_intersect("a", "b"))
    return salted.join(one, "u").join(copies, ["v", "part"]).where(
        F.least(F.size("a"), F.size("b")) / F.greatest(F.size("a"), F.size("b")) >= similarity
    ).where(both / (F.size("a") + F.size("b") - both) >= similarity).select("u", "v")


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the least shingle hash in each of ``BINS`` bins, 0 for an empty bin."""
    bins = (shingles % np.uint64(BINS)).astype(np.int64)
    # Sorted hashes: the first one of a bin is its least.
    at, first = np.unique(bins, return_index=True)
    out = np.zeros(BINS, np.uint16)
    out[at] = np.maximum((shingles[first] >> np.uint64(20)).astype(np.uint16), 1)
    return out


def alike(
    one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """(which signatures may belong to sets of ``similarity`` with ``one``, their shares of equal bins).

    The filled bins are a sample of the union, drawn without replacement: a share may lie four standard
    errors below ``similarity`` (3 in 100,000 of the pairs at it lie lower, fewer above). Where every
    element has a bin of its own, the share is the similarity itself.
    """
    filled = ((one != 0) | (others != 0)).sum(axis=1)
    equal = ((one == others) & (one != 0)).sum(axis=1)
    union = (size + sizes) / (1 + similarity)
    left_out = np.maximum(1 - filled / np.maximum(union, 1), 0)
    least = filled * similarity - 4 * np.sqrt(filled * similarity * (1 - similarity) * left_out) - 1
    fits = np.minimum(size, sizes) >= similarity * np.maximum(size, sizes)
    return fits & (equal >= least), equal / np.maximum(filled, 1)


def signatures(sets: DataFrame) -> DataFrame:
    """(node, sig, size) of shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            made = [signature(np.sort(lists[i].values.to_numpy().view(np.uint64))).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary()), lists.value_lengths()], ["node", "sig", "size"])

    return sets.mapInArrow(run, "node long, sig binary, size int")


def _crowd_pairs(rows: DataFrame, similarity: float, likeliest: bool = False) -> DataFrame:
    """(u, v) of the nodes of one key whose labels differ and whose signatures are alike; with ``likeliest``
    only the most alike partner of every node (one in each block). ``rows`` has (key, label, node, sig, size, n).
    A key of more than ``CROWD`` nodes is cut into blocks, whose pairs are compared in tasks of their own."""
    blocks = F.ceil(F.col("n") / CROWD).cast("int")
    placed = rows.withColumns({"mine": F.pmod(F.xxhash64("node"), blocks).cast("int"), "blocks": blocks})
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "mine",
        (F.col("mine") == F.col("other")).alias("own"), "label", "node", "size", "sig",
    )

    def pairs(group: list[tuple]) -> pa.RecordBatch:
        mine, own, label, node, size = (np.array([g[i] for g in group]) for i in range(5))
        sig = np.frombuffer(b"".join(g[5] for g in group), np.uint16).reshape(len(group), BINS)
        best, partner = np.full(len(group), -1.0), np.full(len(group), -1)
        u, v = [], []
        for i in range(len(group) - 1):
            rest = np.flatnonzero((label[i + 1 :] != label[i]) & (own[i] | (mine[i + 1 :] != mine[i]))) + i + 1
            fits, share = alike(sig[i], sig[rest], size[i], size[rest], similarity)
            hit, share = rest[fits], share[fits]
            if not len(hit):
                continue
            if not likeliest:
                u.append(hit)
                v.append(np.full(len(hit), i))
                continue
            better = share > best[hit]
            best[hit[better]], partner[hit[better]] = share[better], i
            if share.max() > best[i]:
                best[i], partner[i] = share.max(), hit[share.argmax()]
        if likeliest:
            u, v = [np.flatnonzero(partner >= 0)], [partner[partner >= 0]]
        a, b = (node[np.concatenate(x)] if x else np.empty(0, np.int64) for x in (u, v))
        return pa.record_batch({"u": pa.array(np.maximum(a, b), pa.int64()), "v": pa.array(np.minimum(a, b), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, group = None, []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if row[0] != cell and group:
                    yield pairs(group)
                    group = []
                cell = row[0]
                group.append(row[1:])
        if group:
            yield pairs(group)

    return spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long").distinct()


def _open(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, n, label) of the keys whose nodes have different labels."""
    known = durable(
        keys.join(labels.withColumnRenamed("id", "node"), "node", "left").select(
            "key", "node", "n", F.coalesce("component", "node").alias("label")
        )
    )
    apart = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return durable(known.join(apart, "key", "left_semi"))


def verified_components(keys: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(id, component) over the nodes that share a key and have similar sets, by chains.

    ``keys`` has (key, node, least, n): the key's least node and its number of nodes. Every node is
    compared with that one first, so the members of a large group of true copies
    meet in a number of pairs linear in its size. In keys whose nodes are not all connected by
    then, each is compared with its likeliest partner of another label, round by round, which
    connects what belongs together in few pairs. What is still apart after that is compared
    wherever signatures are alike, so no link is left out.
    """
    tested = durable(keys.where("node <> least").groupBy(F.col("node").alias("u"), F.col("least").alias("v")).agg(F.max("n").alias("meets")))
    links = durable(similar_links(tested, sets, similarity))
    tested = tested.select("u", "v")
    labels = connected_components(links)
    signed = None
    for step in range(ROUNDS + 1):
        known = _open(keys, labels)
        if known.isEmpty():
            break
        if signed is None:
            signed = durable(signatures(sets.join(known.select("node").distinct(), "node", "left_semi")))
        pairs = _crowd_pairs(known.join(signed, "node"), similarity, step < ROUNDS).join(tested, ["u", "v"], "left_anti")
        pairs = durable(pairs)
        new = durable(similar_links(pairs.withColumn("meets", F.lit(1)), sets, similarity))
        if step < ROUNDS and new.isEmpty():
            # No likeliest partner is similar: the rest is settled in one go.
            tested = durable(tested.unionByName(pairs))
            pairs = durable(_crowd_pairs(known.join(signed, "node"), similarity).join(tested, ["u", "v"], "left_anti"))
            new = durable(similar_links(pairs.withColumn("meets", F.lit(1)), sets, similarity))
            step = ROUNDS
        tested = durable(tested.unionByName(pairs))
        links = durable(links.unionByName(new))
        labels = connected_components(links)
        if step == ROUNDS:
            break
    return labels


def drop_near_copies(
    docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 5, radius: int = 3, similarity: float = 0.8
) -> DataFrame:
    """One row of each group stays, whole: the one with the least id, then any one of equal ids.

    Documents are linked if the sets of their five-word shingles have a Jaccard
    similarity of ``similarity`` or more. Candidates are fingerprints within ``radius`` bits of each other
    and sets that share a min-hash band; all are compared on the sets. Fingerprints alone are too
    coarse: sets of similarity 0.8 are about ten bits apart, and a radius that wide leaves keys
    too short for large corpora. Bands reach 99.8 % of the pairs at ``similarity`` and more above.
    Rows without an id stay only if their group has no other row. Null and empty texts are one group.
    An empty table gives no rows; columns with any names are kept.
    """
    rows = durable(docs.select(whole_row(docs), F.col(id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no")))
    texts = rows.select("row_no", "doc_id", F.col(f"row.`{text}`").alias("text"))
    narrow = durable(sketches(texts, shingle, similarity))
    # Equal sets have equal bands.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_no")).alias("best")
    distinct = durable(narrow.groupBy("node").agg(best, F.min("bands").alias("bands"), F.min("fp").alias("fp")))
    by_fp = distinct.groupBy("fp").agg(F.min("node").alias("node"))
    close = fingerprint_links(durable(by_fp).select("fp"), radius)
    # A linked pair of fingerprints is a key of its own; equal fingerprints share one.
    linked = close.where("u <> v").select(F.xxhash64(F.lit("pair"), "u", "v").alias("key"), F.explode(F.array("u", "v")).alias("fp"))
    ring = linked.join(by_fp, "fp").select("key", "node").unionByName(distinct.select(F.xxhash64(F.lit("same"), "fp").alias("key"), "node"))
    keys = durable(ring.unionByName(distinct.select(F.explode("bands").alias("key"), "node")))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    keys = durable(keys.join(shared, "key"))
    wanted = keys.select("node").distinct().join(distinct, "node").select("node", F.col("best.row_no").alias("row_no"))
    wanted = durable(wanted)
    if wanted.count() <= LISTED:
        wanted = F.broadcast(wanted)
    sets = durable(shingle_sets(texts.select("row_no", "text").join(wanted, "row_no"), "text", shingle))
    nodes = verified_components(keys, sets, similarity)
    winners = (
        distinct.join(nodes.withColumnRenamed("id", "node"), "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("best").alias("best"))
        .select(F.col("best.row_no").alias("row_no"))
    )
    losers = durable(narrow.select("row_no").join(winners, "row_no", "left_anti"))
    if losers.count() <= LISTED:
        losers = F.broadcast(losers)
    return rows.join(losers, "row_no", "left_anti").select("row.*")
