"""Conversation repair at least cost, by Four-Russians block tables.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Four states
say how far a sound prefix has come: nothing yet, after the system turn, after a user
turn, after an assistant turn. The least costs from each state to the end form a
vector of four; less its minimum, it is one of a few dozen *normalised* vectors. For every
such vector and every block of ``BLOCK`` turn symbols a table holds the vector before the
block, so costs pass a block in one lookup. Edits are then traced forward: each block
is expanded backward, turn by turn, from the vector behind it, and every step takes the
least initial that the costs allow, which makes ties exact.

A long conversation is many pieces of at most ``2 ** CHUNK_BITS`` turns. A piece is a function on
vectors (and, once its last vector is known, on states), so pieces are solved apart and
chained by :func:`entered`, level upon level. No task holds a conversation as a whole.

Nulls: a null role or text counts as one space, a null turn sorts first, null
conversations are one conversation. Turns are ordered by turn, role, the first 64
characters of the text and its SHA-256; equal rows are repeats of one another. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightbox.session import durable

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 20
# States: 0 nothing, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
KEPT = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}  # (role, state): next state
TURN = (2, 2, 3, 2)  # where an inserted or rerolled turn leads to
SPOKEN = {2: "user", 3: "assistant"}
SYMBOLS = 9  # 0: must go; else 1 + 2 * role + truncated, with the roles s, u, a, other
BLOCK = 4
CHUNK_BITS = 16
FAN = 4_096  # pieces of one conversation chained in one task
SPACES = " \t\n\x0b\x0c\r"


def closed(costs: list[int]) -> list[int]:
    """Costs with insertions allowed first; two in a row are enough."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[TURN[q]]) for q, c in enumerate(costs)]
    return costs


def before(symbol: int, after: list[int]) -> list[int]:
    """Costs before a turn, from those behind it."""
    out = [DELETE + c for c in after]
    if symbol:
        role, extra = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        for q in range(4):
            out[q] = min(out[q], REROLE + extra + after[TURN[q]])
            if (role, q) in KEPT:
                out[q] = min(out[q], extra + after[KEPT[role, q]])
    return closed(out)


def traced(symbol: int, after: list[int], state: int) -> tuple[str, int, int]:
    """(initials, next state, cost) of the least edits at one turn, insertions before it included."""
    role, extra = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
    costs, edits, paid = before(symbol, after), "", 0
    while True:
        rest = costs[state]
        if rest == DELETE + after[state]:
            return edits + "D", state, paid + DELETE
        if rest == INSERT + costs[TURN[state]]:
            edits, state, paid = edits + "I", TURN[state], paid + INSERT
        elif (role, state) in KEPT and rest == extra + after[KEPT[role, state]]:
            return edits + "K", KEPT[role, state], paid + extra
        else:
            return edits + "R", TURN[state], paid + REROLE + extra


@dataclass
class Tables:
    """Vectors, and the vector before each symbol and before each block, by the vector behind it."""

    vectors: list[list[int]]
    one: np.ndarray
    block: np.ndarray
    trace: list[list[list[tuple[str, int, int]]]]


END = 0  # the vector at the end of a conversation


def tables(block: int = BLOCK) -> Tables:
    """All normalised vectors that the end can lead to, and their transitions."""
    low = lambda v: [c - min(v) for c in v]
    vectors = [low(closed([0, FAR, FAR, 0]))]
    number, rows = {tuple(vectors[0]): 0}, []
    for v in vectors:  # grows as it is read
        row = []
        for symbol in range(SYMBOLS):
            found = low(before(symbol, v))
            row.append(number.setdefault(tuple(found), len(vectors)))
            if row[-1] == len(vectors):
                vectors.append(found)
        rows.append(row)
    one = np.array(rows, np.int16)
    table = np.arange(len(vectors), dtype=np.int16)[:, None]
    for _ in range(block):
        # The new symbol comes first in the block, so it is the last to be passed.
        table = one[table].transpose(0, 2, 1).reshape(len(vectors), -1)
    trace = [[[traced(s, v, q) for q in range(4)] for s in range(SYMBOLS)] for v in vectors]
    return Tables(vectors, one, table, trace)


def block_codes(symbols: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Codes of whole blocks; the first symbol of a block weighs most."""
    weights = SYMBOLS ** np.arange(block - 1, -1, -1)
    return symbols[: len(symbols) // block * block].reshape(-1, block).astype(np.int64) @ weights


def marks(t: Tables, symbols: np.ndarray, vector: int) -> list[int]:
    """Vectors at the block borders of a piece, first to last, given the one behind it."""
    whole = len(symbols) // BLOCK * BLOCK
    for s in symbols[whole:][::-1].tolist():
        vector = int(t.one[vector, s])
    out = [vector]
    block = t.block
    for code in block_codes(symbols)[::-1].tolist():
        out.append(int(block[out[-1], code]))
    return out[::-1]


def whole_maps(t: Tables, symbols: np.ndarray) -> np.ndarray:
    """The vector before a piece for every vector behind it."""
    at = np.arange(len(t.vectors), dtype=np.int16)
    whole = len(symbols) // BLOCK * BLOCK
    for s in symbols[whole:][::-1].tolist():
        at = t.one[at, s]
    for code in block_codes(symbols)[::-1].tolist():
        at = t.block[at, code]
    return at


def edits_of(t: Tables, symbols: np.ndarray, vector: int, state: int) -> tuple[list[tuple[str, int]], int]:
    """(initials, state before them) of every turn of a piece, and the state behind it."""
    out = []
    borders = marks(t, symbols, vector)
    listed = symbols.tolist()
    for i in range(0, len(listed), BLOCK):
        part = listed[i : i + BLOCK]
        # Expand the block backward from the vector behind it.
        behind = [borders[i // BLOCK + 1] if len(part) == BLOCK else vector]
        for s in part[:0:-1]:
            behind.append(int(t.one[behind[-1], s]))
        for s, v in zip(part, reversed(behind)):
            initials, following, _ = t.trace[v][s][state]
            out.append((initials, state))
            state = following
    return out, state


def tail_of(state: int) -> str:
    """Insertions that a conversation ending in this state still needs."""
    return {1: "II", 2: "I"}.get(state, "")


def key_of(conv_id: Column) -> Column:
    """A string that is never null and differs for different identifiers, null included."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pos, key, conv_id, turn, role, text, digest, symbol, fault): turns in order, written once.

    Range-partitioned by conversation and order, so a conversation of any length spreads
    over many tasks; ``pos`` rises along the order and never changes.
    """
    space = F.lit(" ")
    base = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
    )
    base = base.select(key_of(F.col("conv_id")).alias("key"), "*", F.unhex(F.sha2("text", 256)).alias("digest"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), "digest"]
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    sorted_rows = base.repartitionByRange(*order).sortWithinPartitions(*order)
    faulty = sorted_rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("fault", fault)
    symbol = F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "truncated", 2 + 2 * number).otherwise(1 + 2 * number)
    return durable(faulty.withColumn("symbol", symbol.cast("int")))


def chunks(rows: DataFrame) -> DataFrame:
    """(chunk, keys, heads, symbols): the turn symbols of up to 65,536 consecutive rows in one row.

    ``heads`` are the offsets at which conversations begin, ``keys`` those conversations, led by
    the one that goes on from the chunk before, if any. A turn said before (role and text) must go.
    """
    firsts = rows.where("fault is null or fault <> 'blank'").groupBy("key", "role", "digest").agg(F.min("pos").alias("pos"))
    heads = rows.groupBy("key").agg(F.min("pos").alias("pos"))
    known = firsts.select("pos", F.lit(1).alias("first"), F.lit(0).alias("head")).unionByName(
        heads.select("pos", F.lit(0).alias("first"), F.lit(1).alias("head"))
    ).groupBy("pos").agg(F.max("first").alias("first"), F.max("head").alias("head"))
    said = rows.select("pos", "key", "symbol").join(known, "pos", "left").select(
        F.shiftright("pos", CHUNK_BITS).alias("chunk"), "pos", "key",
        F.when(F.col("first") == 1, F.col("symbol")).otherwise(0).alias("symbol"),
        (F.coalesce("head", F.lit(0)) == 1).alias("head"),
    )

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        head = np.flatnonzero(table.column("head").to_numpy())
        at = head if len(head) and head[0] == 0 else np.concatenate([[0], head])
        return pa.table({
            "chunk": table.column("chunk")[:1], "keys": pa.array([table.column("key").take(pa.array(at)).to_pylist()]),
            "heads": pa.array([head.tolist()], pa.list_(pa.int32())),
            "symbols": pa.array([table.column("symbol").to_numpy().astype(np.uint8).tobytes()], pa.binary()),
        })

    return durable(said.groupBy("chunk").applyInArrow(pack, "chunk long, keys array<string>, heads array<int>, symbols binary"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, list[tuple[int, int]]]]:
    """Rows of :func:`chunks` with their symbols and the bounds of their conversations' pieces."""
    for batch in batches:
        for row in batch.to_pylist():
            symbols = np.frombuffer(row["symbols"], np.uint8)
            cuts = [*row["heads"], len(symbols)]
            cuts = cuts if cuts[0] == 0 else [0, *cuts]
            yield row, symbols, list(zip(cuts[:-1], cuts[1:]))


def entered(maps: DataFrame, start: int | None = None) -> DataFrame:
    """(key, no, at): where each map is entered when a key's maps are applied in the order of ``no``.

    ``maps`` has (key, no, to: array<int>); the first one is entered at ``start``. Runs of
    ``FAN`` numbers and more are composed first and chained among themselves, level upon level.
    """
    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        at = start if "at" not in table.column_names else table.column("at")[0].as_py()
        out = []
        for to in table.column("to").to_pylist():
            out.append(at)
            at = to[at]
        return pa.table({"key": table.column("key"), "no": table.column("no"), "at": pa.array(out, pa.int32())})

    most = maps.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= FAN:
        return maps.groupBy("key").applyInArrow(walk, "key string, no long, at int")

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        at = None
        for to in table.column("to").to_pylist():
            at = to if at is None else [to[a] for a in at]
        return pa.table({"key": table.column("key")[:1], "no": table.column("parent")[:1], "to": pa.array([at], pa.list_(pa.int32()))})

    # Numbers carry the partition above bit 33 - CHUNK_BITS: fold those first, then runs of FAN.
    shift = 33 - CHUNK_BITS if maps.where(f"abs(no) >= {1 << (33 - CHUNK_BITS)}").take(1) else FAN.bit_length() - 1
    grouped = maps.withColumn("parent", F.shiftright("no", shift))
    above = durable(grouped.groupBy("key", "parent").applyInArrow(compose, "key string, no long, to array<int>"))
    inside = entered(above, start).withColumnRenamed("no", "parent")
    return grouped.join(inside, ["key", "parent"]).groupBy("key", "parent").applyInArrow(walk, "key string, no long, at int")


def plan(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """(pos, key, k, edit, said): the edits in order. ``k`` counts those at one turn; insertions
    behind the last turn belong to it. ``said`` is the role that an insertion or rerole gives."""
    t = tables()

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, symbols, bounds in _pieces(batches):
            # The pieces at the borders; those between them are whole conversations.
            sides = [0] if len(bounds) == 1 else [0, len(bounds) - 1]
            yield pa.record_batch({
                "key": pa.array([row["keys"][i] for i in sides]), "no": pa.array([-row["chunk"]] * len(sides), pa.int64()),
                "to": pa.array([whole_maps(t, symbols[slice(*bounds[i])]).tolist() for i in sides], pa.list_(pa.int32())),
            })

    maps = durable(packed.mapInArrow(backward, "key string, no long, to array<int>"))
    ends = durable(entered(maps, END))
    # At most two border pieces a chunk; a conversation has one piece there.
    sides = ends.groupBy(F.negative("no").alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct("key", "at"))).alias("ends"))
    bounded = packed.join(sides, "chunk")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, symbols, bounds in _pieces(batches):
            known = dict(row["ends"])
            sides = [0] if len(bounds) == 1 else [0, len(bounds) - 1]
            to = [
                [edits_of(t, symbols[slice(*bounds[i])], known[row["keys"][i]], q)[1] for q in range(4)] for i in sides
            ]
            yield pa.record_batch({
                "key": pa.array([row["keys"][i] for i in sides]), "no": pa.array([row["chunk"]] * len(sides), pa.int64()),
                "to": pa.array(to, pa.list_(pa.int32())),
            })

    starts = durable(entered(durable(bounded.mapInArrow(forward, "key string, no long, to array<int>")), 0))
    entries = starts.groupBy(F.col("no").alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct("key", "at"))).alias("starts"))
    # A conversation ends in its last chunk.
    lasts = ends.groupBy("key").agg(F.max(F.negative("no")).alias("chunk")).groupBy("chunk").agg(F.collect_list("key").alias("closing"))
    solved = bounded.join(entries, "chunk").join(lasts, "chunk", "left")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, symbols, bounds in _pieces(batches):
            ends, starts, closing = dict(row["ends"]), dict(row["starts"]), set(row["closing"] or ())
            base = row["chunk"] << CHUNK_BITS
            pos, keys, ks, edits, said, gone = [], [], [], [], [], []
            for i, (a, b) in enumerate(bounds):
                key = row["keys"][i]
                side = i in (0, len(bounds) - 1)
                out, state = edits_of(t, symbols[a:b], ends[key] if side else END, starts[key] if side else 0)
                if not side or key in closing:
                    initials, q = out[-1]
                    out[-1] = (initials + tail_of(state), q)
                for j, (initials, q) in enumerate(out):
                    for k, edit in enumerate(initials):
                        pos.append(base + a + j)
                        keys.append(key)
                        ks.append(k)
                        edits.append(edit)
                        gone.append(symbols[a + j] == 0)
                        if edit in "IR":
                            q = TURN[q]
                            said.append(SPOKEN[q])
                        else:
                            said.append(None)
                            if edit == "K":
                                s = int(symbols[a + j])
                                q = KEPT[(s - 1) // 2, q]
            yield pa.record_batch({
                "pos": pa.array(pos, pa.int64()), "key": pa.array(keys, pa.string()), "k": pa.array(ks, pa.int32()),
                "edit": pa.array(edits, pa.string()), "said": pa.array(said, pa.string()),
                "gone": pa.array(gone, pa.bool_()),
            })

    return solved.mapInArrow(expand, "pos long, key string, k int, edit string, said string, gone boolean")


def edits(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits of all conversations, one row each: (key, conv_id, pos, k, edit, fault, turn, role, said, text).

    ``edit`` is K, R, D or I. ``role`` is the role as found (null for insertions), ``said`` the one after
    the edit (null for deletions), ``text`` the turn's (empty for insertions). ``fault`` is a turn's
    first fault: blank, duplicate or truncated. The rows with a role ``said`` are the repaired
    conversation. All rows of a conversation are in one partition, in order, for folds that
    stream over it; it is never held in memory.
    """
    rows = ordered_turns(turns, conv_id, turn, role, text)
    found = ["conv_id", "turn", "role", "text", "fault"]
    decided = plan(rows, chunks(rows))
    typed = {f.name: f.dataType for f in rows.schema.fields}
    merged = rows.select(
        "key", "pos", F.lit(-1).alias("k"), *[F.lit(None).cast("string").alias(c) for c in ("edit", "said")], F.lit(False).alias("gone"), *found
    ).unionByName(decided.select("key", "pos", "k", "edit", "said", "gone", *[F.lit(None).cast(typed[c]).alias(c) for c in found]))

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["k"] < 0:
                    current = row
                elif row["edit"] == "I":
                    out.append(row | {"conv_id": current["conv_id"], "text": ""})
                else:
                    fault = "duplicate" if row["gone"] and current["fault"] != "blank" else current["fault"]
                    said = current["role"] if row["edit"] == "K" else row["said"]
                    out.append(row | {c: current[c] for c in found} | {"fault": fault, "said": said})
            yield pa.RecordBatch.from_pylist(out, batch.schema).select(names)

    names = ["key", "conv_id", "pos", "k", "edit", "fault", "turn", "role", "said", "text"]
    schema = merged.select(names).schema
    return merged.repartition("key").sortWithinPartitions("key", "pos", "k").mapInArrow(attach, schema)


REPORT = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PRICE = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
FOLLOWS = {"su", "ua", "au"}


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its edits in order. A SHA-256 can only be taken in sequence."""
    columns = [c.split()[0] for c in REPORT.split(", ")]
    kinds = pa.schema([(c, pa.string() if c in ("key", "audit", "repaired_sha256") else pa.int64()) for c in columns])
    now, count, audit, digest, last, spoken = None, {}, [], None, None, False

    def closing():
        return count | {"key": now, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for key, edit, fault, role, said, text in zip(*[batch.column(c).to_pylist() for c in ("key", "edit", "fault", "role", "said", "text")]):
            if digest is None or key != now:
                if digest is not None:
                    out.append(closing())
                now, audit, digest, last, spoken = key, [], hashlib.sha256(), None, False
                count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            audit.append(edit)
            count["cost"] += PRICE[edit]
            if edit != "I":
                if last is not None and last + role[:1] not in FOLLOWS:
                    count["illegal"] += 1
                last = role[:1]
                if fault:
                    count[fault] += 1
                    if fault == "truncated" and edit != "D":
                        count["cost"] += TRUNCATED
            if said is not None:
                digest.update(f"{chr(10) * spoken}{said}:{text}".encode())
                spoken = True
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([closing()], kinds)


def repair_report(turns: DataFrame, everyone: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per conversation: conv_id, gaps, faults, illegal neighbours, cost, audit and the repaired text's SHA-256.

    ``everyone`` lists conversations (column ``conv_id``) that may have no turns left.
    """
    report = edits(turns, conv_id, turn).mapInArrow(_folded, REPORT)
    stays = turns.groupBy(key_of(F.col(conv_id)).alias("key")).agg(
        F.max(turn).cast("decimal(20)").alias("most"), F.min(turn).cast("decimal(20)").alias("least"),
        F.countDistinct(turn).cast("decimal(20)").alias("seen"),
    ).select("key", F.coalesce((F.col("most") - F.col("least") + 1 - F.col("seen")), F.lit(0)).try_cast("long").alias("gaps"))
    ids = (turns if everyone is None else everyone).select(F.col(conv_id).alias("conv_id")).distinct()
    out = ids.withColumn("key", key_of(F.col("conv_id"))).join(stays, "key", "left").join(report, "key", "left")
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the CRC-32 of ``conv_id:turn`` (null: one space) modulo 20.

    0 drops a row, 1 empties its text, 2 removes sentence marks, 3 repeats it, 4 gives it the role user.
    """
    space = F.lit(" ")
    hit = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), hit.alias("hit")).where("hit <> 0")
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")
