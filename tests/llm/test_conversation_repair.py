"""Conversation repair against a plain dynamic program, on chains of pieces and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightbox.llm import conversation_repair as cr

TURNS = "conv_id long, turn long, role string, text string"
ONWARD = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute(rows):
    """The report of one conversation, given its (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append(
            "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        )
        seen.add((role, text))
    speak = {q: ("assistant", 3) if q == 2 else ("user", 2) for q in range(4)}
    best = {0: (0, "", ()), 3: (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for q, (role, to) in speak.items():
                if to in best:
                    c, e, lines = best[to]
                    best[q] = min(best.get(q, (9**9,)), (c + 3, "I" + e, (role + ":", *lines)))
        return best

    best = inserted(best)
    for (_, role, text), fault in zip(reversed(rows), reversed(faults)):
        now = {}
        for q in range(4):
            ways = [(best[q][0] + 4, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] in ONWARD[q]:
                    c, e, lines = best[ONWARD[q][role[:1]]]
                    ways.append((c + extra, "K" + e, (f"{role}:{text}", *lines)))
                said, to = speak[q]
                c, e, lines = best[to]
                ways.append((c + 3 + extra, "R" + e, (f"{said}:{text}", *lines)))
            now[q] = min(ways)
        best = inserted(now)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, lines = best[0]
    return (
        gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def random_turns(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for turn in range(rng.randint(1, most)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ua"])
            rows.append((c, turn, role, rng.choice(["a.", "b!", "c", "", " \n", "d? ", "é.", "e" * turn])))
    return rows


@pytest.mark.parametrize("bits, fan, most", [(16, 4_096, 12), (3, 4_096, 60), (2, 4, 300)])
def test_repair(spark, monkeypatch, bits, fan, most):
    """Whole conversations in a chunk, conversations over many chunks, and chains of chains."""
    monkeypatch.setattr(cr, "CHUNK_BITS", bits)
    monkeypatch.setattr(cr, "FAN", fan)
    rows = random_turns(most, 900 // most + 3, most)
    got = {r[0]: tuple(r[1:]) for r in cr.repair_report(spark.createDataFrame(rows, TURNS)).collect()}
    want = {c: brute([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_tables():
    """A block lookup equals its turns one by one; costs are those of the plain step."""
    t = cr.tables()
    rng = np.random.default_rng(1)
    for _ in range(200):
        symbols = rng.integers(0, cr.SYMBOLS, cr.BLOCK).astype(np.uint8)
        v = at = int(rng.integers(len(t.vectors)))
        costs = t.vectors[v]
        for s in symbols[::-1].tolist():
            at, costs = int(t.one[at, s]), cr.before(s, costs)
        assert t.block[v, cr.block_codes(symbols)[0]] == at
        assert t.vectors[at] == [c - min(costs) for c in costs]
        assert cr.whole_maps(t, symbols)[v] == at


LONG = "long words " * 200_000
ODD = [
    (1, None, "user", "Hello."), (1, 0, None, "x."), (1, 1, "assistant", None), (1, 2, "assistant", LONG + "."), (1, 2, "assistant", LONG + "."),
    (None, 0, "user", "hi?"), (None, 0, "user", "hi?"), (None, None, None, None), (2, 5, "system", "s."), (3, None, "user", ""),
]


def test_odd_rows(spark):
    """Nulls in any column, very long and repeated texts, ties, clashing columns."""
    turns = spark.createDataFrame(ODD, TURNS).withColumns({c: F.lit(c) for c in ("key", "pos", "k", "edit", "said", "fault", "digest", "symbol", "gaps")})
    got = {r[0]: tuple(r[1:]) for r in cr.repair_report(turns).collect()}
    groups = {}
    for c, turn, role, text in ODD:
        groups.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    for rows in groups.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert got == {c: brute(rows) for c, rows in groups.items()}
    edits = cr.edits(turns).where("conv_id = 1").orderBy("pos", "k").collect()
    assert "".join(e.edit for e in edits) == got[1][6]
    assert [e.text for e in edits if e.edit == "I"] == [""] * got[1][6].count("I")


def test_lost_conversations_and_empty_table(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert cr.repair_report(nothing).count() == 0 and cr.edits(nothing).count() == 0
    left = cr.repair_report(nothing, spark.createDataFrame(ODD, TURNS)).collect()
    assert len(left) == 4
    assert all(tuple(r[1:]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in left)


def test_hot_conversation(spark, monkeypatch):
    """One conversation with most rows is cut into pieces that tasks solve apart."""
    monkeypatch.setattr(cr, "CHUNK_BITS", 10)
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 15_000, 1).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"),
    )
    hot = cr.repair_report(rows).where("conv_id = 1").first()
    assert hot.audit == "K" * 15_000 and hot.cost == 0
    packed = cr.chunks(cr.ordered_turns(rows))
    assert packed.agg(F.max(F.length("symbols"))).first()[0] <= 1024
