"""Personal data: base spans against re, the vote model against brute force, added spans, odd rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightbox.llm import pii

DOCS = "doc_id long, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }
            if fits[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def row_of(doc_id, text):
    found = brute(text or "")
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (doc_id, *[sum(f[0] == k for f in found) for k in PLAIN], hashlib.sha256(listed.encode()).hexdigest())


def key(row):
    return tuple((v is None, v) for v in row)


def compared(spark, texts):
    rows = list(enumerate(texts))
    out = pii.personal_data(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted((row_of(*r) for r in rows), key=key)
    for r in out:
        assert {f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id])} <= set(r.spans.split(","))
    return {r.doc_id: r.spans for r in out}


def test_base(spark):
    """Every base pattern on tricky neighbours: refused runs, matches that touch, wide characters, controls."""
    compared(spark, [
        "a@b.c_d@e.f.g@h.i", "x..y@z.-.q", "@a.b a@ b@c d@e.", "1.2.3.4.5.6.7.8.9", "999.1.1.1.1 256.1.1.1 0.0.0.0 001.002.0003.4",
        "4111 1111 1111 1111", "4111-1111 11111111-5500-0000-0000-0004", "5500000000000004x378282246310005", "7" * 40,
        "+1 (555) 555-1234 190.12.33.44", "+12 +123456789 +1--------2 +1 234 567 890 123 456", "++49 30 123456+49 30 1234567",
        "🦊ü a@b.co 文字 192.168.0.1\x01\x02 4111111111111111 $0 \\1 $1", "mail me: é@b.c", "+1(((((((((((2", "", " ",
    ])


def test_base_on_random_texts(spark):
    rng = random.Random(5)
    parts = ["a", "B9", "@", ".", "..", "-", " ", "+", "4111111111111111", "1", "255", "256", "0", "(", ")", "com", "_", "%", "é", "378282246310005", "\n"]
    compared(spark, ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(600)])


def test_long_texts(spark):
    """Runs of hundreds of thousands of characters take linear time and no deep recursion."""
    n = 400_000
    texts = ["7" * n, "a" * n, "a@b" + ".c" * n, "1." * n, "1 " * n, "+1" + " (" * n, "@a" * n, "x@y.zz " * 20_000]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    want = {
        2: [f"email:0:{2 * n + 3}"], 3: [f"ip:{8 * i}:{8 * i + 7}" for i in range(n // 4)],
        7: [f"email:{7 * i}:{7 * i + 6}" for i in range(20_000)],
    }
    for i in out:
        assert out[i].spans == ",".join(want.get(i, []))


def test_added_spans(spark):
    """Looser forms beside sound neighbours are added whole; numbers that fail their check are not."""
    rng = random.Random(2)
    good = [f"reach {w}.{i}@mail.example.com or +1 (555) 555-{1000 + i}" for i, w in enumerate(["ann", "bob", "eve", "kim"] * 10)]
    bad = [f"order 9{rng.randint(10**14, 10**15 - 1)} was {rng.randint(300, 900)}.400.1.2 of" for _ in range(60)]
    bad = [t for t in bad if not brute(t)]
    new = ["email: jane [at] example [dot] com", "tel: 555-123-4567 please", "call (0555) 123 4567", "card 4111.1111.1111.1111 ok", "ip 2001:db8:0:0:0:0:0:1 is"]
    texts = good + bad + new
    spans = compared(spark, texts)
    for i, t in enumerate(texts):
        extra = set(filter(None, spans[i].split(","))) - {f"{k}:{a}:{b}" for k, a, b in brute(t)}
        assert len(extra) == (t in new), (t, spans[i])
    kind, a, b = spans[len(texts) - 5].split(":")
    assert (kind, texts[-5][int(a) : int(b)]) == ("email", "jane [at] example [dot] com")


def test_reliabilities():
    """Expectation-maximisation recovers the classes that made the votes; the likelihood is Bayes' rule."""
    rng = np.random.default_rng(0)
    truth = rng.random(6_000) < 0.4
    right = [0.95, 0.8, 0.7, 0.9, 0.6, 0.75]
    counts = {}
    votes = np.column_stack([np.where(rng.random(6_000) < r, 1, -1) * np.where(truth, 1, -1) for r in right])
    for v in map(tuple, votes.tolist()):
        counts["card", v] = counts.get(("card", v), 0) + 1
    model = pii.reliabilities(counts)
    assert abs(model.prior["card"] - 0.4) < 0.03
    assert all(abs(model.tables["card"][1, j, 2] - r) < 0.04 for j, r in enumerate(right))
    guess = np.array([model.likelihood("card", tuple(v)) > 0.5 for v in votes.tolist()])
    assert (guess == truth).mean() > 0.95
    total = 0.0
    for v in itertools.product((-1, 0, 1), repeat=6):
        one, none = ([model.tables["card"][y, j, x + 1] for j, x in enumerate(v)] for y in (1, 0))
        p = model.prior["card"] * math.prod(one)
        q = (1 - model.prior["card"]) * math.prod(none)
        assert abs(model.likelihood("card", v) - p / (p + q)) < 1e-9
        total += p + q
    assert abs(total - 1) < 1e-9


def test_logistic():
    """The gradient vanishes at the fitted weights."""
    rng = np.random.default_rng(1)
    x, y, weight = rng.normal(size=(200, 3)), rng.random(200), rng.random(200) * 5
    w = pii.fit_logistic(x, y, weight, ridge=0.3)
    full = np.column_stack([np.ones(200), x])
    p = 1 / (1 + np.exp(-full @ w))
    assert np.allclose(full.T @ (weight * (p - y)) + np.r_[1e-6, 0.3, 0.3, 0.3] * w, 0, atol=1e-4)


def test_odd_rows(spark):
    """Null texts and identifiers, repeated rows, clashing columns, an empty table; no Python in the plan."""
    rows = [(1, None), (None, "a@b.cc"), (None, "a@b.cc"), (2, ""), (2, "+1 555 555 5555")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("row_no", "kind", "i", "m", "score", "base", "spans", "start")})
    out = pii.personal_data(docs)
    assert sorted((tuple(r)[:6] for r in out.collect()), key=key) == sorted((row_of(*r) for r in rows), key=key)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert pii.personal_data(docs.limit(0)).count() == 0
