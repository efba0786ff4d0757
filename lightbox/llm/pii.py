"""Personal data by weak supervision, with DataFrame functions alone.

Patterns of two families propose candidates: those of the *base*, whose sound matches are
always spans, and looser ones (spelled-out addresses, other separators, numbers without a
country code). Six labelers vote +1, 0 or -1 on every candidate: its pattern, its inner
validity (check digit, ranges), a gazetteer (issuers, top-level domains, country codes),
words before it, its borders, and how varied it is. Expectation-maximisation over the counts of
vote patterns (at most 3 ** 6 for each kind, counted over all documents) estimates how reliable each
labeler is and how likely each pattern is personal data. Those likelihoods train
a logistic span classifier on votes and form; a candidate that it accepts and that
meets no base span is added. The driver sees pattern counts only, never documents.

Positions are code points, ends exclusive. Patterns never rescan a run from its middle, so
texts of any length take linear time. A null text is empty; null and repeated
identifiers are kept, a row of output each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightbox.session import durable

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A look-behind keeps matches from starting inside a run that
# was just refused; \G lets one start where the last ended. Possessive loops never back up.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms, and what a text must hold for them to be worth a search.
LOOSE = {
    "email": (
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?|\x20(?i:at)\x20|@)"
        r"[A-Za-z0-9-]++(?:(?:\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++",
        r"(?i)\bdot\b",
    ),
    "ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r":[0-9A-Fa-f]{1,4}:"),
    "card": (r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])", r"[0-9][._/][0-9]{4}"),
    "phone": (r"(?<![0-9+(])(?:(?:00|\+)[0-9]{1,3}[\x20.-])?+\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", r"[0-9][\x20.-][0-9]{3}"),
}
# Gazetteers and words that speak for or against a candidate behind them.
DOMAINS = "com|org|net|edu|gov|info|io|dev|app|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|pt|pl|se|no|dk|fi|ru|cn|jp|in|br|mx|au"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|60|62|64|65)"
COUNTRIES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
WORDS_FOR = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write|reach)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip|address|host|server|client|from)\W*(?:\w+\W+){0,1}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|payment)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp|dial)\W*(?:\w+\W+){0,2}$",
}
WORDS_AGAINST = r"(?i)(?:version|\bv|isbn|issn|order|invoice|token|hash|sku|build|serial|article|ref|no|id|doi|rfc)\W*$"
MARK, OTHER_MARK = "\x01", "\x02"
CONTEXT = 32
LABELERS = ("pattern", "validity", "gazetteer", "words", "borders", "variety")
FORMS = ("loose", "long", "spaced", "bracketed", *KINDS[1:])
ACCEPT = 0.5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """All matches in order as (gap, n, value, before, behind): characters since the last match, length,
    text, and up to ``CONTEXT`` characters on either side. Null if there is none."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER_MARK), pattern, f"{MARK}$0{MARK}")

    def found(parts: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), lambda i: F.struct(
            F.char_length(F.get(parts, i - 1)).alias("gap"), F.char_length(F.get(parts, i)).alias("n"),
            F.get(parts, i).alias("value"), F.right(F.get(parts, i - 1), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("behind"),
        ))
        return F.when(F.size(parts) > 1, each)

    return _let(F.split(marked, MARK, -1), found)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def sound(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern is a span of the base."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    n = F.char_length(_digits(value))
    return (
        F.when(kind == "email", True).when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", n.between(13, 19) & F.call_function("luhn_check", _digits(value))).otherwise(n.between(9, 15))
    )


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0)


def votes(c: DataFrame) -> DataFrame:
    """``c`` with the vote of every labeler and the features of form."""
    kind, value, before, behind = (F.col(n) for n in ("kind", "value", "before", "behind"))
    digits = _digits(value)
    n = F.char_length(digits)
    spelled = F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)
    octet = F.regexp_extract(value, r"^0*([0-9]{1,3})\.", 1).try_cast("int")
    distinct = F.size(F.array_distinct(F.split(F.substring(digits, 1, 40), "")))
    of_kind = lambda email, ip, card, phone: F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).otherwise(phone)
    validity = of_kind(
        ~value.rlike(r"\.\.|^\.|\.@") & spelled.rlike(r"^[A-Za-z]{2,24}$"), F.col("sound") | value.contains(":"),
        n.between(13, 19) & F.call_function("luhn_check", digits), n.between(9, 15),
    )
    listed = of_kind(
        F.lower(spelled).rlike(f"^(?:{DOMAINS})$"), value.contains(":") | (octet.between(1, 223) & (octet != 127)),
        digits.rlike(ISSUERS), F.regexp_replace(digits, "^00", "").rlike(COUNTRIES),
    )
    words = F.lit(False)
    for k, pattern in WORDS_FOR.items():
        words = words | ((kind == k) & before.rlike(pattern))
    joined = before.rlike(r"[A-Za-z0-9_][.-]?$") | behind.rlike(r"^[.-]?[A-Za-z0-9_]")
    return c.withColumns({
        "pattern": F.when(F.col("loose") == 0, _vote(F.col("sound"))).otherwise(0),
        "validity": _vote(F.coalesce(validity, F.lit(False))), "gazetteer": _vote(F.coalesce(listed, F.lit(False))),
        "words": _vote(words, before.rlike(WORDS_AGAINST)), "borders": _vote(~joined),
        "variety": _vote((kind != "email") & (distinct > 3), (kind != "email") & (distinct <= 2)),
        "long": (F.char_length(value) > 20).cast("int"), "spaced": value.contains(" ").cast("int"),
        "bracketed": value.rlike(r"[(\[{]").cast("int"), **{k: (kind == k).cast("int") for k in KINDS[1:]},
    })


def candidates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, candidates): (row_no, doc_id) of every row, and every candidate with its place and votes.

    Both read one narrow table, written once, in which rows have their numbers for good.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    sought = {("email", 0): body.contains("@")} | {(k, 0): body.rlike("[0-9]") for k in KINDS[1:]}
    sought |= {(k, 1): body.rlike(hint) for k, (_, hint) in LOOSE.items()}
    patterns = {(k, 0): p for k, p in BASE.items()} | {(k, 1): p for k, (p, _) in LOOSE.items()}
    read = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    found = durable(read.select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id",
        *[F.when(hint, matches(body, patterns[k])).alias(f"{k[0]}_{k[1]}") for k, hint in sought.items()],
    ))
    everything = None
    for kind, loose in patterns:
        rows = found.where(F.col(f"{kind}_{loose}").isNotNull()).select(
            "row_no", F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), F.posexplode(f"{kind}_{loose}").alias("i", "m")
        )
        everything = rows if everything is None else everything.unionAll(rows)
    upto = Window.partitionBy("row_no", "kind", "loose").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = everything.withColumn("end", F.sum(F.col("m.gap").cast("long") + F.col("m.n")).over(upto)).select(
        "row_no", "kind", "loose", (F.col("end") - F.col("m.n")).alias("start"), "end", "m.value", "m.before", "m.behind"
    )
    judged = placed.withColumn("sound", F.coalesce(sound(F.col("kind"), F.col("value")), F.lit(False)))
    # Plain numbers are no candidates: a card has at least twelve digits, a phone number seven.
    n = F.char_length(_digits(F.col("value")))
    likely = (F.col("kind") == "email") | (F.col("kind") == "ip") | (F.col("kind") == "card") & n.between(12, 20) | (F.col("kind") == "phone") & n.between(7, 17)
    return found.select("row_no", "doc_id"), durable(votes(judged.where(likely)))


@dataclass
class Labelers:
    """Per kind: the share of personal data, and P(vote | class) as [class 0 or 1][labeler][vote + 1]."""

    prior: dict[str, float] = field(default_factory=dict)
    tables: dict[str, np.ndarray] = field(default_factory=dict)

    def likelihood(self, kind: str, pattern: tuple[int, ...]) -> float:
        """Probability that a candidate with these votes is personal data."""
        table, odds = self.tables[kind], math.log(self.prior[kind] / (1 - self.prior[kind]))
        odds += sum(math.log(table[1, j, v + 1] / table[0, j, v + 1]) for j, v in enumerate(pattern))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


# Pseudo-counts of votes -1, 0, +1: labelers are taken to be right more often than wrong.
LEANING = np.array([[6.0, 2.0, 1.5], [1.5, 2.0, 6.0]])


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 200, close: float = 1e-9) -> Labelers:
    """Expectation-maximisation over vote patterns and their counts, with ``LEANING`` as prior knowledge."""
    model = Labelers()
    for kind in {k for k, _ in counts}:
        patterns = [(p, n) for (k, p), n in sorted(counts.items()) if k == kind]
        seen = np.array([p for p, _ in patterns]) + 1
        weight = np.array([n for _, n in patterns], float)
        model.prior[kind] = 0.5
        model.tables[kind] = np.repeat((LEANING / LEANING.sum(axis=1, keepdims=True))[:, None, :], seen.shape[1], axis=1)
        before = None
        for _ in range(rounds):
            belief = np.array([model.likelihood(kind, p) for p, _ in patterns])
            if before is not None and np.abs(belief - before).max() < close:
                break
            before = belief
            model.prior[kind] = float(((weight * belief).sum() + 1) / (weight.sum() + 2))
            for y, w in ((0, weight * (1 - belief)), (1, weight * belief)):
                for j in range(seen.shape[1]):
                    votes_of = np.bincount(seen[:, j], weights=w, minlength=3) + LEANING[y]
                    model.tables[kind][y, j] = votes_of / votes_of.sum()
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> np.ndarray:
    """Weights (constant first) of the ridge-penalised logistic regression on soft labels, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]

    def loss(v):
        z = x @ v
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * v * v).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        size = 1.0
        while size > 1e-6 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - then < 1e-10 * (1 + abs(now)):
            break
        w, now = w - size * step, then
    return w


@dataclass
class SpanModel:
    labelers: Labelers
    names: list[str]
    weights: list[float]

    def score(self) -> Column:
        """Probability that a candidate is personal data, as a column over votes and forms."""
        z = F.lit(self.weights[0])
        for name, w in zip(self.names, self.weights[1:]):
            column, _, side = name.partition(":")
            value = F.col(column) if not side else (F.col(column) == int(side)).cast("int")
            z = z + value * F.lit(w)
        return 1 / (1 + F.exp(-z))


def train(found: DataFrame) -> SpanModel:
    """Labeler reliabilities and the span classifier, from the counts of all candidates' patterns."""
    rows = found.groupBy("kind", *LABELERS, *FORMS).count().collect()
    counts: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in rows:
        key = (r["kind"], tuple(r[c] for c in LABELERS))
        counts[key] = counts.get(key, 0) + r["count"]
    labelers = reliabilities(counts)
    names = [f"{c}:{s}" for c in LABELERS for s in (1, -1)] + list(FORMS)
    if not rows:
        return SpanModel(labelers, names, [-1.0] + [0.0] * len(names))
    x = np.array([[*[float(r[c] == s) for c in LABELERS for s in (1, -1)], *[float(r[c]) for c in FORMS]] for r in rows])
    y = np.array([labelers.likelihood(r["kind"], tuple(r[c] for c in LABELERS)) for r in rows])
    # Patterns count by the root of their rows: a common form must not drown the others.
    weight = np.sqrt(np.array([r["count"] for r in rows], float))
    return SpanModel(labelers, names, fit_logistic(x, y, weight).tolist())


def spans(found: DataFrame, model: SpanModel) -> DataFrame:
    """(row_no, kind, start, end, value, base, score) of every span: all of the base, and accepted ones that meet
    no other. Of accepted ones that overlap each other in a chain, the likeliest stays."""
    taken = found.withColumns({"base": F.col("sound") & (F.col("loose") == 0), "score": model.score()}).where(
        F.col("base") | (F.col("score") >= ACCEPT)
    )
    place = Window.partitionBy("row_no").orderBy("start", "end", "kind", "loose")
    reach = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    opened = taken.withColumn("opens", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    chained = opened.withColumn("chain", F.sum("opens").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("row_no", "chain")
    rank = F.row_number().over(chain.orderBy(F.col("score").desc(), "start", "kind", "loose"))
    ranked = chained.withColumns({"crossed": F.max("base").over(chain), "rank": rank})
    return ranked.where(F.col("base") | (~F.col("crossed") & (F.col("rank") == 1))).select(
        "row_no", "kind", "start", "end", "value", "base", "score"
    )


def _listed(entries: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(entries), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", model: SpanModel | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row: base counts and digest, all spans."""
    rows, found = candidates(docs, id, text)
    kept = spans(found, model or train(found))
    entry = F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").__sub__(1).alias("k"), "start", "end")
    by_row = kept.groupBy("row_no").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.collect_list(F.when(F.col("base"), entry)).alias("base"), F.collect_list(entry).alias("all"),
    ).select("row_no", *[f"n_{k}" for k in KINDS], _listed(F.col("base")).alias("base"), _listed(F.col("all")).alias("spans"))
    nothing = F.lit("")
    return rows.join(by_row, "row_no", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", nothing), 256).alias("base_sha256"), F.coalesce("spans", nothing).alias("spans"),
    )
