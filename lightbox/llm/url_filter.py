"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Rules are (verdict, host and path prefix); the longest that fits decides. URLs that
no rule covers are judged by boosted trees trained from labelled URLs. Features are
column expressions, so training and scoring stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightbox.session import durable

MAX_LABELLED = 20_000
TREES, DEPTH = 12, 4
SUFFIX_SMOOTHING = 10.0
# Parts of the labelled URLs; a URL's own part is left out of the suffix statistics it is trained with.
SUFFIX_PARTS = 5
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens",
    "parameters", "query_length", "fragment", "secure", "entropy", "host_entropy", "longest_token", "suffix_share", "suffix_risk",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    A rule, like ``example.com/en/``, fits its host and all subdomains where the
    path starts with the rule's. Of equally long rules the first in order wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for decision, pattern in sorted(rules, key=lambda r: len(r[1])):
        domain, _, prefix = pattern.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule = F.when(fits, pattern).otherwise(rule)
        verdict = F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    letters = F.split(text, "")
    n = F.greatest(F.size(letters), F.lit(1))
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path, suffix and the lexical features that need no statistics."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(F.col(url))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)

    def share(value: Column, pattern: str) -> Column:
        return F.char_length(F.regexp_replace(value, pattern, "")) / F.greatest(F.char_length(value), F.lit(1))

    framed = urls.withColumns({"host": host, "path": path})
    return framed.withColumns({
        "suffix": suffix_of(F.col("host")),
        "url_length": F.char_length(text), "host_length": F.char_length("host"), "path_length": F.char_length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "labels": F.size(F.split("host", r"\.")),
        "digits": share(text, r"[^0-9]"), "host_digits": share(F.col("host"), r"[^0-9]"), "hyphens": share(F.col("host"), r"[^-]"),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.char_length(query),
        "fragment": F.instr(text, "#").cast("boolean").cast("int"), "secure": text.startswith("https").cast("int"),
        "entropy": _entropy(text), "host_entropy": _entropy(F.col("host")),
        "longest_token": F.array_max(F.transform(F.split(text, r"[^A-Za-z0-9]"), F.char_length)),
    })


def url_verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str]], id: str = "page_id", url: str = "url",
    labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED, seed: int = 42,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, risk) of every page.

    ``labelled`` (url, blocked 0/1) trains the trees; without it the URLs that rules
    judge are the labels. At most ``max_labelled`` distinct URLs, in the order of a
    seeded hash, are used to fit; suffix statistics count every labelled URL, but for a URL that
    trains the trees only those of other parts, so its own label never reaches its features. ``risk`` is the
    trees' probability of blocking, 1 or 0 if all labels agree, 0 without labels.
    A URL that no rule covers is blocked at a risk of 0.5 and more.
    """
    host, path = host_and_path(F.col(url))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    base = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"))
    judged = durable(base.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict}))
    if labelled is None:
        known = judged.where("ruled is not null").select("url", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        known = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select("url", F.col("blocked").cast("double").alias("label"))
    known = known.groupBy("url").agg(F.max("label").alias("label"))
    part = F.pmod(F.xxhash64("url", F.lit(seed + 1)), F.lit(SUFFIX_PARTS))
    counted = durable(
        known.groupBy(suffix_of(host_and_path(F.col("url"))[0]).alias("s"), part.alias("part")).agg(
            F.sum("label").alias("bad"), F.count("*").alias("seen")
        )
    )
    by_suffix = counted.groupBy("s").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    chosen = durable(known.orderBy(F.xxhash64("url", F.lit(seed)), "url").limit(max_labelled))
    stats = chosen.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).first()

    rows = judged.agg(F.count("*")).first()[0]
    shares = judged.groupBy(suffix_of(F.col("host")).alias("s")).agg((F.count("*") / F.lit(max(rows, 1))).alias("suffix_share"))
    mean = stats["mean"] or 0.0

    def smoothed(bad: Column, seen: Column) -> Column:
        return (F.coalesce(bad, F.lit(0.0)) + mean * SUFFIX_SMOOTHING) / (F.coalesce(seen, F.lit(0)) + SUFFIX_SMOOTHING)

    suffixes = durable(shares.join(by_suffix, "s", "left").select(
        "s", "suffix_share", smoothed(F.col("bad"), F.col("seen")).alias("suffix_risk")
    ))
    # What a suffix looks like without one part of its labelled URLs.
    left_out = counted.join(by_suffix.toDF("s", "all_bad", "all_seen"), "s").select(
        F.col("s").alias("left_s"), F.col("part").alias("left_part"),
        smoothed(F.col("all_bad") - F.col("bad"), F.col("all_seen") - F.col("seen")).alias("left_risk"),
    )
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")

    def features(urls: DataFrame, training: bool = False) -> DataFrame:
        described = lexical(urls).join(suffixes, F.col("suffix") == F.col("s"), "left").fillna({"suffix_share": 0.0, "suffix_risk": mean})
        if training:
            own = (F.col("suffix") == F.col("left_s")) & (part == F.col("left_part"))
            described = described.join(left_out, own, "left").withColumn("suffix_risk", F.coalesce("left_risk", F.lit(mean)))
        return assembler.transform(described)

    if not stats["n"] or mean in (0.0, 1.0):
        scored = judged.withColumn("risk", F.lit(float(mean)))
    else:
        trainer = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, labelCol="label", maxBins=64)
        model = trainer.fit(features(chosen, training=True).select("features", "label"))
        # Rules decide most rows; only the rest needs features.
        open_rows = features(judged.where("ruled is null").drop("host", "path"))
        predicted = model.transform(open_rows).select(
            "page_id", "host", "path", "rule", "ruled", vector_to_array("probability")[1].alias("risk")
        )
        scored = predicted.unionByName(
            judged.where("ruled is not null").select(
                "page_id", "host", "path", "rule", "ruled", (F.col("ruled") == "block").cast("double").alias("risk")
            )
        )
    decided = F.coalesce(F.col("ruled"), F.when(F.col("risk") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", decided.alias("verdict"), "risk")
