"""Corpus operators against brute force, on the odd rows every one of them must take."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lightbox.llm import (
    decontamination, exact_dedup, line_dedup, mixing, quality, queries, simhash, token_counts, toxicity, url_filter, warc,
)
from lightbox.llm.fm_index import FMIndex
from lightbox.llm.pu_learning import fit_nnpu, risk
from lightbox.plans.components import min_labels

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, "Alpha  beta\tgamma", "en", "a", 18), (2, "Alpha beta gamma", "en", "a", 16), (3, None, None, None, None),
    (4, "", "en", "b", 0), (5, " \n\t", "de", "b", 3), (None, "alpha beta gamma", "en", None, 16),
    (2, "Alpha beta gamma", "en", "a", 16), (6, LONG, "en", "a", len(LONG)), (7, LONG + "\n", "en", "c", len(LONG) + 1),
    (8, "ünï çode 文字 🦊", "fr", "b", 15),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns named like those the operators add."""
    extra = ["keep_id", "kept", "fp", "row", "part", "spans", "score", "size", "target", "component", "id", "norm", "row_no"]
    return docs.withColumns({c: F.lit(c) for c in extra})


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_exact_dedup(docs, clashing, ranges):
    got = sorted(map(tuple, exact_dedup.copy_groups(docs, ranges=ranges).collect()), key=str)
    groups = {}
    for d, t, *_ in ODD:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), d is None, d))
    want = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for i, m in enumerate(members):
            want.append((m[2], members[0][2], len(members), i == 0, hashlib.sha256(norm.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    kept = exact_dedup.drop_copies(clashing, ranges=ranges)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[3])


def test_exact_dedup_of_texts_whose_hashes_agree(spark, monkeypatch):
    """Texts alike in all that orders them first are told apart by the whole text."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(0).cast("long"))
    start = "x" * exact_dedup.LEADING
    rows = [(i, start + str(i % 7) + " " * (i % 5)) for i in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.copy_groups(frame, ranges=1).collect()
    assert {r.group_size for r in out} == {10} and sum(r.kept for r in out) == 7
    assert exact_dedup.drop_copies(frame, ranges=1).count() == 7


def test_exact_dedup_hot_group(spark):
    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.copy_groups(rows, ranges=20).where("group_size = 1000")
    assert out.count() == 1000 and out.where("kept").select("doc_id").first()[0] == 0
    assert out.select("keep_id").distinct().collect()[0][0] == 0
    assert exact_dedup.drop_copies(rows, ranges=20).count() == 2001


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_leaks(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for a in range(len(w) - n + 1):
                if w[a : a + n] == b[i : i + n]:
                    hit |= set(range(a, a + n))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("slice_words", [4_000_000, 40])
def test_decontamination(spark, docs, clashing, slice_words):
    items = [
        (1, "Alpha, beta; GAMMA"), (2, None), (3, "  "), (4, " ".join(f"w{i}" for i in range(40, 55))), (11, "alpha BETA gamma"),
        (5, "the the the the the the the the the the the the"), (None, "文字"), (6, " ".join(f"w{i % 977}" for i in range(970, 990))),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame([(20, "x " + "the " * 30 + "y", "en", "a", 5), (21, "the " * 9, "en", "a", 5)], DOCS)
    both = docs.unionByName(extra)
    got = decontamination.contamination(both, bench, slice_words=slice_words).collect()
    texts = ODD + [(20, "x " + "the " * 30 + "y"), (21, "the " * 9)]
    want = []
    for d, t, *_ in texts:
        n, hit, found = brute_leaks(t if t is None or len(t) < 10_000 else " ".join(t.split()), items) if not t or len(t) < 10_000 else long_leaks(t, items)
        want.append((d, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    clean = decontamination.clean_documents(clashing, bench, slice_words=slice_words)
    assert clean.columns == clashing.columns
    assert clean.count() == sum(not w[5] for w in want[: len(ODD)])
    cut = decontamination.cut_leaks(clashing, bench, slice_words=slice_words)
    assert cut.columns == clashing.columns and cut.count() == len(ODD)
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def long_leaks(text, items):
    w = words(text)
    at = {}
    for i in range(len(w) - 9):
        at.setdefault(tuple(w[i : i + 10]), []).append(i)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        if len(b) < 10:
            n = len(b)
            places = [i for i in range(len(w) - n + 1) if n and w[i] == b[0] and w[i : i + n] == b]
            spans = [(i, n) for i in places]
        else:
            spans = [(i, 10) for j in range(len(b) - 9) for i in at.get(tuple(b[j : j + 10]), [])]
        for i, n in spans:
            hit |= set(range(i, i + n))
            found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


def test_fm_index():
    rng = np.random.default_rng(5)
    for alphabet in (2, 3, 9):
        text = rng.integers(0, alphabet, 700)
        text[-1] = 0
        index = FMIndex(text, alphabet, sample=4)
        for n in (1, 2, 5):
            patterns = rng.integers(1, alphabet, (30, n)) if alphabet > 2 else np.ones((1, n), np.int64)
            low, high = index.search(patterns, np.full(len(patterns), n))
            for p, a, b in zip(patterns, low, high):
                want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("radius,small", [(2, 48), (2, 0), (7, 48), (7, 2)])
def test_simhash_links(radius, small):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = [base]
    for _ in range(40):
        f = base.copy()
        for _ in range(rng.integers(1, radius + 3)):
            f = f ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64))
        fps.append(f)
    fp = np.unique(np.concatenate(fps))
    ring = simhash.segments(radius)
    m = len(ring)
    part = [(fp >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in ring]
    keys = [(i, np.array([hash((i, j, *k)) for k in zip(part[i].tolist(), part[(i + 1) % m].tolist(), part[(i + j) % m].tolist())]))
            for i in range(m) for j in (2, 3)]
    u, v = simhash.link_partition(
        np.concatenate([k for _, k in keys]), np.concatenate([np.full(len(fp), i) for i, _ in keys]),
        np.tile(fp.view(np.int64), len(keys)), radius, small,
    )
    a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius, 1))
    want, got = min_labels(fp[a].view(np.int64), fp[b].view(np.int64)), min_labels(u, v)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def brute_fingerprint(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_groups(spark, docs, clashing):
    base = [f"t{i}" for i in range(400)]
    near = [(100 + k, " ".join(base[:k] + ["zz"] + base[k + 1 :]), "en", "a", 1) for k in range(12)]
    many = docs.unionByName(spark.createDataFrame([(99, " ".join(base), "en", "a", 1), *near], DOCS))
    rows = simhash.near_groups(many).collect()
    texts = ODD + [(99, " ".join(base))] + [n[:2] for n in near]
    fps = [brute_fingerprint(t[1], 3) for t in texts]
    assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == sorted((str(t[0]), f"{f:016x}") for t, f in zip(texts, fps))
    x = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)
    label = dict(zip(*[c.tolist() for c in min_labels(a, b)]))
    least = {}
    for i, t in enumerate(texts):
        if t[0] is not None:
            least[label[i]] = min(t[0], least.get(label[i], t[0]))
    want = sorted((str(t[0]), str(least.get(label[i]))) for i, t in enumerate(texts))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == want
    kept = simhash.drop_near_copies(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == len(set(near_labels([t[1] for t in ODD])))


def brute_shingles(text):
    w = re.sub(r"[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def near_labels(texts):
    """The least position that chains of Jaccard similarity 0.8 reach from each text; texts without words are alike."""
    sets = [brute_shingles(t or "") for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1) if sets[i] == sets[j] or (sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8)]
    return min_labels(*map(np.array, zip(*pairs)))[1].tolist()


def edited(base, rng, changes):
    """``base`` with some words replaced by new ones."""
    out = list(base)
    for i in rng.choice(len(out), changes, replace=False):
        out[i] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


def test_near_copies_below_the_similarity_stay(spark):
    """Pairs within 7 bits whose shingle sets are not similar are candidates, no copies."""
    rng, pairs = np.random.default_rng(5), []
    while len(pairs) < 6:
        base = [f"b{rng.integers(1 << 40)}" for _ in range(150)]
        a, b = " ".join(base), edited(base, rng, 6)
        fps = np.array([brute_fingerprint(t, 5) for t in (a, b)], np.uint64)
        if np.bitwise_count(fps[0] ^ fps[1]) <= 7 and jaccard(brute_shingles(a), brute_shingles(b)) < 0.8:
            pairs.append((a, b))
    texts = [t for p in pairs for t in p] + [pairs[0][0].upper()]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(12))


def test_near_copies_are_found_at_the_similarity(spark):
    """Families with one to five words changed, against brute-force Jaccard 0.8."""
    rng, texts = np.random.default_rng(6), []
    for n in (60, 100, 100, 150, 150, 200, 200, 300, 300, 400):
        base = [f"b{rng.integers(1 << 40)}" for _ in range(n)]
        texts += [" ".join(base), *(edited(base, rng, int(rng.integers(1, 1 + max(1, n // 50)))) for _ in range(8))]
    kept = simhash.drop_near_copies(
        spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    )
    sets = [brute_shingles(t) for t in texts]
    u, v = zip(*((i, j) for i in range(len(sets)) for j in range(i + 1) if jaccard(sets[i], sets[j]) >= 0.8))
    ids, least = min_labels(np.array(u), np.array(v))
    assert sorted(r.doc_id for r in kept.collect()) == ids[ids == least].tolist()


def test_bands_reach_the_similarity():
    for similarity in (0.3, 0.5, 0.6, 0.8, 0.9, 1.0):
        bands, rows = simhash.band_plan(similarity)
        assert 1 - (1 - similarity**rows) ** bands >= 0.99


@pytest.mark.parametrize("similarity", [0.5, 0.65])
def test_near_copies_at_other_similarities(spark, similarity):
    rng, texts = np.random.default_rng(8), []
    for n in (60, 90, 120):
        base = [f"b{rng.integers(1 << 40)}" for _ in range(n)]
        texts += [" ".join(base), *(edited(base, rng, int(rng.integers(1, 1 + n // 14))) for _ in range(6))]
    kept = simhash.drop_near_copies(
        spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS), similarity=similarity
    )
    sets = [brute_shingles(t) for t in texts]
    u, v = zip(*((i, j) for i in range(len(sets)) for j in range(i + 1) if jaccard(sets[i], sets[j]) >= similarity))
    ids, least = min_labels(np.array(u), np.array(v))
    assert sorted(r.doc_id for r in kept.collect()) == ids[ids == least].tolist()


@pytest.mark.parametrize("crowd", [4_096, 20])
def test_template_keys(spark, monkeypatch, crowd):
    """Pages of one template share keys but are no copies: few pairs are compared in full, whole or in blocks."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(9)
    base = [f"b{rng.integers(1 << 40)}" for _ in range(120)]
    texts = [edited(base, rng, 6) for _ in range(150)]
    texts += [t + " tail" for t in texts[:10]]
    rows = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)
    label = near_labels(texts)
    kept = simhash.drop_near_copies(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    sets = [np.sort(np.array([hash(x) & (2**64 - 1) for x in brute_shingles(t)], np.uint64)) for t in texts]
    sig = [simhash.signature(x) for x in sets]
    key = spark.createDataFrame(
        [(1, i, i, sig[i].tobytes(), len(sets[i]), len(texts)) for i in range(len(texts))],
        "key long, label long, node long, sig binary, size int, n long",
    )
    pairs = {(r.u, r.v) for r in simhash._crowd_pairs(key, 0.8).collect()}
    assert {(150 + i, i) for i in range(10)} <= pairs and len(pairs) < 3 * len(texts)
    likeliest = {(r.u, r.v) for r in simhash._crowd_pairs(key, 0.8, True).collect()}
    assert {(150 + i, i) for i in range(10)} <= likeliest <= pairs


def test_signatures_keep_similar_pairs():
    rng = np.random.default_rng(10)
    lost = 0
    for _ in range(2_000):
        n = int(rng.integers(20, 4_000))
        same = int(np.ceil(0.8 * n))
        one = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
        left = (n - same) // 2
        a, b = np.sort(one[: same + left]), np.sort(np.concatenate([one[:same], one[same + left :]]))
        fits, share = simhash.alike(simhash.signature(a), simhash.signature(b)[None, :], len(a), np.array([len(b)]), 0.8)
        lost += not fits[0]
    assert lost <= 2


def test_crowded_keys_are_compared_in_blocks(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.integers(0, 20, 3)) for _ in range(300)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.fingerprint_links(frame, 2, block=20).toPandas()
    x = np.array(fps)
    a, b = np.nonzero(np.triu(np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= 2, 1))
    want, got = min_labels(x[a], x[b]), min_labels(edges.u.to_numpy(), edges.v.to_numpy())
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def planted(spark, n=1_500):
    """Documents whose toxic ones use a few words of their own, whose bad ones shout."""
    rng = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(800)]
    rows, labels = [], []
    for d in range(n):
        w = list(rng.choice(vocabulary, 60))
        toxic, bad = d % 8 == 0, d % 6 == 0
        if toxic:
            for bad_word in rng.choice(["vileone", "nastyone", "foulone"], 4):
                w[rng.integers(0, 60)] = str(bad_word)
        text = " ".join(w)
        rows.append((d, text.upper() + "!!!" if bad else text, "en", "a", len(text)))
        labels.append((d, int(not bad), int(toxic)))
    return spark.createDataFrame(rows + [(None, None, None, None, None), (n, "", "en", "a", 0)], DOCS), spark.createDataFrame(
        labels + [(None, 1, 1), (0, None, None), (n + 5, 1, 1)], "doc_id long, quality int, toxic int"
    )


@pytest.mark.parametrize("module,score,label,folds,fold", [
    (toxicity, toxicity.toxicity, "toxic", 4, 2), (quality, quality.quality, "quality", 5, 0),
])
def test_classifiers(spark, module, score, label, folds, fold):
    docs, labels = planted(spark)
    out = score(docs, module.train(docs, labels)).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    out = out[out.doc_id.notna()]
    assert (out.held_out == [zlib.crc32(str(int(d)).encode()) % folds == fold for d in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.3).astype(int)).all()
    truth = labels.toPandas().dropna().set_index("doc_id")[label]
    held = out[out.held_out & out.doc_id.isin(truth.index)]
    assert (held.predicted.to_numpy() == truth[held.doc_id].to_numpy()).mean() > 0.97
    empty = score(docs.limit(0), module.train(docs.limit(0), labels.limit(0)))
    assert empty.count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = planted(spark, 400)
    flipped = labels.withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    a, b = (toxicity.toxicity(docs, toxicity.train(docs, l)).orderBy("doc_id").toPandas().score for l in (labels, flipped))
    assert np.allclose(a, b)


def test_drop_toxic_keeps_columns(clashing, spark):
    docs, labels = planted(spark, 400)
    model = toxicity.train(docs, labels)
    assert toxicity.drop_toxic(clashing, model).columns == clashing.columns
    assert toxicity.drop_toxic(clashing, model).count() == len(ODD)


def test_nnpu_risk():
    rng = np.random.default_rng(3)
    p, n = rng.normal(2, 1, (400, 2)), rng.normal(-2, 1, (1600, 2))
    u = np.concatenate([rng.normal(2, 1, (400, 2)), n])
    model = fit_nnpu(p, u, 0.2)
    assert (model.scores(n) < 0.5).mean() > 0.97 and (model.scores(p) > 0.5).mean() > 0.95
    plus, minus = risk(np.full(5, 9.0), np.full(5, -9.0), 0.5)
    assert plus < 0.01 and minus < 0
    assert np.allclose(fit_nnpu(p[:0], u, 0.3).scores(u), 0.3)


def level_targets(sizes, weights=(1, 2, 3)):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over


def check_mix(frame, rows):
    out = mixing.mix(frame).collect()
    assert len(out) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1])
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(r[0]), count(r[1])) for r in rows)
    target = level_targets(sizes)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - target[s]) <= 1
    again = mixing.mix(frame.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixing(spark, docs):
    check_mix(docs, ODD)
    rng = np.random.default_rng(4)
    rows = [(i, "x " * int(rng.integers(0, 900)), "en", "hot" if i % 3 else f"s{i % 17}", 1) for i in range(600)]
    check_mix(spark.createDataFrame(rows, DOCS), rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null")).first().taken == 0


def test_mixed_stream(spark):
    """Slots in golden-ratio order; every source's slices, by rank, run through its shuffled stream again and again."""
    rng = np.random.default_rng(3)
    size = {"a": 40, "b": 15, None: 25}
    rows = [
        (i, "".join(f" w{i}_{j}" + "\t\n"[: j % 3] for j in range(rng.integers(0, 90))), "en", s, 1)
        for i, s in enumerate(s for s, n in size.items() for _ in range(n))
    ]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS), carry=("text",), block_words=16, slices=True)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    got = sorted(mixing.stream(mixed).collect(), key=lambda r: (r.slot, str(r.source), r.rank, r.offset))
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.text.split() == text[r.doc_id].split()[r.begin : r.end] and r.text in text[r.doc_id]
    assert all(n == sum(r.end - r.begin for r in got if r.doc_id == d) for d, n in taken.items())
    for s in size:
        mine = sorted((r for r in got if r.source == s), key=lambda r: (r.rank, r.offset))
        assert [r.slot for r in mine] == sorted(r.slot for r in mine)
        order = sorted((d for d, _, _, t, _ in rows if t == s), key=lambda d: hashlib.md5(f"{d}|{text[d]}".encode()).hexdigest())
        whole = [w for d in order for w in text[d].split()]
        words = [w for r in mine for w in r.text.split()]
        assert words == (whole * 4)[: len(words)]
    # Which source a slot falls to, by the sequence alone.
    slots = {s: max(r.rank for r in got if r.source == s) for s in size}
    total, used = sum(slots.values()), {s: 0 for s in size}
    for i in range(total):
        at = int((i + 0.5) * mixing.GOLDEN % 1.0 * total)
        here = "a" if at < slots["a"] else "b" if at < slots["a"] + slots["b"] else None
        used[here] += 1
        if used[here] <= slots[here]:
            assert {(r.source, r.rank) for r in got if r.slot == i} == {(here, used[here])}


def test_mix_carries_columns_of_any_name(spark):
    names = ["size", "slot", "Target", "words", "s", "a.b", "doc", "cut", "row_no", "taken"]
    rows = [(i, f"w{i} " * (5 + i % 7) if i % 9 else None, f"s{i % 2}", *[i] * len(names)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    mixed = mixing.mix(frame, carry=("text", *names), block_words=16, slices=True)
    back = mixing.carried_names(tuple(names))
    assert back == ["size_carried", "slot_carried", "Target_carried", "words", "s", "a.b", "doc", "cut", "row_no", "taken_carried"]
    out = mixed.collect()
    assert len(out) == 60 and all(r[n] == r.doc_id for r in out for n in back)
    assert all(r["size"] == len((rows[r.doc_id][1] or "").split()) for r in out)
    streamed = mixing.stream(mixed)
    assert len({c.lower() for c in streamed.columns}) == len(streamed.columns)
    got = streamed.collect()
    assert got and all(r[n] == r.doc_id for r in got for n in back)
    assert all(r.text.split() == rows[r.doc_id][1].split()[r.begin : r.end] for r in got)


def test_schedule_is_evenly_spread(spark):
    rows = [(i, "x " * 500, "en", f"s{i % 4}", 1) for i in range(800)]
    frame = spark.createDataFrame(rows, DOCS)
    sizes = frame.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))
    plan = mixing._plan(mixing.source_targets(sizes), 256)
    slots = mixing.schedule(plan, chunk=64).toPandas()
    total, share = plan.first().all_slots, {r.source_no: r.slots / r.all_slots for r in plan.collect()}
    for no, part in slots[slots.slot < total].groupby("source_no"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        for stop in (100, 500, 1000):
            assert abs((part.slot < stop).sum() - share[no] * stop) < 6
    assert slots.groupby("source_no").size().to_dict() == {r.source_no: r.slots for r in plan.collect()}


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer, models

    pieces = [("▁", -3.0), ("▁▁", -4.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁ab", -5.0), ("ba", -3.5), ("aab", -4.0), ("▁a", -5.0), ("bb", -4.0)]
    counter = token_counts.UnigramCounter(token_counts.Vocabulary(pieces, bytes_fallback=False))
    whole = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0))
    rng = np.random.default_rng(6)
    for _ in range(300):
        text = "".join(rng.choice(list("ab ab a")) for _ in range(rng.integers(1, 40)))
        assert counter.count(text) == len(whole.encode("▁" + text.replace(" ", "▁")).ids), text
    out = token_counts.token_counts(docs, token_counts.Vocabulary(pieces)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d[0]) for d in ODD)
    assert {r.doc_id: r.n_tokens for r in out}[4] == 0 and {r.doc_id: r.n_tokens for r in out}[3] == 0
    assert token_counts.token_counts(docs.limit(0), token_counts.Vocabulary(pieces)).count() == 0


def test_token_counts_of_the_public_vocabulary():
    path = "/opt/tokenizers/piece_bpe_32k.model"
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer, models

    vocabulary = token_counts.load_vocabulary(path)
    counter = token_counts.UnigramCounter(vocabulary)
    fallback = [(f"<0x{i:02X}>", -1e12) for i in range(256)]
    whole = Tokenizer(models.Unigram([("<unk>", 0.0), *fallback, *vocabulary.pieces], 0, byte_fallback=True))
    for text in ("The quick  brown fox\n\njumps 日本語 🦊🦊 over", "   ", "a", "x" * 300, "Übergrößenträger, naïve\tcafé"):
        assert counter.count(text) == len(whole.encode("▁" + text.replace(" ", "▁")).ids)


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in RULES:
        domain, _, prefix = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_url_rules(spark):
    urls = [
        None, "", "foo", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "https://a.net/es/?q#f", "x://b.org?p/es/",
        "http://com/", "http://notexample.com/en/a", "http://m.www.example.com/en/a://b", "https://net/fr/\nx", "http://a.net/esx", "http://com",
    ] + [f"http://h{i % 7}.{'com' if i % 2 else 'net'}/{'es' if i % 3 else 'de'}/{i}?a={i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[3]), (3, urls[3])], "page_id long, url string")
    out = url_filter.url_verdicts(pages, RULES).collect()
    assert len(out) == len(urls) + 2
    for r in out:
        if r.page_id is not None:
            host, path, rule, verdict = brute_rule(urls[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.url_verdicts(pages.limit(0), RULES).count() == 0


def test_url_trees_learn_lexical_signs(spark):
    urls = [(i, f"http://s{i % 9}.org/{'x' * (i % 5)}/" + ("?a=1&b=2&c=3&d=4" if i % 2 else "")) for i in range(400)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labelled = pages.where("page_id < 300").select("url", (F.col("page_id") % 2).alias("blocked"))
    out = url_filter.url_verdicts(pages, [], labelled=labelled).where("page_id >= 300")
    assert out.where((F.col("verdict") == "block") != (F.col("page_id") % 2 == 1)).count() == 0


def test_url_trees_do_not_trust_their_own_labels(spark):
    """A suffix of its own for every labelled URL says nothing of others; the lexical sign does."""
    urls = [(i, f"http://h.s{i}.org/x{'/y' * (3 if i % 2 else 0)}") for i in range(600)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    noisy = ((F.col("page_id") % 2 == 1) != (F.col("page_id") % 10 == 0)).cast("int")
    labelled = pages.where("page_id < 450").select("url", noisy.alias("blocked"))
    out = url_filter.url_verdicts(pages, [], labelled=labelled).where("page_id >= 450")
    assert out.where((F.col("verdict") == "block") == (F.col("page_id") % 2 == 1)).count() == 150


def test_keys_of_lines_taken_together():
    """Lines hashed in one piece get the keys that each gets alone, and share halves where they may be partners."""
    lines = [line.split() for line in (b"a b c d e f", b"", b"x", b"a b c d e g", b"a b c d e", b"z b c d e f", b"a b c d e f")]
    n, hashed, keys, held = line_dedup.line_keys(lines)
    alone = [line_dedup.line_keys([line]) for line in lines]
    assert n.tolist() == [6, 0, 1, 6, 5, 6, 6] and held.sum(axis=1).tolist() == [4, 0, 0, 4, 2, 4, 4]
    assert all((hashed[i], keys[i].tolist()) == (a[1][0], a[2][0].tolist()) for i, a in enumerate(alone))
    assert len(set(hashed.tolist())) == 6 and hashed[0] == hashed[6]
    halves = [set(k[h].tolist()) for k, h in zip(keys, held)]
    assert all(halves[0] & halves[i] for i in (3, 4, 5, 6))


def test_line_dedup(spark, rows):
    rng = np.random.default_rng(7)
    texts = []
    for d in range(50):
        lines = [" ".join(rng.choice(list("abcd"), rng.choice([0, 1, 4, 5, 6, 7, 9]))) for _ in range(6)]
        texts.append((None if d % 11 == 5 else int(rng.integers(0, 60)), None if d % 13 == 0 else "\n".join(lines)))
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    lines = [((d is None, d or 0, r, i), l.encode().split()) for r, (d, t) in enumerate(texts) for i, l in enumerate((t or "").split("\n"))]
    lines.sort(key=lambda x: x[0])
    want = set()
    for j, (k, w) in enumerate(lines):
        near = lambda v: v == w or (min(len(v), len(w)) >= 5 and line_dedup.within_one_edit(v, w))
        if w and any(near(v) for _, v in lines[:j] if v):
            want.add(k[2:])
    out = line_dedup.repeated_lines(frame)
    assert {(r.row_no, r.line_no) for r in out.where("dropped").collect()} == want
    report = line_dedup.line_report(frame).toPandas()
    assert len(report) == 50 and report.n_lines.sum() == len(lines) and report.n_kept.sum() == len(lines) - len(want)
    text = line_dedup.drop_repeated_lines(frame)
    assert text.count() == 50
    assert line_dedup.line_report(frame.limit(0)).count() == 0


def test_one_edit():
    rng = np.random.default_rng(8)

    def distance(a, b):
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a):
            prev, d = d, np.concatenate([[i + 1], np.zeros(len(b), int)])
            for j, y in enumerate(b):
                d[j + 1] = min(prev[j] + (x != y), prev[j + 1] + 1, d[j] + 1)
        return d[-1]

    for _ in range(400):
        a, b = (list(rng.choice([b"x", b"y"], rng.integers(0, 6))) for _ in range(2))
        assert line_dedup.within_one_edit(a, b) == (distance(a, b) <= 1)


def test_warc(spark):
    body = "WARC/1.1\r\n\r\n" * 20
    pages = [
        (1, None, None), (2, "http://A.com/x", body), (3, "u\r\n%00://b", body), (None, "http://A.com/x", body),
        (2, "http://A.com/x", body), (5, "", ""), (6, "http://b.org/é?q", "ü" * 49), (7, "http://b.org/", "ü" * 50), (8, "http://b.org/", "ü" * 50),
    ] + [(100 + i, f"http://{'hot' if i % 3 else i}.org/", f"page {i} " * 30) for i in range(90)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "row_no": F.lit(2), "run": F.lit(3)})
    out = warc.capture_history(frame).toPandas()
    assert len(out) == len(pages)
    want = sorted((str(p), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in pages)
    got = sorted((str(None if p != p else int(p)), n, d) for p, n, d in zip(out.page_id, out.payload_bytes, out.payload_digest))
    assert got == want
    kinds = {(None if r.page_id != r.page_id else int(r.page_id), r.record_type, None if r.refers_to != r.refers_to else int(r.refers_to)) for r in out.itertuples() if not r.page_id >= 100}
    assert kinds == {
        (1, "response", None), (2, "response", None), (2, "revisit", 2), (3, "revisit", 2), (None, "revisit", 2), (5, "response", None),
        (6, "response", None), (7, "response", None), (8, "revisit", 7),
    }
    assert set(out.url) == {u or "" for _, u, _ in pages}
    ordered = out.sort_values(["range_no", "place"])
    keys = [(k.encode(), d, p != p, 0 if p != p else p) for k, d, p in zip(ordered.url_key, ordered.date, ordered.page_id)]
    assert keys == sorted(keys)
    assert warc.capture_history(frame.limit(0)).count() == 0


def unstable(frame):
    """The same rows, read in another order by every plan: round robin deals by what is left after pruning."""
    return frame.repartition(7).where("page_id >= 0").unionByName(frame.where("page_id < 0"))


@pytest.mark.parametrize("shape", [lambda f: f, lambda f: f.repartition(7), lambda f: f.repartition(5, "url"), unstable])
def test_warc_decides_once(spark, shape):
    """One response per payload whatever plan the pages come from, and no payload is lost."""
    pages = [(i, f"http://h{i % 11}.org/{i}", f"payload {i % 50} " * 20) for i in range(600)]
    frame = shape(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3))
    out = warc.capture_history(frame).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in out) == [
        (i, "response", None) if i < 50 else (i, "revisit", i % 50) for i in range(600)
    ]


def test_warc_matches_its_sql_on_copies(spark, tmp_path):
    rng = np.random.default_rng(4)
    pages = [(int(i), f"http://h.org/{i}", None if i % 9 == 0 else f"body {rng.integers(40)} " * int(rng.integers(5, 20))) for i in rng.permutation(500)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    frame.toPandas().to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    out = queries.QUERIES["op8_warc"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(con.sql(queries.CHECKS["op8_warc"]).fetchall(), key=str)
    assert warc.capture_history(frame).where("record_type = 'revisit'").count() > 40


def test_warc_files_are_cut_by_bytes(spark, tmp_path):
    """Very long pages are files of their own; every page comes back whole."""
    sizes = [10] * 40 + [200_000] * 4 + [3_000_000] * 2 + [30_000_000]
    pages = [(i, f"u://{i}", chr(97 + i % 26) * n) for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.gz"))) == 4
    back = warc.read_archives(str(tmp_path / "w"), spark).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in back) == list(enumerate(sizes))


def test_loser_tree():
    rng = np.random.default_rng(9)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
