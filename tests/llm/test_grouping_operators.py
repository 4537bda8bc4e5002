"""SuperMinHash near duplicates, phrase collocations and clustering by bit planes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.llm import clustering, minhash, phrases

from .helpers import frame, jaccard_components, odd_texts, words
from .test_corpus_operators import edited, near_copies

# ---- MinHash


def plain_signature(hashes, slots):
    """One element after another, each with a whole shuffle."""
    best = [2**64 - 1] * slots
    for h in hashes:
        order = list(range(slots))
        for step in range(slots):
            drawn = int(minhash._mixed(np.array([h], np.int64).view(np.uint64) + minhash._step(step))[0])
            other = step + ((drawn >> 32) * (slots - step) >> 32)
            order[step], order[other] = order[other], order[step]
            best[order[step]] = min(best[order[step]], step << 32 | drawn & 0xFFFFFFFF)
    return best


@pytest.mark.parametrize("n", [1, 2, 7, 60, 700])
def test_signature_is_that_of_whole_shuffles(n, monkeypatch):
    r = np.random.default_rng(n)
    hashes = np.unique(r.integers(-(2**63), 2**63 - 1, n))
    want = plain_signature(hashes.tolist(), 64)
    assert minhash.signature(hashes, 64).tolist() == want
    monkeypatch.setattr(minhash, "ELEMENTS", 16)
    assert minhash.signature(hashes, 64).tolist() == want


def test_equal_slots_estimate_the_similarity():
    r = np.random.default_rng(5)
    errors = []
    for k in range(60):
        both, rest = r.integers(-(2**63), 2**63 - 1, 300), r.integers(-(2**63), 2**63 - 1, (2, 50))
        a, b = (minhash.signature(np.unique(np.concatenate([both, rest[i]])), 128) for i in (0, 1))
        errors.append((a == b).mean() - 300 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < math.sqrt(0.75 * 0.25 / 128)


@pytest.mark.parametrize("tile_rows,small_tile", [(1024, 32), (4, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile_rows, small_tile):
    monkeypatch.setattr("lanternfish.llm.jaccard.TILE_ROWS", tile_rows)
    monkeypatch.setattr("lanternfish.llm.jaccard.SMALL_TILE", small_tile)
    texts = near_copies()
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert found == {i: (n, c, i == c) for i, (n, c) in jaccard_components(list(enumerate(texts)), percent=85).items()}


def test_near_duplicates_of_tiles_alone(spark, monkeypatch):
    monkeypatch.setattr("lanternfish.llm.jaccard.TILE_ROWS", 8)
    monkeypatch.setattr(minhash, "_pairs_within_bound", lambda pairs, classes, percent: pairs.limit(0))
    texts = near_copies()
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert found == {i: c for i, (_, c) in jaccard_components(list(enumerate(texts)), percent=85).items()}


def test_near_duplicates_of_a_hot_group(spark):
    """A third of all rows is one text, another third differs from one text by a word each."""
    base, other = words(3, 200), words(4, 300)
    texts = [" ".join(base)] * 60 + [" ".join(edited(other, k, 0.004)) for k in range(60)] + [" ".join(words(100 + k, 50)) for k in range(40)] + [None, "", " "] * 7
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert found == jaccard_components(list(enumerate(texts)), percent=85)


def test_near_duplicates_take_odd_rows(spark):
    found = minhash.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", None, "", "a b c d e f"], ids=[7, 7, None, 3, None])).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == Counter({(7, 2, 7, True): 2, (None, 0, None, True): 1, (3, 0, 3, True): 1, (None, 2, 7, False): 1})
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    texts = odd_texts()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts)).collect()} == jaccard_components(list(enumerate(texts)), percent=85)


def test_forest_joins_the_same_nodes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FOREST_NODES", 10)
    r = random.Random(2)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(300)]

    def groups(pairs):
        of = {k: k for k in range(80)}
        for _ in range(80):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of

    kept = [tuple(x) for x in minhash.forest(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()]
    assert groups(kept) == groups(links) and len(kept) < len(links)


# ---- phrases


def plain_phrases(rows, least, top=2000):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], a)
    found = {}
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] >= 80 * a:
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -score) for lang, rows in found.items() for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def phrase_texts():
    r = random.Random(8)
    stock = ["alpha beta gamma delta", "Beta gamma", "le coeur a ses raisons", "x", "Ünï cödé", "of the of the of the", "a a a a a a"]
    texts = [" ".join(r.choice(stock) + r.choice([".", "", ",", "\n", " ", "\t"]) for _ in range(r.randrange(60))) + " " + " ".join(words(k, 30, 60)) for k in range(60)]
    return texts + odd_texts()


def found_phrases(spark, texts, langs, **more):
    return sorted(map(tuple, phrases.collocations(frame(spark, texts, langs).repartition(3), **more).collect()))


@pytest.mark.parametrize("least,dealt", [(30, False), (5, False), (5, True)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, dealt):
    if dealt:  # few routes, and pairs of over 40 suffixes dealt by all their words
        for name, value in (("ROUTES", 3), ("DEALT_FROM", 40), ("DEALT_TIMES", 0), ("HELD_ROWS", 50), ("HELD_WORDS", 50)):
            monkeypatch.setattr(phrases, name, value)
    texts = phrase_texts()
    langs = [[None, "en", "fr", "und"][k % 4] for k in range(len(texts))]
    want = plain_phrases(list(zip(langs, texts)), least)
    assert found_phrases(spark, texts, langs, least=least) == want and len(want) > (20 if least == 30 else 100)


def test_phrases_of_a_cut_list(spark):
    texts = phrase_texts()
    want = plain_phrases([("en", t) for t in texts], 5, top=7)
    assert found_phrases(spark, texts, ["en"] * len(texts), least=5, top=7) == want


def test_bitmaps_with_one_bit_let_all_through(spark, monkeypatch):
    """False hits in bitmaps cost time alone."""
    monkeypatch.setattr(phrases.Bitmap, "has", lambda self, h: np.ones(len(h), bool))
    texts = phrase_texts()[:30]
    assert found_phrases(spark, texts, ["en"] * 30, least=5) == plain_phrases([("en", t) for t in texts], 5)


def test_quicksort_abandons_what_is_infrequent():
    r = np.random.default_rng(1)
    rows = r.integers(1, 6, (4, 3000)).astype(np.uint64)
    rows[3, r.random(3000) < 0.3] = 0
    rows, n = np.unique(rows, axis=1, return_counts=True)
    want = Counter()
    for column, times in zip(rows.T.tolist(), n.tolist()):
        want[tuple(column[:3])] += times
        if column[3]:
            want[tuple(column)] += times
    for least in (1, 4, 20, 40):
        found = {tuple(rows[:depth, at].tolist()): size for depth, at, size in phrases.quicksorted(rows, n, least)}
        assert found == {k: v for k, v in want.items() if v >= least}
        dealt = {tuple(rows[:depth, at].tolist()): size for depth, at, size in phrases.quicksorted(rows, n, least, dealt=True)}
        assert dealt == {k: v for k, v in want.items() if v >= least or len(k) == 3}
    assert phrases.quicksorted(np.zeros((4, 0), np.uint64), np.zeros(0, np.int64), 1) == []


def test_phrases_take_odd_tables(spark):
    assert found_phrases(spark, [], []) == []
    assert found_phrases(spark, [None, ""], [None, "en"]) == []


# ---- clustering

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType()), T.StructField("id", T.StringType()), T.StructField("norm", T.StringType()), T.StructField("x", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", "i", "n", "x") for i, v in rows], VECTORS)


def plain_clusters(rows, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        centroids = [[sum(col) // len(col) for col in zip(*own)] if (own := [v for (_, v), k in zip(kept, of) if k == c]) else centroids[c] for c in range(len(centroids))]
    out = [(i, k, d) for (i, v) in kept for d, k in [nearest(v)]]
    inertia = Counter()
    for _, k, d in out:
        inertia[k] += d
    return sorted((i, k, d, inertia[k], inertia.total(), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in out)


def odd_vectors():
    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(k, [x + r.gauss(0, 0.3) for x in centres[k % 6]]) for k in range(90)]
    rows += [(200 + k, [0.5] * 64) for k in range(5)] + [(5, rows[5][1])]  # equal vectors; a repeated row
    rows += [(300, [-1.0 / 1024] * 64), (301, [1e-12] * 64), (302, [-1e-12] * 64), (303, [100.0] * 64)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("inf")], [-float("inf")] + [1.0] * 63]
    return rows + [(400 + k, v) for k, v in enumerate(bad)]


def clustered(spark, rows, **more):
    return sorted(map(tuple, clustering.described(clustering.cluster(vectors(spark, rows).repartition(3), **more)).collect()))


def test_clusters_equal_brute_force(spark):
    rows = odd_vectors()
    assert clustered(spark, rows) == plain_clusters(rows)
    assert clustered(spark, rows, clusters=3, rounds=2) == plain_clusters(rows, 3, 2)


def test_clusters_of_few_vectors(spark):
    assert clustered(spark, []) == []
    assert clustered(spark, [(1, [1.0])]) == []
    rows = odd_vectors()[:3]
    assert clustered(spark, rows) == plain_clusters(rows)
    found = clustering.described(clustering.cluster(vectors(spark, [(None, [0.5] * 64), (1, [0.5] * 64)]))).collect()
    assert {(r.vec_id, r.cluster, r.distance) for r in found} == {(None, 0, 0), (1, 0, 0)}
    with pytest.raises(Exception, match="distances are exact"):
        clustered(spark, [(1, [1e9] * 64)])


def test_planes_are_exact():
    r = np.random.default_rng(3)
    x, y = r.integers(-(2**27), 2**27, (40, 64)), r.integers(-3, 4, (9, 64))
    px, py = clustering.pack(x), clustering.pack(y)
    assert px.shape == (40, 28) and py.shape == (9, 3) and clustering.pack(np.zeros((2, 64), np.int64)).shape == (2, 1)
    assert (clustering.dots(px, py) == x @ y.T).all() and (clustering.norms(px) == (x * x).sum(axis=1)).all()
    assert clustering.unpack_sum(px).tolist() == x.sum(axis=0).tolist()


def test_rows_of_hot_keys_stay_spread(spark):
    """Half of the rows have one key: they are joined by broadcast, where they are."""
    from lanternfish.llm import jaccard
    from lanternfish.llm.common import stored

    signed = spark.range(4000, numPartitions=8).select("id", F.lit(1).alias("n"), F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("key"))
    of_key = stored(signed.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("first")))
    rows = jaccard.by_key(signed, of_key)
    assert {(r.id, r.first) for r in rows.collect()} == {(k, 0 if k % 2 == 0 else k) for k in range(4000)}
    per_task = [r["count"] for r in rows.where("key = -1").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 2000 and max(per_task) <= 250


def test_jaccard_of_a_hot_group(spark):
    from lanternfish.llm import jaccard

    base, other = words(3, 200), words(4, 300)
    texts = [" ".join(base)] * 60 + [" ".join(edited(other, k, 0.004)) for k in range(30)] + [" ".join(words(100 + k, 50)) for k in range(20)] + [None, "", " "] * 5
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_classes(frame(spark, texts)).collect()}
    assert found == jaccard_components(list(enumerate(texts)))
