"""Small documents with what operators must bear, and brute-force versions of what they do."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import types as T

#: Extra columns have names that operators use for results or inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("shard", T.StringType()),
    ]
)


def frame(spark, texts, langs=None, sources=None, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs or [None] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or ""), *["x"] * 7) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"w{r.randrange(vocabulary)}" for _ in range(n)]


def odd_texts():
    """Null, empty, blank, one word, very long, low in variety, repeated rows."""
    long = " ".join(words(1, 30_000, 5000))
    return [None, "", " \n\t ", "word", "a" * 50_000, "ab " * 5000, long, long, "Ünïcode " * 30, "🙂 emoji 🙂 text 🙂", "word"]


def jaccard_components(rows, n=5, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of what is kept) of each text."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if counts[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


def window_hits(texts, items, split, window=10):
    """(n_words, hit positions, item ids) of each text."""
    owners = defaultdict(set)
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[k : k + window])].add(item)
    sizes = {len(k) for k in owners}
    out = []
    for text in texts:
        w = split(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (who := owners.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= who
        out.append((len(w), sorted(hit), sorted(x for x in found if x is not None)))
    return out
