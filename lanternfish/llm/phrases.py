"""Phrase collocations: frequent phrases of each language, scored by how seldom their parts occur apart.

1. Words are counted; those of a language that reach the least count are its leading words. A phrase can't be more frequent
   than what it holds, so all others end a suffix.
2. Pairs of leading words next to each other are counted: the routing table of suffixes. Infrequent ones are abandoned.
3. A suffix is a place in a text with the words that follow, up to the deepest phrase, as far as all pairs are frequent. Each
   task sorts its suffixes and counts equal ones before it sends them on, by the hash of their leading pair; suffixes of
   pairs that hold more than a task's share are dealt by all their words instead, and their counts added up.
4. A task sorts the pointers to its suffixes by multikey three-way quicksort: each step splits a run of pointers by one word
   of a pivot into less, equal and greater; equal ones go on to the next word. The size of an equal run is the count of its
   phrase. Runs that hold less than the least count are abandoned, unless they are shares of a dealt pair.
5. Scores, the least one over all cuts; phrases that a longer one nearly always holds go; the first of each language stay.

What a task must know of words and pairs comes as bitmaps of a fixed size: a false hit there costs time and is dropped when
the counts are in. Nothing that is broadcast or collected grows with the corpus but one row a language.

Words are runs between spaces and tabs, within pieces between punctuation and line ends, after lower-casing A-Z. Hashes of
64 bits stand for words of a language.

Defined results: a null text holds nothing, a null language is `und`. Ties are by phrase, in the order of UTF-8 bytes. Rows
count each, ids aren't read. Whole texts of any length are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, prepare, slices, stored

LEAST, DEEPEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one that holds it has so many hundredths of its count.
INSIDE_PERCENT = 80
#: Bits of a bitmap.
BITS, HOT_BITS = 8 * BROADCAST_BYTES, BROADCAST_BYTES
#: Bytes of the pieces that Spark makes bitmaps in.
PIECE_BYTES = 4096
#: Suffixes a route gets on average at most, and the least number of routes.
ROUTE_SUFFIXES, ROUTES = 1 << 18, 1024
#: Pairs with more suffixes than so many are dealt, or than so many times the average of a route where that is more.
DEALT_FROM, DEALT_TIMES = 1 << 14, 4
#: Words, and pairs or suffixes, that a task counts before it sends them on.
HELD_WORDS, HELD_ROWS = 200_000, 1 << 20
#: Words whose hashes a task keeps.
KNOWN_WORDS = 100_000
#: Spark's seed of xxhash64.
SEED = 42

_ENDS = b".,;:!?\n\x0b\x0c\r"
_PIECES = bytes.maketrans(_ENDS, b"." * len(_ENDS))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) of each language in each slice of rows (lang, text); a piece ends with the word `.`."""
    for batch in slices(batches):
        texts: dict[str, list[bytes]] = {}
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if raw:
                texts.setdefault(lang, []).append(raw.lower().translate(_PIECES))
        for lang, found in texts.items():
            yield lang, b".".join(found).replace(b".", b" . ").split()


class _Coder:
    """Hashes of words of a language, as Spark's xxhash64(lang, word) has them; 0 for the end of a piece."""

    def __init__(self):
        import xxhash

        self.digest, self.known = xxhash.xxh64_intdigest, {}

    def __call__(self, lang: str, words: list[bytes]) -> np.ndarray:
        if sum(map(len, self.known.values())) > KNOWN_WORDS:
            self.known.clear()
        known = self.known.setdefault(lang, {b".": 0})
        if new := set(words).difference(known):
            seed = self.digest(lang.encode(), seed=SEED)
            for word in new:
                known[word] = self.digest(word, seed=seed)
        return np.array([known[w] for w in words], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _key(*words: np.ndarray) -> np.ndarray:
    """A hash of words in their order."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = _mixed(h * _ODD[0] + w * _ODD[1])
    return h


class Bitmap:
    """A set of 64-bit hashes that may hold more than was put in, in a fixed number of bits, a power of two."""

    def __init__(self, raw: bytearray):
        self.bits = np.frombuffer(bytes(raw), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(8 * len(self.bits) - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap(hashes: DataFrame, bits: int = BITS) -> Bitmap:
    """Of the column h, made by Spark in pieces of 4 KB."""
    rows = hashes.select((F.col("h").bitwiseAND(bits - 1) + 1).alias("at"))
    pieces = rows.groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    raw = bytearray(bits // 8)
    for r in pieces.collect():  # all of them are the bitmap
        start = (r["piece"] - 1) * PIECE_BYTES
        raw[start : start + PIECE_BYTES] = r["bits"]
    return Bitmap(raw)


def _count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text); the row of word null has how many words there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                del counts[b"."]  # a Counter doesn't mind if it isn't there
                words, numbers = [*counts, None], [*counts.values(), counts.total()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], ["lang", "word", "n"])
            held.clear()

        for lang, words in _words(batches):
            held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    counts = rows.mapInArrow(run, "lang string, word string, n bigint")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Held:
    """Rows of 64-bit numbers with counts; equal rows are added up when many are held."""

    def __init__(self, width: int):
        self.width, self.parts, self.rows = width, [], 0

    def add(self, columns: list[np.ndarray]) -> bool:
        """Whether it's time to take them."""
        self.parts.append(self._summed(np.stack(columns), np.ones(len(columns[0]), np.int64)))
        self.rows += self.parts[-1][0].shape[1]
        return self.rows > HELD_ROWS

    def _summed(self, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(rows[::-1])
        rows, n = rows[:, order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])) if len(n) else np.zeros(0, np.int64)
        return rows[:, first], np.add.reduceat(n, first) if len(n) else n

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows, sorted, and their counts."""
        if not self.parts:
            return np.zeros((self.width, 0), np.uint64), np.zeros(0, np.int64)
        found = self._summed(np.concatenate([r for r, _ in self.parts], axis=1), np.concatenate([n for _, n in self.parts]))
        self.parts, self.rows = [], 0
        return found


def _signed(column: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(column).view(np.int64))


def _count_pairs(rows: DataFrame, leading: Bitmap) -> DataFrame:
    """(w1, w2, n) of words next to each other that may both be frequent."""
    shipped = rows.sparkSession.sparkContext.broadcast(leading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, frequent = _Coder(), _Held(2), shipped.value

        def out() -> pa.RecordBatch:
            (w1, w2), n = held.take()
            return pa.RecordBatch.from_arrays([_signed(w1), _signed(w2), pa.array(n)], ["w1", "w2", "n"])

        for lang, words in _words(batches):
            codes = code(lang, words)
            fits = frequent.has(codes) & (codes != 0)
            at = np.flatnonzero(fits[:-1] & fits[1:])
            if len(at) and held.add([codes[at], codes[at + 1]]):
                yield out()
        yield out()

    return rows.mapInArrow(run, "w1 bigint, w2 bigint, n bigint").groupBy("w1", "w2").agg(F.sum("n").alias("n"))


class _Routing(NamedTuple):
    leading: Bitmap
    pairs: Bitmap
    hot: Bitmap
    routes: int


def _suffixes(rows: DataFrame, routing: _Routing, deepest: int) -> DataFrame:
    """(route, dealt, w1 .. , n): suffixes of at least three words whose pairs all may be frequent, counted within a task;
    words past the end are 0."""
    shipped = rows.sparkSession.sparkContext.broadcast(routing)
    names = ["route", "dealt", *(f"w{k + 1}" for k in range(deepest)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, to = _Coder(), _Held(deepest), shipped.value

        def out() -> pa.RecordBatch:
            words, n = held.take()
            pair = _key(words[0], words[1])
            dealt = to.hot.has(pair)
            route = np.where(dealt, _key(*words), pair) % np.uint64(to.routes)
            return pa.RecordBatch.from_arrays([pa.array(route.astype(np.int32)), pa.array(dealt), *map(_signed, words), pa.array(n)], names)

        for lang, words in _words(batches):
            codes = np.concatenate([code(lang, words), np.zeros(deepest, np.uint64)])
            fits = to.leading.has(codes) & (codes != 0)
            on = np.zeros(len(codes), bool)  # whether a frequent pair starts here
            at = np.flatnonzero(fits[:-1] & fits[1:])
            on[at] = to.pairs.has(_key(codes[at], codes[at + 1]))
            at = np.flatnonzero(on[:-1] & on[1:])
            if not len(at):
                continue
            columns, goes = [codes[at], codes[at + 1]], np.ones(len(at), bool)
            for k in range(2, deepest):
                goes = goes & on[at + k - 1]
                columns.append(np.where(goes, codes[at + k], 0))
            if held.add(columns):
                yield out()
        yield out()

    return rows.mapInArrow(run, ", ".join(["route int", "dealt boolean", *(f"{c} bigint" for c in names[2:])]))


def quicksorted(words: np.ndarray, n: np.ndarray, least: int, dealt: bool = False) -> list[tuple[int, int, int]]:
    """(depth, pointer to one suffix, count) of phrases of three words and more among suffixes words[depth, pointer] that
    occur n times each, by multikey three-way quicksort of the pointers. Word 0 ends a suffix. Runs that hold less than
    `least` are abandoned; of dealt suffixes, only those that share all words but the last, as others go on elsewhere."""
    found: list[tuple[int, int, int]] = []
    runs = [(np.arange(len(n)), 0)] if len(n) else []
    while runs:
        at, depth = runs.pop()
        column = words[depth, at]
        pivot = np.sort(column[[0, len(at) // 2, -1]])[1]
        for part, reached in ((at[column < pivot], depth), (at[column > pivot], depth), (at[column == pivot], depth + 1)):
            if not len(part) or (reached > depth and pivot == 0):
                continue
            size = int(n[part].sum())
            if size < least and (not dealt or depth == len(words) - 1):
                continue
            if reached > depth and reached >= 3:
                found.append((reached, int(part[0]), size))
            if reached < len(words):
                runs.append((part, reached))
    return found


def _count_phrases(suffixes: DataFrame, least: int, deepest: int) -> DataFrame:
    """(p, n): arrays of three words and more, with their counts, those that reach the least."""
    names = [f"w{k + 1}" for k in range(deepest)]

    def run(table: pa.Table) -> pa.Table:
        words = np.stack([table.column(c).to_numpy().view(np.uint64) for c in names])
        n, dealt = table.column("n").to_numpy(), table.column("dealt")[0].as_py()
        found = quicksorted(words, n, least, dealt)
        phrases = [words[:depth, at].view(np.int64) for depth, at, _ in found]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in phrases])]).astype(np.int32))
        return pa.table([pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *phrases]))), pa.array([x for *_, x in found], pa.int64())], names=["p", "n"])

    counts = suffixes.groupBy("route", "dealt").applyInArrow(run, "p array<bigint>, n bigint")
    return counts.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _slices(m: int) -> Column:
    """All slices of m words of a phrase p."""
    return F.transform(F.sequence(F.lit(1), F.size("p") - m + 1), lambda i: F.slice("p", i, m))


def _scored(counts: DataFrame, deepest: int, inside_percent: int) -> DataFrame:
    """(p, a, l, r, score) of candidates that stay, from counts (p, n) of all frequent phrases, single words included."""
    candidates = counts.where(F.size("p") > 1)
    cuts = candidates.select("p", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("left"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("right"))
    part = lambda name, count: counts.select(F.col("p").alias(name), F.col("n").alias(count))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.select("p", "a", "k", "l", "r", score.alias("score")).groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("p", "a", "c.l", "c.r", "c.score")

    longer = candidates.where(F.size("p") > 2)
    none = F.array().cast("array<array<bigint>>")
    held = F.flatten(F.array(*(F.when(F.size("p") > m, _slices(m)).otherwise(none) for m in range(2, deepest))))
    longer = longer.select("n", F.explode(F.array_distinct(held)).alias("p")).groupBy("p").agg(F.max("n").alias("longest"))
    kept = best.join(longer, "p", "left").where(F.expr(f"longest is null or cast(100 as decimal(3,0)) * cast(longest as decimal(19,0)) < cast({inside_percent} as decimal(3,0)) * cast(a as decimal(19,0))"))
    return kept.drop("longest")


def collocations(df: DataFrame, least: int = LEAST, deepest: int = DEEPEST, top: int | None = TOP, inside_percent: int = INSIDE_PERCENT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language (None: all) of two words and more
    that occur at least `least` times, by score, count and phrase. a: how often it occurs, l and r: its parts at the cut of
    the lowest score, n: words of the language. deepest: words of the longest phrases, three or more."""
    prepare(df.sparkSession)
    rows = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = stored(_count_words(rows).where((F.col("n") >= least) | F.col("word").isNull()))
    totals = words.where("word is null").select("lang", F.col("n").alias("n"))
    words = words.where("word is not null").withColumn("h", F.xxhash64("lang", "word"))
    leading = _bitmap(words)

    pairs = stored(_count_pairs(rows, leading).where(F.col("n") >= least))
    suffixes = pairs.agg(F.sum("n")).first()[0] or 0
    routes = max(ROUTES, -(-suffixes // ROUTE_SUFFIXES))
    keyed = pairs.mapInArrow(_pair_keys, "h bigint, n bigint")
    dealt = keyed.where(F.col("n") > max(DEALT_FROM, DEALT_TIMES * suffixes // routes))
    routing = _Routing(leading, _bitmap(keyed), _bitmap(dealt, HOT_BITS), routes)
    deeper = stored(_count_phrases(_suffixes(rows, routing, deepest), least, deepest))

    single = words.select(F.array("h").alias("p"), "n")
    counts = single.union(pairs.select(F.array("w1", "w2").alias("p"), "n")).union(deeper)
    scored = _scored(counts, deepest, inside_percent)
    of = words.select("h", "lang", "word")
    scored = stored(scored.join(of.select(F.col("h").alias("first"), "lang"), F.get("p", F.lit(0)) == F.col("first")).drop("first"))
    ranked = scored
    if top is not None:  # words are looked up for what may be among the first alone; equal ones all stay for now
        ranked = scored.withColumn("at", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("at") <= top).drop("at")
    spelled = ranked.select("p", F.posexplode("p").alias("at", "h")).join(of.select("h", "word"), "h").groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = ranked.join(spelled, "p").join(totals, "lang")
    return _ranked(out, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(rows: DataFrame, top: int | None) -> DataFrame:
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = rows.withColumn("rank", place)
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).withColumn("rank", F.col("rank").cast("long"))


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = _key(*(batch.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2")))
        yield pa.RecordBatch.from_arrays([_signed(key), batch.column("n")], ["h", "n"])
