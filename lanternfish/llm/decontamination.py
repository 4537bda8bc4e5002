"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in segments. A segment numbers the words of its documents, with a gap between documents, and holds
for each term the sorted list of its positions (postings). The index is stored in the shared folder, and no posting is
shuffled. Test items become windows of `window` words. In each segment the postings of a window's rarest term (by count
over all documents), less its offset in the window, are candidate starts; the offset-adjusted lists of the other terms,
rarest first, are intersected with them. What is left are exact phrase matches. With an offset that may differ by `slop`
and up to a fifth of the terms missing, the same pass gives proximity matches. As the rarest term may be a missing one,
these also start from the next rarest places: one more than may be missing, so each match holds one of them.

Test items are taken in blocks of bounded size, long ones in pieces that overlap by a window less a word. If they fit in
one block, only terms of theirs are indexed. Windows, terms and postings are integer arrays; all candidates of a segment
are tested at once, a bounded number at a time.

Words are runs of characters other than 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F after lower-casing A-Z.

Defined results: a null or empty text has no words, no hits and no items. An item with fewer words than a window is one
window; one without words never occurs. Items of equal text are all listed; an item_id that repeats is listed once, and
one that is null isn't listed, though its words count as hit. Repeated documents give repeated rows.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, discard, slices, small_enough, stored, texts

WINDOW, SLOP = 10, 2
#: Words of test items in a block, about; a block is broadcast: some 40 bytes a word in arrays, and its terms. Windows of a
#: longer item that go together.
BLOCK_WORDS, PIECE_WINDOWS = 250_000, 10_000
#: Candidates that a task tests at a time.
CANDIDATES = 1 << 20
#: A segment is closed when it holds so many documents or words.
SEGMENT_DOCS, SEGMENT_WORDS = 4 * SLICE, 1_000_000
GAP = 64

_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_WORDS).split()


def build_index(df: DataFrame, vocabulary: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a segment: ids, starts and n_words of its documents; terms, the end of each one's postings, and positions
    (32-bit integers). vocabulary: terms to index (it's broadcast, so its size must be bounded); None for all."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"ids array<{id_type}>, starts binary, n_words binary, terms array<binary>, ends binary, positions binary"
    given = df.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(sorted(vocabulary))}) if vocabulary is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_field = None

        def segment() -> pa.RecordBatch:
            codes = np.concatenate(found) if found else np.zeros(0, np.int32)
            at = np.concatenate([np.arange(s, s + n, dtype=np.int32) for s, n in zip(starts, counts)]) if starts else np.zeros(0, np.int32)
            if given:
                at, codes = at[codes >= 0], codes[codes >= 0]
            order = np.argsort(codes, kind="stable")
            present, first = np.unique(codes[order], return_index=True)
            names = list(lookup)
            ends = np.append(first[1:], len(codes)).astype(np.int32) if len(present) else np.zeros(0, np.int32)
            row = [pa.concat_arrays(ids).to_pylist()], [np.array(starts, np.int32).tobytes()], [np.array(counts, np.int32).tobytes()], [[names[i] for i in present]], [ends.tobytes()], [at[order].tobytes()]
            kinds = pa.list_(id_field), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["ids", "starts", "n_words", "terms", "ends", "positions"])

        ids, starts, counts, found, at, lookup = [], [], [], [], 0, given.value if given else {}
        for batch in slices(batches):
            id_field = batch.column(0).type
            ids.append(batch.column(0))
            for raw in texts(batch.column(1)):
                words = words_of(raw)
                if given:
                    codes = np.array(list(map(lookup.get, words, repeat(-1))), dtype=np.int32)
                else:
                    codes = np.array([lookup.setdefault(w, len(lookup)) for w in words], dtype=np.int32)
                starts.append(at)
                counts.append(len(words))
                found.append(codes)
                at += len(words) + GAP
            if len(starts) >= SEGMENT_DOCS or at >= SEGMENT_WORDS:
                yield segment()
                ids, starts, counts, found, at, lookup = [], [], [], [], 0, given.value if given else {}
        if starts:
            yield segment()

    return df.select(id_col, text_col).mapInArrow(run, schema)


class Windows:
    """The distinct windows of a block of items as rows of term numbers, and which items hold each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary = sorted({word for _, words in items for word in words})
        number = {word: i for i, word in enumerate(self.vocabulary)}
        self.names = sorted({item for item, _ in items if item is not None})
        name = {item: i for i, item in enumerate(self.names)}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, words in items:
            codes = np.array([number[w] for w in words], np.int32)
            if len(codes) >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(codes, window))
            elif len(codes):
                rows.append(np.pad(codes, (0, window - len(codes)), constant_values=-1)[None])
            else:
                continue
            owners.append(np.full(len(rows[-1]), name.get(item, -1)))
        self.terms, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.sizes = (self.terms >= 0).sum(axis=1)
        held = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)]), axis=1)
        held = held[:, held[1] >= 0]
        self.items, self.item_ends = held[1].astype(np.int32), np.searchsorted(held[0], np.arange(len(self.terms) + 1))

    def rank(self, counts: np.ndarray) -> None:
        """Puts the terms of each window in the order of their counts, rarest first; offsets are their places in the window."""
        key = np.where(self.terms >= 0, counts[self.terms] if len(counts) else 0, np.iinfo(np.int64).max)
        self.offsets = np.argsort(key, axis=1, kind="stable").astype(np.int8)
        self.terms = np.take_along_axis(self.terms, self.offsets.astype(np.int64), axis=1)

    def match(self, keys: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, starts, whether exact) of matches in a segment, given as sorted keys (term * 2^32 + position). A match may
        come several times, but an exact one only from the window's rarest term."""
        if not len(keys) or not len(self.terms):
            return
        from_, to = (np.searchsorted(keys, np.arange(len(self.vocabulary), dtype=np.int64) + more << 32) for more in (0, 1))
        spare = self.sizes // 5
        for probe in range(int(spare.max()) + 1):
            windows = np.flatnonzero((spare >= probe) & (self.terms[:, probe] >= 0))
            windows = windows[to[self.terms[windows, probe]] > from_[self.terms[windows, probe]]]
            many = np.cumsum(to[self.terms[windows, probe]] - from_[self.terms[windows, probe]])
            at = 0
            while at < len(windows):
                until = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + CANDIDATES, "right")))
                yield from self._test(windows[at:until], probe, keys, from_, to, spare, slop)
                at = until

    def _test(self, windows: np.ndarray, probe: int, keys: np.ndarray, from_: np.ndarray, to: np.ndarray, spare: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        first = from_[self.terms[windows, probe]]
        counts = to[self.terms[windows, probe]] - first
        for low in range(0, int(counts.max()), CANDIDATES) if len(windows) == 1 else (0,):  # one window may have more alone
            n = np.clip(counts - low, 0, CANDIDATES) if len(windows) == 1 else counts
            k = np.repeat(windows, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first + low, n)
            starts = (keys[place] & 0xFFFFFFFF) - self.offsets[k, probe]
            missing = np.zeros(len(k), np.int8)
            last = len(keys) - 1
            for j in (j for j in range(self.terms.shape[1]) if j != probe):
                term = self.terms[k, j].astype(np.int64)
                wanted = np.maximum(starts + self.offsets[k, j] - slop, 0)
                found = keys[np.minimum(np.searchsorted(keys, (term << 32) + wanted), last)]
                near = (found >= (term << 32) + wanted) & (found <= (term << 32) + starts + self.offsets[k, j] + slop)
                missing += (term >= 0) & ~near
                alive = missing <= spare[k]
                if not alive.all():
                    k, starts, missing = k[alive], starts[alive], missing[alive]
            if len(k):
                exact = missing == 0
                for j in range(self.terms.shape[1]):
                    term = self.terms[k, j].astype(np.int64)
                    key = (term << 32) + starts + self.offsets[k, j]
                    exact &= (term < 0) | (keys[np.minimum(np.searchsorted(keys, key), last)] == key)
                take = np.full(len(k), True) if not probe else ~exact
                yield k[take], starts[take], exact[take]

    def held(self, pairs: np.ndarray) -> dict[int, list[str]]:
        """Sorted items of each document, from (document, window) pairs."""
        documents, windows = pairs
        n = self.item_ends[windows + 1] - self.item_ends[windows]
        items = self.items[np.repeat(self.item_ends[windows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        found: dict[int, list[str]] = defaultdict(list)
        for document, item in np.unique(np.stack([np.repeat(documents, n), items]), axis=1).T.tolist():
            found[document].append(self.names[item])
        return found


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, dict]]:
    for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
        column = lambda name: batch.column(batch.schema.names.index(name))[0]  # noqa: B023, E731
        yield column("ids").values, {"terms": column("terms").values} | {name: np.frombuffer(column(name).as_py(), np.int32) for name in ("starts", "n_words", "ends", "positions")}


def _segment_keys(segment: dict, vocabulary: pa.Array) -> np.ndarray:
    """Sorted (term * 2^32 + position) of the postings whose terms are in the vocabulary."""
    terms = pc.fill_null(pc.index_in(segment["terms"], value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    each = np.repeat(terms, np.diff(segment["ends"], prepend=0))
    return np.sort((each[each >= 0] << 32) + segment["positions"][each >= 0])


def search(index: DataFrame, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW, slop: int = SLOP, id_col: str = "doc_id", found_only: bool = False, sent: list[Broadcast] | None = None) -> DataFrame:
    """For a block of items, all documents of an index (or those with a match): id_col, n_words, hit_positions (sorted places
    of words in exact matches), items and near_items (ids of those with exact, and with only proximity matches)."""
    if window + slop > GAP:
        raise ValueError(f"windows of up to {GAP - slop} words only: documents in a segment lie {GAP} places apart")
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    windows = Windows(items, window)
    context = index.sparkSession.sparkContext
    shipped_terms = context.broadcast(pa.array(windows.vocabulary, pa.binary()))
    sent = [] if sent is None else sent  # gets what was broadcast, to be destroyed when the result is stored
    sent.append(shipped_terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shipped_terms.value
        totals = np.zeros(len(terms), np.int64)
        for batch in batches:
            for names, ends in zip(batch.column(0), batch.column(1).to_pylist()):
                place = pc.fill_null(pc.index_in(names.values, value_set=terms), -1).to_numpy(zero_copy_only=False)
                np.add.at(totals, place[place >= 0], np.diff(np.frombuffer(ends, np.int32), prepend=0)[place >= 0])
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(totals[there])], ["term", "n"])

    counts = np.zeros(len(windows.vocabulary), np.int64)
    for r in index.select("terms", "ends").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    windows.rank(counts)
    windows.vocabulary = shipped_terms.value
    shipped = context.broadcast(windows)
    sent.append(shipped)
    schema = f"`{id_col}` {id_type}, n_words bigint, hit_positions array<int>, items array<string>, near_items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shipped.value
        for ids, segment in _segments(batches):
            starts, n_words = segment["starts"], segment["n_words"]
            n, hit = len(starts), np.zeros((int(starts[-1]) + int(n_words[-1]) + 1 if len(starts) else 0) + 1, np.int32)
            exact_of, near_of = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
            for k, at, exact in windows.match(_segment_keys(segment, windows.vocabulary), slop):
                np.add.at(hit, at[exact], 1)
                np.add.at(hit, at[exact] + windows.sizes[k[exact]], -1)
                # a proximity match may begin before its document does
                doc = np.clip(np.searchsorted(starts, np.where(exact, at, at + windows.sizes[k]), "right") - 1, 0, None)
                exact_of.append(np.stack([doc[exact], k[exact]]))
                near_of.append(np.stack([doc[~exact], k[~exact]]))
            hit = np.cumsum(hit) > 0
            exact_items, near_items = windows.held(np.concatenate(exact_of, axis=1)), windows.held(np.concatenate(near_of, axis=1))
            hits = [np.flatnonzero(hit[s : s + m]).astype(np.int32) for s, m in zip(starts.tolist(), n_words.tolist())]
            near = [sorted({*near_items[i]} - {*exact_items.get(i, ())}) if i in near_items else [] for i in range(n)]
            out = pa.RecordBatch.from_arrays([ids, pa.array(n_words.astype(np.int64)), pa.array(hits, pa.list_(pa.int32())), pa.array([exact_items.get(i, []) for i in range(n)], pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))], [id_col, "n_words", "hit_positions", "items", "near_items"])
            yield out.filter(pa.array([bool(len(hits[i]) or near[i]) for i in range(n)], pa.bool_())) if found_only else out

    return index.mapInArrow(run, schema)


def _pieces(benchmark: DataFrame, window: int, item_col: str, item_text_col: str) -> DataFrame:
    """(item, words): items, long ones in pieces that together have the same windows."""
    lower = F.translate(F.coalesce(F.col(item_text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE_WINDOWS))
    return items.withColumn("begin", F.explode(begins)).select("item", F.slice("words", F.col("begin") + 1, F.lit(PIECE_WINDOWS + window - 1)).alias("words"))


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """All documents against all test items: the columns of search()."""
    pieces = _pieces(benchmark, window, item_col, item_text_col)
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = -(-total // block_words) or 1

    def block(k: int) -> list[tuple[str | None, list[bytes]]]:
        rows = pieces if n_blocks == 1 else pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == k)
        return [(r["item"], [w.encode("utf-8") for w in r["words"]]) for r in rows.collect()]

    if n_blocks == 1:
        only = block(0)
        index = stored(build_index(df, {w for _, words in only for w in words}, id_col, text_col))
        return search(index, only, window, slop, id_col)
    # each row gets a key of its own, as ids may repeat
    index = stored(build_index(df.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("__key"), F.col(text_col).alias("__text")), None, "__key", "__text"))
    parts = []
    for k in range(n_blocks):  # what a block needs on driver and executors goes before the next one comes
        sent: list[Broadcast] = []
        parts.append(stored(search(index, block(k), window, slop, "__key", found_only=True, sent=sent).drop("n_words")))
        for x in sent:
            x.destroy()
    found = reduce(DataFrame.unionByName, parts)
    merged = found.groupBy("__key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_positions")))).alias("hit_positions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("near_items")).alias("near"),
    )
    merged = stored(merged.select(F.col("__key.row").alias("row"), "hit_positions", "items", F.array_sort(F.array_distinct(F.array_except("near", "items"))).alias("near_items")))
    discard(*parts)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, segment in _segments(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(segment["n_words"].astype(np.int64))], ["__key", "n_words"])

    rows = index.mapInArrow(lengths, f"__key {index.schema['ids'].dataType.elementType.simpleString()}, n_words bigint").select(F.col("__key.row").alias("row"), F.col("__key.id").alias(id_col), "n_words")
    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    return rows.join(small_enough(merged), "row", "left").select(id_col, "n_words", none("hit_positions", "int"), none("items", "string"), none("near_items", "string"))
