"""Removal of repeated substrings: each byte covered by a string of `length` bytes that also starts anywhere else.

Equal strings get equal ranks, made by prefix doubling, and what is unique leaves early. Sorting a pair for each byte and
round would take many times the input's size, so positions are pruned before:

1. Windows (strings of `length` bytes) are grouped by an anchor of theirs: of the 24-byte strings inside, the one with the
   least hash. Equal windows have equal anchors in equal places. Neighbouring windows mostly have one anchor, and such a
   run is one row. Spark counts rows by anchor; where an anchor has one row, no window of it repeats.
2. Spark groups the rest by anchor and name of the whole run. A run that occurs twice or more has only windows that repeat.
3. What is left are runs that share an anchor with different runs. One of each goes to a group by anchor. There its windows
   are ranked by doubling (1, 2, 4, ... bytes up to `length`; a rank is a 64-bit name of the pair of ranks half as long),
   in numpy, and equal ranks are counted with the number of copies. Groups of more than `group_limit` runs aren't taken by
   one task: Spark groups their windows by rank.

An anchor or run may have a great part of all rows (a licence, a group of copies). Counts are combined before they move.
Anchors and runs with more than a thousandth of all rows are a thousand at most; this list is broadcast, and rows that have
one of them need no other join by it, so they stay spread.

Matches never cross texts. Distances are in bytes of UTF-8.

Defined results: a null text counts as empty; a text shorter than `length` keeps all. Repeated rows repeat each other, so
they're removed if long enough. Ids may be null or repeat. Texts of any length are taken whole. Other columns of the input
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, discard, numbered, own_ids, slices, stored, texts

LENGTH, ANCHOR = 200, 24
#: Runs of a group that one task ranks: their bytes and ranks take some 50 MB.
GROUP_LIMIT = 16_384
#: Bytes of text from which a worker ranks what it holds, and windows of a text that it takes at a time: some 60 bytes of
#: memory each.
CHUNK, PIECE = 400_000, 1 << 20
#: Bits of a place in what is ranked at a time; the others of a hash are compared, always as many.
PLACE_BITS = 26

_BYTES = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit name of two ranks."""
    x = left * _A + (right ^ (right >> np.uint64(31)))
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all strings of a length, by doubling; the last two halves may overlap."""
    ranks, n = _BYTES[data], 1
    while n < length:
        step = min(n, length - n)
        ranks = _pair(ranks[: len(ranks) - step], ranks[step:]) if len(ranks) > step else ranks[:0]
        n += step
    return ranks


def _runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor's name of each run, in texts that lie one after the other."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(np.uint64)
    names = _ranks(data, ANCHOR)
    width = length - ANCHOR + 1
    place = np.uint64((1 << PLACE_BITS) - 1)
    least, n = (names & ~place) | np.arange(len(names), dtype=np.uint64), 1
    while n < width:  # least of the next n, doubling
        step = min(n, width - n)
        least = np.minimum(least[:-step], least[step:])
        n += step
    anchor = (least & place).astype(np.int64)
    windows = np.arange(len(anchor))
    text = np.searchsorted(ends, windows, "right")
    inside = windows + length <= ends[text]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(anchor)) - 1
    keep = inside[first]
    return first[keep], last[keep], names[anchor[first[keep]]]


def _chunks(batches: Iterator[pa.RecordBatch], length: int, piece: int) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Keys, bytes and offsets of texts, some at a time. Of long texts they are those of pieces, each of which has `piece`
    windows of its own: runs are cut there, which changes what moves together, not which windows are equal."""
    keys, held, offsets, size = [], [], [], 0
    for batch in slices(batches):
        for key, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            raw = raw or b""
            for start in range(0, max(1, len(raw) - length + 1), piece):
                keys.append(key)
                held.append(raw[start : start + piece + length - 1])
                offsets.append(start)
                size += len(held[-1])
                if size >= CHUNK:
                    yield np.array(keys, np.int64), held, np.array(offsets, np.int64)
                    keys, held, offsets, size = [], [], [], 0
    if held:
        yield np.array(keys, np.int64), held, np.array(offsets, np.int64)


def _find_runs(docs: DataFrame, length: int, full: bool, piece: int = PIECE) -> DataFrame:
    """A row a run: anchor and, if full, run (name of its bytes), key of the text and at (first window * 256 + windows - 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for keys, held, offsets in _chunks(batches, length, piece):
            joined = b"".join(held)
            ends = np.cumsum([len(x) for x in held])
            first, last, anchor = _runs(np.frombuffer(joined, np.uint8), ends, length)
            columns = [pa.array(anchor.view(np.int64))]
            if full:
                view = memoryview(joined)
                names = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], dtype=np.uint64)
                text = np.searchsorted(ends, first, "right")
                at = (first - np.concatenate([[0], ends])[text] + offsets[text]) * 256 + (last - first)
                columns += [pa.array(names.view(np.int64)), pa.array(keys[text]), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "run", "key", "at"][: len(columns)])

    return docs.mapInArrow(run, "anchor bigint" + ", run bigint, key bigint, at bigint" * full)


def _often(counts: DataFrame, n: str) -> int:
    """A count that at most a thousand of the keys counted exceed."""
    return (counts.agg(F.sum(n)).first()[0] or 0) // 1000


def _of_shared(runs: DataFrame, shared: DataFrame) -> DataFrame:
    """Runs whose anchor is among the shared ones (anchor, n). Rows of the most frequent ones go anywhere."""
    hot = shared.where(F.col("n") > _often(shared, "n")).select("anchor", F.lit(True).alias("hot"))
    marked = runs.join(F.broadcast(hot), "anchor", "left").withColumn("place", F.when(F.col("hot"), F.xxhash64("key", "at")).otherwise(F.col("anchor")))
    there = shared.select(F.col("anchor").alias("place"), F.lit(True).alias("there"))
    return marked.join(there, "place", "left").where("hot or there").select(*runs.columns)


def _contents(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Adds the bytes of runs: from (anchor, key, at, copies) to the same and content."""
    of_text = stored(runs.groupBy("key").agg(F.collect_list(F.struct("anchor", "at", "copies")).alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            anchors, keys, ats, copies, contents = [], [], [], [], []
            for key, raw, found in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2)):
                for x in found.as_py():
                    first, more = divmod(x["at"], 256)
                    anchors.append(x["anchor"])
                    keys.append(key)
                    ats.append(x["at"])
                    copies.append(x["copies"])
                    contents.append(raw[first : first + more + length])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((anchors, keys, ats, copies, contents), (pa.int64(),) * 4 + (pa.binary(),))], ["anchor", "key", "at", "copies", "content"])

    return docs.join(of_text, "key").select("key", "text", "runs").mapInArrow(run, "anchor bigint, key bigint, at bigint, copies bigint, content binary")


def _windows(part: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of some runs: which run, which window of the run, and the name of its bytes."""
    contents = part.column("content").to_pylist()
    sizes = np.array([len(x) for x in contents])
    counts = sizes - length + 1
    ranks = _ranks(np.frombuffer(b"".join(contents), np.uint8), length)
    run = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return run, within, ranks[np.repeat(np.cumsum(sizes) - sizes, counts) + within]


def _repeated(part: pa.Table, length: int) -> pa.RecordBatch | None:
    """Windows that repeat in a group of runs with one anchor, as ranges (key, first, last); runs with copies are known."""
    run, within, names = _windows(part, length)
    copies = part.column("copies").to_numpy()
    _, group = np.unique(names, return_inverse=True)
    twice = np.bincount(group, weights=copies[run])[group] > 1
    twice &= copies[run] == 1
    if not twice.any():
        return None
    run, within = run[twice], within[twice]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (within[1:] != within[:-1] + 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(run)) - 1
    base = part.column("at").to_numpy()[run[start]] // 256
    return pa.RecordBatch.from_arrays([part.column("key").combine_chunks().take(pa.array(run[start])), pa.array(base + within[start]), pa.array(base + within[end])], ["key", "first", "last"])


def _in_groups(contents: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group at hand: rows come sorted by anchor
        last = None
        for batch in batches:
            anchors = batch.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist()]
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                if start == end:
                    continue
                if anchors[start] != last and held:
                    out = _repeated(pa.Table.from_batches(held), length)
                    if out is not None:
                        yield out
                    held = []
                last = anchors[start]
                held.append(batch.slice(start, end - start))
        if held:
            out = _repeated(pa.Table.from_batches(held), length)
            if out is not None:
                yield out

    return contents.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "key bigint, first bigint, last bigint")


def _by_windows(contents: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: a row a window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            part = pa.Table.from_batches([batch])
            which, within, names = _windows(part, length)
            take = lambda c: part.column(c).combine_chunks().take(pa.array(which))
            yield pa.RecordBatch.from_arrays([take("anchor"), pa.array(names.view(np.int64)), take("key"), pa.array(part.column("at").to_numpy()[which] // 256 + within), take("copies")], ["anchor", "name", "key", "first", "copies"])

    rows = contents.mapInArrow(run, "anchor bigint, name bigint, key bigint, first bigint, copies bigint")
    twice = stored(rows.groupBy("anchor", "name").agg(F.sum("copies").alias("n")).where("n > 1").drop("n"))
    return rows.where("copies = 1").join(twice, ["anchor", "name"]).select("key", "first", F.col("first").alias("last"))


def _spans(ranges: DataFrame, length: int) -> DataFrame:
    """(key, starts, ends): the maximal removed byte ranges of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, ends = [], []
            for found in batch.column(1):
                spans = np.stack([found.values.field(0).to_numpy(), found.values.field(1).to_numpy() + length])
                spans = spans[:, np.argsort(spans[0], kind="stable")]
                reach = np.maximum.accumulate(spans[1])
                new = np.concatenate([[True], spans[0][1:] > reach[:-1]])
                starts.append(spans[0][new].tolist())
                ends.append(reach[np.append(np.flatnonzero(new)[1:], len(new)) - 1].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["key", "starts", "ends"])

    grouped = ranges.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    return grouped.mapInArrow(run, "key bigint, starts array<bigint>, ends array<bigint>")


def remove_repeated(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT, piece: int = PIECE) -> DataFrame:
    """Returns id_col, n_bytes, starts and ends (of removed byte ranges) and kept (the bytes that remain)."""
    if not ANCHOR <= length <= ANCHOR + 255:
        raise ValueError(f"length must be from {ANCHOR} to {ANCHOR + 255}")
    if not 0 < piece <= 1 << (PLACE_BITS - 1):
        raise ValueError(f"a piece has up to {1 << (PLACE_BITS - 1)} windows")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if own_ids(rows, "id"):
        docs = rows.select(F.col("id").cast("bigint").alias("key"), "id", "text")
    else:
        docs = numbered(df, id_col, text_col).select(F.col(ROW).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = docs.select("key", "text").where(F.octet_length("text") >= length)

    shared = stored(_find_runs(long, length, full=False, piece=piece).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    runs = stored(_of_shared(_find_runs(long, length, full=True, piece=piece), shared))
    discard(shared)
    kinds = stored(runs.groupBy("anchor", "run").agg(F.count("*").alias("copies"), F.min(F.struct("key", "at")).alias("one")))
    twice = kinds.where("copies > 1")
    hot = F.broadcast(twice.where(F.col("copies") > _often(twice, "copies")).select("anchor", "run"))
    several = runs.join(hot, ["anchor", "run"], "left_semi").unionByName(runs.join(hot, ["anchor", "run"], "left_anti").join(twice.select("anchor", "run"), ["anchor", "run"]))
    known = several.select("key", F.floor(F.col("at") / 256).alias("first"), (F.floor(F.col("at") / 256) + F.col("at") % 256).alias("last"))
    groups = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 and fewest = 1").drop("fewest"))
    open_runs = kinds.join(groups, "anchor").select("anchor", F.col("one.key").alias("key"), F.col("one.at").alias("at"), "copies", "kinds")
    found = known.unionByName(_in_groups(_contents(long, open_runs.where(F.col("kinds") <= group_limit), length), length))
    if groups.where(F.col("kinds") > group_limit).limit(1).count():
        found = found.unionByName(_by_windows(_contents(long, open_runs.where(F.col("kinds") > group_limit), length), length))
    spans = stored(_spans(found, length))
    discard(runs, kinds, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, kept, empty = [], [], []
            for raw, starts, ends in zip(texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = raw or b""
                sizes.append(len(raw))
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(ends or [])], [*(starts or []), len(raw)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(c if not c.null_count else pa.array([x or [] for x in c.to_pylist()], c.type) for c in (batch.column(2), batch.column(3))), pa.array(kept, pa.binary())], [id_col, "n_bytes", "starts", "ends", "kept"])

    whole = docs.join(spans, "key", "left").select("id", "text", "starts", "ends")
    return whole.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")
