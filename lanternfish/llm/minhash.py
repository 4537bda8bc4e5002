"""MinHash near duplicates: SuperMinHash signatures, banding, verification, union-find grouping.

1. A document's set of word shingles gets a SuperMinHash signature: each element draws a permutation of the slots and puts a
   number that grows from step to step into them, in that order; a slot keeps the least. As the steps of an element are
   correlated, signatures vary less than with independent hashes, and a set is done once every slot holds less than the
   next step can bring: after a step or two, for most texts. Equal sets are one class.
2. Slots go into bands of ROWS; classes with an equal band share a bucket. BANDS bands miss a pair at the threshold of 0.85
   with probability (1 - 0.85^ROWS)^BANDS, less than 1e-10, and likelier ones still less.
3. Each class is first compared with one class of its buckets, of those that come first in a bucket the one that it shares
   the most bands with; groups of copies thus become components after a number of comparisons in proportion to their rows.
4. Buckets that still hold several components are searched pair by pair in bounded tiles. All candidates are confirmed on
   full sets, as sorted arrays of shingles. Neither step caps a bucket or the partners of a document.
5. Tasks group links by union-find and send on one link a joined set; star contraction joins these across tasks.

Words are runs between the ASCII white space bytes after lower-casing A-Z. Hashes of 64 bits stand for shingles.

Defined results: a null text or one without words has 0 shingles and is its own component; fewer words than a shingle's
make one shingle. Repeated rows are of one class. A null doc_id gets the least doc_id of its component, or null; a row is
kept if its id is that of its component, both null counting as equal, so rows that share that id all are. Whole texts of any
length are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, discard, numbered, slices, stored, texts
from .graph import components
from .jaccard import BITS, Shingler, _bitmap, _linked, _mixed, _pairs_within_bound, _tile_pairs, by_key

SHINGLE, PERCENT = 5, 85
ROWS, BANDS = 4, 32
#: Elements of a set that draw their permutations at one time.
ELEMENTS = 1 << 14
#: Nodes of a task's union-find.
FOREST_NODES = 1 << 19

_STEP, _FRACTION, _HALF = 0x9E3779B97F4A7C15, np.uint64(0xFFFFFFFF), np.uint64(32)


def _step(step: int) -> np.uint64:
    return np.uint64((step + 1) * _STEP % (1 << 64))


def signature(hashes: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of distinct hashes: a slot's step in the upper half, its random number in the lower."""
    best = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), ELEMENTS):
        block = hashes[start : start + ELEMENTS].view(np.uint64)
        order, every = None, np.arange(len(block))
        for step in range(slots):
            drawn = _mixed(block + _step(step))
            other = step + ((drawn >> _HALF) * np.uint64(slots - step) >> _HALF).astype(np.int64)
            if step == 0:  # permutations are still in their first order, and most sets need no second step
                first = slot = other
            else:
                if order is None:
                    order = np.tile(np.arange(slots, dtype=np.uint16), (len(block), 1))
                    order[every, first] = 0
                slot = order[every, other]
                order[every, other] = order[every, step]
            np.minimum.at(best, slot, (np.uint64(step) << _HALF) | (drawn & _FRACTION))
            if best.max() < np.uint64(step + 1) << _HALF:
                break
    return best


def bands(signed: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band of a signature and of its place."""
    parts = signed.reshape(-1, rows)
    h = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(_STEP)
    for k in range(rows):
        h = _mixed(h + parts[:, k])
    return h.view(np.int64)


def _signatures(df: DataFrame, size: int, rows: int, count: int) -> DataFrame:
    """(id, row, n, key, bitmap, bands) from (id, row, text): key is a digest of the whole set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches):
            sets = list(map(shingler, texts(batch.column(2))))
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            made = [bands(signature(s, rows * count), rows) if len(s) else s for s in sets]
            ends = pa.array(np.concatenate([[0], np.cumsum(list(map(len, made)))]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *made])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array([_bitmap(s, BITS) for s in sets], pa.binary()), lists], ["id", "row", "n", "key", "bitmap", "bands"])

    return df.select("id", "row", "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, row bigint, n bigint, key binary, bitmap binary, bands array<bigint>")


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that join the same nodes, fewer of them: each task keeps those that union-find hadn't joined yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = up = parent.setdefault(up, up)
                x = up
            return x

        for batch in batches:
            joined = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (a := find(a)) != (b := find(b)):
                    parent[max(a, b)] = min(a, b)
                    joined.append((max(a, b), min(a, b)))
            a, b = np.array(joined, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            if len(parent) > FOREST_NODES:
                parent.clear()

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _grouped(links: DataFrame) -> DataFrame:
    return components(forest(links))


def near_duplicates(df: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, count: int = BANDS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Returns id_col, n_shingles, component_id (the smallest id reachable by links) and kept for every row. row_col: a number
    of each row that no other has and that stays the same, if df has one."""
    docs = (df.withColumnRenamed(row_col, ROW) if row_col else numbered(df, id_col, text_col)).select(F.col(id_col).alias("id"), F.col(ROW).alias("row"), F.col(text_col).alias("text"))
    signed = stored(_signatures(docs, size, rows, count))
    classes = stored(signed.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.count("*").alias("copies")))
    nodes = stored(signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "bitmap", "bands"))
    placed = nodes.select(F.explode("bands").alias("h"), "node")
    shared = placed.groupBy("h").agg(F.count("*").alias("of"), F.min("node").alias("hub")).where("of > 1")
    buckets = stored(placed.join(shared, "h").select("h", "node", "hub"))

    # one comparison a class
    common = buckets.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("common"))
    best = common.groupBy("node").agg(F.max(F.struct("common", "hub")).alias("best"))
    pairs = best.select(F.col("node").alias("a"), F.col("best.hub").alias("b"))
    links = _linked(docs, stored(_pairs_within_bound(pairs, nodes, percent)), size, percent)
    labels = _grouped(links)

    # what is left: buckets of several components
    labelled = buckets.select("h", "node").join(nodes.select("node", "n").join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label")), "node")
    mixed = labelled.groupBy("h").agg(F.count("*").alias("of"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    mixed = mixed.where(f"low <> high and (of > 2 or 100 * least >= {percent} * most)").select("h", "of")
    open_rows = labelled.join(mixed, "h").join(nodes.select("node", "bitmap"), "node").select("h", "of", "node", "label", "n", "bitmap")
    more = _linked(docs, stored(_tile_pairs(open_rows, percent)), size, percent)
    final = _grouped(links.union(more)) if more.limit(1).count() else labels
    discard(buckets, links, more, nodes, *([] if final is labels else [labels]))

    named = classes.join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_key = stored(named.join(least, "label").select("key", "copies", "component_id"))
    out = by_key(signed.select("id", "n", "key"), of_key).select("id", "n", "component_id").union(signed.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
