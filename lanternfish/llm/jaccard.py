"""N-gram Jaccard join: documents that share at least `percent` hundredths of their word shingles, and what they link to.

1. A document's shingles become sorted 64-bit hashes, and the set a hashed bitmap. Equal sets are one class.
2. Two sets that link share an element of their prefixes: the first n - ceil(t n) + 1 elements in any one order. The order
   used puts frequent shingles last (a bounded list from a sample; it changes speed only). Elements that no other
   class has in its prefix are dropped.
3. Each class is first compared with one class of its buckets, one whose prefix is shared the most; groups of copies thus
   become components after a number of comparisons in proportion to their rows.
4. Buckets that still hold several components are cut into size-banded tiles: a band and the next hold all sizes that can
   link. In a tile bit counts bound the overlap of each pair of different components from above.
5. Pairs that pass the bound are intersected exactly as sorted arrays. Links of both steps give the components.

No pair that could join two components is left out, so components are those of all links. Pairs inside a component are
skipped; link_pairs() compares and returns all.

Words are runs between the ASCII white space bytes after lower-casing A-Z. Hashes of 64 bits stand for shingles.

Defined results: a null text or one without words has 0 shingles and is its own component; fewer words than a shingle's
make one shingle. Repeated rows are of one class. A null doc_id gets the least doc_id of its component, or null. Whole
texts of any length are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, discard, numbered, slices, small_enough, stored, texts
from .graph import components

SHINGLE, PERCENT = 5, 80
#: Frequent shingles that are put last: at most so many, seen in so many texts of the sampled share.
MAX_FREQUENT, SAMPLE_SHARE, SAMPLE_MIN = 200_000, 16, 8
BITS = 1024
#: Buckets are named by so many bits of a hash: two elements of one name only add candidates.
BUCKET_MASK = (1 << 48) - 1
TILE_ROWS, SMALL_TILE = 1024, 32
#: A class with more than one in so many rows has its rows joined by broadcast.
HOT_SHARE = 1000
#: Classes whose arrays are compared at once, some 10 MB in all, without a look at wider bitmaps first.
FEW_ARRAYS = 2_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of a text. Word hashes are kept, up to a bounded number."""

    def __init__(self, size: int):
        import xxhash

        self.size, self.known, self.digest = size, {}, xxhash.xxh3_64_intdigest
        steps = np.arange(1, size + 1, dtype=np.uint64)
        self.factors = _mixed(steps * _MULTIPLIERS[0]) | np.uint64(1)

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = (raw or b"").lower().split()
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        if len(known) > 100_000:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.digest(word)
        codes = np.array([known[w] for w in words], dtype=np.uint64)
        n = min(self.size, len(codes))
        windows = len(codes) - n + 1
        total = np.full(windows, n, dtype=np.uint64)
        for i in range(n):
            total += codes[i : i + windows] * self.factors[i]
        return np.unique(_mixed(total).view(np.int64))


def _bitmap(hashes: np.ndarray, size: int) -> bytes:
    bits = np.zeros(max(size, 8), np.uint8)
    bits[hashes.view(np.uint64) % np.uint64(len(bits))] = 1
    return np.packbits(bits).tobytes()


def _frequent(df: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches):
            found, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *map(shingler, texts(batch.column(0)))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["h", "n"])

    sample = df.where(F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(SAMPLE_SHARE)) == 0).select("text")
    counts = sample.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_MIN)
    return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).collect()], dtype=np.int64))


def _signatures(df: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(id, row, n, key, bitmap, prefix) from (id, row, text): key is a digest of the whole set."""
    shipped = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last = Shingler(size), shipped.value
        for batch in slices(batches):
            ns, keys, bitmaps, prefixes = [], [], [], []
            for raw in texts(batch.column(2)):
                hashes = shingler(raw)
                n = len(hashes)
                ns.append(n)
                keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                bitmaps.append(_bitmap(hashes, BITS))
                length = n - -(-percent * n // 100) + 1 if n else 0
                if len(last) and n:
                    known = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
                    hashes = np.concatenate([hashes[~known], hashes[known]])
                prefixes.append(hashes[:length] & BUCKET_MASK)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32))
            prefix = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(bitmaps, pa.binary()), prefix], ["id", "row", "n", "key", "bitmap", "prefix"])

    return df.select("id", "row", "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, row bigint, n bigint, key binary, bitmap binary, prefix array<bigint>")


def _again(df: DataFrame, nodes: DataFrame, size: int, wide: bool) -> DataFrame:
    """(node, n, made) of classes, named by the row of their first document, from its text: a wide bitmap of four to eight
    bits an element, or the sorted hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches):
            found = list(map(shingler, texts(batch.column(1))))
            made = [_bitmap(hashes, 4 << (len(hashes) - 1).bit_length()) if wide else hashes.tobytes() for hashes in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(made, pa.binary())], ["node", "n", "made"])

    wanted = df.join(small_enough(nodes).select(F.col("node").alias("row")), "row", "left_semi")
    return wanted.select(F.col("row").alias("node"), "text").mapInArrow(run, "node bigint, n bigint, made binary")


def _compared(df: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, percent: int, wide: bool) -> DataFrame:
    """Pairs (a, b) of classes that link, by exact intersection of sorted arrays; if wide, those that may, by bitmaps. nodes
    holds the classes in pairs."""
    made = stored(_again(df, nodes, size, wide))

    def fold(bitmap: np.ndarray, length: int) -> np.ndarray:
        return np.bitwise_or.reduce(bitmap.reshape(-1, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for n_x, n_y, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                if wide:
                    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    length = min(len(x), len(y))
                    x, y = fold(x, length), fold(y, length)
                    ones_x, ones_y, both = (int(np.bitwise_count(z).sum(dtype=np.int64)) for z in (x, y, x & y))
                    keep.append(bool(_bounded(percent, n_x, n_y, ones_x, ones_y, both)))
                else:
                    both = len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
                    keep.append(100 * both >= percent * (n_x + n_y - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    of = lambda side: made.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("made").alias(f"made_{side}"))
    joined = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "made_a", "made_b")
    found = stored(joined.mapInArrow(run, "a bigint, b bigint"))
    discard(made)
    return found


def _ends(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())


def _linked(df: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of stored pairs (a, b) of classes those that link. Wide bitmaps, a tenth of the arrays, rule out most before arrays
    move, unless arrays are few."""
    nodes = _ends(pairs)
    if nodes.limit(FEW_ARRAYS + 1).count() > FEW_ARRAYS:
        close = _compared(df, pairs, nodes, size, percent, wide=True)
        discard(pairs, nodes)
        pairs, nodes = close, _ends(close)
    links = _compared(df, pairs, nodes, size, percent, wide=False)
    discard(pairs, nodes)
    return links


def _bounded(percent: int, n_a: np.ndarray, n_b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether the overlap, at most what the bits allow, can reach the threshold. Bits that only one set has prove elements
    that the other lacks."""
    overlap = np.minimum(n_a - (bits_a - both), n_b - (bits_b - both))
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def _words(bitmaps: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bitmaps.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _pairs_within_bound(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Drops pairs that the bitmaps rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = _words(batch.column("bitmap_a")), _words(batch.column("bitmap_b"))
            n_a, n_b = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
            count = lambda words: np.bitwise_count(words).sum(axis=1, dtype=np.int64)
            yield batch.filter(pa.array(_bounded(percent, n_a, n_b, count(x), count(y), count(x & y)))).select(["a", "b"])

    of = lambda side: classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bitmap").alias(f"bitmap_{side}"))
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a bigint, b bigint")


def _tile_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """From (h, of, node, label, n, bitmap), `of` being the rows of a bucket h: pairs (a, b) of different labels in a bucket
    that the bitmaps can't rule out. A bucket of up to TILE_ROWS is one tile. Of larger ones each size band, with the next
    one as guest, is cut into blocks, and a tile is two blocks."""
    columns = ["h", "band", "i", "j", "block", "node", "label", "n", "guest", "bitmap"]
    zero = F.lit(0).cast("long")
    small = rows.where(F.col("of") <= TILE_ROWS).select("h", zero.alias("band"), zero.alias("i"), zero.alias("j"), zero.alias("block"), "node", "label", "n", F.lit(False).alias("guest"), "bitmap")
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)) + 1e-9)
    banded = rows.where(F.col("of") > TILE_ROWS).withColumn("own", band).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    sizes = banded.groupBy("h", "band").agg(F.ceil(F.count("*") / TILE_ROWS).alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").drop("low", "high")
    dealt = banded.join(sizes, ["h", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1))).select("h", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "n", (F.col("own") > F.col("band")).alias("guest"), "bitmap")
    keys = ["h", "band", "i", "j"]

    def search(part: pa.Table) -> pa.RecordBatch:
        """All pairs of some whole tiles."""
        i, j, block, node, label, n, guest = (part.column(c).to_numpy() for c in columns[2:9])
        bits = _words(part.column("bitmap"))
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        tile = _groups(part)
        sizes = np.bincount(tile)
        found = [np.zeros((2, 0), np.int64)]

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            allowed = (label[x] != label[y]) & ~(guest[x] & guest[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
            x, y = x[allowed], y[allowed]
            both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
            fits = _bounded(percent, n[x], n[y], ones[x], ones[y], both)
            found.append(np.stack([node[x[fits]], node[y[fits]]]))

        # small tiles side by side: each row with the k-th after it
        few = np.flatnonzero(sizes[tile] <= SMALL_TILE)
        for k in range(1, int(sizes[sizes <= SMALL_TILE].max(initial=0))):
            x, y = few[:-k], few[k:]
            same = tile[x] == tile[y]
            if not same.any():
                break
            keep(x[same], y[same])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for t in np.flatnonzero(sizes > SMALL_TILE):
            inside = np.arange(starts[t], starts[t + 1])
            if (label[inside] == label[inside[0]]).all():
                continue
            for at in range(len(inside)):
                keep(np.full(len(inside) - at - 1, inside[at]), inside[at + 1 :])
        pairs = np.concatenate(found, axis=1)
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def _groups(part: pa.Table) -> np.ndarray:
        names = [part.column(c).to_numpy() for c in keys]
        return np.concatenate([[0], np.cumsum(np.any([c[1:] != c[:-1] for c in names], axis=0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of tiles that may go on: rows come sorted by tile
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            part = pa.Table.from_batches(held)
            whole = int(np.searchsorted(groups := _groups(part), groups[-1]))
            if whole:
                yield search(part.slice(0, whole).combine_chunks())
                held = part.slice(whole).combine_chunks().to_batches()
        if held:
            yield search(pa.Table.from_batches(held).combine_chunks())

    return small.unionByName(dealt).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def _signed(df: DataFrame, size: int, percent: int, id_col: str, text_col: str, row_col: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(id, row, text) of all rows; what is stored of them; classes of equal sets; their signatures; and the buckets (h, node)
    that several classes share."""
    rows = (df.withColumnRenamed(row_col, ROW) if row_col else numbered(df, id_col, text_col)).select(F.col(id_col).alias("id"), F.col(ROW).alias("row"), F.col(text_col).alias("text"))
    signed = stored(_signatures(rows, size, percent, _frequent(rows, size)))
    classes = stored(signed.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.count("*").alias("copies")))
    # copies, those that aren't their class's first, are told by narrow rows and are the fewer, as a rule; what is left is wide
    # and had better stay where it is
    copies = stored(signed.where("n > 0").select("row").join(classes.select(F.col("node").alias("row")), "row", "left_anti"))
    first = signed.where("n > 0").join(small_enough(copies), "row", "left_anti")
    nodes = stored(first.select(F.col("row").alias("node"), "n", "bitmap", "prefix"))
    prefix = nodes.select(F.explode("prefix").alias("h"), "node")
    shared = prefix.groupBy("h").agg(F.count("*").alias("of")).where("of > 1")
    return rows, signed, classes, nodes.drop("prefix"), stored(prefix.join(shared.select("h"), "h").select("h", "node"))


def link_classes(df: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Returns id_col, n_shingles and component_id (the smallest id reachable by links) for every row. row_col: a number of
    each row that no other has and that stays the same, if df has one."""
    rows, signed, classes, nodes, buckets = _signed(df, size, percent, id_col, text_col, row_col)

    # one comparison a class: with the class of its buckets whose own prefix is shared the most
    weight = buckets.groupBy("node").agg(F.count("*").alias("shared")).join(nodes, "node").select("node", (F.col("shared") / F.col("n")).alias("weight"))
    hubs = buckets.join(weight, "node").groupBy("h").agg(F.max(F.struct("weight", "node")).alias("hub")).select("h", F.col("hub.node").alias("hub"))
    best = buckets.join(hubs, "h").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("common")).groupBy("node").agg(F.max(F.struct("common", "hub")).alias("best"))
    pairs = best.select(F.col("node").alias("a"), F.col("best.hub").alias("b"))
    links = _linked(rows, stored(_pairs_within_bound(pairs, nodes, percent)), size, percent)
    labels = components(links)

    # what is left: buckets of several components
    labelled = buckets.join(nodes.select("node", "n").join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label")), "node")
    mixed = labelled.groupBy("h").agg(F.count("*").alias("of"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    mixed = mixed.where(f"low <> high and (of > 2 or 100 * least >= {percent} * most)").select("h", "of")
    open_rows = labelled.join(mixed, "h").join(nodes.select("node", "bitmap"), "node").select("h", "of", "node", "label", "n", "bitmap")
    more = _linked(rows, stored(_tile_pairs(open_rows, percent)), size, percent)
    final = components(links.union(more)) if more.limit(1).count() else labels
    discard(buckets, links, more, *([] if final is labels else [labels]))

    named = classes.join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_key = stored(named.join(least, "label").select("key", "copies", "component_id"))
    out = by_key(signed.select("id", "n", "key"), of_key).select("id", "n", "component_id").union(signed.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def by_key(signed: DataFrame, of_key: DataFrame) -> DataFrame:
    """The rows that have words with what of_key (key, copies, ...), a stored table, has for their keys. Keys of many rows are
    at most HOT_SHARE and broadcast, so no task gets all rows of one."""
    total = of_key.agg(F.sum("copies")).first()[0] or 0
    many = F.broadcast(of_key.where(F.col("copies") * HOT_SHARE > total).drop("copies"))
    few = of_key.where(F.col("copies") * HOT_SHARE <= total).drop("copies")
    some = signed.where("n > 0")
    return some.join(many, "key").unionByName(some.join(many.select("key"), "key", "left_anti").join(few, "key"))


def link_pairs(df: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All links, not only what they connect: pairs (a, b) of classes that link, a < b, and membership (id_col, class_id,
    n_shingles), class_id being null for rows without words. Rows of one class are linked with each other and with those of
    the classes that theirs links with. This compares all classes of a bucket, so it costs more than link_classes() where
    very many texts differ by a little."""
    rows, signed, classes, nodes, buckets = _signed(df, size, percent, id_col, text_col, row_col)
    of = buckets.groupBy("h").agg(F.count("*").alias("of"))
    tiles = buckets.join(of, "h").join(nodes, "node").select("h", "of", "node", F.col("node").alias("label"), "n", "bitmap")
    links = _linked(rows, stored(_tile_pairs(tiles, percent)), size, percent)
    discard(buckets)
    members = by_key(signed.select("id", "n", "key"), classes.select("key", "copies", F.col("node").alias("class_id")))
    members = members.unionByName(signed.where("n = 0").select("id", "n", "key", F.lit(None).cast("bigint").alias("class_id")))
    return links, members.select(F.col("id").alias(id_col), "class_id", F.col("n").alias("n_shingles"))
