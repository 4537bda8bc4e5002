"""Centroid clustering of vectors by bit planes.

Components become integers, floor(scale * x). Plane i of a vector packs bit i of its 64 components, in two's complement,
into one 64-bit word, so a dot product is a sum over two planes each of 2^(i + j) times the bits that both words have; the
last plane, of signs, counts negative. Squared distances are |x|^2 - 2 x.c + |c|^2: all is exact.

Vectors are packed once and stored; each round reads them, and a task sends on the sums of its vectors by cluster, which
are a fixed number of rows. Only these sums and the centroids, clusters * 64 numbers, come to the driver.

Defined results: vectors with another number of components than 64, or with one that is null or not finite, are left out.
The first centroids are the vectors whose ids have the least hashes, equal ones by components; vectors of null id are taken
last. Vectors of one id count each. Fewer vectors than clusters give fewer centroids, an empty table no rows. Components
beyond 27 bits would give distances beyond 64 bits and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

COMPONENTS = 64
#: Bits of a component, its sign apart.
MAX_BITS = 27
#: Vectors that a task works on at one time.
ROWS = 4096

Centroids = list[list[int]]


class Clustering(NamedTuple):
    #: (id, cluster, distance) of each vector that was kept, stored.
    assigned: DataFrame
    centroids: Centroids


def pack(values: np.ndarray) -> np.ndarray:
    """Planes (n, bits) of integers (n, 64): as many as the largest needs, the last one of signs."""
    bits = int(np.maximum(values, ~values).max(initial=0)).bit_length() + 1
    if bits > MAX_BITS + 1:
        raise ValueError(f"a component needs {bits} bits; distances are exact up to {MAX_BITS + 1}")
    planes = np.stack([np.packbits((values >> i & 1).astype(np.uint8), axis=1, bitorder="little") for i in range(bits)], axis=1)
    return planes.reshape(len(values), -1).view(np.uint64)


def _weights(bits: int) -> list[int]:
    return [1 << i for i in range(bits - 1)] + [-(1 << (bits - 1))]


def unpack_sum(planes: np.ndarray) -> np.ndarray:
    """The sum of vectors by component, from how often each bit is set."""
    ones = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=1, bitorder="little").reshape(len(planes), -1, COMPONENTS).sum(axis=0, dtype=np.int64)
    return np.array(_weights(len(ones))) @ ones


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products (n, m) of vectors by planes (n, bits) and (m, bits)."""
    out = np.zeros((len(x), len(y)), np.int64)
    for i, u in enumerate(_weights(x.shape[1])):
        for j, v in enumerate(_weights(y.shape[1])):
            out += u * v * np.bitwise_count(x[:, i, None] & y[None, :, j]).astype(np.int64)
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Squared lengths."""
    out = np.zeros(len(x), np.int64)
    for i, u in enumerate(_weights(x.shape[1])):
        for j, v in enumerate(_weights(x.shape[1])):
            out += u * v * np.bitwise_count(x[:, i] & x[:, j]).astype(np.int64)
    return out


def _packed(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, planes, norm), stored: one row a vector that is kept."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), x.alias("x")).where((F.size("x") == COMPONENTS) & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            planes = pack(np.floor(scale * batch.column(1).flatten().to_numpy().reshape(-1, COMPONENTS)).clip(-(2.0**62), 2.0**62).astype(np.int64))
            ends = np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(planes.view(np.int64).ravel())), pa.array(norms(planes))], ["id", "planes", "norm"])

    return stored(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, planes array<bigint>, norm bigint"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Record batches of up to ROWS rows with their planes; shorter ones are filled up with their signs."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            lists = part.column("planes")
            bits, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view(np.uint64)
            starts = np.concatenate([[0], np.cumsum(bits)[:-1]])
            at = np.minimum(np.arange(bits.max()), bits[:, None] - 1)
            yield part, flat[starts[:, None] + at]


def _nearest(planes: np.ndarray, norm: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one of several, and squared distance to it."""
    packed = pack(np.array(centroids, np.int64))
    distances = norm[:, None] - 2 * dots(planes, packed) + norms(packed)
    nearest = distances.argmin(axis=1)
    return nearest, distances[np.arange(len(nearest)), nearest]


def _moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Centroids after a round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), COMPONENTS), np.int64), np.zeros(len(centroids), np.int64)
        for batch, planes in _blocks(batches):
            nearest, _ = _nearest(planes, batch.column("norm").to_numpy(), centroids)
            for cluster in np.unique(nearest):
                own = planes[nearest == cluster]
                sums[cluster] += unpack_sum(own)
                counts[cluster] += len(own)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, COMPONENTS)), pa.array(np.tile(np.arange(COMPONENTS), len(some))), pa.array(sums[some].ravel()), pa.array(np.repeat(counts[some], COMPONENTS))], ["cluster", "at", "total", "n"])

    moved = [list(c) for c in centroids]
    parts = vectors.mapInArrow(run, "cluster bigint, at bigint, total bigint, n bigint")
    for r in parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # clusters * 64 rows at most
        moved[r["cluster"]][r["at"]] = r["total"] // r["n"]
    return moved


def cluster(df: DataFrame, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Rounds end early where centroids stay as they were."""
    prepare(df.sparkSession)
    vectors = _packed(df, id_col, vector_col, scale)
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    filled = F.concat("planes", F.array_repeat(F.element_at("planes", -1), MAX_BITS + 1 - F.size("planes")))  # the same however a vector was packed
    first = vectors.orderBy(by_hash.asc_nulls_last(), filled).limit(clusters).collect()
    centroids = [unpack_sum(np.array([r["planes"]], np.int64).view(np.uint64)).tolist() for r in first]
    for _ in range(rounds):
        if (moved := _moved(vectors, centroids)) == centroids:
            break
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, planes in _blocks(batches):
            nearest, distance = _nearest(planes, batch.column("norm").to_numpy(), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(nearest.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return Clustering(stored(vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance bigint")), centroids)


def described(found: Clustering, id_col: str = "vec_id") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256): inertia is the distance summed, over a cluster
    or all; the digest is of a centroid's components, comma-joined."""
    spark = found.assigned.sparkSession
    sums = {r["cluster"]: r["d"] for r in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(k, sums[k], sum(sums.values()), digest(c)) for k, c in enumerate(found.centroids) if k in sums]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.withColumnRenamed("id", id_col).join(F.broadcast(of), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
