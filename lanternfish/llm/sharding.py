"""Sharding by proportional stratified interleaving.

Within each source, rows are ranked in a seeded random order, and a row's fractional rank is (rank - u) / rows of the
source, where u in (0, 1] is the source's own seeded offset (so that sources of few rows don't meet at one place). Sorted
by fractional rank, any run of rows has the mixture of the whole; the order is cut into shards whose row counts differ
by one at most (law `rows`).

Ranks don't take one task a source: rows fall into buckets by their random key, buckets are counted, and a row's rank is
its place in its bucket plus the rows of the buckets before. The same holds for the places in the order of fractional
ranks. Bucket counts follow the number of rows, so a bucket holds about a thousand rows at any size; running sums over
buckets are made in two levels, so no task sums more than their number's root.

Where ids are null or repeat, a row's number in its table goes into its random key, so rows of one id are spread like any
others; the order among such rows then is that of the table's files.

Defined results: rows with a null source are a source of their own. A null text has 0 bytes, so size 1, and crc32 0.
Repeated rows each get a place. An empty table gives no rows. Texts aren't shuffled, only their size and crc32.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, numbered, own_ids, small_enough

ROWS_PER_BUCKET = 1024
_SPAN = 1 << 40


def _place(df: DataFrame, group: list[str], bucket: Column, order: list[Column], n_buckets: int) -> DataFrame:
    """Adds __place: the 1-based rank of each row within its group, by bucket and then by order."""
    rows = df.withColumn("__bucket", bucket)
    keys = [*group, "__bucket"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__over", F.floor(F.col("__bucket") / math.isqrt(n_buckets)))
    upto = lambda n, by, order: F.sum(n).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(n)
    over = counts.groupBy(*group, "__over").agg(F.sum("__n").alias("__of")).select(*group, "__over", upto("__of", group or [F.lit(0)], "__over").alias("__first"))
    inside = counts.select(*keys, "__over", upto("__n", [*group, "__over"], "__bucket").alias("__before"))
    before = inside.join(over, [*group, "__over"]).select(*keys, (F.col("__first") + F.col("__before")).alias("__before"))
    placed = rows.withColumn("__in", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return placed.join(before, keys).withColumn("__place", F.col("__before") + F.col("__in")).drop("__before", "__in", "__bucket")


def interleave(df: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Returns id_col, source, size, text_crc32, shard and slot (from 0 within the shard)."""
    own = own_ids(df, id_col)
    rows = (df if own else numbered(df, *dict.fromkeys((id_col, source_col, text_col)))).select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("__source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("__size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).alias("__crc"),
        *(() if own else (ROW,)),
    )
    ties = ["__id"] if own else ["__id", ROW]
    total = df.count()
    rows = rows.withColumn("__key", F.pmod(F.xxhash64(F.lit(seed), *ties), F.lit(_SPAN)))
    in_source = rows.groupBy("__source").agg(F.count("*").alias("__of"))
    n_buckets = max(1, total // rows_per_bucket)
    ranked = _place(rows, ["__source"], F.floor(F.col("__key") * n_buckets / _SPAN), [F.col("__key"), *map(F.col, ties)], n_buckets)
    offset = (F.pmod(F.xxhash64(F.lit(seed), "__source"), F.lit(_SPAN)) + 1) / F.lit(float(_SPAN))
    ranked = ranked.join(small_enough(in_source), "__source")
    ranked = ranked.select(*ties, "__source", "__size", "__crc", ((F.col("__place") - offset) / F.col("__of")).alias("__fraction"))
    ordered = _place(ranked, [], F.least(F.floor(F.col("__fraction") * n_buckets), F.lit(n_buckets - 1)), [F.col("__fraction"), F.col("__source"), *map(F.col, ties)], n_buckets)
    place, small, larger = F.col("__place") - 1, total // shards, total % shards
    cut = larger * (small + 1)
    shard = F.when(place < cut, F.floor(place / (small + 1))).otherwise(larger + F.floor((place - cut) / max(small, 1)))
    slot = F.when(place < cut, place % (small + 1)).otherwise((place - cut) % max(small, 1))
    return ordered.select(
        F.col("__id").alias(id_col),
        F.expr("if(__source = 'null', null, substring(__source, 2))").alias("source"),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
    )

