"""Keyword and hybrid ranking, and global places without a single-task window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import vectors as V

#: Fixed values of the search: keyword candidates, files, symbols of a file.
KEYWORD_CANDIDATES, TOP_FILES, TOP_SYMBOLS = 200, 10, 5


def postings(symbols: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(term, id_col, tf): occurrences of each token in all given columns together.

    They are counted in each row, and nothing but ids is shuffled: a small job sees whether any comes twice. Only if one does,
    the counts of rows are added up by term and id.
    """
    rows = _counted(symbols, id_col, *text_cols)
    if symbols.groupBy(id_col).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty():
        return rows
    return rows.groupBy("term", id_col).agg(F.sum("tf").alias("tf"))


def _counted(symbols: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(term, id_col, tf) of each row for itself: its tokens are sorted, and a run of equal ones is a term."""
    rows = symbols.select(id_col, F.sort_array(F.concat(*(T.tokens(F.col(c)) for c in text_cols))).alias("__bag"))
    begins = F.transform("__bag", lambda t, i: F.when(~t.eqNullSafe(F.get("__bag", i - 1)), i))
    rows = rows.select(id_col, "__bag", F.array_compact(begins).alias("__runs"))
    # outer: else Spark asks first whether there are runs, with the tokens made anew for each token
    rows = rows.select(id_col, "__bag", "__runs", F.posexplode_outer("__runs").alias("__run", "__at")).where(F.col("__at").isNotNull())
    end = F.coalesce(F.get("__runs", F.col("__run") + 1), F.size("__bag"))
    return rows.select(F.get("__bag", F.col("__at")).alias("term"), id_col, (end - F.col("__at")).cast("long").alias("tf"))


def posting_deltas(old: DataFrame, new: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(term, id_col, tf): by how much each term's occurrences in a symbol change from the old rows to the new, below 0 where
    they get fewer. What stays the same has no row."""
    bag = F.concat(*(T.tokens(F.col(c)) for c in text_cols))
    signed = [rows.select(id_col, F.explode(bag).alias("term"), F.lit(sign).alias("by")) for rows, sign in ((old, -1), (new, 1))]
    return merged_postings(signed[0].unionByName(signed[1]).withColumnRenamed("by", "tf"), id_col)


def merged_postings(deltas: DataFrame, id_col: str) -> DataFrame:
    """Deltas of several changes in one row a term and symbol; those that make up for each other go."""
    return deltas.groupBy("term", id_col).agg(F.sum("tf").alias("tf")).where("tf <> 0")


def indexed_keyword_scores(deltas: DataFrame, terms: list[str], symbols: int, id_col: str) -> DataFrame:
    """keyword_scores() from stored deltas: only rows of the terms are read. symbols: how many there are."""
    hits = merged_postings(deltas.where(F.col("term").isin(*terms) if terms else F.lit(False)), id_col).where("tf > 0")
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row a term of the query
    weighted = hits.join(df, "term").select(id_col, (F.col("tf") * (F.log((1 + F.lit(max(symbols, 1))) / (1 + F.col("df"))) + 1)).alias("score"))
    return weighted.groupBy(id_col).agg(F.round(F.sum("score"), 6).alias("score"))


def terms_of(spark: SparkSession, query: str) -> list[str]:
    return [r[0] for r in spark.range(1).select(F.explode(T.query_terms(F.lit(query)))).collect()]


def document_frequency(symbols: DataFrame, *text_cols: str) -> DataFrame:
    """(term, df): rows that hold a term. Only counts by term are shuffled."""
    bag = F.array_distinct(F.concat(*(T.tokens(F.col(c)) for c in text_cols)))
    return symbols.select(F.explode(bag).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def keyword_scores(symbols: DataFrame, query: str, id_col: str, *text_cols: str) -> DataFrame:
    """(id_col, score) of the symbols that hold a query term: the sum over distinct terms of tf * (ln((1+N)/(1+df)) + 1).

    A symbol is a row, so term frequencies are counted in place, of the query's terms only. All that is shuffled is one row
    of sums: N and the document frequencies, as many as the query has terms. It comes back by broadcast.
    """
    wanted = terms_of(symbols.sparkSession, query)
    bag = F.filter(F.concat(*(T.tokens(F.col(c)) for c in text_cols)), lambda t: t.isin(*wanted) if wanted else F.lit(False))
    times = lambda w: F.size(F.filter("bag", lambda t: t == w))
    tf = F.array(*map(times, wanted)) if wanted else F.array().cast("array<int>")
    rows = symbols.select(id_col, bag.alias("bag")).select(id_col, tf.alias("tf"))
    sums = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.array(*(F.count(F.when(F.get("tf", F.lit(i)) > 0, 1)) for i in range(len(wanted)))).alias("df"))
    hits = rows.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(sums))
    each = F.zip_with("tf", "df", lambda t, d: t * (F.log((1 + F.col("n")) / (1 + d)) + 1))
    return hits.select(id_col, F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 6).alias("score"))


def keyword_search(symbols: DataFrame, query: str, id_col: str, *text_cols: str, limit: int = KEYWORD_CANDIDATES) -> DataFrame:
    return keyword_scores(symbols, query, id_col, *text_cols).orderBy(F.desc("score"), id_col).limit(limit)


def cosine_scores(vectors: DataFrame, query: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id_col, cosine) of vectors as long as the query's one row `q`; zero vectors are left out."""
    rows = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("v")).crossJoin(F.broadcast(query.limit(1)))
    rows = rows.where((F.size("v") == F.size("q")) & (V.norm(F.col("v")) > 0) & (V.norm(F.col("q")) > 0))
    return rows.select(id_col, V.cosine(F.col("v"), F.col("q")).alias("cosine"))


def hybrid_scores(cosines: DataFrame, keywords: DataFrame, id_col: str) -> DataFrame:
    """(id_col, score): similarity in 0..1 and keyword score by its maximum, blended; no keyword hit counts 0."""
    top = F.max("score").over(W.partitionBy(F.lit(0)))  # over the keyword candidates, 200 at most
    scaled = keywords.select(id_col, F.when(top > 0, F.col("score") / top).otherwise(0.0).alias("keyword"))
    rows = cosines.join(scaled, id_col, "left")
    return rows.select(id_col, F.round(V.blend(V.to_unit_range(F.col("cosine")), F.coalesce("keyword", F.lit(0.0))), V.DIGITS).alias("score"))


def top_in_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their rank; Spark filters ranks before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def hybrid_search(symbols: DataFrame, vectors: DataFrame, query: DataFrame, text: str, id_col: str, file_col: str, vector_id: str, vector_col: str, *text_cols: str, top_k: int = TOP_FILES, keywords: DataFrame | None = None) -> DataFrame:
    """(file, score, name, symbol_score, rank): the best files by their best symbol, with up to five symbols each. keywords:
    the candidates by keyword, if an index has them."""
    keywords = keyword_search(symbols, text, id_col, *text_cols) if keywords is None else keywords
    cosines = cosine_scores(vectors.withColumnRenamed(vector_id, id_col), query, id_col, vector_col)
    scored = hybrid_scores(cosines, keywords, id_col).join(symbols.select(id_col, F.col(file_col).alias("file")), id_col)
    best = top_in_group(scored, "file", [F.desc("score"), F.col(id_col)], TOP_SYMBOLS)
    files = best.groupBy("file").agg(F.max("score").alias("file_score"), F.collect_list(F.struct("rank", "score", id_col)).alias("found"))
    top = files.orderBy(F.desc("file_score"), "file").limit(top_k).select("file", "file_score", F.explode("found").alias("s"))
    return top.select("file", F.col("file_score").alias("score"), F.col("s")[id_col].alias("name"), F.col("s.score").alias("symbol_score"), F.col("s.rank").cast("long").alias("rank"))


def place(rows: DataFrame, bucket: Column, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the 1-based place of each row in one order over all rows. bucket must not fall along the order; places are
    made within buckets, plus the rows of those before, so no task gets all rows. Buckets are as many as the running sum
    in one task can bear (one row each)."""
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = counts.select("__bucket", (F.sum("__n").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    inside = rows.withColumn("__in", F.row_number().over(W.partitionBy("__bucket").orderBy(*order)))
    before = before.withColumnRenamed("__bucket", "__of")
    return inside.join(before, F.col("__bucket").eqNullSafe(F.col("__of"))).drop("__of").withColumn(name, F.col("__before") + F.col("__in")).drop("__bucket", "__before", "__in")


def place_sorted(rows: DataFrame, order: list[Column], keep: Callable[[DataFrame], DataFrame], name: str = "place") -> DataFrame:
    """place() without buckets: rows are sorted in ranges and kept (written and read again), so that their places within
    ranges stay as they are; the running sum is over the ranges."""
    at = F.monotonically_increasing_id()  # range and place in it, 33 bits
    kept = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)).withColumn("__range", F.shiftright("__at", 33))
    counts = kept.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    placed = kept.join(F.broadcast(before), "__range")  # a row a range: no more than shuffle partitions
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__range", "__at", "__before")
