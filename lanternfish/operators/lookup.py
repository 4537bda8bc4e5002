"""Lookups, joins, counts and summaries over files and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokens as T


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def signature_head(signature: Column) -> Column:
    return F.substring_index(signature, "(", 1)


def match_tier(short_name: Column, signature: Column, wanted: Column) -> Column:
    """1 to 5, the way in which a symbol has the wanted name, or null."""
    tests = short_name == wanted, signature == wanted, last_segment(short_name) == wanted, signature_head(signature) == wanted, last_segment(signature_head(signature)) == wanted
    return F.coalesce(*(F.when(test, tier) for tier, test in enumerate(tests, 1)))


def first_by_tier(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with a tier the first of each key, by tier and then by order."""
    ranked = rows.where("tier is not null").withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("tier", *order)))
    return ranked.where("__r = 1").drop("__r")


def equal_to(rows: DataFrame, column: str, value: object, order: str | None = None) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    found = rows.where(F.col(column) == F.lit(value))
    return found.orderBy(order) if order else found


def with_children(parents: DataFrame, children: DataFrame, key: str, fields: list[Column], name: str, how: str = "inner") -> DataFrame:
    """Parents with an array of their children's fields, in the order of the fields. Children are grouped before they meet."""
    return parents.join(children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name)), key, how)


def grep(rows: DataFrame, text_col: str, pattern: str, *keep: str) -> DataFrame:
    """(keep, line, match): the lines of a text that match a pattern, numbered from 1."""
    lines = rows.where(F.rlike(text_col, F.lit(f"(?m){pattern}"))).select(*keep, F.posexplode(T.lines(F.col(text_col))).alias("at", "match"))
    return lines.where(F.rlike("match", F.lit(pattern))).select(*keep, (F.col("at") + 1).alias("line"), "match")


def totals(**tables: tuple[DataFrame, Column]) -> DataFrame:
    """One row with an aggregate of each table."""
    out = None
    for name, (table, count) in tables.items():
        row = table.agg(count.alias(name))
        out = row if out is None else out.crossJoin(row)  # one row each
    return out


def pending(symbols: DataFrame, vectors: DataFrame, id_col: str) -> DataFrame:
    """Symbols without a vector."""
    return symbols.join(vectors.select(id_col).distinct(), id_col, "left_anti")


def skip_reason(kind: Column, line: Column, end_line: Column) -> Column:
    """Why a symbol gets no vector, or null: imports, and methods or functions of up to three lines."""
    short = F.coalesce(end_line, F.lit(0)) - F.coalesce(line, F.lit(0)) <= 2
    return F.when(kind == "import", "import").when(kind.isin("method", "function") & short, "trivial_method")


def counts_by(rows: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def known_kind(kind: Column) -> Column:
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown"))


def counts_text(rows: DataFrame, key: str) -> DataFrame:
    """One row: `key: n` sorted by key and comma-joined, or `none`. The keys are few: languages, kinds, reasons."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("n").alias("n")))), lambda x: F.concat(x["k"], F.lit(": "), x["n"].cast("string"))), ", ")
    return counts.agg(F.coalesce(F.nullif(listed, F.lit("")), F.lit("none")).alias("summary"))
