"""A corpus pipeline: language ID, near duplicates, decontamination, secrets, tokens.

Each stage gets what the one before kept, as a table read from Parquet, and its decisions take effect. All but the last
return the columns of documents. A document is a row: stages that drop some tell rows apart by file and place in it, not
by doc_id, which may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import bpe, decontamination, jaccard, language, secrets
from lanternfish.llm.common import ROW, discard, documents, hex_sha256, numbered, prepare, small_enough, stored


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs whose ROW isn't among rows, without that column."""
    return docs.join(small_enough(rows), ROW, "left_anti").drop(ROW)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letters, or a narrow margin."""
    prepare(spark)
    model = language.fit(docs.where(~language.held_out()))
    others = tuple(c for c in docs.columns if c != "doc_id")
    return language.identify(docs, model, keep=others, prefix="__").where("not __rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, the first one if several have it. Null
    counts as largest."""
    prepare(spark)
    docs = numbered(docs)
    by_id = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW).alias("__key")
    groups = jaccard.link_classes(docs.select(by_id, "text", ROW), id_col="__key", row_col=ROW)
    return _without(docs, stored(groups.where("not (__key <=> component_id)").select(f"__key.{ROW}")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    prepare(spark)
    docs = numbered(docs)
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW)
    return _without(docs, stored(found.where(F.size("hit_positions") > 0).select(ROW)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked, and n_chars is that of the new text."""
    prepare(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, and digests of them and of what they decode to."""
    import public_tokenizers

    prepare(spark)
    tokens = bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids_sha256 = hex_sha256(F.concat_ws(",", F.col("ids").cast("array<string>")))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", ids_sha256.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: Compression, merges and structural parsing aren't expressible in SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
