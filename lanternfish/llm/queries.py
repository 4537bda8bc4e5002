"""Registered queries of this subpackage: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, decontamination, jaccard, language, minhash, phrases, pii, quality, secrets, sharding, substrings
from .common import documents, hex_sha256, prepare
from .oracles import ORACLE_SQL as ORACLE_SQL

SHARDS = 8


def _joined(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of an array of spans, in its order, comma-joined."""
    chosen = F.filter(spans, lambda x: x["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.concat_ws(",", F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    model = language.fit(rows.where(~language.held_out()))
    predicted = language.identify(rows, model)
    return predicted.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_positions").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        hex_sha256(F.concat_ws(",", "items")).alias("items_sha256"),
        (F.size("hit_positions") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *(_count("spans", kind) for kind in secrets.BASE_KINDS), hex_sha256(_joined("spans", secrets.BASE_KINDS)).alias("base_sha256"), _joined("spans").alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    order = [name for name, *_ in quality.measure(rows)]
    return quality.cascade(rows, quality.RULES, order)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.tokenize(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(documents(spark, sf_dir), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    scores = F.concat_ws(",", F.transform("spans", lambda x: x["score"].cast("string")))
    return found.select("doc_id", *(_count("spans", kind) for kind in pii.BASE_KINDS), hex_sha256(_joined("spans", pii.BASE_KINDS)).alias("base_sha256"), _joined("spans").alias("spans"), scores.alias("scores"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeated(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return described_views(chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def described_views(views: DataFrame) -> DataFrame:
    mask = F.concat_ws(",", F.transform("mask", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))))
    return views.select("conv_id", "perspective", "part", "n_turns", "n_repeated", "n_targets", hex_sha256(F.col("text")).alias("text_sha256"), mask.alias("mask"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_classes(documents(spark, sf_dir))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.described(clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_secrets, op4_quality_rules, op5_byte_bpe, op6_sharding, op7_pii, op8_substring_dedup, op9_chat_rotation, op10_jaccard_join, op11_minhash, op12_phrase_mining, op13_centroid_clustering)}
