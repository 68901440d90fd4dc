"""The registered queries: each operator with its production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup, normalised
from .html_extract import extract_text
from .lm_score import lm_score
from .minhash import near_duplicates
from .mixing import mix_sources
from .piece_merges import encode_merges
from .quality_model import classify
from .quality_rules import quality_rules
from .sentencepiece import decode
from .sharding import shard_rows
from .url_filter import filter_urls

SEED = 20
SHARDS = 8
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law rows: shard sizes are at most one row apart; grown_shard is for law key and null here."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = shard_rows(narrow, SHARDS, ["doc_id"], SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules(docs, narrow=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("sha")
    out = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", sha))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_digest(encoded: DataFrame, *columns: str) -> DataFrame:
    """n_tokens, the CRC-32 of the ids, and whether decoding gives back the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return decode(encoded).select(*columns, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == text).alias("round_trip"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(encode_merges(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source to weight in proportion to the square root of its rows, as many rows in all as before.

    The texts themselves are repeated and put in order; size is measured on each copy."""
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), alpha=0.5, seed=SEED)
    return out.select("doc_id", "source", F.octet_length("text").cast("long").alias("size"), "copy", "shuffle_key")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_html_extraction, op3_url_filter, op4_quality_rules, op5_exact_dedup, op6_quality_model, op7_lm_score, op8_mixing, op9_minhash, op10_sentencepiece)}
