"""From documents to tokens: five stages, each an operator of lexispan.llm on all rows of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispan.llm.common import materialize
from lexispan.llm.exact_dedup import distinct_texts
from lexispan.llm.minhash import near_duplicates
from lexispan.llm.mixing import mix_sources
from lexispan.llm.piece_merges import encode_merges
from lexispan.llm.quality_rules import quality_rules
from lexispan.llm.queries import SEED, table, token_digest

#: Similarity in percent from which the stage takes documents for near duplicates; op9 has its own, 85.
PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the perplexity bands keep; those without text go."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; null and empty texts are equal."""
    return distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; a null id is in no component and stays."""
    gone = materialize(near_duplicates(docs, percent=PERCENT).where("not kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in the order of a hash; null is a source of its own."""
    return mix_sources(docs, alpha=0.5, seed=SEED).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, as their number, their checksum and whether they decode to the text; none for a null text."""
    return token_digest(encode_merges(docs), "doc_id", "lang", "source")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixing),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither perplexity nor the merges of pieces can be written in SQL.
ORACLE_SQL = None
