"""Searches over streams. A match needs no state; scores use statistics of a table, fixed at the start."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..index import Search


def search_stream(search: Search, stream: DataFrame) -> DataFrame:
    """The rows of a streaming DataFrame that match."""
    return search.rows(stream).drop("_terms")


def score_stream(search: Search, stream: DataFrame, **how) -> DataFrame:
    """Matching rows with their score by the statistics of the search's own index."""
    return search.rows(stream).withColumn("score", search.score_column(**how)).drop("_terms")
