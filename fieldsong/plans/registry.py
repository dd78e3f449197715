"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldsong.plans import corpus_queries, file_queries, interval_queries, label_queries, scale_queries, signal_queries, sound_queries, stream_queries, survey_queries

PARTS = [corpus_queries, file_queries, interval_queries, label_queries, scale_queries, signal_queries, sound_queries, stream_queries, survey_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLE: dict[str, str] = {k: sql for part in PARTS for k, sql in part.SQL.items()}
