"""The corpus pipeline: language, quality, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsong.llm import language, quality
from fieldsong.llm.bpe import ranks_file, token_digests
from fieldsong.llm.common import discard, fresh, table, tables_written, written
from fieldsong.llm.mixing import mixed_documents
from fieldsong.llm.near_copies import one_of_each

#: A document's language is sure enough if the mean probability over its words is this at least.
LEAST_SCORE = 0.4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language go on; those without letters or of no clear language are rejected."""
    model = language.fit(language.training_rows(docs))
    found = fresh(docs, "found_language")
    marked = docs.withColumn(found, language.language(model, F.col("text")))
    sure = (F.col(found)["lang_pred"] != language.UNKNOWN) & (F.col(found)["score"] >= LEAST_SCORE)
    return marked.where(sure).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours vote good go on."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "quality_score")
    return docs.withColumn(score, quality.quality(model, F.col("text"))).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies goes on: five-word shingles, a similarity of 0.8 or more."""
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy that the mix takes is a row; n_chars follows the text where it was cut."""
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else mixed


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    ranks = ranks_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return token_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]
#: The models learned in the first two stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written before the next reads them, and then deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with tables_written() as tables:
            after = written(stage(spark, docs, sf_dir))
        discard(docs, *tables[:-1])
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
