"""A corpus pipeline: language, near-duplicates, benchmark leaks, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatework.llm.common import fresh_path, table
from gatework.llm.decontamination import decontaminated
from gatework.llm.language import with_language
from gatework.llm.mixing import mix
from gatework.llm.near_pairs import near_deduplicated
from gatework.llm.token_output import token_output


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language go: null texts and texts without a letter.

    Very long texts are read whole, repeated rows each stay, an empty table gives an empty one, extra columns stay."""
    return with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word Jaccard of 0.8 and more) stays: that of the smallest id.

    Null texts and texts without words are one group; of repeated rows one stays; a null id stays only where there is no
    other. An empty table gives an empty one."""
    return near_deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go.

    Null and empty texts have none and stay, as do repeated rows without one; very long texts are read whole. An empty
    benchmark lets all stay; an empty table gives an empty one; extra columns stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or cut to the sources' targets, in training order.

    The null source is one of its own; texts without words are never taken. Repeated rows count each, ties are broken by a
    hash of the id, an empty table gives an empty one, extra columns stay."""
    return mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what is read back from them: doc_id, start, n_tokens, ids_crc32 of each document.

    Null and empty texts have the end id only; repeated rows are each written; an empty table gives an empty result."""
    return token_output(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]

#: SQL can express neither the language model nor the tokenizer; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
