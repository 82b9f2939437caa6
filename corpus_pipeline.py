"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before it kept. The first four return documents with all their columns; what they
reject is gone for the later ones. The last returns one row per piece of a packed sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewright.llm.common import clear_work, table, work_count, work_dir, written
from tapewright.llm.exact_dedup import drop_exact_copies
from tapewright.llm.minhash import drop_near_copies
from tapewright.llm.packing import packed_documents
from tapewright.llm.quality import drop_low_quality
from tapewright.llm.queries import tokenizer_file
from tapewright.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be of good quality."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packed_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next.

    What a stage wrote for itself and what it read are deleted once its output is written.
    """
    docs, before = table(spark, sf_dir, "documents"), work_count()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            used = work_count()
            docs = written(docs, f"{work_dir(spark)}/{k}_{name}")
            clear_work(spark, before, used)
    return docs


#: Learnt scores, MinHash and tokenising have no SQL form; tests/llm holds each stage against a plain version.
ORACLE_SQL = None
