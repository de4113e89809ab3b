"""A training corpus from raw documents, in five stages.

Each stage takes the whole table that the one before kept and its decisions take
effect: poor documents go, of equal and of near-equal documents one stays,
documents that quote the benchmark go, and the rest is packed into sequences.
All stages but the last return the columns they are given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewash.functions.scratch import scratch_folder
from tidewash.llm.decontaminate import keep_clean
from tidewash.llm.exact_dedup import keep_first
from tidewash.llm.packing import packed_digests
from tidewash.llm.quality import fit_quality, graded_labels, select_quality
from tidewash.llm.registry import table
from tidewash.llm.simhash import keep_one_of_near

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def select_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that more likely than not have the lowest grade.

    The model is fitted on the raw documents of the labels' sample; repeated rows
    and null ids are kept or rejected by their text.
    """
    model = fit_quality(
        table(spark, sf_dir, "documents"), graded_labels(table(spark, sf_dir, "labels"))
    )
    return select_quality(docs, model, grade=1, least=0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links between fingerprints connect the smallest id stays."""
    return keep_one_of_near(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents of which at least a twentieth quotes the benchmark."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"), unnamed=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents' tokens goes, with a checksum of its ids."""
    return packed_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", select_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

# The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
