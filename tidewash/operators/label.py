"""Labels for a text column, and how often each occurs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.columns import column
from tidewash.functions.scratch import write_scratch
from tidewash.functions.text import list_items


def label_column(name: str) -> str:
    return f"{name}_Classified"


def distinct_atomic_values(df: DataFrame, name: str) -> DataFrame:
    """The distinct items of a comma-separated column, trimmed and sorted."""
    return (
        df.where(column(name).isNotNull())
        .select(F.explode(list_items(column(name))).alias("value"))
        .distinct()
        .orderBy("value")
    )


def rule_label(value: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern found in the value; null stays null."""
    label = F.lit(default).cast("string")
    for pattern, name in reversed(rules):
        label = F.when(value.rlike(pattern), F.lit(name)).otherwise(label)
    return F.when(value.isNotNull(), label)


def label_by_rules(
    df: DataFrame, name: str, rules: list[tuple[str, str]], default: str | None = None
) -> DataFrame:
    """Add ``<name>_Classified`` by ordered patterns; no shuffle."""
    return df.withColumn(label_column(name), rule_label(column(name), rules, default))


def label_by_lookup(df: DataFrame, name: str, lookup: DataFrame) -> DataFrame:
    """Add the label that a table ``value, label`` gives; unknown values get null.

    The table is stored first, so Spark knows its size and broadcasts a small one.
    """
    stored = write_scratch(
        lookup.groupBy(F.col("value").alias("_value")).agg(
            F.min("label").alias(label_column(name))
        ),
        "labels",
    )
    return df.join(stored, column(name) == F.col("_value"), "left").drop("_value")


def label_by_function(
    df: DataFrame, name: str, label: Callable[[pd.Series], pd.Series]
) -> DataFrame:
    """Label every distinct value once by a function on batches of values."""
    distinct = df.where(column(name).isNotNull()).select(column(name).alias("value")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": batch["value"], "label": label(batch["value"])})

    return label_by_lookup(df, name, distinct.mapInPandas(run, "value string, label string"))


def label_counts(df: DataFrame, name: str, top_n: int | None = None) -> DataFrame:
    """``label, count``, most frequent first and equal counts by label."""
    counted = (
        df.where(column(name).isNotNull())
        .groupBy(column(name).alias("label"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "label")
    )
    return counted.limit(top_n) if top_n else counted
