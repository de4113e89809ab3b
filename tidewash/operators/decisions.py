"""Reviewed decisions: which outlier rows to remove or cap, and which to keep.

A decision table has the columns ``row_id, column, action, reason, approved``,
and ``limit`` where values may be capped. It comes from a rule, from a reviewer's
table or from a user function; only approved rows with the action ``remove`` or
``cap`` change the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.columns import column, quoted

DECISION_COLUMNS = ["row_id", "column", "action", "reason", "approved"]


def decide_by_rule(
    records: DataFrame,
    rule: Column,
    reason: str,
    approved: bool = False,
    action: str = "remove",
) -> DataFrame:
    """Decide every outlier record by a condition on its columns.

    Records that meet ``rule`` get the ``action``. With ``cap`` the table also has
    the ``limit``, the fence that the value is moved onto.
    """
    if action not in ("remove", "cap"):
        raise ValueError(f"unknown action: {action!r}")
    decided = [
        F.col("row_id"),
        F.col("column"),
        F.when(rule, F.lit(action)).otherwise(F.lit("keep")).alias("action"),
        F.when(rule, F.lit(reason)).otherwise(F.lit("within the rule")).alias("reason"),
        F.lit(approved).alias("approved"),
    ]
    if action == "cap":
        decided.append(nearest_fence().alias("limit"))
    return records.select(*decided)


def nearest_fence() -> Column:
    """The fence of an outlier record that its value lies beyond."""
    above = F.col("value") > F.col("upper")
    return F.when(above, F.col("upper")).otherwise(F.col("lower"))


def beyond(factor: float) -> Column:
    """A rule for ``decide_by_rule``: further than ``factor`` IQR from the box."""
    reach = F.lit(float(factor)) * (F.col("q3") - F.col("q1"))
    return (F.col("value") > F.col("q3") + reach) | (F.col("value") < F.col("q1") - reach)


def decide_by_function(
    records: DataFrame, decide: Callable[[pd.DataFrame], pd.DataFrame]
) -> DataFrame:
    """Decide batches of records with a function that adds ``action`` and ``reason``."""
    id_type = records.schema["row_id"].dataType.simpleString()
    schema = f"row_id {id_type}, column string, action string, reason string, approved boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            decided = decide(batch)
            yield decided.assign(approved=False)[DECISION_COLUMNS]

    return records.mapInPandas(run, schema)


def approve(table: DataFrame, condition: Column | None = None) -> DataFrame:
    """Mark the rows that meet ``condition`` (all by default) as approved."""
    return table.withColumn(
        "approved", F.lit(True) if condition is None else F.col("approved") | condition
    )


def approved_only(table: DataFrame) -> DataFrame:
    """The gate in front of every change: rows without approval are left out."""
    return table.where(F.col("approved"))


def apply_decisions(
    df: DataFrame, decisions: DataFrame, key: str, capped: Iterable[str] = ()
) -> DataFrame:
    """Drop the rows with an approved ``remove`` and cap the values with an approved ``cap``.

    Only the columns ``capped`` are looked at for caps; they become double. A
    ``remove`` drops the row whatever else is decided. The keys are unique on both
    sides, so the joins spread evenly; Spark broadcasts the decisions by itself if
    they turn out small.
    """
    approved = approved_only(decisions)
    removed = approved.where(F.col("action") == "remove").select(
        F.col("row_id").alias("_removed")
    )
    left = df.join(removed, column(key) == F.col("_removed"), "left_anti")
    for name in capped:
        limits = (
            approved.where((F.col("action") == "cap") & (F.col("column") == name))
            .groupBy(F.col("row_id").alias("_capped"))
            .agg(F.min("limit").alias("_limit"))
        )
        joined = left.join(limits, column(key) == F.col("_capped"), "left")
        value = F.coalesce(F.col("_limit").cast("double"), column(name).cast("double"))
        left = joined.withColumn(name, value).select(*map(quoted, df.columns))
    return left
