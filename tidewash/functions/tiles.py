"""Compare rows of blocks in groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.scratch import write_scratch

Compare = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]
CompareInParts = Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]]


def _salt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("id"), parts.cast("bigint")).cast("int")


def _none(schema: str) -> pd.DataFrame:
    # Objects, as an empty column of numbers cannot stand for arrays.
    return pd.DataFrame({part.split()[0]: [] for part in schema.split(", ")}, dtype=object)


def meet(
    homes: DataFrame,
    visits: DataFrame,
    compare: Compare | CompareInParts,
    schema: str,
    tile: int,
    in_parts: bool = False,
) -> DataFrame:
    """Apply ``compare(visitors, members)`` to every tile of every block.

    Both inputs have the same columns, among them ``target`` (the block) and
    ``id``. A block with many members or visitors is cut into parts along both
    sides; a row goes into one part of its own side and meets all parts of the
    other, so no group holds more than about ``tile`` rows of either. The sizes of
    the blocks stay in a stored table, which Spark broadcasts if it is small. With
    ``in_parts`` the function yields its result part by part, and no task holds all of it.
    """

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("target").agg(F.ceil(F.count("*") / tile).cast("int").alias(name))

    plan = write_scratch(
        parts(homes, "home_parts").join(parts(visits, "visit_parts"), "target"), "tiles"
    )
    columns = [c for c in homes.columns if c != "target"]

    def spread(side: DataFrame, own: str, other: str) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1))
        return side.join(plan, "target").select(
            "target",
            _salt(F.col(f"{own}_parts")).alias(f"{own}_part"),
            copies.alias(f"{other}_part"),
            F.lit(own).alias("side"),
            *columns,
        )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        home, visit = group[group["side"] == "home"], group[group["side"] == "visit"]
        return _none(schema) if home.empty or visit.empty else compare(visit, home)

    def run_in_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(batches))
        home, visit = group[group["side"] == "home"], group[group["side"] == "visit"]
        if not (home.empty or visit.empty):
            yield from compare(visit, home)

    return (
        spread(homes, "home", "visit")
        .unionByName(spread(visits, "visit", "home"))
        .groupBy("target", "home_part", "visit_part")
        .applyInPandas(run_in_parts if in_parts else run, schema)
    )


def meet_within(
    rows: DataFrame, keys: list[str], compare: Compare, schema: str, tile: int
) -> DataFrame:
    """Apply ``compare(some, others)`` to all pairs of rows that agree in ``keys``.

    Rows have an ``id``. A key with many rows is cut into parts of about ``tile`` rows,
    and every two parts meet once; a part that meets itself is given twice, so
    ``compare`` sees each pair of it from both sides. Keys must not be null.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    plan = write_scratch(
        sizes.select(*keys, F.ceil(F.col("_n") / tile).cast("int").alias("_parts")), "tiles"
    )
    spread = (
        rows.join(plan, keys)
        .withColumn("_part", _salt(F.col("_parts")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_low", F.least("_part", "_other"))
        .withColumn("_high", F.greatest("_part", "_other"))
        .drop("_parts", "_other")
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, high = group["_low"].iloc[0], group["_high"].iloc[0]
        some, others = group[group["_part"] == low], group[group["_part"] == high]
        return _none(schema) if some.empty or others.empty else compare(some, others)

    return spread.groupBy(*keys, "_low", "_high").applyInPandas(run, schema)
