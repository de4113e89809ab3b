"""Filling missing values.

Fill values travel in a table ``row_id, column, value, reason, approved``, so
that a reviewer can see and change them before ``apply_fills`` writes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.columns import (
    column,
    is_numeric,
    number,
    numeric_columns,
    one_row,
    quoted,
    text_columns,
)
from tidewash.functions.frequencies import column_totals, value_frequencies
from tidewash.functions.ordered import Ordered
from tidewash.functions.quantiles import exact_quantiles
from tidewash.functions.rounds import RoundLog
from tidewash.functions.scratch import drop_table, write_scratch
from tidewash.functions.text import to_number
from tidewash.operators.clean import percent
from tidewash.operators.decisions import approved_only
from tidewash.operators.missing import columns_with_gaps, is_missing
from tidewash.operators.outliers import IQR_FACTOR

NEIGHBOURS = 5
SKEWED = 1.0
#: The largest number of single precision.
MOST_SINGLE = 3.4e38
FILL_COLUMNS = ["row_id", "column", "value", "reason", "approved"]


# ---- what is known about a column -----------------------------------------


def bounds_numeric(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Mean, quartiles, fences and number of missing cells per numeric column."""
    names = list(names)
    quartiles = exact_quantiles(df, names)
    found = one_row(
        df,
        [
            e
            for i, c in enumerate(names)
            for e in (
                F.avg(number(df, c)).alias(f"mean{i}"),
                F.count_if(is_missing(df, c)).alias(f"missing{i}"),
            )
        ],
        fields=2,
    )
    rows = []
    for i, c in enumerate(names):
        q1, median, q3 = (quartiles[c][p] for p in (0.25, 0.5, 0.75))
        if q1 is None:
            rows.append((c, *[None] * 7, found[f"missing{i}"]))
            continue
        iqr = q3 - q1
        fences = (q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr)
        rows.append((c, found[f"mean{i}"], median, q1, q3, iqr, *fences, found[f"missing{i}"]))
    measures = ["mean", "median", "q1", "q3", "iqr", "lower", "upper"]
    table = df.sparkSession.createDataFrame(
        rows,
        "column string, "
        + ", ".join(f"{m} double" for m in measures)
        + ", total_missing bigint",
    )
    return table.select(
        "column", *[F.round(m, 4).alias(m) for m in measures], "total_missing"
    )


def bounds_categorical(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Every value of each column with count and share, and the dominant value."""
    names = list(names)
    freq = value_frequencies(df, names)
    totals = column_totals(freq).select(
        "column", "total", F.col("top_value").alias("dominant_value"), "top_count"
    )
    rows = F.lit(df.count())
    return (
        freq.join(F.broadcast(totals), "column")
        .select(
            "column",
            "value",
            F.col("n").alias("count"),
            F.round(F.col("n") / F.col("total"), 4).alias("share"),
            "dominant_value",
            percent(F.col("top_count"), F.col("total")).alias("dominant_pct"),
            (rows - F.col("total")).alias("total_missing"),
        )
    )


# ---- neighbours and records -------------------------------------------------


def _target_value(df: DataFrame, target: str) -> Column:
    if is_numeric(df.schema[target].dataType):
        return number(df, target)
    return column(target)


def _merged(place: Column, k: int, gap: Callable[[Column], Column]) -> Column:
    """The ``k`` nearest of the arrays ``_before`` and ``_after``, before first on ties."""

    def tagged(side: str, rank: int) -> Column:
        return F.transform(
            side,
            lambda p: F.struct(
                gap(p).alias("distance"),
                F.abs(p["place"] - place).alias("steps"),
                F.lit(rank).alias("side"),
                p["value"].alias("value"),
            ),
        )

    return F.slice(F.array_sort(F.concat(tagged("_before", 0), tagged("_after", 1))), 1, k)


def nearest_neighbours(
    df: DataFrame,
    target: str,
    key: str,
    k: int = NEIGHBOURS,
    slices: int | None = None,
) -> DataFrame:
    """The ``k`` closest present values for every row where ``target`` is missing.

    Closeness is the number of rows between them in the order of the unique
    ``key``; at equal distance the earlier row comes first. Gives ``row_id``,
    the running number ``index`` among the missing rows, and ``neighbours``,
    an array of ``distance, value``.
    """
    narrow = df.select(column(key).alias("row_id"), _target_value(df, target).alias("_target"))
    present = F.col("_target").isNotNull()
    ordered = Ordered(narrow, ["row_id"], slices=slices).running_sums(
        {"_place": F.lit(1).cast("bigint"), "index": (~present).cast("bigint")}
    )
    point = F.when(present, F.struct(F.col("_place").alias("place"), F.col("_target").alias("value")))
    # The carried parts are computed from the numbered rows, so store them.
    if ordered.has_cut_groups:
        ordered = ordered.written()
    near = ordered.nearest(point, k, before="_before", after="_after").result()
    place = F.col("_place")
    merged = _merged(place, k, lambda p: F.abs(p["place"] - place))
    return near.where(F.col("_target").isNull()).select(
        "row_id",
        "index",
        F.transform(merged, lambda m: F.struct(m["distance"], m["value"])).alias("neighbours"),
    )


def impute_records(
    df: DataFrame,
    target: str,
    key: str,
    drivers: DataFrame | None = None,
    k: int = NEIGHBOURS,
) -> DataFrame:
    """One record per missing cell: the row's other values, neighbours and drivers.

    ``drivers`` is the report of ``missingness_drivers``.
    """
    near = nearest_neighbours(df, target, key, k)
    others = [c for c in df.columns if c not in (target, key)]
    explained = ""
    if drivers is not None:
        found = drivers.where(F.col("target") == target).select("place", "column").collect()
        explained = ",".join(r["column"] for r in sorted(found))
    rows = df.where(is_missing(df, target)).select(
        column(key).alias("row_id"), *[column(c) for c in others]
    )
    total = df.agg(F.count_if(is_missing(df, target))).first()[0]
    return near.join(rows, "row_id").select(
        F.lit(target).alias("column"),
        "index",
        F.lit(total).cast("bigint").alias("total"),
        "row_id",
        *map(quoted, others),
        F.transform("neighbours", lambda m: m["value"]).alias("closest_neighbours"),
        F.lit(explained).alias("drivers"),
    )


# ---- choosing fill values ---------------------------------------------------


def _fills(rows: DataFrame, target: str, value: Column, reason: str, approved: bool) -> DataFrame:
    return rows.select(
        "row_id",
        F.lit(target).alias("column"),
        value.cast("string").alias("value"),
        F.lit(reason).alias("reason"),
        F.lit(approved).alias("approved"),
    )


def _array_mode(values: Column) -> Column:
    """The most frequent entry of a short array; ties go to the smallest."""
    counted = F.transform(
        F.array_distinct(values),
        lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("m"), v.alias("v")),
    )
    return F.array_min(counted)["v"]


def neighbour_fills(
    df: DataFrame,
    target: str,
    key: str,
    how: str = "mean",
    k: int = NEIGHBOURS,
    approved: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Fill from the closest rows by ``mean``, ``median``, ``mode`` or ``nearest``."""
    near = nearest_neighbours(df, target, key, k, slices)
    values = F.transform("neighbours", lambda m: m["value"])
    count = F.size(values)
    if how == "mean":
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        value = F.try_divide(total, count.cast("double"))
    elif how == "median":
        ordered = F.array_sort(values)
        half = F.floor((count - 1) / 2).cast("int")
        value = (F.get(ordered, half) + F.get(ordered, F.floor(count / 2).cast("int"))) / 2
    elif how == "mode":
        value = _array_mode(values)
    elif how == "nearest":
        value = F.get(values, F.lit(0))
    else:
        raise ValueError(f"unknown way to fill: {how!r}")
    return _fills(near, target, value, f"{how} of the {k} closest rows", approved)


def group_values(
    df: DataFrame, target: str, by: str, how: str = "mean", slices: int | None = None
) -> DataFrame:
    """``group, value``: mean, median or mode of ``target`` for each value of ``by``.

    Equal values are combined before the shuffle, and the median is read from
    a sorted order that is spread over slices, so a group that holds a third
    of the table is not put into one task.
    """
    rows = df.select(column(by).alias("group"), _target_value(df, target).alias("value")).where(
        F.col("group").isNotNull() & F.col("value").isNotNull()
    )
    if how == "mean":
        return rows.groupBy("group").agg(F.avg("value").alias("value"))
    counted = rows.groupBy("group", "value").agg(F.count("*").alias("n"))
    if how == "mode":
        first = F.min(F.struct((-F.col("n")).alias("m"), "value"))
        return counted.groupBy("group").agg(first.alias("f")).select("group", "f.value")
    if how != "median":
        raise ValueError(f"unknown way to fill: {how!r}")
    summed = (
        Ordered(counted, by=["value"], group=["group"], slices=slices)
        .running_sums({"upto": F.col("n")})
        .result()
    )
    totals = counted.groupBy("group").agg(F.sum("n").alias("total"))
    lower, upper = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    start = F.col("upto") - F.col("n")
    low = F.max(F.when((start <= lower) & (lower < F.col("upto")), F.col("value")))
    high = F.max(F.when((start <= upper) & (upper < F.col("upto")), F.col("value")))
    return (
        summed.join(totals, "group")
        .groupBy("group")
        .agg(((low + high) / 2).alias("value"))
    )


def group_fills(
    df: DataFrame,
    target: str,
    key: str,
    by: str,
    how: str = "mean",
    approved: bool = False,
) -> DataFrame:
    """Fill with the mean, median or mode of the rows that agree in ``by``."""
    rows = df.where(is_missing(df, target)).select(
        column(key).alias("row_id"), column(by).alias("group")
    )
    # Stored, so Spark knows its size: a small table of groups is broadcast and
    # the rows are not shuffled. With one row per group on this side, the join
    # of a large one splits a frequent group over tasks.
    values = write_scratch(group_values(df, target, by, how), "groups")
    found = rows.join(values, "group")
    return _fills(found, target, F.col("value"), f"{how} by {by}", approved)


def strongest_drivers(drivers: DataFrame, target: str, most: int = 2) -> list[str]:
    """The columns that explain best where ``target`` is missing, from ``missingness_drivers``."""
    found = drivers.where((F.col("target") == target) & (F.col("place") <= most))
    return [r["column"] for r in found.orderBy("place").collect()]


def driver_values(
    df: DataFrame, target: str, drivers: Iterable[str], how: str = "mean"
) -> DataFrame:
    """``level, <drivers>, value``: mean or mode of ``target`` at every level of its drivers.

    The last level, as many as there are drivers, agrees in all of them, the one before in
    all but the weakest, and level 0 takes the whole column. All come from one
    aggregate over ``GROUPING SETS``; equal values are combined first.
    """
    if how not in ("mean", "mode"):
        raise ValueError(f"unknown way to fill: {how!r}")
    drivers = list(drivers)
    keys = [f"_d{i}" for i in range(len(drivers))]
    rows = df.select(
        *[column(c).alias(k) for c, k in zip(drivers, keys, strict=True)],
        _target_value(df, target).alias("value"),
    ).where(F.col("value").isNotNull())
    if how == "mean":
        sums = [F.sum(c).alias(c) for c in ("n", "high", "low")]
        halves = _halves(F.col("value").cast("double"))
        each, totals = [], [F.sum(half).alias(name) for name, half in halves.items()]
        counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), *totals)
    else:
        each, sums = ["value"], [F.sum("n").alias("n")]
        counted = rows.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    if keys:
        levels = [[*keys[:size], *each] for size in range(len(keys), -1, -1)]
        # The grouping number has a one for every driver that is left out.
        size = F.lit(len(keys)) - F.bit_count(F.grouping_id())
        grouped = counted.groupingSets([[F.col(c) for c in some] for some in levels], *keys, *each)
        summed = grouped.agg(size.alias("level"), *sums)
    else:
        summed = counted.groupBy(*each).agg(F.lit(0).alias("level"), *sums)
    if how == "mean":
        mean = (F.col("high") + F.col("low")) / F.col("n")
        found = summed.select("level", *keys, mean.alias("value"))
    else:
        first = F.min(F.struct((-F.col("n")).alias("m"), "value"))
        modes = summed.groupBy("level", *keys).agg(first.alias("f"))
        found = modes.select("level", *keys, F.col("f.value").alias("value"))
    return found.where(_known(keys))


def _halves(value: Column) -> dict[str, Column]:
    """A number as ``high`` and ``low``, its leading 24 bits and the rest, to be summed apart.

    Numbers of like size leave 29 bits of a double free, so up to half a billion of the first
    are summed exactly; the rest is too small for its rounding to show. So a mean does not
    depend on the order in which groups and tasks are added up.
    """
    fits = F.abs(value) <= MOST_SINGLE
    high = F.when(fits, value.cast("float").cast("double")).otherwise(value)
    return {"high": high, "low": F.when(fits, value - high).otherwise(0.0)}


def _known(keys: list[str]) -> Column:
    """Groups of a level whose drivers all have a value."""
    known = F.lit(True)
    for i, key in enumerate(keys):
        known = known & ((F.col("level") <= i) | F.col(key).isNotNull())
    return known


def driver_fills(
    df: DataFrame,
    target: str,
    key: str,
    drivers: Iterable[str],
    how: str = "mean",
    approved: bool = False,
) -> DataFrame:
    """Fill with the mean or mode of the rows that agree in the columns that explain the gap.

    ``drivers`` come strongest first. A row takes the value of the rows that agree in
    all of them; where there are none, or a driver is missing, of those that agree in all but
    the weakest, and so on down to the whole column.
    """
    drivers = list(drivers)
    keys = [f"_d{i}" for i in range(len(drivers))]
    values = write_scratch(driver_values(df, target, drivers, how), "levels")
    rows = df.where(is_missing(df, target)).select(
        column(key).alias("row_id"),
        *[column(c).alias(k) for c, k in zip(drivers, keys, strict=True)],
    )
    found, level = F.lit(None), F.lit(None)
    # One row per group on the right; Spark broadcasts a small table and splits frequent groups.
    for size in range(len(drivers), 0, -1):
        own = values.where(F.col("level") == size).select(
            *keys[:size], F.col("value").alias(f"_v{size}")
        )
        rows = rows.join(own, keys[:size], "left")
        found = F.coalesce(found, F.col(f"_v{size}"))
        level = F.coalesce(level, F.when(F.col(f"_v{size}").isNotNull(), F.lit(size)))
    whole = values.where("level = 0").select("value").first()  # one row
    if whole is not None:
        found = F.coalesce(found, F.lit(whole["value"]))
    names = F.array(*[F.lit(" and ".join(drivers[:size])) for size in range(len(drivers) + 1)])
    level = F.coalesce(level, F.lit(0))
    reason = F.concat(
        F.lit(how),
        F.when(level > 0, F.concat(F.lit(" by "), F.get(names, level))).otherwise(
            F.lit(" of the column")
        ),
    )
    return rows.where(found.isNotNull()).select(
        "row_id",
        F.lit(target).alias("column"),
        found.cast("string").alias("value"),
        reason.alias("reason"),
        F.lit(approved).alias("approved"),
    )


def fills_by_function(
    records: DataFrame, choose: Callable[[pd.DataFrame], pd.DataFrame]
) -> DataFrame:
    """Choose values for batches of records by a function adding ``value`` and ``reason``."""
    id_type = records.schema["row_id"].dataType.simpleString()
    schema = f"row_id {id_type}, column string, value string, reason string, approved boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chosen = choose(batch).assign(approved=False)
            chosen["value"] = chosen["value"].map(lambda v: None if v is None else str(v))
            yield chosen[FILL_COLUMNS]

    return records.mapInPandas(run, schema)


# ---- applying ---------------------------------------------------------------


def apply_fills(df: DataFrame, fills: DataFrame, target: str, key: str) -> DataFrame:
    """Write the approved fills of ``target``; a value that is no number is skipped.

    Numeric targets become double. Only missing cells change.
    """
    chosen = (
        approved_only(fills)
        .where(F.col("column") == target)
        .groupBy(F.col("row_id").alias("_row_id"))
        .agg(F.min("value").alias("_fill"))
    )
    joined = df.join(chosen, column(key) == F.col("_row_id"), "left")
    data_type = df.schema[target].dataType
    if is_numeric(data_type):
        value = F.coalesce(number(df, target), to_number(F.col("_fill")))
    else:
        value = F.coalesce(column(target), F.col("_fill").try_cast(data_type))
    return joined.withColumn(target, value).select(*map(quoted, df.columns))


def impute_sequential(
    df: DataFrame,
    key: str,
    fills: Callable[[DataFrame, str], DataFrame],
    names: Iterable[str] | None = None,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """Fill one column after the other; later columns see the earlier fills.

    ``fills(table, column)`` proposes the values for one column. The table is
    written after every column, which keeps the plan of each step short.
    """
    names = columns_with_gaps(df, exclude) if names is None else list(names)
    current = stored = df
    for name in names:
        before = stored
        current = stored = write_scratch(
            apply_fills(current, fills(current, name), name, key), "filled"
        )
        if before is not df:
            drop_table(before)
    return current


# ---- statistical fills --------------------------------------------------------


STRATEGIES = ("auto", "mean", "median", "mode")


def statistical_choices(
    df: DataFrame, names: Iterable[str] | None = None, strategy: str = "auto"
) -> list[tuple[str, str, object]]:
    """``(column, strategy, value)``: what a missing cell of each column becomes.

    ``auto`` takes the median of a numeric column with skewness beyond one and
    else the mean; text columns take the most frequent value.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy!r}")
    names = columns_with_gaps(df) if names is None else list(names)
    numbers = [c for c in names if c in numeric_columns(df)]
    texts = [c for c in names if c in text_columns(df)]
    choices: dict[str, tuple[str, object]] = {}
    if numbers:
        found = one_row(
            df,
            [
                e
                for i, c in enumerate(numbers)
                for e in (
                    F.avg(number(df, c)).alias(f"mean{i}"),
                    F.skewness(number(df, c)).alias(f"skew{i}"),
                )
            ],
            fields=3,
        )
        way = {}
        for i, c in enumerate(numbers):
            skew = found[f"skew{i}"]
            skewed = skew is not None and abs(skew) > SKEWED
            way[c] = strategy if strategy != "auto" else "median" if skewed else "mean"
        medians = exact_quantiles(df, [c for c in numbers if way[c] == "median"], (0.5,))
        for i, c in enumerate(numbers):
            if way[c] == "mean":
                choices[c] = ("mean", found[f"mean{i}"])
            elif way[c] == "median":
                choices[c] = ("median", medians[c][0.5])
    by_mode = [c for c in [*texts, *numbers] if c not in choices]
    if by_mode:
        for r in column_totals(value_frequencies(df, by_mode)).collect():
            top = r["top_value"] if r["column"] in texts else r["top_number"]
            choices[r["column"]] = ("mode", top)
    return [(c, *choices[c]) for c in names if c in choices]


def impute_statistical(
    df: DataFrame, names: Iterable[str] | None = None, strategy: str = "auto"
) -> DataFrame:
    """Fill every column with one value of its own (see ``statistical_choices``)."""
    filled = {}
    for c, _, value in statistical_choices(df, names, strategy):
        if value is not None:
            filled[c] = F.coalesce(_target_value(df, c), F.lit(value))
    return df.withColumns(filled)


# ---- nearest rows by value ----------------------------------------------------


def knn_fills(
    df: DataFrame,
    target: str,
    feature: str,
    key: str,
    block: str | None = None,
    k: int = NEIGHBOURS,
    approved: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Mean of ``target`` over the ``k`` rows closest in ``feature``, within ``block``.

    Exact, and without comparing pairs of rows: sorted by the feature, the
    closest rows are among the ``k`` present rows on either side. Ties go to
    the row nearest in the order of feature and key, the earlier one first.
    Rows without feature or block get no value.
    """
    blocks = [column(block).alias("_block")] if block else [F.lit(1).alias("_block")]
    narrow = df.select(
        column(key).alias("row_id"),
        number(df, feature).alias("_x"),
        number(df, target).alias("_target"),
        *blocks,
    ).where(F.col("_x").isNotNull() & F.col("_block").isNotNull())
    present = F.col("_target").isNotNull()
    ordered = Ordered(narrow, ["_x", "row_id"], group=["_block"], slices=slices).running_sums(
        {"_place": F.lit(1).cast("bigint")}
    )
    if ordered.has_cut_groups:
        ordered = ordered.written()
    point = F.when(
        present,
        F.struct(
            F.col("_place").alias("place"),
            F.col("_target").alias("value"),
            F.col("_x").alias("x"),
        ),
    )
    near = ordered.nearest(point, k, before="_before", after="_after").result()
    merged = _merged(F.col("_place"), k, lambda p: F.abs(p["x"] - F.col("_x")))
    found = near.where(~present).select("row_id", merged.alias("_near"))
    total = F.aggregate("_near", F.lit(0.0), lambda a, m: a + m["value"])
    value = F.try_divide(total, F.size("_near").cast("double"))
    return _fills(found, target, value, f"mean of the {k} closest by {feature}", approved)


# ---- regression rounds --------------------------------------------------------


def impute_iterative(
    df: DataFrame,
    key: str,
    names: Iterable[str],
    predictors: Iterable[str] = (),
    rounds: int = 5,
    log: RoundLog | None = None,
) -> DataFrame:
    """Fill numeric columns by linear regression on each other, in rounds.

    Missing cells start at the mean. In each round every column is fitted on
    all others over the rows where it was present, and its missing cells are
    predicted anew. A fit is one pass that sums all products of the columns; only
    these sums go to the driver. Only the numeric columns are written per round. With
    a ``log`` every finished round is kept, and a later call with the same log goes on
    after the last one.
    """

    def store(table: DataFrame, turn: int) -> DataFrame:
        return write_scratch(table, "rounds") if log is None else log.write(table, "rounds", turn)

    names = list(names)
    inputs = [*names, *[c for c in predictors if c not in names]]
    before = log.last() if log else None
    if before:
        done, tables, state = before
        current, middle = tables["rounds"], state["middle"]
    else:
        start = one_row(
            df, [F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(inputs)], fields=2
        )
        current = store(
            df.select(
                column(key).alias("_key"),
                *[
                    F.coalesce(number(df, c), F.lit(start[f"m{i}"])).alias(f"x{i}")
                    for i, c in enumerate(inputs)
                ],
                *[is_missing(df, c).alias(f"gap{i}") for i, c in enumerate(names)],
            ),
            0,
        )
        done, middle = 0, [float(start[f"m{i}"] or 0.0) for i in range(len(inputs))]
        if log:
            log.finish(0, {"rounds": current}, {"middle": middle})
    stored = current
    for turn in range(done + 1, rounds + 1):
        for i in range(len(names)):
            others = [j for j in range(len(inputs)) if j != i]
            slopes, base = _regression(current.where(~F.col(f"gap{i}")), i, others, middle)
            predicted = F.lit(base)
            for j, slope in zip(others, slopes, strict=True):
                predicted = predicted + F.lit(float(slope)) * F.col(f"x{j}")
            current = current.withColumn(
                f"x{i}", F.when(F.col(f"gap{i}"), predicted).otherwise(F.col(f"x{i}"))
            )
        earlier, current = stored, store(current, turn)
        if log:  # which deletes the table of the last round
            log.finish(turn, {"rounds": current}, {"middle": middle})
        else:
            drop_table(earlier)
        stored = current
    filled = current.select(
        "_key", *[F.col(f"x{i}").alias(f"_x{i}") for i in range(len(names))]
    )
    joined = df.join(filled, column(key) == F.col("_key"), "left")
    return joined.withColumns(
        {c: F.coalesce(number(df, c), F.col(f"_x{i}")) for i, c in enumerate(names)}
    ).select(*map(quoted, df.columns))


def _regression(
    rows: DataFrame, target: int, others: list[int], middle: list[float]
) -> tuple[list[float], float]:
    """Slopes and intercept of column ``x<target>`` on the columns ``x<j>``.

    Every task adds up the products of its rows, less ``middle`` so that large
    numbers lose no digits; the sums of all tasks are as many as the columns squared.
    """
    columns = [*others, target]
    shift = np.array([middle[j] for j in columns])
    size = len(others)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 2, size + 2))
        for batch in batches:
            values = batch.to_numpy(dtype=np.float64) - shift
            values = np.hstack([np.ones((len(values), 1)), values])
            total += values.T @ values
        if total[0, 0]:
            places = np.arange(total.size, dtype=np.int32)
            yield pd.DataFrame({"place": places, "total": total.ravel()})

    found = (
        rows.select(*[f"x{j}" for j in columns])
        .mapInPandas(products, "place int, total double")
        .groupBy("place")
        .agg(F.sum("total").alias("total"))
        .toPandas()
    )
    if not len(found):
        return [0.0] * size, 0.0
    flat = np.zeros((size + 2) ** 2)
    flat[found["place"]] = found["total"]
    moments = flat.reshape(size + 2, size + 2) / flat[0]
    means = moments[0, 1:]
    spread = moments[1:, 1:] - np.outer(means, means)
    # Least squares of smallest norm, so constant or repeated columns do no harm.
    slopes = np.linalg.lstsq(spread[:size, :size], spread[:size, size], rcond=None)[0]
    base = means[size] + shift[size] - float(slopes @ (means[:size] + shift[:size]))
    return [float(s) for s in slopes], base
