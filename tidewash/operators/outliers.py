"""Numeric outliers by the interquartile fences: find, report, remove, cap."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewash.functions.columns import column, number, numeric_columns, one_row
from tidewash.functions.ordered import Ordered
from tidewash.functions.quantiles import exact_quantiles
from tidewash.operators.clean import percent
from tidewash.operators.correlation import top_correlated

IQR_FACTOR = 1.5
QUARTILES = (0.25, 0.5, 0.75)


def outlier_filter(df: DataFrame, name: str, fences: Fences) -> Column:
    """Keeps the outliers of a column, in a form that reaches the parquet scan."""
    value = column(name)
    lower, upper = _bounds(df, name, fences)
    outside = (value < lower) | (value > upper)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return outside & ~F.isnan(value)
    return outside


def inlier_filter(df: DataFrame, name: str, fences: Fences) -> Column:
    """Keeps what is no outlier, also missing values.

    For whole numbers this reaches the parquet scan; real numbers need a test for
    NaN, which the scan has not.
    """
    value = column(name)
    lower, upper = _bounds(df, name, fences)
    inside = value.isNull() | ((value >= lower) & (value <= upper))
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return inside | F.isnan(value)
    return inside


# The largest number of each integer type.
LARGEST = {T.ByteType: 2**7 - 1, T.ShortType: 2**15 - 1, T.IntegerType: 2**31 - 1, T.LongType: 2**63 - 1}


def _bounds(df: DataFrame, name: str, fences: Fences) -> tuple[Column, Column]:
    """The smallest and largest value that is no outlier, in the column's own integer type.

    A comparison with a number of another type would cast the column, and a cast
    column does not reach the scan.
    """
    kind = df.schema[name].dataType
    largest = LARGEST.get(type(kind))
    if largest is None or not (math.isfinite(fences.lower) and math.isfinite(fences.upper)):
        return F.lit(fences.lower), F.lit(fences.upper)
    low, high = math.ceil(fences.lower), math.floor(fences.upper)
    if low > largest or high < -largest - 1:  # nothing lies inside
        return F.lit(fences.lower), F.lit(fences.upper)
    return F.lit(max(low, -largest - 1)).cast(kind), F.lit(min(high, largest)).cast(kind)


@dataclass(frozen=True)
class Fences:
    """Quartiles of a column and the limits beyond which a value is an outlier."""

    count: int
    q1: float
    median: float
    q3: float
    lower: float
    upper: float

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1

    def is_outlier(self, value: Column) -> Column:
        """Strictly outside the fences; null is never an outlier."""
        outside = (value < F.lit(self.lower)) | (value > F.lit(self.upper))
        return F.coalesce(outside, F.lit(False))


def iqr_fences(
    df: DataFrame, names: Iterable[str] | None = None, factor: float = IQR_FACTOR
) -> dict[str, Fences]:
    """Fences per numeric column; columns without values are left out."""
    names = numeric_columns(df) if names is None else list(names)
    found = {}
    for name, q in exact_quantiles(df, names, QUARTILES).items():
        if q.count:
            q1, median, q3 = (q[p] for p in QUARTILES)
            reach = factor * (q3 - q1)
            found[name] = Fences(q.count, q1, median, q3, q1 - reach, q3 + reach)
    return found


def outlier_summary(
    df: DataFrame, names: Iterable[str] | None = None, stage: str = "before"
) -> DataFrame:
    """Outliers per column, as a share of all rows."""
    names = numeric_columns(df) if names is None else list(names)
    fences = iqr_fences(df, names)
    found = one_row(
        df,
        [
            F.count("*").alias("rows"),
            *[
                F.count_if(fences[c].is_outlier(number(df, c))).alias(f"c{i}")
                for i, c in enumerate(names)
                if c in fences
            ],
        ],
    )
    rows = [(c, found["rows"], found.get(f"c{i}", 0), stage) for i, c in enumerate(names)]
    table = df.sparkSession.createDataFrame(
        rows, "column string, total_rows bigint, outlier_count bigint, stage string"
    )
    return table.withColumn(
        "outlier_pct", percent(F.col("outlier_count"), F.col("total_rows"))
    )


def outlier_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outlier counts of two ``outlier_summary`` reports side by side."""
    b = before.select("column", F.col("outlier_count").alias("outliers_before"))
    a = after.select("column", F.col("outlier_count").alias("_after"))
    removed = F.col("outliers_before") - F.col("outliers_after")
    return (
        b.join(a, "column", "left")
        .select(
            "column",
            "outliers_before",
            F.coalesce("_after", F.lit(0)).alias("outliers_after"),
        )
        .select(
            "*",
            removed.alias("outliers_removed"),
            percent(removed, F.col("outliers_before")).alias("pct_reduced"),
        )
    )


def iqr_outlier_rows(df: DataFrame, name: str, factor: float = IQR_FACTOR) -> DataFrame:
    """The rows whose ``name`` lies outside the fences, with the direction."""
    fences = iqr_fences(df, [name], factor).get(name)
    if fences is None:
        return df.withColumn("direction", F.lit(None).cast("string")).where(F.lit(False))
    value = number(df, name)
    found = df.where(outlier_filter(df, name, fences))
    return found.withColumn("direction", direction(value, fences))


# The texts for the two directions.
ABOVE, BELOW = "ABOVE upper fence", "BELOW lower fence"


def direction(value: Column, fences: Fences) -> Column:
    return F.when(value > F.lit(fences.upper), F.lit(ABOVE)).otherwise(F.lit(BELOW))


def boxplot_stats(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The numbers behind a box plot: box, whiskers inside the fences, fliers."""
    names = numeric_columns(df) if names is None else list(names)
    fences = iqr_fences(df, names)
    aggregates = []
    for i, (c, f) in enumerate(fences.items()):
        x = number(df, c)
        inside = F.when(~f.is_outlier(x), x)
        aggregates += [
            F.min(inside).alias(f"low{i}"),
            F.max(inside).alias(f"high{i}"),
            F.count_if(f.is_outlier(x)).alias(f"fliers{i}"),
        ]
    found = one_row(df, aggregates)
    rows = [
        (c, f.q1, f.median, f.q3, found[f"low{i}"], found[f"high{i}"], found[f"fliers{i}"])
        for i, (c, f) in enumerate(fences.items())
    ]
    table = df.sparkSession.createDataFrame(
        rows,
        "column string, q1 double, median double, q3 double, "
        "whisker_low double, whisker_high double, fliers bigint",
    )
    return table.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


def winsorize(
    df: DataFrame, names: Iterable[str] | None = None, factor: float = IQR_FACTOR
) -> DataFrame:
    """Move values outside the fences onto the nearest fence; null stays null."""
    fences = iqr_fences(df, names, factor)
    capped = {}
    for c, f in fences.items():
        x = number(df, c)
        limited = F.least(F.greatest(x, F.lit(f.lower)), F.lit(f.upper))
        capped[c] = F.when(x.isNotNull(), limited)
    return df.withColumns(capped)


def outlier_records(
    df: DataFrame, target: str, key: str, related: int = 5, factor: float = IQR_FACTOR
) -> DataFrame:
    """One record per outlier of ``target``, in the order of the unique ``key``.

    Each record has its running number, the total, the direction, the bounds
    of the column and the values of the ``related`` most correlated columns.
    """
    fences = iqr_fences(df, [target], factor).get(target)
    # The key is left out before the ranking, so that it takes no one's place.
    ranked = top_correlated(df.drop(key), [target], related).orderBy("place")
    near = [r["column"] for r in ranked.collect()]
    value = number(df, target)
    test = outlier_filter(df, target, fences) if fences else F.lit(False)
    found = df.where(test).select(
        column(key).alias("row_id"),
        value.alias("value"),
        *[number(df, c).alias(f"with_{c}") for c in near if c != target],
    )
    numbered = Ordered(found, ["row_id"]).running_sums({"index": F.lit(1).cast("bigint")})
    rows = numbered.rows
    total = rows.count()
    bounds = {"median": "median", "q1": "q1", "q3": "q3", "lower": "lower", "upper": "upper"}
    mean = df.agg(F.avg(value)).first()[0]
    return numbered.result().select(
        F.lit(target).alias("column"),
        "index",
        F.lit(total).cast("bigint").alias("total"),
        "row_id",
        direction(F.col("value"), fences).alias("direction")
        if fences
        else F.lit(None).cast("string").alias("direction"),
        "value",
        *[c for c in numbered.rows.columns if c.startswith("with_")],
        F.round(F.lit(mean), 4).alias("mean"),
        *[
            F.round(F.lit(getattr(fences, b) if fences else None).cast("double"), 4).alias(name)
            for name, b in bounds.items()
        ],
    )


@dataclass
class Removal:
    """The rows left after removal, and the fences used for each column in turn."""

    data: DataFrame
    fences: dict[str, Fences]


def remove_outliers(
    df: DataFrame,
    names: Iterable[str] | None = None,
    factor: float = IQR_FACTOR,
    sequential: bool = True,
) -> Removal:
    """Drop the rows outside the fences of each column.

    With ``sequential`` the fences of a column are taken from the rows that
    the columns before it left over, so the order of the columns matters;
    otherwise all fences come from the input. Fences become literals in the
    filter, so nothing is shuffled, and for whole numbers parquet can skip row groups.
    """
    names = numeric_columns(df) if names is None else list(names)
    used: dict[str, Fences] = {}
    left = df
    if not sequential:
        used = iqr_fences(df, names, factor)
        for c, f in used.items():
            left = left.where(inlier_filter(df, c, f))
        return Removal(left, used)
    for c in names:
        for name, f in iqr_fences(left, [c], factor).items():
            used[name] = f
            left = left.where(inlier_filter(df, name, f))
    return Removal(left, used)
