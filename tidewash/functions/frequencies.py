"""How often each value of each column occurs, grouped by narrow keys.

Whole numbers, real numbers and texts are grouped apart, each keyed by the number
of the column and one value of the form's own type, so that a row on its way to
the shuffle holds nothing else. Many columns are taken in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewash.functions.columns import column, number

#: Columns that are grouped in one pass.
COLUMNS_AT_ONCE = 64


def as_text(df: DataFrame, name: str) -> Column:
    """The value as text, equal for equal values (no NaN, one zero)."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return (number(df, name) + F.lit(0.0)).cast("string")
    return column(name).cast("string")


def value_frequencies(
    df: DataFrame,
    columns: Iterable[str],
    counters: dict[str, Column] | None = None,
    by: dict[str, Column] | None = None,
) -> DataFrame:
    """``column, value, number, n`` for every non-null distinct value.

    ``number`` is the value as double for numeric columns and null otherwise.
    ``counters`` adds sums of 0/1 expressions over the rows with the value; ``by`` counts
    apart for each value of some whole numbers of the row.
    The rows are combined before the shuffle, so a value that fills a third of
    the table costs one row per task.
    """
    columns = list(columns)
    counters, by = counters or {}, by or {}
    sums = [F.sum(name).alias(name) for name in counters]
    tables = []
    for form, names in _by_form(df, columns):
        grouped = (
            _stacked(df, names, lambda c: _value(df, c), counters, by)
            .groupBy("column", "key", *by)
            .agg(F.count("*").alias("n"), *sums)
        )
        # Numbers become text only after equal values are combined.
        number_of = F.col("key").cast("double")
        if form == "text":
            decimals = [c for c in names if isinstance(df.schema[c].dataType, T.DecimalType)]
            number_of = (
                F.when(_named(names).isin(decimals), F.col("key").try_cast("double"))
                if decimals
                else F.lit(None).cast("double")
            )
        tables.append(
            grouped.select(
                _named(names).alias("column"),
                F.col("key").cast("string").alias("value"),
                number_of.alias("number"),
                "n",
                *counters,
                *by,
            )
        )
    if not tables:
        extra = "".join(f", {name} bigint" for name in [*counters, *by])
        return df.sparkSession.createDataFrame(
            [], f"column string, value string, number double, n bigint{extra}"
        )
    return reduce(DataFrame.unionAll, tables)


def distinct_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``column, num_unique, present``: distinct and all non-null values of each column.

    Texts are told apart by 128 bits of two hashes, so long ones are not shuffled.
    """
    tables = []
    for form, names in _by_form(df, list(columns)):
        def key(name: str, form: str = form) -> Column:
            value = _value(df, name)
            if form != "text":
                return value
            hashes = F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))
            return F.when(value.isNotNull(), hashes)

        grouped = (
            _stacked(df, names, key, {}).groupBy("column", "key").agg(F.count("*").alias("n"))
        )
        counted = grouped.groupBy("column").agg(
            F.count("*").alias("num_unique"), F.sum("n").alias("present")
        )
        tables.append(counted.select(_named(names).alias("column"), "num_unique", "present"))
    if not tables:
        schema = "column string, num_unique bigint, present bigint"
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, tables)


def _by_form(df: DataFrame, columns: list[str]) -> Iterator[tuple[str, list[str]]]:
    """The columns of each form, in chunks."""
    for form in ("whole", "real", "text"):
        names = [c for c in columns if _form(df.schema[c].dataType) == form]
        for at in range(0, len(names), COLUMNS_AT_ONCE):
            yield form, names[at : at + COLUMNS_AT_ONCE]


def _stacked(
    df: DataFrame,
    names: list[str],
    value: Callable[[str], Column],
    counters: dict[str, Column],
    by: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per cell: the number of the column and its value, if there is one."""
    carried = [expr.cast("int").alias(name) for name, expr in counters.items()]
    carried += [expr.cast("bigint").alias(name) for name, expr in (by or {}).items()]
    cells = [part for i, name in enumerate(names) for part in (F.lit(i), value(name))]
    stacked = df.select(*carried, F.stack(F.lit(len(names)), *cells).alias("column", "key"))
    return stacked.where(F.col("key").isNotNull())


def _named(names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col("column") + 1)


def _value(df: DataFrame, name: str) -> Column:
    form = _form(df.schema[name].dataType)
    if form == "whole":
        return column(name).cast("bigint")
    if form == "real":
        return number(df, name) + F.lit(0.0)  # adding zero makes the two zeros equal
    return column(name).cast("string")


def _form(data_type: T.DataType) -> str:
    """How a value is grouped: as whole number, as real number, or as text."""
    if isinstance(data_type, T.IntegralType):
        return "whole"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "real"
    return "text"


def column_totals(frequencies: DataFrame) -> DataFrame:
    """One row per column: values, distinct values, mean, most frequent value.

    Ties go to the smallest value, by number for numeric columns.
    """
    first = F.min(F.struct((-F.col("n")).alias("m"), "number", "value"))
    return frequencies.groupBy("column").agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("number") * F.col("n")) / F.sum("n")).alias("mean"),
        F.count("*").alias("distinct_values"),
        first.alias("_first"),
    ).select(
        "column",
        "total",
        "distinct_values",
        "mean",
        F.col("_first.value").alias("top_value"),
        F.col("_first.number").alias("top_number"),
        (-F.col("_first.m")).alias("top_count"),
    )


