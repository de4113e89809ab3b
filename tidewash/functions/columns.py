"""Which columns count as numeric, categorical or datetime."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC_RULES = ("narrow", "wide", "predicate")


def quoted(name: str) -> str:
    """``name`` quoted so that dots and spaces in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def is_numeric(data_type: T.DataType, rule: str = "wide") -> bool:
    """Numeric test under one of three rules.

    ``narrow``: bigint and double only. ``wide``: every number type.
    ``predicate``: every number type and boolean.
    """
    if rule not in NUMERIC_RULES:
        raise ValueError(f"unknown numeric rule {rule!r}; use one of {NUMERIC_RULES}")
    if rule == "narrow":
        return isinstance(data_type, (T.LongType, T.DoubleType))
    if rule == "predicate" and isinstance(data_type, T.BooleanType):
        return True
    return isinstance(data_type, T.NumericType)


def numeric_columns(
    df: DataFrame, rule: str = "wide", exclude: Iterable[str] = ()
) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema
        if is_numeric(f.dataType, rule) and f.name not in skip
    ]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """String columns; pass ``exclude=("ID",)`` to leave an id column out."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be grouped and written as text."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


def column_kinds(df: DataFrame, rule: str = "wide") -> dict[str, str]:
    """``numeric``, ``categorical``, ``datetime`` or ``other`` for every column."""
    numbers = set(numeric_columns(df, rule))
    texts = set(text_columns(df))
    dates = set(datetime_columns(df))
    return {
        name: "numeric"
        if name in numbers
        else "categorical"
        if name in texts
        else "datetime"
        if name in dates
        else "other"
        for name in df.columns
    }


def number(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN as null so that fences and averages hold."""
    data_type = df.schema[name].dataType
    value = column(name).cast("double")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in float and double columns."""
    return df.select(
        *[
            F.when(~F.isnan(column(f.name)), column(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else column(f.name)
            for f in df.schema
        ]
    )


# Spark compiles an aggregate only while its buffer has at most 100 fields
# (spark.sql.codegen.maxFields); beyond that it runs several times slower. A
# count takes one field, a variance three, a covariance four.
AGGREGATE_FIELDS = 90


def one_row(df: DataFrame, aggregates: list[Column], fields: int = 1) -> dict:
    """The values of many aggregates, by name, in as few scans as compile well."""
    found: dict = {}
    for part in chunks(aggregates, fields):
        found.update(df.agg(*part).first().asDict())
    return found


def added(terms: list[Column]) -> Column:
    """The sum of many columns, as a shallow tree that any number of terms fits."""
    while len(terms) > 1:
        pairs = [terms[i : i + 2] for i in range(0, len(terms), 2)]
        terms = [p[0] + p[1] if len(p) == 2 else p[0] for p in pairs]
    return terms[0] if terms else F.lit(0)


def chunks(items: list, fields: int = 1) -> list[list]:
    """``items`` in runs whose aggregates, of ``fields`` each, stay compilable."""
    size = max(1, AGGREGATE_FIELDS // fields)
    return [items[i : i + size] for i in range(0, len(items), size)]
