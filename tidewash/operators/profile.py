"""Descriptions of a table: sizes, missing cells, values and distributions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.columns import (
    chunks,
    column,
    column_kinds,
    is_numeric,
    number,
    numeric_columns,
    one_row,
    scalar_columns,
    text_columns,
)
from tidewash.functions.frequencies import (
    as_text,
    column_totals,
    distinct_counts,
    value_frequencies,
)
from tidewash.functions.quantiles import exact_quantiles
from tidewash.operators.clean import count_duplicates, percent

IDENTIFIER_PERCENT = 10.0


def _is_missing(df: DataFrame, name: str) -> Column:
    if name in numeric_columns(df):
        return number(df, name).isNull()
    return column(name).isNull()


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of rows, and of missing cells per column, in one scan."""
    found = one_row(
        df,
        [
            F.count("*").alias("rows"),
            *[F.count_if(_is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
        ],
    )
    return found["rows"], {c: found[f"c{i}"] for i, c in enumerate(df.columns)}


def missing_summary(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Per column: rows, missing cells, their share, and whether it is excluded."""
    skip = set(exclude)
    total, missing = missing_counts(df)
    table = df.sparkSession.createDataFrame(
        [(c, total, missing[c], c in skip) for c in df.columns],
        "column string, total_rows bigint, missing_count bigint, excluded boolean",
    )
    return table.withColumn(
        "missing_pct", percent(F.col("missing_count"), F.col("total_rows"))
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: size, share of null cells, duplicates and kinds of columns."""
    kinds = list(column_kinds(df).values())
    rows, missing = missing_counts(df)
    cells = rows * len(df.columns)
    row = (
        rows,
        len(df.columns),
        sum(missing.values()),
        cells,
        count_duplicates(df),
        *[kinds.count(kind) for kind in ("numeric", "categorical", "datetime")],
    )
    table = df.sparkSession.createDataFrame(
        [row],
        "rows bigint, cols bigint, nulls bigint, cells bigint, duplicate_rows bigint, "
        "numeric_cols bigint, categorical_cols bigint, datetime_cols bigint",
    )
    null_pct = percent(F.col("nulls"), F.col("cells"))
    return table.withColumn("null_pct", null_pct).drop("nulls", "cells")


def describe_dataset(df: DataFrame, samples: int = 0, seed: int = 0) -> DataFrame:
    """One row per column: type, distinct values, nulls; sizes of the whole table.

    With ``samples``, adds that many distinct example values per column, the
    ones with the lowest hash under ``seed``, joined by `` | ``.
    """
    names = scalar_columns(df)
    types = dict(df.dtypes)
    totals = distinct_counts(df, names).withColumnRenamed("present", "_present")
    schema = "column string, dtype string"
    listed = df.sparkSession.createDataFrame([(c, types[c]) for c in names], schema)
    per_column = listed.join(F.broadcast(totals), "column", "left").withColumn(
        "total_rows", F.lit(df.count()).cast("bigint")
    )
    nulls = F.col("total_rows") - F.coalesce(F.col("_present"), F.lit(0))
    described = per_column.select(
        "column",
        "dtype",
        F.coalesce(F.col("num_unique"), F.lit(0)).alias("num_unique"),
        nulls.alias("null_count"),
        percent(nulls, F.col("total_rows")).alias("null_pct"),
        "total_rows",
        F.lit(len(names)).cast("bigint").alias("total_columns"),
        (F.col("total_rows") * len(names)).alias("total_cells"),
    )
    if not samples:
        return described
    return described.join(
        F.broadcast(column_samples(value_frequencies(df, names), samples, seed)), "column", "left"
    )


def column_samples(frequencies: DataFrame, samples: int = 3, seed: int = 0) -> DataFrame:
    """A few example values per column, chosen by hash, the same on every run."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("value")))
    ranked = frequencies.select("column", "value", order.alias("_hash"))
    # Filtering on the rank lets Spark cut each task to `samples` rows per
    # column before the shuffle.
    first = ranked.selectExpr(
        "*", "row_number() over (partition by column order by _hash, value) as _rank"
    ).where(F.col("_rank") <= samples)
    return first.groupBy("column").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_rank", "value"))), lambda s: s["value"]
            ),
            " | ",
        ).alias("samples")
    )


def identifier_columns(df: DataFrame, threshold: float = IDENTIFIER_PERCENT) -> DataFrame:
    """Text columns whose most common value covers less than ``threshold`` percent."""
    totals = column_totals(value_frequencies(df, text_columns(df)))
    share = F.col("top_count") / F.col("total") * 100
    return totals.where(share < float(threshold)).select(
        "column", F.round(share, 4).alias("top_pct")
    )


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """``value, count, share`` of the non-null values, most frequent first."""
    counted = df.where(column(name).isNotNull()).groupBy(column(name).alias("value")).agg(
        F.count("*").alias("count")
    )
    # A window over all values would be one task; the total is one number.
    total = F.lit(df.agg(F.count(column(name))).first()[0])
    return (
        counted.select("value", "count", F.round(F.col("count") / total, 4).alias("share"))
        .orderBy(F.col("count").desc(), F.col("value"))
    )


def top_values(df: DataFrame, names: Iterable[str], k: int = 5) -> DataFrame:
    """``column, place, value, count``: the ``k`` most frequent values of each column."""
    ranked = value_frequencies(df, names).selectExpr(
        "column",
        "row_number() over (partition by column order by n desc, number, value) as place",
        "value",
        "n as count",
    )
    # Each task keeps only `k` rows per column before the shuffle.
    return ranked.where(F.col("place") <= k)


def dominant_values(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The most frequent value of each column and its share of non-null rows."""
    totals = column_totals(value_frequencies(df, names))
    return totals.select(
        "column",
        F.col("top_value").alias("dominant_value"),
        F.col("top_count").alias("dominant_count"),
        percent(F.col("top_count"), F.col("total")).alias("dominant_pct"),
    )


def rare_categories(df: DataFrame, names: Iterable[str], below: float = 1.0) -> DataFrame:
    """Values that make up less than ``below`` percent of their column."""
    freq = value_frequencies(df, names)
    totals = freq.groupBy("column").agg(F.sum("n").alias("_total"))
    share = F.col("n") / F.col("_total") * 100
    return (
        freq.join(F.broadcast(totals), "column")
        .where(share < float(below))
        .select("column", "value", F.col("n").alias("count"), F.round(share, 4).alias("pct"))
    )


def moments(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Counts, range, mean, spread, skewness and kurtosis, in one scan."""
    found: dict = {}
    for part in chunks(list(enumerate(names)), 18):
        aggregates = []
        for i, c in part:
            x = number(df, c)
            aggregates += [
                F.count(x).alias(f"count{i}"),
                F.min(x).alias(f"min{i}"),
                F.max(x).alias(f"max{i}"),
                F.avg(x).alias(f"mean{i}"),
                F.stddev(x).alias(f"stddev{i}"),
                F.skewness(x).alias(f"skewness{i}"),
                F.kurtosis(x).alias(f"kurtosis{i}"),
                F.count_if(x == 0).alias(f"zeros{i}"),
            ]
        found.update(df.agg(F.count("*").alias("rows"), *aggregates).first().asDict())
    measures = ["count", "min", "max", "mean", "stddev", "skewness", "kurtosis", "zeros"]
    return {
        c: {"rows": found["rows"], **{m: found[f"{m}{i}"] for m in measures}}
        for i, c in enumerate(names)
    }


def numeric_stats(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mean, median, mode and quartiles per numeric column (exact; mode ties: smallest)."""
    names = numeric_columns(df) if names is None else list(names)
    quartiles = exact_quantiles(df, names)
    rows = [(c, *[quartiles[c][p] for p in (0.25, 0.5, 0.75)]) for c in names]
    table = df.sparkSession.createDataFrame(
        rows, "column string, q1 double, median double, q3 double"
    )
    totals = column_totals(value_frequencies(df, names)).select(
        "column",
        F.col("total").alias("count"),
        "mean",
        F.col("top_number").alias("mode"),
        F.col("top_count").alias("mode_count"),
    )
    return table.join(F.broadcast(totals), "column", "left").select(
        "column",
        F.coalesce("count", F.lit(0)).alias("count"),
        *[F.round(c, 4).alias(c) for c in ("mean", "median", "mode", "q1", "q3")],
        "mode_count",
    )


#: Size of a quantile sketch, and the rank that its quantiles are off by at most (in 99 of 100).
SKETCH_SIZE, RANK_ERROR = 800, 0.01
#: Bits of a sketch of distinct values, and the share that its count is off by at most.
DISTINCT_BITS, DISTINCT_ERROR = 12, 0.05


def sketch_profile(
    df: DataFrame, names: Iterable[str] | None = None, by: str | None = None
) -> DataFrame:
    """``[part,] column, n, low, high, quantiles, distinct``: sketches of each column in one scan.

    The last two are sketches as binary values (``quantiles`` of numeric columns only). They
    stay small whatever the size of the table, and those of parts of a table (``by``, or
    tables of different days) add up by :func:`merge_sketches` without another scan.
    """
    names = scalar_columns(df) if names is None else list(names)
    rows = []
    for name in names:
        numeric = is_numeric(df.schema[name].dataType)
        none = F.lit(None)
        value = number(df, name) if numeric else None
        seen = as_text(df, name)
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(seen).alias("n"),
                (F.min(value) if numeric else none.cast("double")).alias("low"),
                (F.max(value) if numeric else none.cast("double")).alias("high"),
                (
                    F.kll_sketch_agg_double(value, SKETCH_SIZE)
                    if numeric
                    else none.cast("binary")
                ).alias("quantiles"),
                F.hll_sketch_agg(seen, DISTINCT_BITS).alias("distinct"),
            )
        )
    parts = [] if by is None else [column(by).alias("part")]
    found = df.groupBy(*parts).agg(F.array(*rows).alias("rows"))
    return found.select(*(["part"] if parts else []), F.inline("rows"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """``column, n, low, high, quantiles, distinct`` of all parts together."""
    return sketches.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.when(F.count("low") > 0, F.kll_merge_agg_double("quantiles")).alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def sketch_report(
    sketches: DataFrame, probabilities: Iterable[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """``column, n, low, high, num_unique`` and a column ``q<percent>`` per probability.

    A quantile's rank is off by :data:`RANK_ERROR` and ``num_unique`` by
    :data:`DISTINCT_ERROR` of itself, as a rule less.
    """
    return sketches.select(
        "column",
        "n",
        "low",
        "high",
        F.hll_sketch_estimate("distinct").alias("num_unique"),
        *[
            F.when(
                F.col("low").isNotNull(),
                F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))),
            ).alias(f"q{p * 100:g}".replace(".", "_"))
            for p in probabilities
        ],
    )


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column with counts, range, shape, quartiles and top value."""
    kinds = column_kinds(df)
    names = scalar_columns(df)
    numbers = [c for c in names if kinds[c] == "numeric"]
    stats = moments(df, numbers)
    quartiles = exact_quantiles(df, numbers)
    rows_in_table, missing = missing_counts(df.select(*map(column, names)))

    def rounded(value: float | None) -> float | None:
        return None if value is None or value != value else float(value)

    rows = []
    for c in names:
        s = stats.get(c, {})
        q = quartiles.get(c)
        rows.append(
            (
                c,
                kinds[c],
                rows_in_table - missing[c],
                missing[c],
                *[rounded(s.get(m)) for m in ("min", "max", "mean", "stddev")],
                *[rounded(q[p]) if q else None for p in (0.25, 0.5, 0.75)],
                s.get("zeros"),
                *[rounded(s.get(m)) for m in ("skewness", "kurtosis")],
            )
        )
    measured = ["min", "max", "mean", "stddev", "q1", "median", "q3"]
    table = df.sparkSession.createDataFrame(
        rows,
        "column string, kind string, count bigint, missing bigint, "
        + ", ".join(f"{m} double" for m in measured)
        + ", zeros bigint, skewness double, kurtosis double",
    )
    totals = column_totals(value_frequencies(df, names)).select(
        "column",
        F.col("distinct_values"),
        F.when(F.col("top_number").isNull(), F.col("top_value")).alias("top_text"),
        "top_number",
        "top_count",
    )
    return table.join(F.broadcast(totals), "column", "left").select(
        "column",
        "kind",
        "count",
        "missing",
        F.coalesce(F.col("distinct_values"), F.lit(0)).alias("distinct_values"),
        *[F.round(m, 4).alias(m) for m in measured],
        "zeros",
        *[F.round(m, 4).alias(m) for m in ("skewness", "kurtosis")],
        "top_text",
        F.round("top_number", 4).alias("top_number"),
        "top_count",
    )
