"""Which cells are missing, and which other columns explain it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.columns import (
    chunks,
    column,
    is_numeric,
    number,
    scalar_columns,
)
from tidewash.functions.frequencies import value_frequencies
from tidewash.functions.ordered import Ordered
from tidewash.functions.pvalues import chi2_p_column, mann_whitney_p_column
from tidewash.functions.scratch import write_scratch
from tidewash.operators.profile import missing_counts

FEW_VALUES = 10
SIGNIFICANT = 0.05
LEAST_SAMPLE = 3
# Buffer fields that the widest aggregate needs for one target.
FIELDS_PER_TARGET = 9
#: Targets whose gaps fit one whole number.
PATTERN_BITS = 62

# The columns of the report.
PROFILE_SCHEMA = (
    "target string, column string, type string, "
    "dominant_val_missing string, dominant_pct_missing double, "
    "dominant_val_present string, dominant_pct_present double, "
    "mean_when_missing double, median_when_missing double, mean_when_present double, "
    "direction string, statistic double, dof bigint, raw_p double"
)


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a numeric column."""
    if is_numeric(df.schema[name].dataType):
        return number(df, name).isNull()
    return column(name).isNull()


def columns_with_gaps(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Columns with any missing value, without the excluded ones."""
    skip = set(exclude)
    _, missing = missing_counts(df)
    return [c for c in df.columns if missing[c] and c not in skip]


def null_patterns(df: DataFrame) -> DataFrame:
    """How often each combination of missing columns occurs.

    ``pattern`` lists the missing columns in table order; the empty pattern
    counts the complete rows.
    """
    flags = [F.when(is_missing(df, c), F.lit(c)) for c in df.columns]
    return (
        df.select(F.concat_ws(",", *flags).alias("pattern"))
        .groupBy("pattern")
        .agg(F.count("*").alias("rows"))
    )


def null_rate_by_range(df: DataFrame, key: str, buckets: int = 20) -> DataFrame:
    """Share of missing cells per column along ``key``, in ``buckets`` equal ranges.

    The table form of a picture of all cells: rows run along the numeric key.
    """
    ends = df.agg(F.min(number(df, key)).alias("low"), F.max(number(df, key)).alias("high")).first()
    names = [c for c in df.columns if c != key]
    schema = "bucket bigint, column string, rows bigint, missing bigint, missing_pct double"
    if ends["low"] is None:
        return df.sparkSession.createDataFrame([], schema)
    width = (ends["high"] - ends["low"]) / buckets or 1.0
    place = F.floor((number(df, key) - F.lit(ends["low"])) / F.lit(width))
    grouped = (
        df.where(number(df, key).isNotNull())
        .groupBy(F.least(place, F.lit(buckets - 1)).cast("bigint").alias("bucket"))
        .agg(
            F.count("*").alias("rows"),
            *[F.count_if(is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(names)],
        )
    )
    parts = [x for i, c in enumerate(names) for x in (F.lit(c), F.col(f"c{i}"))]
    long = grouped.select(
        "bucket", "rows", F.stack(F.lit(len(names)), *parts).alias("column", "missing")
    )
    return long.select(
        "bucket",
        "column",
        "rows",
        "missing",
        F.round(F.col("missing") / F.col("rows") * 100, 2).alias("missing_pct"),
    )


def missingness_profile(
    df: DataFrame,
    targets: Iterable[str] | None = None,
    exclude: Iterable[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Compare the rows where a target is missing with the rows where it is present.

    One row per target and other column. Columns that are not numbers, or hold
    at most ten distinct values, are compared by their most frequent value and
    a chi-squared test; other numeric columns by mean, median and the
    Mann-Whitney test. Columns without any value, and numeric columns with
    fewer than three values on either side, are left out. ``statistic`` is
    chi-squared or U of the missing rows.

    All targets and columns share one table of value counts, which is combined
    before its shuffle; the ranks come from one sort of the distinct values. With many
    targets the values are counted once for every combination of missing targets, and these
    counts are added up for some targets at a time: the table itself is read once.
    """
    targets = columns_with_gaps(df, exclude) if targets is None else list(targets)
    others = scalar_columns(df)
    spark = df.sparkSession
    groups = list(chunks(targets, FIELDS_PER_TARGET))
    if len(groups) > 1:
        patterns = write_scratch(
            value_frequencies(df, others, by=missing_patterns(df, targets)), "patterns"
        )
        counts = [_per_pattern(patterns, targets, some) for some in groups]
    else:
        flags = [{f"m{i}": is_missing(df, t) for i, t in enumerate(some)} for some in groups]
        counts = [value_frequencies(df, others, some) for some in flags]
    parts = [
        _profile_targets(df, write_scratch(freq, "values"), some, slices)
        for freq, some in zip(counts, groups, strict=True)
    ]
    if not parts:
        return _with_significance(spark.createDataFrame([], PROFILE_SCHEMA))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return _with_significance(report)


def _with_significance(report: DataFrame) -> DataFrame:
    return report.withColumn("p_value", F.round("raw_p", 4)).withColumn(
        "significant", F.col("raw_p") < SIGNIFICANT
    )


def missing_patterns(df: DataFrame, targets: list[str]) -> dict[str, Column]:
    """Which targets a row lacks, as the bits of whole numbers."""
    patterns = {}
    for at in range(0, len(targets), PATTERN_BITS):
        bits = F.lit(0).cast("bigint")
        for i, target in enumerate(targets[at : at + PATTERN_BITS]):
            bit = F.lit(1 << i).cast("bigint")
            bits = bits + F.when(is_missing(df, target), bit).otherwise(F.lit(0).cast("bigint"))
        patterns[f"_pattern{at // PATTERN_BITS}"] = bits
    return patterns


def _per_pattern(patterns: DataFrame, targets: list[str], some: list[str]) -> DataFrame:
    """The counts for some of the targets, from those for every pattern."""
    sums = []
    for i, target in enumerate(some):
        word, bit = divmod(targets.index(target), PATTERN_BITS)
        missing = F.col(f"_pattern{word}").bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0
        sums.append(F.sum(F.when(missing, F.col("n")).otherwise(F.lit(0))).alias(f"m{i}"))
    return patterns.groupBy("column", "value", "number").agg(F.sum("n").alias("n"), *sums)


def _profile_targets(
    df: DataFrame, freq: DataFrame, targets: list[str], slices: int | None
) -> DataFrame:
    flags = [f"m{i}" for i in range(len(targets))]
    # Column facts: as many rows as the table has columns.
    totals = freq.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("distinct_values"),
        *[F.sum(m).alias(f"total_{m}") for m in flags],
    )
    by_numbers = {
        r["column"]
        for r in totals.where(F.col("distinct_values") > FEW_VALUES).select("column").collect()
        if is_numeric(df.schema[r["column"]].dataType, "predicate")
    }
    categorical = freq.where(~F.col("column").isin(*by_numbers)) if by_numbers else freq
    reports = [_chi2_rows(categorical, totals, targets)]
    if by_numbers:
        numeric = freq.where(F.col("column").isin(*by_numbers))
        reports.append(_rank_rows(numeric, targets, slices))
    report = reports[0]
    for more in reports[1:]:
        report = report.unionByName(more)
    return report.where(F.col("target") != F.col("column"))


def _per_target(wide: DataFrame, targets: list[str], fields: list[str]) -> DataFrame:
    """Turn ``field_i`` columns into one row per target ``i``."""
    parts = [
        x
        for i, target in enumerate(targets)
        for x in (F.lit(target), *[F.col(f"{field}_{i}") for field in fields])
    ]
    return wide.select(
        "column", F.stack(F.lit(len(targets)), *parts).alias("target", *fields)
    )


def _chi2_rows(freq: DataFrame, totals: DataFrame, targets: list[str]) -> DataFrame:
    joined = freq.join(F.broadcast(totals), "column")
    aggregates = []
    n, total = F.col("n"), F.col("total")
    for i in range(len(targets)):
        m, all_m = F.col(f"m{i}"), F.col(f"total_m{i}")
        all_p = total - all_m
        one_dof = (F.col("distinct_values") == 2) & (all_m > 0) & (all_p > 0)
        terms = F.lit(0.0)
        for seen, side in ((m, all_m), (n - m, all_p)):
            expected = n * side / total
            gap = F.abs(seen - expected)
            # With one degree of freedom the gap is moved half a unit towards zero.
            gap = gap - F.when(one_dof, F.least(F.lit(0.5), gap)).otherwise(F.lit(0.0))
            terms = terms + F.coalesce(F.try_divide(gap * gap, expected), F.lit(0.0))
        first_m = F.min(
            F.when(m > 0, F.struct((-m).alias("m"), F.col("number").alias("x"), "value"))
        )
        first_p = F.min(
            F.when(n - m > 0, F.struct((m - n).alias("m"), F.col("number").alias("x"), "value"))
        )
        both = (F.max(all_m) > 0) & (F.max(all_p) > 0)
        aggregates += [
            F.sum(terms).alias(f"chi2_{i}"),
            F.when(both, F.max("distinct_values") - 1)
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias(f"dof_{i}"),
            first_m.alias(f"first_m_{i}"),
            first_p.alias(f"first_p_{i}"),
            F.max(all_m).alias(f"all_m_{i}"),
            F.max(all_p).alias(f"all_p_{i}"),
        ]
    wide = joined.groupBy("column").agg(*aggregates)
    long = _per_target(
        wide, targets, ["chi2", "dof", "first_m", "first_p", "all_m", "all_p"]
    )
    none = F.lit(None)
    statistic = F.when(F.col("dof") > 0, F.col("chi2")).otherwise(F.lit(0.0))

    def share(first: str, side: str) -> Column:
        pct = F.try_divide(-F.col(f"{first}.m"), F.col(side)) * 100
        return F.round(F.coalesce(pct, F.lit(0.0)), 2)

    return long.select(
        "target",
        "column",
        F.lit("categorical").alias("type"),
        F.col("first_m.value").alias("dominant_val_missing"),
        share("first_m", "all_m").alias("dominant_pct_missing"),
        F.col("first_p.value").alias("dominant_val_present"),
        share("first_p", "all_p").alias("dominant_pct_present"),
        none.cast("double").alias("mean_when_missing"),
        none.cast("double").alias("median_when_missing"),
        none.cast("double").alias("mean_when_present"),
        none.cast("string").alias("direction"),
        statistic.alias("statistic"),
        "dof",
        chi2_p_column(statistic, F.col("dof").cast("double")).alias("raw_p"),
    )


def _rank_rows(freq: DataFrame, targets: list[str], slices: int | None) -> DataFrame:
    counts = ["n"] + [f"m{i}" for i in range(len(targets))]
    ordered = Ordered(freq, by=["number", "value"], group=["column"], slices=slices)
    summed = ordered.running_sums({f"upto_{c}": F.col(c) for c in counts}).result()
    totals = freq.groupBy("column").agg(*[F.sum(c).alias(f"total_{c}") for c in counts])
    ranked = summed.join(F.broadcast(totals), "column").withColumn(
        # Equal values share the average of the ranks they fill.
        "rank",
        F.col("upto_n") - F.col("n") + (F.col("n") + 1) / 2,
    )
    aggregates = []
    x, n = F.col("number"), F.col("n").cast("double")
    for i in range(len(targets)):
        m, upto, total = F.col(f"m{i}"), F.col(f"upto_m{i}"), F.col(f"total_m{i}")
        lower, upper = F.floor((total - 1) / 2), F.floor(total / 2)
        aggregates += [
            F.sum(m * F.col("rank")).alias(f"rank_sum_{i}"),
            F.max(total).alias(f"n1_{i}"),
            F.max(F.col("total_n") - total).alias(f"n2_{i}"),
            F.sum(m * x).alias(f"sum1_{i}"),
            F.sum((F.col("n") - m) * x).alias(f"sum2_{i}"),
            F.max(F.when((upto - m <= lower) & (lower < upto), x)).alias(f"low_{i}"),
            F.max(F.when((upto - m <= upper) & (upper < upto), x)).alias(f"high_{i}"),
            F.sum(n * n * n - n).alias(f"ties_{i}"),
        ]
    wide = ranked.groupBy("column").agg(*aggregates)
    fields = ["rank_sum", "n1", "n2", "sum1", "sum2", "low", "high", "ties"]
    long = _per_target(wide, targets, fields).where(
        (F.col("n1") >= LEAST_SAMPLE) & (F.col("n2") >= LEAST_SAMPLE)
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    mean1, mean2 = F.col("sum1") / n1, F.col("sum2") / n2
    none = F.lit(None)
    return long.select(
        "target",
        "column",
        F.lit("numerical").alias("type"),
        none.cast("string").alias("dominant_val_missing"),
        none.cast("double").alias("dominant_pct_missing"),
        none.cast("string").alias("dominant_val_present"),
        none.cast("double").alias("dominant_pct_present"),
        F.round(mean1, 2).alias("mean_when_missing"),
        F.round((F.col("low") + F.col("high")) / 2, 2).alias("median_when_missing"),
        F.round(mean2, 2).alias("mean_when_present"),
        F.when(mean1 > mean2, F.lit("higher")).otherwise(F.lit("lower")).alias("direction"),
        u.alias("statistic"),
        none.cast("bigint").alias("dof"),
        mann_whitney_p_column(u, n1, n2, F.col("ties")).alias("raw_p"),
    )


def missingness_drivers(profile: DataFrame, min_signals: int = 1) -> DataFrame:
    """The significant columns per target, strongest first, with the target's totals.

    Targets with fewer than ``min_signals`` significant columns are left out.
    The input has one row per pair of columns.
    """
    totals = profile.groupBy("target").agg(
        F.count_if("significant").alias("significant_drivers"),
        F.count("*").alias("total_tested"),
    )
    ratio = F.round(F.col("significant_drivers") / F.col("total_tested"), 3)
    kept = totals.where(F.col("significant_drivers") >= min_signals).withColumn(
        "signal_ratio", ratio
    )
    return (
        profile.where("significant")
        .selectExpr(
            "*", "row_number() over (partition by target order by p_value, column) as place"
        )
        .drop("significant", "raw_p")
        .join(F.broadcast(kept), "target")
    )
