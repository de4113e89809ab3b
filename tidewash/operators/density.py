"""Density clusters among the outliers of a column.

Clustering one dimension needs no pairwise distances: a value is a core point
if enough points lie within ``eps``, and because every distinct value holds at
least one point, looking at the next ``min_samples - 1`` distinct values on
either side decides it. A cluster is a run of core points whose gaps are at
most ``eps``. Equal values are combined first, and the sorted order is spread
over the cluster in slices.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.columns import number, numeric_columns, one_row
from tidewash.functions.frequencies import column_totals, value_frequencies
from tidewash.functions.ordered import Ordered
from tidewash.functions.quantiles import exact_quantiles
from tidewash.functions.scratch import write_scratch
from tidewash.operators.clean import percent
from tidewash.operators.outliers import IQR_FACTOR, Fences, iqr_fences

MIN_SAMPLES = 3
LEAST_EPS = 0.3


@dataclass(frozen=True)
class _Scale:
    count: int
    mean: float
    deviation: float
    eps: float


def _scales(
    df: DataFrame, fences: dict[str, Fences], eps: float | None, min_samples: int
) -> dict[str, _Scale]:
    """How to standardise the outliers of each column, and the radius to use."""
    outliers = {c: _outlier_value(df, c, f) for c, f in fences.items()}
    if not outliers:
        return {}
    names = list(outliers)
    spread = one_row(
        df,
        [
            e
            for i, c in enumerate(names)
            for e in (
                F.count(outliers[c]).alias(f"n{i}"),
                F.avg(outliers[c]).alias(f"m{i}"),
                F.stddev_pop(outliers[c]).alias(f"s{i}"),
            )
        ],
        fields=2,
    )
    enough = {c: i for i, c in enumerate(names) if spread[f"n{i}"] >= min_samples}
    if eps is None and enough:
        quartiles = exact_quantiles(df, {c: outliers[c] for c in enough}, (0.25, 0.75))
    scales = {}
    for c, i in enough.items():
        radius = eps
        if radius is None:
            width = quartiles[c][0.75] - quartiles[c][0.25]
            radius = max(LEAST_EPS, 0.5 * width / (fences[c].iqr if fences[c].iqr > 0 else 1))
        scales[c] = _Scale(spread[f"n{i}"], spread[f"m{i}"], spread[f"s{i}"] or 1.0, radius)
    return scales


def _outlier_value(df: DataFrame, name: str, fences: Fences) -> Column:
    value = number(df, name)
    return F.when(fences.is_outlier(value), value)


def outlier_clusters(
    df: DataFrame,
    names: Iterable[str] | None = None,
    eps: float | None = None,
    min_samples: int = MIN_SAMPLES,
    factor: float = IQR_FACTOR,
    slices: int | None = None,
    fences: dict[str, Fences] | None = None,
) -> DataFrame | None:
    """``column, value, n, core, cluster`` for every distinct outlier value.

    ``cluster`` counts from 0 upwards by value and is null for noise. A value
    near two clusters goes to the nearer one, on a tie to the lower one.
    Columns with fewer than ``min_samples`` outliers are left out; None when
    no column is left. ``fences`` spares working them out again.
    """
    names = numeric_columns(df) if names is None else list(names)
    if fences is None:
        fences = iqr_fences(df, names, factor)
    scales = _scales(df, fences, eps, min_samples)
    if not scales:
        return None
    # Emit only outliers, and combine equal values before the shuffle.
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                _outlier_value(df, c, fences[c]).alias("value"),
                ((_outlier_value(df, c, fences[c]) - F.lit(s.mean)) / F.lit(s.deviation)).alias("z"),
                F.lit(s.eps).alias("eps"),
            )
            for c, s in scales.items()
        ]
    )
    points = (
        df.select(F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("e"))
        .select("e.*")
        .groupBy("column", "value", "z", "eps")
        .agg(F.count("*").alias("n"))
    )
    near = min_samples - 1
    ordered = Ordered(points, by=["z", "value"], group=["column"], slices=slices)
    point = F.struct("z", "n")
    if near:
        ordered = ordered.nearest(point, near, before="_before", after="_after")
        z, radius = F.col("z"), F.col("eps")
        left = F.aggregate(
            "_before",
            F.lit(0).cast("bigint"),
            lambda total, p: total + F.when(z - p["z"] <= radius, p["n"]).otherwise(0),
        )
        right = F.aggregate(
            "_after",
            F.lit(0).cast("bigint"),
            lambda total, p: total + F.when(p["z"] - z <= radius, p["n"]).otherwise(0),
        )
        core = F.col("n") + left + right >= min_samples
    else:
        core = F.lit(True)
    cored = ordered._with(
        ordered.rows.withColumn("core", core).drop("_before", "_after")
    ).written()

    core_z = F.when(F.col("core"), F.col("z"))
    linked = cored.nearest(core_z, 1, before="_below", after="_above")
    below, above = F.get("_below", F.lit(0)), F.get("_above", F.lit(0))
    gap_below, gap_above = F.col("z") - below, above - F.col("z")
    starts = F.col("core") & F.coalesce(gap_below > F.col("eps"), F.lit(True))
    marked = linked._with(
        linked.rows.withColumn("_start", starts.cast("bigint"))
        .withColumn("_gap_below", gap_below)
        .withColumn("_gap_above", gap_above)
        .drop("_below", "_above")
    ).written()
    summed = marked.running_sums({"_started": F.col("_start")}).result()
    joins_below = F.coalesce(F.col("_gap_below") <= F.col("eps"), F.lit(False))
    joins_above = F.coalesce(F.col("_gap_above") <= F.col("eps"), F.lit(False))
    nearer_above = joins_above & (~joins_below | (F.col("_gap_above") < F.col("_gap_below")))
    # Between two core points more than eps apart, the next one starts a new
    # cluster; otherwise both belong to the running one.
    one_run = F.col("_gap_below") + F.col("_gap_above") <= F.col("eps")
    cluster = (
        F.when(F.col("core"), F.col("_started") - 1)
        .when(nearer_above & ~F.coalesce(one_run, F.lit(False)), F.col("_started"))
        .when(joins_below | joins_above, F.col("_started") - 1)
    )
    return summed.select("column", "value", "n", "core", cluster.alias("cluster"))


def with_density(
    records: DataFrame,
    df: DataFrame,
    name: str,
    eps: float | None = None,
    min_samples: int = MIN_SAMPLES,
    factor: float = IQR_FACTOR,
) -> DataFrame:
    """Outlier records of one column with their ``cluster``, and whether they are ``noise``.

    A column with too few outliers has no clusters and no noise. The clusters have one
    row per distinct outlier value, which the records are looked up in; ``noise`` serves as
    the rule of :func:`tidewash.operators.decisions.decide_by_rule`.
    """
    clusters = outlier_clusters(df, [name], eps, min_samples, factor)
    if clusters is None:
        none = F.lit(None).cast("bigint")
        return records.withColumn("cluster", none).withColumn("noise", F.lit(False))
    stored = write_scratch(
        clusters.select(F.col("value").alias("_value"), "cluster", F.lit(True).alias("_known")),
        "clusters",
    )
    joined = records.join(stored, F.col("value") == F.col("_value"), "left")
    noise = F.coalesce(F.col("_known"), F.lit(False)) & F.col("cluster").isNull()
    return joined.withColumn("noise", noise).drop("_value", "_known")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Points per cluster."""
    return (
        clusters.where(F.col("cluster").isNotNull())
        .groupBy("column", "cluster")
        .agg(F.sum("n").alias("points"))
    )


CLUSTER_REPORT = (
    "column string, n_clusters bigint, noise_points bigint, noise_pct double, core_points bigint"
)


def density_report(clusters: DataFrame) -> DataFrame:
    """Clusters, noise and core points per column."""
    noise = F.coalesce(F.sum(F.when(F.col("cluster").isNull(), F.col("n"))), F.lit(0))
    return clusters.groupBy("column").agg(
        F.count_distinct("cluster").alias("n_clusters"),
        noise.alias("noise_points"),
        percent(noise, F.sum("n")).alias("noise_pct"),
        F.coalesce(F.sum(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("core_points"),
    )


def numeric_outlier_report(
    df: DataFrame,
    names: Iterable[str] | None = None,
    factor: float = IQR_FACTOR,
    min_samples: int = MIN_SAMPLES,
    eps: float | None = None,
) -> DataFrame:
    """Location, fences, outliers (as a share of the non-null values) and clusters.

    Columns without any value are left out.
    """
    names = numeric_columns(df) if names is None else list(names)
    fences = iqr_fences(df, names, factor)
    shown = list(fences)
    spark = df.sparkSession
    measured = one_row(
        df,
        [
            e
            for i, c in enumerate(shown)
            for e in (
                F.avg(number(df, c)).alias(f"mean{i}"),
                F.count_if(fences[c].is_outlier(number(df, c))).alias(f"n{i}"),
            )
        ],
        fields=2,
    )
    rows = [
        (
            c,
            measured[f"mean{i}"],
            f.q1,
            f.q3,
            f.iqr,
            f.lower,
            f.upper,
            f.count,
            measured[f"n{i}"],
        )
        for i, (c, f) in enumerate(fences.items())
    ]
    numbers = ["mean", "q1", "q3", "iqr", "lower_fence", "upper_fence"]
    table = spark.createDataFrame(
        rows,
        "column string, "
        + ", ".join(f"{c} double" for c in numbers)
        + ", n_total bigint, n_outliers bigint",
    )
    modes = column_totals(value_frequencies(df, shown)).select(
        "column", F.col("top_number").alias("mode")
    ) if shown else spark.createDataFrame([], "column string, mode double")
    clusters = outlier_clusters(df, shown, eps, min_samples, factor, fences=fences)
    density = (
        density_report(clusters)
        if clusters is not None
        else spark.createDataFrame([], CLUSTER_REPORT)
    )
    # Every report has one row per column.
    return (
        table.join(F.broadcast(modes), "column", "left")
        .join(F.broadcast(density), "column", "left")
        .select(
            "column",
            *[F.round(c, 4).alias(c) for c in [*numbers, "mode"]],
            "n_total",
            "n_outliers",
            percent(F.col("n_outliers"), F.col("n_total")).alias("outlier_pct"),
            "n_clusters",
            "noise_points",
            "noise_pct",
        )
    )
