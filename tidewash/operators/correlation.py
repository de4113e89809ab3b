"""Pearson correlation between columns, and feature sets chosen by it."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewash.functions.columns import chunks, number, numeric_columns
from tidewash.functions.pvalues import correlation_p


# Beyond this many scans with compiled aggregates, one pass with a matrix
# product over all columns is cheaper.
MOST_SCANS = 2
# A variance this small beside the squared offset is rounding, not variation.
ROUNDING = 1e-12


def _pair_values(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple, tuple]:
    """``(r, n)`` for each pair, over the rows where both values are present.

    A constant column has no correlation. A few pairs are aggregated as
    covariances; many columns, or columns with gaps, go through one pass that
    adds up products of whole column blocks.
    """
    names = sorted({c for pair in pairs for c in pair})
    single: dict = {}
    for part in chunks(list(enumerate(names)), 6):
        aggregates = [F.count("*").alias("rows")]
        for i, c in part:
            x = number(df, c)
            aggregates += [
                F.count(x).alias(f"n{i}"),
                F.avg(x).alias(f"m{i}"),
                F.var_pop(x).alias(f"v{i}"),
            ]
        single.update(df.agg(*aggregates).first().asDict())
    place = {c: i for i, c in enumerate(names)}
    gaps = any(single[f"n{i}"] < single["rows"] for i in place.values())
    parts = chunks(pairs, 4)
    if gaps or len(parts) > MOST_SCANS:
        return _pair_products(df, names, pairs, [single[f"m{i}"] for i in place.values()])

    found = {}
    for part in parts:
        row = df.agg(
            *[
                F.covar_pop(number(df, a), number(df, b)).alias(f"c{i}")
                for i, (a, b) in enumerate(part)
            ]
        ).first()
        for i, (a, b) in enumerate(part):
            n = single["rows"]
            vx, vy = single[f"v{place[a]}"], single[f"v{place[b]}"]
            found[(a, b)] = (_bounded(row[f"c{i}"], vx, vy) if n > 1 else None, n)
    return found


def _bounded(shared: float, vx: float, vy: float) -> float | None:
    if not vx or not vy:
        return None
    return min(1.0, max(-1.0, shared / math.sqrt(vx) / math.sqrt(vy)))


def _pair_products(
    df: DataFrame, names: list[str], pairs: list[tuple[str, str]], means: list[float | None]
) -> dict[tuple, tuple]:
    """Pairwise complete correlations from sums of products, in one pass.

    Every task adds up four matrices as wide as the number of columns; only
    these are shuffled. Values are taken relative to their mean, which keeps
    the sums accurate.
    """
    size = len(names)
    offset = np.array([m or 0.0 for m in means])
    values = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(names)])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, size, size))
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64) - offset
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            there = seen.astype(np.float64)
            total[0] += there.T @ there
            total[1] += x.T @ there
            total[2] += (x * x).T @ there
            total[3] += x.T @ x
        yield pd.DataFrame(
            {"place": np.arange(total.size, dtype=np.int32), "total": total.ravel()}
        )

    # Four numbers per pair of columns, however many rows there are.
    summed = (
        values.mapInPandas(products, "place int, total double")
        .groupBy("place")
        .agg(F.sum("total").alias("total"))
        .orderBy("place")
        .toPandas()["total"]
        .to_numpy()
    )
    if not len(summed):
        return {pair: (None, 0) for pair in pairs}
    counts, sums, squares, shared = summed.reshape(4, size, size)
    found = {}
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        n = counts[i, j]
        r = None
        if n > 1:
            spread = []
            for p, q in ((i, j), (j, i)):
                variance = squares[p, q] / n - (sums[p, q] / n) ** 2
                spread.append(variance if variance > ROUNDING * squares[p, q] / n else 0.0)
            covariance = shared[i, j] / n - sums[i, j] / n * sums[j, i] / n
            r = _bounded(covariance, *spread)
        found[(a, b)] = (None if r is None else float(r), int(n))
    return found


def pearson_matrix(
    df: DataFrame, names: Iterable[str] | None = None, rule: str = "wide"
) -> DataFrame:
    """``x, y, r, n`` for every ordered pair of different numeric columns."""
    names = numeric_columns(df, rule) if names is None else list(names)
    found = _pair_values(df, list(combinations(names, 2)))
    rows = [
        (*ends, r, n) for (a, b), (r, n) in found.items() for ends in ((a, b), (b, a))
    ]
    # As many rows as the square of the number of columns.
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double, n bigint")


def top_correlated(
    df: DataFrame,
    targets: Iterable[str] | None = None,
    k: int = 5,
    rule: str = "wide",
) -> DataFrame:
    """The ``k`` columns with the largest absolute correlation to each target.

    Columns without a correlation come last; ties go to the smaller name.
    """
    names = numeric_columns(df, rule)
    targets = names if targets is None else list(targets)
    pairs = [p for p in combinations(names, 2) if set(p) & set(targets)]
    found = _pair_values(df, pairs)
    rows = []
    for target in targets:
        others = []
        for name in names:
            if name != target:
                r, _ = found.get((target, name)) or found[(name, target)]
                others.append((r is None, -abs(r or 0.0), name, r))
        for place, (_, _, name, r) in enumerate(sorted(others)[:k], start=1):
            rows.append((target, place, name, r))
    return df.sparkSession.createDataFrame(
        rows, "target string, place int, column string, r double"
    )


def pearson_ranking(
    df: DataFrame, target: str, rule: str = "wide", complete_pairs: bool = False
) -> DataFrame:
    """Correlation of every other numeric column with ``target``, strongest first.

    ``p_value`` is two-sided. A column with missing values gets no result
    unless ``complete_pairs`` allows leaving the incomplete rows out.
    """
    names = numeric_columns(df, rule)
    if target not in names:
        raise ValueError(f"{target!r} is not a numeric column")
    others = [c for c in names if c != target]
    found = _pair_values(df, [(c, target) for c in others])
    total = df.count()
    rows = []
    for c in others:
        r, n = found[(c, target)]
        if n < total and not complete_pairs:
            r = None
        p = None if r is None else round(correlation_p(r, n), 4)
        rows.append((c, r, p, n))
    return df.sparkSession.createDataFrame(
        rows, "column string, r double, p_value double, n bigint"
    ).orderBy(F.abs("r").desc_nulls_last(), "column")


def feature_sets(
    df: DataFrame, target: str, sizes: Iterable[int] = (3, 5, 10), rule: str = "wide"
) -> DataFrame:
    """Nested sets of the columns most correlated with ``target``, one row per set."""
    ranked = [r["column"] for r in pearson_ranking(df, target, rule).collect() if r["r"] is not None]
    rows = [
        (f"feature_set_{i}", min(size, len(ranked)), ",".join(ranked[:size]))
        for i, size in enumerate(sorted(sizes), start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "feature_set string, features int, columns string"
    )
