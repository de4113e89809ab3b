"""Fill a number from the rows that are closest in several features, exactly.

Donors are cut into cells, level by level: a cell with too many donors is cut at the
quantiles of its widest feature. The tree of cells with their boxes is a table;
nobody holds a list of cells. A row that asks goes down the tree to a
cell near it and finds its closest donors there; the distance of the last of them
bounds how far any better donor can be. Then it goes down again, into every cell whose
box lies within that bound, and meets the donors of the leaves it reaches, in
tiles of bounded size that give no more than the best few donors per row.

Quantiles come from sketches, which merge and stay small; they only decide how even
the cells are, not what is found. Donors that are equal in all features cannot be cut
apart and stay one cell, of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.columns import column, number, one_row
from tidewash.functions.scratch import drop_table, write_scratch
from tidewash.functions.tiles import meet

TILE = 2048
#: Cells that a cell is cut into.
FAN = 8
# Squared distances are compared to this many decimals, so that equal
# distances stay equal whatever the order of the additions.
DECIMALS = 9
SLACK = 1e-6
FOUND = "id {id}, donor {id}, distance double, value double"
#: Between the parts of a cell's path; not in a block, as JSON has no such character.
_MARK = "\x01"


def knn_features_fills(
    df: DataFrame,
    target: str,
    features: Iterable[str],
    key: str,
    k: int = 5,
    approved: bool = False,
    tile: int = TILE,
    block: str | None = None,
) -> DataFrame:
    """Fill table with the mean of the ``k`` donors closest in all ``features``.

    Features are scaled to mean zero and deviation one. Donors are the rows
    that have the target and all features, and agree in ``block`` if one is given (null
    agrees with null); rows that lack a feature or have no donor get no value. At
    equal distance the donor with the smaller key comes first.
    """
    features = list(features)
    id_type = df.schema[key].dataType.simpleString()
    scale = one_row(
        df,
        [
            e
            for i, c in enumerate(features)
            for e in (
                F.avg(number(df, c)).alias(f"m{i}"),
                F.stddev_pop(number(df, c)).alias(f"s{i}"),
            )
        ],
        fields=3,
    )
    scaled = [
        (number(df, c) - F.lit(scale[f"m{i}"])) / F.lit(scale[f"s{i}"] or 1.0)
        for i, c in enumerate(features)
    ]
    root = F.lit("") if block is None else F.to_json(F.struct(column(block)))
    rows = write_scratch(
        df.select(
            column(key).alias("id"),
            F.array(*scaled).alias("x"),
            number(df, target).alias("value"),
            root.alias("cell"),
        ).where(~F.exists("x", lambda x: x.isNull())),
        "features",
    )
    wide = len(features)
    donors = _in_cells(rows.where(F.col("value").isNotNull()), wide, tile)
    nodes = write_scratch(_nodes(donors, wide), "cells")
    depth = nodes.agg(F.max("depth")).first()[0]
    if depth is None:
        return _as_fills(rows.where("false").select("id", "value"), target, k, approved)
    members = donors.select("id", "x", "value", F.col("cell").alias("target"))
    asking = rows.where(F.col("value").isNull()).select("id", "x", "value", "cell")

    children = write_scratch(_children(nodes), "children")
    homes = write_scratch(_go_down(asking, nodes, children, depth, wide, k), "homes")
    leaves = nodes.where("leaf")
    under = leaves.select(
        F.explode(_ancestors(F.col("cell"))).alias("cell"), F.col("cell").alias("target")
    )
    near = _search(
        members,
        homes.join(under, "cell").select("id", "x", "value", "target"),
        k,
        tile,
        id_type,
    )
    first = write_scratch(_best(near, k), "nearest")
    last = first.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
    # Fewer than k were found only where the whole block has fewer; all of it was met then.
    bounded = homes.join(last.where(F.col("n") >= k), "id").select(
        "id",
        "x",
        "value",
        F.col("cell").alias("home"),
        F.col("root").alias("cell"),
        (F.sqrt("d") + SLACK).alias("bound"),
    )
    further = write_scratch(_within(bounded, children, depth, wide), "visits")
    more = _search(members, further, k, tile, id_type)
    both = _best(first.unionByName(more), k)
    means = both.groupBy("id").agg(F.avg("value").alias("value"))
    return _as_fills(means, target, k, approved)


def _as_fills(means: DataFrame, target: str, k: int, approved: bool) -> DataFrame:
    return means.select(
        F.col("id").alias("row_id"),
        F.lit(target).alias("column"),
        F.col("value").cast("string").alias("value"),
        F.lit(f"mean of the {k} closest rows by value").alias("reason"),
        F.lit(approved).alias("approved"),
    )


# ---- the tree -------------------------------------------------------------------


def _ends(wide: int) -> list[Column]:
    """The box of a group of rows: the lowest and highest value of every feature."""
    return [
        F.array(*[end(F.col("x")[f]) for f in range(wide)]).alias(name)
        for name, end in (("low", F.min), ("high", F.max))
    ]


def _in_cells(donors: DataFrame, wide: int, tile: int) -> DataFrame:
    """``donors`` in cells of about ``tile`` rows at most, stored.

    Every level is one count of the cells, one sketch of the widest feature of those
    that are too large, and one pass that puts their rows into the new cells.
    """
    stored = write_scratch(donors, "donors")
    count = stored.count()
    # A few levels more than even cuts would take; what is left then is mostly ties.
    levels = math.ceil(math.log(max(2.0, count / tile), FAN)) + wide if count > tile else 0
    probabilities = F.array(*[F.lit((i + 1) / FAN) for i in range(FAN - 1)])
    for _ in range(levels):
        boxes = stored.groupBy("cell").agg(F.count("*").alias("n"), *_ends(wide))
        spans = F.array(
            *[
                F.struct((F.col("high")[f] - F.col("low")[f]).alias("span"), F.lit(f).alias("f"))
                for f in range(wide)
            ]
        )
        large = (
            boxes.where(F.col("n") > tile)
            .withColumn("widest", F.array_max(spans))
            .where(F.col("widest.span") > 0)
            .select(
                "cell",
                F.col("widest.f").alias("f"),
                F.get("low", F.col("widest.f")).alias("least"),
                F.get("high", F.col("widest.f")).alias("most"),
            )
        )
        large = write_scratch(large, "large-cells")
        if large.isEmpty():
            break
        own = F.get("x", F.col("f"))
        cuts = (
            stored.join(large, "cell")
            .groupBy("cell", "f", "least", "most")
            .agg(F.percentile_approx(own, probabilities, F.lit(10_000)).alias("cuts"))
            .select(
                "cell",
                "f",
                # Where nearly all have the highest value, the lowest is cut off.
                F.array_distinct(
                    F.transform(
                        "cuts",
                        lambda c: F.when(c < F.col("most"), c).otherwise(F.col("least")),
                    )
                ).alias("cuts"),
            )
        )
        cuts = write_scratch(cuts, "cuts")
        child = F.size(F.filter("cuts", lambda c: c < own)).cast("string")
        cell = F.when(F.col("f").isNull(), F.col("cell")).otherwise(
            F.concat("cell", F.lit(_MARK), child)
        )
        moved = stored.join(cuts, "cell", "left").select(
            "id", "x", "value", cell.alias("cell")
        )
        before, stored = stored, write_scratch(moved, "donors")
        drop_table(before)
    return stored


def _ancestors(cell: Column) -> Column:
    """The paths of a cell and of all cells around it."""
    parts = F.split(cell, _MARK)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), _MARK)
    )


def _nodes(donors: DataFrame, wide: int) -> DataFrame:
    """``cell, parent, depth, leaf, n, low, high`` for every cell and all around it."""
    boxes = donors.groupBy("cell").agg(F.count("*").alias("n"), *_ends(wide))
    every = boxes.select(
        F.explode(_ancestors(F.col("cell"))).alias("node"), "cell", "n", "low", "high"
    )
    merged = every.groupBy("node").agg(
        F.sum("n").alias("n"),
        F.max(F.col("node") == F.col("cell")).alias("leaf"),
        F.array(*[F.min(F.col("low")[f]) for f in range(wide)]).alias("low"),
        F.array(*[F.max(F.col("high")[f]) for f in range(wide)]).alias("high"),
    )
    steps = F.size(F.split("node", _MARK)) - 1
    return merged.select(
        F.col("node").alias("cell"),
        F.when(steps > 0, F.element_at(_ancestors(F.col("node")), -2)).alias("parent"),
        steps.alias("depth"),
        "leaf",
        "n",
        "low",
        "high",
    )


def _away(wide: int, cell: Column) -> Column:
    """The squared distance of ``x`` from a cell's box."""
    gaps = [
        F.greatest(
            cell["low"][f] - F.col("x")[f], F.col("x")[f] - cell["high"][f], F.lit(0.0)
        )
        for f in range(wide)
    ]
    total = F.lit(0.0)
    for gap in gaps:
        total = total + gap * gap
    return total


def _children(nodes: DataFrame) -> DataFrame:
    """``cell, depth, children``: each cell that was cut, with what it was cut into.

    With at most ``FAN`` children in one array, rows choose among them where they are: they
    are not copied per child, sorted or shuffled.
    """
    child = F.struct(F.col("cell").alias("name"), "n", "low", "high")
    return (
        nodes.where(F.col("parent").isNotNull())
        .groupBy(F.col("parent").alias("cell"), (F.col("depth") - 1).alias("depth"))
        .agg(F.collect_list(child).alias("children"))
    )


def _at_depth(children: DataFrame, depth: int) -> DataFrame:
    return children.where(F.col("depth") == depth).select("cell", "children")


def _go_down(
    asking: DataFrame, nodes: DataFrame, children: DataFrame, depth: int, wide: int, k: int
) -> DataFrame:
    """Each row with a cell close to it (``cell``) that has ``k`` donors, as far as its block has.

    The row follows the closest cell of each level as long as that has enough donors.
    """
    at = asking.join(nodes.where("depth = 0").select("cell"), "cell", "left_semi").withColumn(
        "root", F.col("cell")
    )
    closest = F.array_min(
        F.transform(
            F.filter("children", lambda c: c["n"] >= k),
            lambda c: F.struct(_away(wide, c).alias("d"), c["name"].alias("name")),
        )
    )
    for level in range(depth):
        at = at.join(_at_depth(children, level), "cell", "left").select(
            "id", "x", "value", F.coalesce(closest["name"], "cell").alias("cell"), "root"
        )
    return at


def _within(bounded: DataFrame, children: DataFrame, depth: int, wide: int) -> DataFrame:
    """``id, x, value, target``: each row with all leaves within its bound but those it has met.

    A row that has reached a leaf stays there while others go further down.
    """
    reached = F.transform(
        F.filter("children", lambda c: _away(wide, c) <= F.col("bound") * F.col("bound")),
        lambda c: c["name"],
    )
    at = bounded
    for level in range(depth):
        at = at.join(_at_depth(children, level), "cell", "left").select(
            "id",
            "x",
            "value",
            "home",
            F.explode(F.coalesce(reached, F.array("cell"))).alias("cell"),
            "bound",
        )
    met = (F.col("cell") == F.col("home")) | F.col("cell").startswith(
        F.concat("home", F.lit(_MARK))
    )
    return at.where(~met).select("id", "x", "value", F.col("cell").alias("target"))


# ---- comparing ------------------------------------------------------------------


def _points(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        gap = a[:, f, None] - b[None, :, f]
        total += gap * gap
    return np.round(total, DECIMALS)


def _search(
    homes: DataFrame, visits: DataFrame, k: int, tile: int, id_type: str
) -> DataFrame:
    def compare(visit: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        home = home.sort_values("id")
        members, donors = _points(home["x"]), home["id"].to_numpy()
        values = home["value"].to_numpy()
        asked = visit["id"].to_numpy()
        points = _points(visit["x"])
        parts = []
        for start in range(0, len(points), 256):
            square = _squares(points[start : start + 256], members)
            # Stable, so equal distances keep the order of the keys.
            order = np.argsort(square, axis=1, kind="stable")[:, :k]
            parts.append(
                pd.DataFrame(
                    {
                        "id": np.repeat(asked[start : start + 256], order.shape[1]),
                        "donor": donors[order].ravel(),
                        "distance": np.take_along_axis(square, order, axis=1).ravel(),
                        "value": values[order].ravel(),
                    }
                )
            )
        return pd.concat(parts)

    return meet(homes, visits, compare, FOUND.format(id=id_type), tile)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` closest donors of every row; each task keeps only ``k`` per row."""
    return (
        found.selectExpr(
            "*", "row_number() over (partition by id order by distance, donor) as place"
        )
        .where(F.col("place") <= k)
        .drop("place")
    )
