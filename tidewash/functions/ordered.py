"""Running sums and nearest values over a whole table in order.

A window without ``partitionBy`` puts every row into one task. Here the rows
are range-partitioned on a unique key into slices and written once; windows
run inside the slices, and what a slice needs from the slices before or after
it (a total, or a few values) is carried over in a table with one row per
slice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewash.functions.columns import quoted
from tidewash.functions.scratch import drop_table, write_scratch

SLICE = "_slice"
ROWS_PER_SLICE = 1_000_000
# Spark samples at most a million rows to find the borders of the slices: with no
# more slices than this at least fifty for each, so slices stay even.
MOST_SLICES = 20_000


class Ordered:
    """A table in the order of ``by``, separately within each ``group``.

    ``by`` must identify a row within its group, so that no slice can hold
    more than its share. Methods add columns and return a new ``Ordered``.
    """

    def __init__(
        self,
        df: DataFrame,
        by: list[str],
        group: list[str] | None = None,
        slices: int | None = None,
    ):
        self.by = list(by)
        self.group = list(group or [])
        keys = [F.col(quoted(c)) for c in self.group + self.by]
        # Written first: the rows are counted, sampled and dealt out, and what
        # they come from is worked out once.
        stored = write_scratch(df, "unordered")
        # The number of slices follows the table, so that a slice has the same
        # size at any scale and setting; a very large table has larger slices.
        wanted = math.ceil(stored.count() / ROWS_PER_SLICE) or 1
        spread = stored.repartitionByRange(slices or min(wanted, MOST_SLICES), *keys)
        self.rows = write_scratch(
            spread.withColumn(SLICE, F.spark_partition_id()), "ordered"
        )
        drop_table(stored)
        # Slices follow the order, so each border between two slices cuts at
        # most one group: this holds at most two entries per slice, however
        # many groups there are.
        parts = self.rows.select(SLICE, *map(quoted, self.group)).distinct()
        cut = (
            parts.groupBy(*map(quoted, self.group))
            .agg(F.sort_array(F.collect_list(SLICE)).alias(SLICE))
            .where(F.size(SLICE) > 1)
            .collect()
        )
        self._cut = {tuple(r[g] for g in self.group): r[SLICE] for r in cut}

    def _with(self, rows: DataFrame) -> "Ordered":
        other = object.__new__(Ordered)
        other.__dict__ = {**self.__dict__, "rows": rows}
        return other

    def written(self) -> "Ordered":
        """The same table with the added columns stored, to be read many times."""
        return self._with(write_scratch(self.rows, "ordered"))

    def result(self) -> DataFrame:
        return self.rows.drop(SLICE)

    @property
    def has_cut_groups(self) -> bool:
        """Whether any group reaches over more than one slice."""
        return bool(self._cut)

    def _cut_rows(self, rows: DataFrame) -> DataFrame:
        """Only the rows of groups that reach over more than one slice."""
        if not self.group:
            return rows
        schema = T.StructType([rows.schema[g] for g in self.group])
        table = rows.sparkSession.createDataFrame(list(self._cut), schema)
        return rows.join(F.broadcast(table), self.group, "left_semi")

    def _over(self) -> str:
        part = ", ".join(map(quoted, [SLICE, *self.group]))
        order = ", ".join(map(quoted, self.by))
        return f"partition by {part} order by {order}"

    def running_sums(self, sums: dict[str, Column]) -> "Ordered":
        """Inclusive running sums within the group, one column per entry."""
        rows = self.rows.withColumns(sums)
        frame = "rows between unbounded preceding and current row"
        summed = rows.withColumns(
            {
                name: F.expr(f"sum({quoted(name)}) over ({self._over()} {frame})")
                for name in sums
            }
        )
        if not self._cut:
            return self._with(summed)
        totals = (
            self._cut_rows(rows)
            .groupBy(SLICE, *map(quoted, self.group))
            .agg(*[F.sum(quoted(name)).alias(name) for name in sums])
            .collect()
        )
        before: dict[tuple, list] = {}
        carried = []
        for r in sorted(totals, key=lambda r: r[SLICE]):
            key = tuple(r[g] for g in self.group)
            so_far = before.get(key, [None] * len(sums))
            carried.append((r[SLICE], *key, *so_far))
            before[key] = [
                (a or 0) + (r[name] or 0) for a, name in zip(so_far, sums, strict=True)
            ]
        fields = [(f"_carry{i}", rows.schema[name].dataType) for i, name in enumerate(sums)]
        joined = self._join_carried(summed, carried, fields)
        added = joined.withColumns(
            {
                name: F.col(quoted(name))
                + F.coalesce(F.col(f"_carry{i}"), F.lit(0)).cast(rows.schema[name].dataType)
                for i, name in enumerate(sums)
            }
        )
        return self._with(added.drop(*[name for name, _ in fields]))

    def nearest(
        self, value: Column, count: int, before: str | None = None, after: str | None = None
    ) -> "Ordered":
        """Arrays of the nearest ``count`` non-null ``value`` on either side.

        ``before`` and ``after`` name the arrays; each starts at the row and
        moves away from it. The row's own value is not part of them.
        """
        rows = self.rows.withColumn("_value", value)
        sides = [(before, "lag", -1), (after, "lead", 1)]
        sides = [s for s in sides if s[0]]
        added = rows
        for name, function, _ in sides:
            picks = [
                F.expr(f"{function}(_value, {k}) ignore nulls over ({self._over()})")
                for k in range(1, count + 1)
            ]
            added = added.withColumn(name, F.array_compact(F.array(*picks)))
        if self._cut:
            for name, _, direction in sides:
                carried = self._carried_values(rows, count, direction)
                value_type = T.ArrayType(rows.schema["_value"].dataType)
                joined = self._join_carried(added, carried, [("_carry", value_type)])
                both = F.concat(
                    F.col(quoted(name)), F.coalesce(F.col("_carry"), F.array().cast(value_type))
                )
                added = joined.withColumn(name, F.slice(both, 1, count)).drop("_carry")
        return self._with(added.drop("_value"))

    def _carried_values(self, rows: DataFrame, count: int, direction: int) -> list[tuple]:
        """For each slice and group, the nearest values of the slices on one side."""
        order = ", ".join(
            quoted(c) + (" desc" if direction < 0 else "") for c in self.by
        )
        part = ", ".join(map(quoted, [SLICE, *self.group]))
        edges = (
            self._cut_rows(rows)
            .where(F.col("_value").isNotNull())
            .withColumn(
                "_place", F.expr(f"row_number() over (partition by {part} order by {order})")
            )
            .where(F.col("_place") <= count)
            .select(SLICE, *map(quoted, self.group), "_place", "_value")
            .collect()
        )
        of_part: dict[tuple, list] = {}
        for r in sorted(edges, key=lambda r: r["_place"]):
            of_part.setdefault((r[SLICE], *[r[g] for g in self.group]), []).append(r["_value"])
        near: dict[tuple, list] = {}
        carried = []
        for key, slices in self._cut.items():
            for place in slices if direction < 0 else reversed(slices):
                so_far = near.get(key, [])
                carried.append((place, *key, so_far))
                near[key] = (of_part.get((place, *key), []) + so_far)[:count]
        return carried

    def _join_carried(self, rows: DataFrame, carried: list[tuple], fields: list[tuple]) -> DataFrame:
        schema = T.StructType(
            [T.StructField(SLICE, T.IntegerType())]
            + [T.StructField(g, rows.schema[g].dataType) for g in self.group]
            + [T.StructField(name, data_type) for name, data_type in fields]
        )
        table = rows.sparkSession.createDataFrame(carried, schema)
        # At most two rows per slice, however large the table is.
        return rows.join(F.broadcast(table), [SLICE, *self.group], "left")


def with_position(
    df: DataFrame, by: list[str], name: str = "row_id", slices: int | None = None
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of the unique key ``by``."""
    ordered = Ordered(df, by, slices=slices).running_sums({name: F.lit(1).cast("bigint")})
    return ordered.result().withColumn(name, F.col(quoted(name)) - 1)
