"""Exact linear-interpolated quantiles that stay small in memory.

Spark's ``percentile`` keeps every distinct value of a column in one buffer.
Here a quantile is found by narrowing: a sketch brackets the wanted order
statistic, a second scan counts exactly how many values lie below and between
the brackets, and this repeats until the open interval holds few enough
values to sort in one buffer. Each scan moves only counters, and the result
is exact because the counts, not the sketch, decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.columns import number, one_row

# How many values of one interval may be sorted inside one buffer, and how
# many such values one aggregate may hold in total.
SORT_LIMIT = 100_000
BUFFER_LIMIT = 1_500_000
# The sketch is right to one part in SKETCH_ACCURACY of the ranks; brackets
# are set a little wider, so one round leaves about half a percent of a column.
SKETCH_ACCURACY = 2_000
SPREAD = 2.5 / SKETCH_ACCURACY


@dataclass
class _Statistic:
    """The search for the value at one rank of one column."""

    name: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def interval(self) -> tuple:
        return (self.name, self.low, self.high)

    def mask(self, value: Column) -> Column:
        """``value`` inside the open interval, else null."""
        if self.low is None and self.high is None:
            return value
        test = F.lit(True)
        if self.low is not None:
            test = test & (value > F.lit(self.low))
        if self.high is not None:
            test = test & (value < F.lit(self.high))
        return F.when(test, value)


@dataclass
class Quantiles:
    """Number of non-null values and the value at each probability."""

    count: int
    at: dict[float, float | None] = field(default_factory=dict)

    def __getitem__(self, prob: float) -> float | None:
        return self.at[prob]


def exact_quantiles(
    df: DataFrame,
    columns: Iterable[str] | dict[str, Column],
    probs: Iterable[float] = (0.25, 0.5, 0.75),
    sort_limit: int = SORT_LIMIT,
) -> dict[str, Quantiles]:
    """Quantiles of numeric columns or of named double expressions.

    Nulls and NaN are left out. The answer is a few numbers per column.
    """
    if isinstance(columns, dict):
        exprs = dict(columns)
    else:
        exprs = {name: number(df, name) for name in columns}
    probs = list(probs)
    if not exprs:
        return {}
    # Spark names without dots, whatever the columns are called.
    short = {name: f"c{i}" for i, name in enumerate(exprs)}
    values = df.select(*[expr.alias(short[name]) for name, expr in exprs.items()])

    # One scan counts the values and sketches the first brackets.
    wanted = [q for p in probs for q in (max(0.0, p - SPREAD), min(1.0, p + SPREAD))]
    first = one_row(
        values,
        [
            e
            for c in short.values()
            for e in (
                F.count(c).alias(f"n_{c}"),
                F.percentile_approx(c, wanted, SKETCH_ACCURACY).alias(f"s_{c}"),
            )
        ],
    )
    counts = {c: first[f"n_{c}"] for c in short.values()}
    searches: dict[tuple[str, int], _Statistic] = {}
    groups = []
    for c, n in counts.items():
        for i, prob in enumerate(probs if n else ()):
            position = prob * (n - 1)
            group = []
            for rank in sorted({math.floor(position), math.ceil(position)}):
                if (c, rank) not in searches:
                    searches[(c, rank)] = _Statistic(c, rank, n)
                    group.append(searches[(c, rank)])
            if group and n > sort_limit:
                groups.append((group, *first[f"s_{c}"][2 * i : 2 * i + 2]))
    while groups:
        _count_and_narrow(values, groups)
        groups = _sketch(
            values,
            [s for s in searches.values() if s.value is None and s.inside > sort_limit],
        )
    _sort_remaining(values, [s for s in searches.values() if s.value is None])

    result = {}
    for name, c in short.items():
        n = counts[c]
        found = Quantiles(n)
        for prob in probs:
            if not n:
                found.at[prob] = None
                continue
            position = prob * (n - 1)
            rank = math.floor(position)
            low = searches[(c, rank)].value
            high = searches[(c, math.ceil(position))].value
            part = position - rank
            found.at[prob] = low if low == high else (1 - part) * low + part * high
        result[name] = found
    return result


def _sketch(values: DataFrame, searches: list[_Statistic]) -> list[tuple]:
    """Brackets for every search; searches in one interval share one sketch."""
    intervals: dict[tuple, list[_Statistic]] = {}
    for s in sorted(searches, key=lambda s: (s.name, s.rank)):
        intervals.setdefault(s.interval(), []).append(s)
    members = list(intervals.values())
    sketches = []
    for i, group in enumerate(members):
        wanted = []
        for s in group:
            wanted.append(max(0.0, (s.rank - s.below) / s.inside - SPREAD))
            wanted.append(min(1.0, (s.rank - s.below + 1) / s.inside + SPREAD))
        sketches.append(
            F.percentile_approx(
                group[0].mask(F.col(group[0].name)), wanted, SKETCH_ACCURACY
            ).alias(f"g{i}")
        )
    brackets = one_row(values, sketches) if sketches else {}
    return [
        ([s], *brackets[f"g{i}"][2 * k : 2 * k + 2])
        for i, group in enumerate(members)
        for k, s in enumerate(group)
    ]


def _count_and_narrow(values: DataFrame, groups: list[tuple]) -> None:
    """Count exactly around each pair of brackets and shrink the intervals."""
    counters: dict[tuple, Column] = {}
    for members, *brackets in groups:
        s = members[0]
        for bound in brackets:
            value = s.mask(F.col(s.name))
            counters[(*s.interval(), bound, "<")] = F.count_if(value < bound)
            counters[(*s.interval(), bound, "<=")] = F.count_if(value <= bound)
    names = {key: f"n{i}" for i, key in enumerate(counters)}
    counted = one_row(values, [e.alias(names[key]) for key, e in counters.items()])

    for members, low, high in groups:
        found = members[0].interval()

        def count(bound: float, test: str) -> int:
            return counted[names[(*found, bound, test)]]

        ends = [
            count(low, "<"), count(low, "<="), count(high, "<"), count(high, "<=")
        ]
        for s in members:
            place = s.rank - s.below
            if place < ends[0]:
                s.high, s.inside = low, ends[0]
            elif place < ends[1]:
                s.value = low
            elif place < ends[2]:
                s.below += ends[1]
                s.low, s.high, s.inside = low, high, ends[2] - ends[1]
            elif place < ends[3]:
                s.value = high
            else:
                s.below += ends[3]
                s.low, s.inside = high, s.inside - ends[3]


def _sort_remaining(values: DataFrame, searches: list[_Statistic]) -> None:
    """Read the wanted ranks from the sorted values of each small interval."""
    groups: dict[tuple, list[_Statistic]] = {}
    for s in searches:
        groups.setdefault(s.interval(), []).append(s)

    batches: list[list[list[_Statistic]]] = []
    held = BUFFER_LIMIT + 1
    for group in groups.values():
        if held + group[0].inside > BUFFER_LIMIT:
            batches.append([])
            held = 0
        batches[-1].append(group)
        held += group[0].inside

    for batch in batches:
        # Drop the rows outside every interval before anything is collected.
        wanted = F.lit(False)
        for group in batch:
            wanted = wanted | group[0].mask(F.col(group[0].name)).isNotNull()
        found = values.where(wanted).agg(
            *[
                F.transform(
                    F.array(*[F.lit(s.rank - s.below) for s in group]),
                    _picker(F.sort_array(F.collect_list(group[0].mask(F.col(group[0].name))))),
                ).alias(f"g{i}")
                for i, group in enumerate(batch)
            ]
        ).first()
        for i, group in enumerate(batch):
            for s, value in zip(group, found[f"g{i}"], strict=True):
                s.value = value


def _picker(ordered: Column):
    return lambda place: F.get(ordered, place)
