"""Whole jobs: clean, treat outliers, fill gaps, merge categories, label.

Every job is a chain of stored steps. With a ``Run`` the steps are kept under
the run's folder and skipped when they are already done; without one they are
written to the scratch folder.

Nothing is removed, capped, filled or merged without approval. A job that is
called without a reviewer stores its proposals unapproved and leaves the data as
it is; called again with the reviewed proposals it goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidewash.functions.branches import run_branches
from tidewash.functions.columns import numeric_columns
from tidewash.functions.scratch import write_scratch
from tidewash.operators import clean as cleaning
from tidewash.operators.correlation import pearson_matrix
from tidewash.operators.decisions import apply_decisions, beyond, decide_by_rule
from tidewash.operators.density import numeric_outlier_report, with_density
from tidewash.operators.impute import (
    apply_fills,
    driver_fills,
    neighbour_fills,
    strongest_drivers,
)
from tidewash.operators.label import (
    distinct_atomic_values,
    label_by_rules,
    label_column,
    label_counts,
)
from tidewash.operators.merge import (
    apply_merge_map,
    canonical_merge_map,
    drop_rare_values,
    reviewed_candidate_columns,
)
from tidewash.operators.missing import (
    columns_with_gaps,
    missingness_drivers,
    missingness_profile,
    null_patterns,
)
from tidewash.operators.outliers import (
    boxplot_stats,
    outlier_comparison,
    outlier_records,
    outlier_summary,
)
from tidewash.operators.profile import (
    column_profile,
    dataset_summary,
    dominant_values,
    missing_summary,
    rare_categories,
)
from tidewash.sources.runs import Run


def _stored(df: DataFrame, run: Run | None, step: str) -> DataFrame:
    return write_scratch(df, step) if run is None else run.step(step, lambda: df)


class Reports(Mapping):
    """Reports by name, each worked out when it is first asked for."""

    def __init__(self) -> None:
        self._builders: dict[str, Callable[[], DataFrame]] = {}
        self._built: dict[str, DataFrame] = {}

    def add(self, name: str, build: Callable[[], DataFrame]) -> None:
        self._builders[name] = build

    def include(self, other: "Reports", prefix: str = "") -> None:
        for name in other:
            self.add(prefix + name, lambda name=name: other[name])

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._builders

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


@dataclass
class Outcome:
    """The resulting table and the reports on the way to it."""

    data: DataFrame
    reports: Reports = field(default_factory=Reports)


def clean_table(
    df: DataFrame,
    row_threshold: float = cleaning.SPARSE_PERCENT,
    col_threshold: float = cleaning.SPARSE_PERCENT,
    minimal_profiling: bool = False,
    run: Run | None = None,
) -> Outcome:
    """Profile, clean, profile again.

    A done cleaning step is read back instead of being computed again, and
    the second profile always describes the stored result.
    """

    def profile(table: DataFrame, stage: str) -> Reports:
        found = Reports()
        found.add(f"summary_{stage}", lambda: dataset_summary(table))
        if not minimal_profiling and len(numeric_columns(table)) > 1:
            found.add(f"correlation_{stage}", lambda: pearson_matrix(table))
        found.add(f"profile_{stage}", lambda: column_profile(table))
        return found

    reports = Reports()
    if run is None:
        done = cleaning.clean(df, row_threshold, col_threshold)
        reports.include(profile(df, "before"))
        reports.add("changes", done.summary)
        reports.include(profile(done.data, "after"))
        return Outcome(done.data, reports)

    raw = run.snapshot_input(df)
    reports.include(_stored_reports(profile(raw, "before"), run))
    if not run.is_done("clean"):
        done = cleaning.clean(raw, row_threshold, col_threshold)
        run.step("changes", done.summary)
        run.step(
            "clean",
            lambda: done.data,
            lambda _: {
                "rows_removed": done.duplicates_removed + done.rows_dropped_sparse,
                "cols_removed": len(done.cols_dropped_sparse),
            },
        )
    reports.add("changes", lambda: run.read("changes"))
    data = run.read("clean")
    reports.include(_stored_reports(profile(data, "after"), run))
    return Outcome(data, reports)


def _stored_reports(reports: Reports, run: Run) -> Reports:
    """Work the reports out now, as steps of the run, unless they are stored already."""
    stored = Reports()
    for name in reports:
        run.step(name, lambda name=name: reports[name])
        stored.add(name, lambda name=name: run.read(name))
    return stored


def _reviewed(table: DataFrame | None, name: str) -> DataFrame | None:
    """The reviewer's rows for one column."""
    return None if table is None else table.where(F.col("column") == name)


def treat_outliers(
    df: DataFrame,
    key: str,
    names: Iterable[str] | None = None,
    decide: Callable[[DataFrame], DataFrame] | None = None,
    rule: Column | None = None,
    action: str = "remove",
    reviewed: DataFrame | None = None,
    run: Run | None = None,
    density: bool = False,
) -> Outcome:
    """Find outliers column by column, and remove or cap what is decided and approved.

    ``decide`` turns the outlier records of a column into decisions; without it
    ``rule`` (beyond three IQR by default) proposes the ``action`` and waits for
    approval: the proposals are in the report ``decisions``, the data stays.
    ``reviewed`` is that table with the reviewer's approvals (and changes) and takes
    the place of both. Fences of a column come from what the columns before it left.
    With ``density`` records also have their ``cluster`` and whether they are ``noise``, for
    ``decide`` and ``rule``.
    """
    names = (
        [c for c in numeric_columns(df) if c != key] if names is None else list(names)
    )
    chosen_rule = beyond(3.0) if rule is None else rule
    step = "reviewed" if reviewed is not None else "decisions"
    reports = Reports()
    reports.add("boxes_before", lambda: boxplot_stats(df, names))
    reports.add("outliers_before", lambda: outlier_summary(df, names, "before"))
    current, every = df, None
    for i, name in enumerate(names):
        decided = _reviewed(reviewed, name)
        if decided is None:
            records = outlier_records(current, name, key)
            if density:
                records = with_density(records, current, name)
            decided = (
                decide(records)
                if decide
                else decide_by_rule(records, chosen_rule, "matches the rule", action=action)
            )
        decisions = _stored(decided, run, f"{step}_{i}_{name}")
        reports.add(f"decisions_{name}", lambda decisions=decisions: decisions)
        every = (
            decisions
            if every is None
            else every.unionByName(decisions, allowMissingColumns=True)
        )
        capped = [name] if "limit" in decisions.columns else []
        applied = apply_decisions(current, decisions, key, capped)
        current = _stored(applied, run, f"{step}_kept_{i}_{name}")
    left, decisions = current, every
    if decisions is not None:
        reports.add("decisions", lambda: decisions)
    reports.add("boxes_after", lambda: boxplot_stats(left, names))
    reports.add("outliers_after", lambda: outlier_summary(left, names, "after"))
    reports.add(
        "comparison",
        lambda: outlier_comparison(reports["outliers_before"], reports["outliers_after"]),
    )
    return Outcome(left, reports)


def closest_fills(key: str, approved: bool = False) -> Callable[[DataFrame, str], DataFrame]:
    """Fills from the closest rows: mean for numbers, most frequent value for text."""

    def fills(table: DataFrame, name: str) -> DataFrame:
        how = "mean" if name in numeric_columns(table) else "mode"
        return neighbour_fills(table, name, key, how, approved=approved)

    return fills


def driven_fills(
    key: str, exclude: Iterable[str] = (), most: int = 2, approved: bool = False
) -> Callable[[DataFrame, str], DataFrame]:
    """Fills from the rows that agree in the columns that best explain the gap."""
    skip = {key, *exclude}

    def fills(table: DataFrame, name: str) -> DataFrame:
        seen = table.drop(*[c for c in skip if c != name])
        drivers = strongest_drivers(
            missingness_drivers(missingness_profile(seen, [name])), name, most
        )
        how = "mean" if name in numeric_columns(table) else "mode"
        return driver_fills(table, name, key, drivers, how, approved)

    return fills


def impute_table(
    df: DataFrame,
    key: str,
    exclude: Iterable[str] = (),
    fills: Callable[[DataFrame, str], DataFrame] | None = None,
    min_signals: int = 1,
    reviewed: DataFrame | None = None,
    run: Run | None = None,
) -> Outcome:
    """Describe the gaps, test what explains them, and fill column by column.

    ``fills(table, column)`` gives the fill table of a column. Without it
    :func:`closest_fills` proposes values and waits for approval: the proposals are
    in the report ``fills``, the data stays. ``reviewed`` is that table with the
    reviewer's approvals (and changes) and takes the place of both.
    """
    skip = set(exclude)
    choose = fills or closest_fills(key)
    step = "reviewed_fills" if reviewed is not None else "fills"
    reports = Reports()
    reports.add("patterns_before", lambda: null_patterns(df))
    reports.add("missing_before", lambda: missing_summary(df, skip))
    reports.add("missingness", lambda: missingness_profile(df, exclude=skip))
    reports.add("drivers", lambda: missingness_drivers(reports["missingness"], min_signals))
    current, every = df, None
    for i, name in enumerate(columns_with_gaps(df, skip)):
        chosen = _reviewed(reviewed, name)
        proposed = _stored(
            choose(current, name) if chosen is None else chosen, run, f"{step}_{i}_{name}"
        )
        reports.add(f"fills_{name}", lambda proposed=proposed: proposed)
        every = proposed if every is None else every.unionByName(proposed)
        current = _stored(
            apply_fills(current, proposed, name, key), run, f"{step}_done_{i}_{name}"
        )
    filled, proposals = current, every
    if proposals is not None:
        reports.add("fills", lambda: proposals)
    reports.add("patterns_after", lambda: null_patterns(filled))
    reports.add("missing_after", lambda: missing_summary(filled, skip))
    return Outcome(filled, reports)


def merge_categories(
    df: DataFrame,
    names: Iterable[str] | None = None,
    suggest: Callable[[DataFrame, str], DataFrame] = canonical_merge_map,
    review: Callable[[DataFrame], DataFrame] | None = None,
    reviewed: DataFrame | None = None,
    run: Run | None = None,
) -> Outcome:
    """Choose columns, suggest merges, pass them through review, apply them.

    Without ``review`` or a ``reviewed`` merge map nothing is approved and the data
    stays as it is.
    """
    names = reviewed_candidate_columns(df) if names is None else list(names)
    merge_map, step = reviewed, "merge_map" if reviewed is None else "reviewed_merge_map"
    if reviewed is None:
        # Columns have nothing to do with each other, so their jobs run at the same time.
        suggested = run_branches(
            df.sparkSession, {name: lambda name=name: suggest(df, name) for name in names}
        )
        for one in suggested.values():
            merge_map = one if merge_map is None else merge_map.unionByName(one)
    if merge_map is None:
        return Outcome(df)
    decided = review(merge_map) if review and reviewed is None else merge_map
    stored = _stored(decided, run, step)
    reports = Reports()
    reports.add("merge_map", lambda: stored)
    return Outcome(apply_merge_map(df, stored, names), reports)


def label_table(
    df: DataFrame,
    name: str,
    rules: list[tuple[str, str]],
    default: str | None = None,
    top_n: int | None = None,
) -> Outcome:
    """Raw distinct items, labelled rows, and the count of every label."""
    labelled = label_by_rules(df, name, rules, default)
    reports = Reports()
    reports.add("distinct", lambda: distinct_atomic_values(df, name))
    reports.add("counts", lambda: label_counts(labelled, label_column(name), top_n))
    return Outcome(labelled, reports)


@dataclass
class Reviewed:
    """A reviewer's tables for :func:`full_cleaning`, each with its ``approved`` column."""

    decisions: DataFrame | None = None
    merge_map: DataFrame | None = None
    rare: DataFrame | None = None
    fills: DataFrame | None = None


def full_cleaning(
    df: DataFrame,
    key: str,
    row_threshold: float = cleaning.SPARSE_PERCENT,
    col_threshold: float = cleaning.SPARSE_PERCENT,
    outlier_names: Iterable[str] | None = None,
    decide: Callable[[DataFrame], DataFrame] | None = None,
    action: str = "remove",
    merge_names: Iterable[str] | None = None,
    suggest: Callable[[DataFrame, str], DataFrame] = canonical_merge_map,
    review: Callable[[DataFrame], DataFrame] | None = None,
    rare_below: float = 1.0,
    fills: Callable[[DataFrame, str], DataFrame] | None = None,
    reviewed: Reviewed | None = None,
    run: Run | None = None,
) -> Outcome:
    """Clean, analyse outliers and categories, apply what is approved, fill gaps.

    Numbers and categories are both analysed on the cleaned table, before anything
    is removed; the reports hold the numeric outliers, the rare values of each
    category column, and the proposals. Then come, each only as far as approved:
    removal or capping of outliers, merging of category values, removal of rows with
    rare values (below ``rare_below`` percent of their column), and filling.
    ``reviewed`` has the reports ``decisions``, ``merge_map``, ``rare`` and ``fills`` of
    an earlier call after review.
    """
    known = reviewed or Reviewed()
    first = clean_table(df, row_threshold, col_threshold, True, run)
    base = first.data if run is not None else _stored(first.data, run, "phase_1")
    reports = Reports()
    reports.include(first.reports, "clean_")
    numbers = [c for c in numeric_columns(base) if c != key]
    step = "" if reviewed is None else "reviewed_"

    def categories() -> tuple[list[str], DataFrame, Outcome]:
        names = (
            [c for c in reviewed_candidate_columns(base) if c != key]
            if merge_names is None
            else list(merge_names)
        )
        proposed = known.rare
        if proposed is None:
            proposed = rare_categories(base, names, rare_below).withColumn(
                "approved", F.lit(False)
            )
        rare = _stored(proposed, run, f"{step}rare")
        # Suggestions come from the cleaned table; they are applied to what is left of it.
        return names, rare, merge_categories(base, names, suggest, review, known.merge_map, run)

    def outliers() -> Outcome:
        return treat_outliers(
            base, key, outlier_names, decide, action=action, reviewed=known.decisions, run=run
        )

    # Both look at the cleaned table only, so they run at the same time.
    found = run_branches(df.sparkSession, {"outliers": outliers, "categories": categories})
    treated, (merge_names, rare, merges) = found["outliers"], found["categories"]
    reports.add("outlier_report", lambda: numeric_outlier_report(base, numbers))
    reports.add("categorical_report", lambda: dominant_values(base, merge_names))
    reports.add("rare", lambda: rare)
    merged = treated.data
    if "merge_map" in merges.reports:
        merged = apply_merge_map(merged, merges.reports["merge_map"], merge_names)
    for name in merge_names if known.rare is not None else ():
        merged = drop_rare_values(merged, name, rare)
    phase_3 = _stored(merged, run, f"{step}phase_3")
    filled = impute_table(phase_3, key, fills=fills, reviewed=known.fills, run=run)
    for part in (merges, treated, filled):
        reports.include(part.reports)
    if run is not None:
        run.finish()
    return Outcome(filled.data, reports)
