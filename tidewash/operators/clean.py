"""Headers, text values, duplicates, sparse rows and sparse columns.

"Empty" means null, or text that is blank after stripping.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewash.functions.columns import added, column, one_row, text_columns
from tidewash.functions.scratch import write_scratch
from tidewash.functions.text import WHITE_SPACE, is_blank, normalized

SPARSE_PERCENT = 70.0


def clean_header(name: str) -> str:
    return name.strip(WHITE_SPACE).lower().replace(" ", "_")


def header_changes(df: DataFrame) -> dict[str, str]:
    """The headers that ``normalize_headers`` changes, old to new."""
    return {c: clean_header(c) for c in df.columns if clean_header(c) != c}


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip and lower-case headers and replace spaces by underscores.

    Two headers that become equal raise, because no later step could tell
    the columns apart.
    """
    names = [clean_header(c) for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"headers become equal after normalising: {repeated}")
    return df.toDF(*names)


def normalize_text(df: DataFrame) -> DataFrame:
    """Strip and lower-case every text value."""
    return df.withColumns({c: normalized(column(c)) for c in text_columns(df)})


def changed_text_columns(df: DataFrame) -> DataFrame:
    """``column, changed_rows`` for the text columns that normalising changes."""
    rows = [(c, n) for c, n in _changed_counts(df)[1].items() if n]
    return df.sparkSession.createDataFrame(rows, "column string, changed_rows bigint")


def _changed_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of rows, and of values that normalising changes per text column."""
    names = text_columns(df)
    found = one_row(
        df,
        [
            F.count("*").alias("rows"),
            *[
                F.count_if(~column(c).eqNullSafe(normalized(column(c)))).alias(f"c{i}")
                for i, c in enumerate(names)
            ],
        ],
    )
    return found["rows"], {c: found[f"c{i}"] for i, c in enumerate(names)}


def blank_to_null(df: DataFrame) -> DataFrame:
    """Make blank text null, so that later steps see one kind of missing value."""
    return df.withColumns(
        {c: F.when(~is_blank(column(c)), column(c)) for c in text_columns(df)}
    )


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of rows that agree in every column (nulls agree)."""
    return df.dropDuplicates()


def count_duplicates(df: DataFrame) -> int:
    """How many rows ``drop_duplicates`` would remove.

    Rows are not shuffled whole: only the hashes are grouped, and rows are
    compared in full only where a hash occurs more than once.
    """
    names = [column(c) for c in df.columns]
    row_hash = F.xxhash64(*names).alias("_hash")
    repeated = write_scratch(
        df.select(row_hash)
        .groupBy("_hash")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("_hash"),
        "hashes",
    )
    groups = (
        df.select(row_hash, *names)
        .join(repeated, "_hash", "left_semi")
        .groupBy(*names)
        .agg(F.count("*").alias("_n"))
    )
    return groups.agg(F.sum(F.col("_n") - 1)).first()[0] or 0


def duplicate_stats(df: DataFrame) -> DataFrame:
    """``total_rows, duplicate_rows, duplicate_pct`` without removing anything."""
    table = df.sparkSession.createDataFrame(
        [(df.count(), count_duplicates(df))], "total_rows bigint, duplicate_rows bigint"
    )
    return table.withColumn(
        "duplicate_pct", percent(F.col("duplicate_rows"), F.col("total_rows"))
    )


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` in percent of ``whole``, rounded; 0 when there is nothing."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.round(F.coalesce(share, F.lit(0.0)), digits)


def is_empty(df: DataFrame, name: str) -> Column:
    value = column(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return value.isNull() | is_blank(value)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def is_sparse_row(df: DataFrame, threshold: float = SPARSE_PERCENT) -> Column:
    """True where more than ``threshold`` percent of the row's cells are empty."""
    cells = added([is_empty(df, c).cast("int") for c in df.columns])
    return cells / F.lit(len(df.columns)) * 100 > F.lit(float(threshold))


def drop_sparse_rows(df: DataFrame, threshold: float = SPARSE_PERCENT) -> DataFrame:
    return df.where(~is_sparse_row(df, threshold))


def empty_cells(df: DataFrame) -> DataFrame:
    """``column, empty_count, empty_pct``; the percentage is null without rows."""
    found = one_row(
        df,
        [
            F.count("*").alias("rows"),
            *[F.count_if(is_empty(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
        ],
    )
    rows = found["rows"]
    counts = [(c, found[f"c{i}"]) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(
        [(c, n, n / rows * 100 if rows else None) for c, n in counts],
        "column string, empty_count bigint, empty_pct double",
    )


def sparse_columns(df: DataFrame, threshold: float = SPARSE_PERCENT) -> list[str]:
    """Names of the columns that are more than ``threshold`` percent empty."""
    sparse = {
        r["column"]
        for r in empty_cells(df).where(F.col("empty_pct") > float(threshold)).collect()
    }
    return [c for c in df.columns if c in sparse]


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the named columns; names that are not there are no error."""
    return df.drop(*names)


def drop_sparse_columns(df: DataFrame, threshold: float = SPARSE_PERCENT) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


def cleaning_diagnostics(
    df: DataFrame,
    row_threshold: float = SPARSE_PERCENT,
    col_threshold: float = SPARSE_PERCENT,
) -> DataFrame:
    """One row: size, duplicates, sparse rows and sparse columns; changes nothing."""
    found = one_row(
        df,
        [
            F.count("*").alias("rows"),
            F.count_if(is_sparse_row(df, row_threshold)).alias("sparse_rows"),
            *[F.count_if(is_empty(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
        ],
    )
    rows = found["rows"]
    sparse = [
        c
        for i, c in enumerate(df.columns)
        if rows and found[f"c{i}"] / rows * 100 > col_threshold
    ]
    table = df.sparkSession.createDataFrame(
        [(rows, len(df.columns), count_duplicates(df), found["sparse_rows"], ",".join(sparse))],
        "rows bigint, cols bigint, duplicate_count bigint, sparse_row_count bigint, "
        "sparse_cols string",
    )
    return table.withColumns(
        {
            "duplicate_pct": percent(F.col("duplicate_count"), F.col("rows")),
            "sparse_row_pct": percent(F.col("sparse_row_count"), F.col("rows")),
        }
    )


@dataclass
class Cleaned:
    """A cleaned table and what was changed on the way."""

    data: DataFrame
    rows_before: int
    rows_after: int
    cols_before: int
    duplicates_removed: int
    rows_dropped_sparse: int
    cols_dropped_sparse: list[str]
    headers_normalised: dict[str, str]
    categorical_normalised: list[str]

    def summary(self) -> DataFrame:
        """The changes as one row."""
        row = (
            self.rows_before,
            self.rows_after,
            self.cols_before,
            len(self.data.columns),
            self.duplicates_removed,
            self.rows_dropped_sparse,
            ",".join(self.cols_dropped_sparse),
            ",".join(f"{a}={b}" for a, b in self.headers_normalised.items()),
            ",".join(self.categorical_normalised),
        )
        return self.data.sparkSession.createDataFrame(
            [row],
            "rows_before bigint, rows_after bigint, cols_before bigint, cols_after bigint, "
            "duplicates_removed bigint, rows_dropped_sparse bigint, "
            "cols_dropped_sparse string, headers_normalised string, "
            "categorical_normalised string",
        )


def clean(
    df: DataFrame,
    row_threshold: float = SPARSE_PERCENT,
    col_threshold: float = SPARSE_PERCENT,
) -> Cleaned:
    """Normalise, deduplicate, drop sparse rows, then sparse columns.

    The deduplicated rows are written once. All counts come from that table
    and from one scan of the input, not from counters inside running tasks,
    so they stay right when a task is run twice.
    """
    headed = normalize_headers(df)
    rows_before, changed = _changed_counts(headed)
    plain = normalize_text(headed)
    unique = drop_duplicates(plain)
    kept = "_kept"
    written = write_scratch(
        unique.withColumn(kept, ~is_sparse_row(unique, row_threshold)), "unique"
    )
    names = unique.columns
    after = one_row(
        written,
        [
            F.count("*").alias("unique_rows"),
            F.count_if(kept).alias("kept_rows"),
            *[
                F.count_if(F.col(kept) & is_empty(unique, c)).alias(f"e{i}")
                for i, c in enumerate(names)
            ],
        ],
    )
    rows = after["kept_rows"]
    dropped = [
        c
        for i, c in enumerate(names)
        if rows and after[f"e{i}"] / rows * 100 > col_threshold
    ]
    data = blank_to_null(written.where(kept).drop(kept, *dropped))
    return Cleaned(
        data=data,
        rows_before=rows_before,
        rows_after=rows,
        cols_before=len(df.columns),
        duplicates_removed=rows_before - after["unique_rows"],
        rows_dropped_sparse=after["unique_rows"] - rows,
        cols_dropped_sparse=dropped,
        headers_normalised=header_changes(df),
        categorical_normalised=[c for c, n in changed.items() if n],
    )
