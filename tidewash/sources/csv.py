"""CSV files: read as text, make missing markers null, find the column types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewash.functions.columns import chunks, column
from tidewash.functions.text import plain_number, strip

# The texts that stand for a missing value in a CSV file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def read_csv_text(
    spark: SparkSession, path: str, multiline: bool | str = "auto"
) -> DataFrame:
    """Every column as text, empty fields as null.

    A file with line breaks inside quotes cannot be split over tasks. With
    ``auto`` one scan of the lines decides: if every line has an even number
    of quotes, no field reaches over a line break and the files are split.
    """
    if multiline == "auto":
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = not spark.read.text(path).where(quotes % 2 != 0).isEmpty()
    return spark.read.csv(
        path,
        header=True,
        multiLine=multiline,
        escape='"',
        inferSchema=False,
        enforceSchema=False,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def tokens_to_null(df: DataFrame, tokens: Iterable[str] = MISSING_TOKENS) -> DataFrame:
    """Make the texts that stand for a missing value null."""
    listed = list(tokens)
    return df.select(
        *[F.when(~column(c).isin(listed), column(c)).alias(c) for c in df.columns]
    )


def _readings(value: Column) -> dict[str, Column]:
    """For each type, from narrow to wide, the value read as that type."""
    text = strip(value)
    truth = F.when(value.isin("True", "TRUE", "true"), F.lit(True)).when(
        value.isin("False", "FALSE", "false"), F.lit(False)
    )
    return {
        "bigint": text.try_cast("bigint"),
        "double": plain_number(text),
        "boolean": truth,
    }


def infer_types(df: DataFrame) -> dict[str, str]:
    """The narrowest of bigint, double, boolean and string that reads every value.

    A column without values becomes double. One aggregate counts the failures
    of all columns.
    """
    found: dict = {}
    for part in chunks(list(enumerate(df.columns)), 4):
        aggregates = []
        for i, c in part:
            value = column(c)
            aggregates.append(F.count(value).alias(f"n{i}"))
            for kind, reading in _readings(value).items():
                aggregates.append(F.count(reading).alias(f"{kind}{i}"))
        found.update(df.agg(*aggregates).first().asDict())
    types = {}
    for i, c in enumerate(df.columns):
        n = found[f"n{i}"]
        fitting = [k for k in ("bigint", "double", "boolean") if found[f"{k}{i}"] == n]
        types[c] = "double" if not n else fitting[0] if fitting else "string"
    return types


def with_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(
        *[
            (column(c) if types[c] == "string" else _readings(column(c))[types[c]]).alias(c)
            for c in df.columns
        ]
    )


def read_csv(
    spark: SparkSession,
    path: str,
    types: dict[str, str] | None = None,
    multiline: bool | str = "auto",
) -> DataFrame:
    """Read CSV with a header; types are inferred unless given."""
    text = tokens_to_null(read_csv_text(spark, path, multiline))
    return with_types(text, types or infer_types(text))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write with a header; null becomes an empty field, quotes are doubled."""
    writer = df.write.mode(mode).options(
        header=True,
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        timestampFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]",
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    )
    writer.csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a report as JSON lines."""
    df.write.json(path, mode=mode)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read by file extension: CSV or parquet; anything else raises."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return read_csv(spark, path)
    if ending == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format {ending!r}; supported: csv, parquet")


def classified_path(path: str) -> str:
    """Where the labelled copy of a file goes: the stem gains ``_classified``."""
    folder, _, name = path.rstrip("/").rpartition("/")
    stem, dot, ending = name.rpartition(".")
    new = f"{stem}_classified.{ending}" if dot else f"{name}_classified"
    return f"{folder}/{new}" if folder else new


def save_classified(df: DataFrame, source_path: str) -> str:
    """Write the labelled copy beside the source, which is never changed."""
    target = classified_path(source_path)
    if target.lower().endswith(".parquet"):
        df.write.parquet(target, mode="overwrite")
    else:
        write_csv(df, target, mode="overwrite")
    return target
