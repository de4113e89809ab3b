"""A log of rounds, so that a loop goes on where a lost driver left it.

Every finished round has its tables and a row in the log, in a folder that outlives
the application. A round without a row did not finish and is done again.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = "round int, tables map<string,string>, state string"


class RoundLog:
    """The rounds of one loop under ``folder``; a loop that is called again reads them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _files(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def last(self) -> tuple[int, dict[str, DataFrame], dict[str, Any]] | None:
        """The last finished round: its number, its tables and its state."""
        files, path = self._files(f"{self.folder}/log")
        if not files.exists(path):
            return None
        rows = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.folder}/log")
        row = rows.orderBy(F.col("round").desc()).first()  # a row per round
        if row is None:
            return None
        tables = {name: self.spark.read.parquet(at) for name, at in row["tables"].items()}
        return row["round"], tables, json.loads(row["state"])

    def write(self, df: DataFrame, name: str, number: int) -> DataFrame:
        """Store a table of a round; one that a stopped run left half written is replaced."""
        path = f"{self.folder}/{name}-{number}"
        df.write.mode("overwrite").parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored.scratch_path = path
        return stored

    def finish(
        self,
        number: int,
        tables: Mapping[str, DataFrame],
        state: Mapping[str, Any] | None = None,
    ) -> None:
        """Record a finished round, then delete the tables of the one before that it does not need."""
        before = self.last()
        paths = {name: table.scratch_path for name, table in tables.items()}
        row = (number, paths, json.dumps(dict(state or {})))
        self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.folder}/log"
        )
        if before:
            for name in before[1]:
                old = f"{self.folder}/{name}-{before[0]}"
                if old not in paths.values():
                    files, path = self._files(old)
                    files.delete(path, True)
