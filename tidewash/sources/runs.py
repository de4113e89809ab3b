"""Runs on disk: settings, raw input, the output of each step and an event table.

Every event is a folder of its own in the event table, so writers, also threads of one
driver, cannot lose each other's entries. A step is done when its event is present and its
output is complete; a later call with the same run then reads that output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewash.functions.scratch import safe_name

EVENT_SCHEMA = (
    "run_id string, ts timestamp, step string, status string, output string, "
    "metrics map<string,double>, settings map<string,string>"
)
STARTED, DONE, FINISHED = "in_progress", "done", "finished"


def _all_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def run_name(source: str, when: datetime) -> str:
    """``<stem of the source>_<date>_<time>``."""
    stem = source.rstrip("/").rsplit("/", 1)[-1]
    stem = safe_name(stem.rpartition(".")[0] or stem)
    return f"{stem}_{when:%Y%m%d_%H%M%S}"


class Run:
    """One cleaning run under ``<root>/runs/<run_id>``."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.run_id = run_id

    @property
    def folder(self) -> str:
        return f"{self.root}/runs/{self.run_id}"

    @property
    def events_path(self) -> str:
        return f"{self.root}/run_events"

    def _exists(self, path: str) -> bool:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(jvm_path)

    def log(
        self,
        step: str,
        status: str,
        output: str = "",
        metrics: dict[str, float] | None = None,
        settings: dict[str, str] | None = None,
    ) -> None:
        now = datetime.now(timezone.utc)
        clean = {k: float(v) for k, v in (metrics or {}).items()}
        row = (self.run_id, now, step, status, output, clean, settings or {})
        # Two writes into one folder at the same time would delete each other's temporary files.
        self.spark.createDataFrame([row], EVENT_SCHEMA).coalesce(1).write.parquet(
            f"{self.events_path}/event-{uuid.uuid4().hex}"
        )

    def events(self) -> DataFrame:
        if not self._exists(self.events_path):
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return _all_events(self.spark, self.events_path).where(F.col("run_id") == self.run_id)

    def output_path(self, step: str) -> str:
        return f"{self.folder}/{safe_name(step)}"

    def is_done(self, step: str) -> bool:
        if not self._exists(f"{self.output_path(step)}/_SUCCESS"):
            return False
        logged = self.events().where((F.col("step") == step) & (F.col("status") == DONE))
        return not logged.isEmpty()

    def read(self, step: str) -> DataFrame:
        return self.spark.read.parquet(self.output_path(step))

    def step(
        self,
        name: str,
        build: Callable[[], DataFrame],
        metrics: Callable[[DataFrame], dict[str, float]] | None = None,
    ) -> DataFrame:
        """The stored output of a step, built and written only if it is not done yet."""
        if not self.is_done(name):
            build().write.mode("overwrite").parquet(self.output_path(name))
            stored = self.read(name)
            self.log(name, DONE, self.output_path(name), metrics(stored) if metrics else None)
        return self.read(name)

    def snapshot_input(self, df: DataFrame) -> DataFrame:
        """Store the raw input once; later calls read it and never change it."""
        return self.step("input", lambda: df)

    def finish(self) -> None:
        self.log("run", FINISHED)


def start_run(
    spark: SparkSession,
    root: str,
    source: str,
    row_threshold: float = 70.0,
    col_threshold: float = 70.0,
    minimal_profiling: bool = False,
    when: datetime | None = None,
) -> Run:
    """Open a new run and record its settings."""
    run = Run(spark, root, run_name(source, when or datetime.now(timezone.utc)))
    settings = {
        "source_file": source,
        "run_path": run.folder,
        "row_threshold": str(float(row_threshold)),
        "col_threshold": str(float(col_threshold)),
        "minimal_profiling": str(minimal_profiling).lower(),
    }
    run.log("run", STARTED, run.folder, settings=settings)
    return run


def latest_status(events: DataFrame) -> DataFrame:
    """One row per run: when it started, its last event and number of events."""
    last = F.max(F.struct("ts", "status", "step"))
    return events.groupBy("run_id").agg(
        F.min("ts").alias("started_at"),
        last["status"].alias("status"),
        last["step"].alias("last_step"),
        F.count("*").alias("events"),
    )


def run_registry(spark: SparkSession, root: str) -> DataFrame:
    """The latest status of every run under ``root``."""
    run = Run(spark, root, "")
    if not run._exists(run.events_path):
        return latest_status(spark.createDataFrame([], EVENT_SCHEMA))
    return latest_status(_all_events(spark, run.events_path))
