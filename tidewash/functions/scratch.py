"""Intermediate tables that cut lineage and survive the loss of executors.

They are parquet tables under the shared folder the cluster names in
``spark.checkpoint.dir``. Only a local session without that setting gets a
folder of its own.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tidewash-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach"
        )
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="tidewash-")
    return _local_folders[app]


def safe_name(label: str) -> str:
    """A folder name for any label: characters that paths or patterns use are written in hex."""
    return re.sub(r"[^A-Za-z0-9_.-]", lambda m: f"~{ord(m[0]):x}~", label)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results read from them are lost."""
    _delete(spark, scratch_folder(spark))


def write_scratch(df: DataFrame, label: str = "table", compression: str = "snappy") -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{safe_name(label)}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


def drop_table(stored: DataFrame) -> None:
    """Delete a table of :func:`write_scratch` that nothing will read any more."""
    _delete(stored.sparkSession, stored.scratch_path)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of finished shuffles deleted, for which Spark waits for the driver's
    garbage to be collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
