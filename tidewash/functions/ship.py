"""Send the library to the workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession, *paths: str) -> None:
    """Make Python packages (folders) and modules (files) importable in every worker.

    They are put into one archive and handed to Spark, which brings it to each
    executor; once per application. An installed library does not need this.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tidewash-ship-"), "tidewash_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in filter(os.path.exists, paths):
            parent = os.path.dirname(os.path.abspath(path))
            if os.path.isfile(path):
                packed.write(path, os.path.basename(path))
                continue
            for folder, _, names in os.walk(path):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        packed.write(full, os.path.relpath(full, parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
