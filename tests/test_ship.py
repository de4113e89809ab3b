import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").getOrCreate())
print("rows", entry.queries()["label_by_function"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_find_the_library_from_any_folder(tmp_path):
    plain = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM],
        cwd=tmp_path,
        env=plain,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert "rows " in done.stdout, done.stderr[-2000:]
