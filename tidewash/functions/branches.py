"""Independent jobs at the same time.

Each branch runs in a thread of the driver with a scheduler pool and a job group of its
own, so Spark shares the executors between them. The first error cancels the running
and future jobs of all other branches and is raised again.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: Branches at the same time; more than a few only wait for each other's tasks.
AT_ONCE = 4


def run_branches(
    spark: SparkSession, branches: Mapping[str, Callable[[], Any]], at_once: int = AT_ONCE
) -> dict[str, Any]:
    """The results of all branches by name, in the order in which they are given."""
    if len(branches) < 2:
        return {name: work() for name, work in branches.items()}
    context = spark.sparkContext
    groups = {name: f"{name}-{uuid.uuid4().hex}" for name in branches}
    results: dict[str, Any] = {}
    errors: list[BaseException] = []
    lock, places = threading.Lock(), threading.Semaphore(at_once)

    def run(name: str, work: Callable[[], Any]) -> None:
        with places:
            if errors:
                return
            context.setLocalProperty("spark.scheduler.pool", name)
            context.setJobGroup(groups[name], name)
            try:
                results[name] = work()
            except BaseException as error:  # raised again below, in the caller's thread
                with lock:
                    errors.append(error)
                    first = len(errors) == 1
                for other, group in groups.items():
                    if first and other != name:
                        context._jsc.sc().cancelJobGroupAndFutureJobs(group)

    threads = [
        InheritableThread(target=run, args=(name, work))
        for name, work in branches.items()
    ]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if errors:
        raise errors[0]
    return {name: results[name] for name in branches}
