"""A time limit for one scan's jobs that leaves the session's other jobs alone."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")

#: Seconds that a scan may take, a fixed value.
SCAN_SECONDS = 300.0


class ScanTimeout(TimeoutError):
    """A scan's jobs were cancelled because it took too long."""


def within(spark: SparkSession, work: Callable[[], T], seconds: float = SCAN_SECONDS) -> T:
    """What work() gives. Its jobs carry a tag of their own; once the time is up, jobs with that tag are cancelled, later ones as well, and ScanTimeout is raised.

    Spark passes the tag on to the jobs that this thread starts; work() that
    starts threads itself must let them inherit it (pyspark.InheritableThread).
    """
    context, tag = spark.sparkContext, f"scan-{uuid.uuid4().hex}"
    ended, late = threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not ended.wait(wait):
            late.set()
            context.cancelJobsWithTag(tag)
            wait = 0.2  # for jobs that begin after the first call

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        found = work()
    except Exception as error:
        if late.is_set():
            raise ScanTimeout(f"the scan took more than {seconds:g} seconds") from error
        raise
    finally:
        ended.set()
        watcher.join()
        context.removeJobTag(tag)
    if late.is_set():
        raise ScanTimeout(f"the scan took more than {seconds:g} seconds")
    return found
