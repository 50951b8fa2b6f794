"""The time limit of a scan."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from candela.plans.limits import ScanTimeout, within


def slow(spark, seconds, rows=4):
    def wait(batches):
        for batch in batches:
            time.sleep(seconds)
            yield batch

    return spark.range(rows).repartition(2).mapInArrow(wait, "id long")


def test_a_late_scan_ends_and_other_jobs_live(spark):
    others = []
    other = threading.Thread(target=lambda: others.append(slow(spark, 4).count()))
    other.start()
    began = time.monotonic()
    with pytest.raises(ScanTimeout):
        within(spark, lambda: slow(spark, 30).count(), 2.0)
    assert time.monotonic() - began < 25
    other.join()
    assert others == [4]


def test_work_in_time_gives_its_result_and_errors_stay_their_own(spark):
    assert within(spark, lambda: spark.range(5).count(), 60.0) == 5
    with pytest.raises(Exception, match="boom") as found:
        within(spark, lambda: spark.range(1).select(F.raise_error(F.lit("boom"))).collect(), 60.0)
    assert not isinstance(found.value, ScanTimeout) and not set(spark.sparkContext.getJobTags())
