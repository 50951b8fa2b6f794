"""Zones that follow a stream against zones of a batch."""

import datetime

import pytest
from pyspark.sql import functions as F

from candela.operators import zones
from candela.plans import queries
from candela.streaming import zones as streamed

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def run(spark, folder, bars, seeds, parts, **kw):
    """Streams the bars in `parts` micro-batches, in order of their start; gives the rows of follow()."""
    for k, (low, high) in enumerate(parts):
        bars.filter((F.col("bar_idx") >= low) & (F.col("bar_idx") < high)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/part={k}")
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    name = f"moved_{abs(hash(folder))}"
    stream = streamed.follow(source, seeds, **kw).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    assert stream.awaitTermination(300)
    return spark.table(name).collect()


def test_streamed_zones_end_as_those_of_the_batch(spark, rocks, tmp_path):
    s = queries.fixture(spark, "/root/testdata/sf0.001")
    all_zones = s.raw_zones
    cut = 150
    early = s.bars.filter(F.col("bar_idx") < cut)
    known = all_zones.filter(F.col("last_idx") < cut - 1)
    seeds = streamed.seeds(zones.stages(known, early)).checkpoint()
    want = {(r["symbol"], r["tf"], r["zone_type"], r["level"]): r["status"] for r in zones.with_status(known, s.bars).collect()}
    later = s.bars.filter(F.col("bar_idx") >= cut).select("symbol", "tf", "ts", "open", "high", "low", "close", "bar_idx").checkpoint()
    moved = run(spark, str(tmp_path), later, seeds, [(cut, cut + 90), (cut + 90, 500)], keep=datetime.timedelta(days=10_000))
    got = {(r["symbol"], r["tf"], r["zone_type"], r["level"]): streamed.status(r["tested"], r["broken"], r["retested"], r["undone"]) for r in seeds.collect()}
    started = dict(got)
    for r in sorted(moved, key=lambda r: r["ts"]):
        key = (r["symbol"], r["tf"], r["zone_type"], r["level"])
        assert got[key] == r["before"] != r["status"]
        got[key] = r["status"]
    assert got == want and moved and started != got


def test_repeated_and_older_bars_are_passed_over_and_old_frames_go(spark, rocks, tmp_path):
    zone = [("A", "Daily", "Support", 100.0, 1.0, False, False, False, False)]
    seeds = spark.createDataFrame(zone, "symbol string, tf string, zone_type string, level double, tolerance double, tested boolean, broken boolean, retested boolean, undone boolean")
    day = lambda d, high, low, close, k, s="A": (s, "Daily", START + datetime.timedelta(days=d), float(close), float(high), float(low), float(close), k)
    rows = [day(5, 104, 103, 103.5, 0), day(6, 102, 100, 101, 0), day(3, 101, 90, 91, 1), day(6, 101, 90, 91, 1), day(7, 103, 102, 102.5, 1), day(200, 110, 109, 109.5, 2, "B"), day(201, 110, 109, 109.5, 3, "B"), day(202, 101, 90, 91, 4)]
    bars = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp, open double, high double, low double, close double, bar_idx int")
    moved = run(spark, str(tmp_path), bars, seeds, [(k, k + 1) for k in range(5)], keep=datetime.timedelta(days=30))
    assert [(r["before"], r["status"], r["ts"].day) for r in moved] == [(streamed.FRESH, streamed.TESTED, 6 + 1)]  # the frame's zones are gone when its late break comes


@pytest.mark.parametrize("kind, bars, want", [
    ("Support", [(103, 102, 102.5)], streamed.FRESH), ("Support", [(102, 100.5, 101.5)], streamed.TESTED), ("Support", [(99, 90, 91)], streamed.CONSUMED), ("Support", [(99, 90, 91), (99.5, 98, 98.5)], streamed.REVERSED),
    ("Support", [(99, 90, 91), (99.5, 98, 98.5), (103, 98, 102)], streamed.CONSUMED), ("Support", [(99, 90, 91), (103, 98, 102)], streamed.REVERSED),
    ("Resistance", [(99.5, 98, 98.5)], streamed.TESTED), ("Resistance", [(105, 100, 104)], streamed.CONSUMED), ("Resistance", [(105, 100, 104), (103, 101, 102)], streamed.REVERSED), ("Resistance", [(105, 100, 104), (103, 101, 102), (99, 90, 91)], streamed.CONSUMED),
])
def test_steps_of_a_zone(kind, bars, want):
    zone = kind, 100.0, 1.0, False, False, False, False
    for bar in bars:
        zone = streamed.advanced(zone, *bar)
    assert streamed.status(*zone[3:]) == want
