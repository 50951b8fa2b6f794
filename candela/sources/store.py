"""Fetched candles kept between scans, failures and empty answers too.

Two append-only logs of Parquet files in one folder: `bars`, every candle ever
fetched with the time of its fetch and its place in the answer, and `fetches`, a
row for each answer with its number of candles (0 for failures and empty
answers). What counts is derived from them: of each (symbol, tf, ts) the last
arrival, of each (symbol, tf) the last fetch. A frame is asked for again when its
last fetch is older than its time frame allows (sooner if the answer was empty),
so a scan sends requests for stale frames only.

An append that fails leaves nothing that is read, as Spark commits files
at a job's end; bars are appended before their fetch, so a crash between the two
costs one more request. compact() writes what counts to the next generation of
both logs and readers take the last complete one.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.hashes import is_fresh
from candela.schema import BARS
from candela.sources import payloads
from candela.storage import written

BAR_LOG = f"{BARS}, fetched_at timestamp, arrival int"
FETCH_LOG = "symbol string, tf string, fetched_at timestamp, rows long"
FRAME = ["symbol", "tf"]


def upserted(log: DataFrame, order: tuple[str, ...] = ("fetched_at", "arrival")) -> DataFrame:
    """Of each (symbol, tf, ts) the row that arrived last; rows are merged before they are shuffled."""
    rest = [c for c in log.columns if c not in (*FRAME, "ts")]
    last = log.groupBy(*FRAME, "ts").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*(F.col(c) if c in (*FRAME, "ts") else F.col(f"last.{c}").alias(c) for c in log.columns))


def latest(fetches: DataFrame) -> DataFrame:
    """(symbol, tf, fetched_at, rows): the last fetch of each frame."""
    return fetches.groupBy(*FRAME).agg(F.max("fetched_at").alias("fetched_at"), F.max_by("rows", "fetched_at").alias("rows"))


def stale(requested: DataFrame, fetches: DataFrame, now) -> DataFrame:
    """(symbol, tf, reason): the requested frames to ask for at that time (a timestamp or an expression); reason is never, empty or old."""
    now = F.lit(now) if isinstance(now, datetime.datetime) else now
    rows = requested.select(*FRAME).distinct().join(latest(fetches), FRAME, "left")
    age = now.cast("double") - F.col("fetched_at").cast("double")
    fresh = F.coalesce(is_fresh(F.col("tf"), age, F.col("rows")), F.lit(False))
    reason = F.when(F.col("fetched_at").isNull(), "never").when(F.col("rows") == 0, "empty").otherwise("old")
    return rows.filter(~fresh).select(*FRAME, reason.alias("reason"))


class CandleStore:
    """The logs under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generation(self) -> int:
        """The last complete generation; 0 is the first."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return 0
        found = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("generation=")]
        done = [int(p.getName().split("=")[1]) for p in found if files.exists(context._jvm.org.apache.hadoop.fs.Path(p, "fetches/_SUCCESS"))]
        return max(done, default=0)

    def _log(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/generation={self._generation()}/{name}"
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def fetches(self) -> DataFrame:
        return latest(self._log("fetches", FETCH_LOG))

    def bars(self) -> DataFrame:
        """(symbol, tf, ts, open, high, low, close, volume), last arrivals, of the frames whose last fetch gave any."""
        full = self.fetches().filter("rows > 0")
        return upserted(self._log("bars", BAR_LOG)).join(full.select(*FRAME), FRAME, "left_semi").drop("fetched_at", "arrival")

    def stale(self, requested: DataFrame, now: datetime.datetime) -> DataFrame:
        return stale(requested, self._log("fetches", FETCH_LOG), now)

    def record(self, answers: DataFrame, at: datetime.datetime) -> DataFrame:
        """Appends what a fetch gave, as (symbol, tf, payload); gives the frames that couldn't be read."""
        rows = written(payloads.parsed(answers))
        bars = written(payloads.usable_candles(rows))
        arrival = F.lit(0)  # starts are unique within an answer
        base = f"{self.path}/generation={self._generation()}"
        bars.withColumn("fetched_at", F.lit(at)).withColumn("arrival", arrival).select(*(c.split()[0] for c in BAR_LOG.split(", "))).write.mode("append").parquet(f"{base}/bars")
        counts = bars.groupBy(*FRAME).agg(F.count("*").alias("rows"))
        asked = answers.select(*FRAME).distinct().join(counts, FRAME, "left")
        asked.select(*FRAME, F.lit(at).alias("fetched_at"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows")).write.mode("append").parquet(f"{base}/fetches")
        return payloads.frame_errors(rows)

    def refresh(self, requested: DataFrame, now: datetime.datetime, **options: str) -> DataFrame:
        """Asks the REST source for the stale frames, records the answers, gives the bars. requested is a list of instruments' frames."""
        frames = sorted(f"{r['symbol']}:{r['tf']}" for r in self.stale(requested, now).collect())
        if frames:
            answers = self.spark.read.format("candles_rest").options(frames=",".join(frames), **options).load()
            self.record(written(answers), now)
        return self.bars().join(requested.select(*FRAME).distinct(), FRAME, "left_semi")

    def compact(self) -> None:
        """What counts, as the next generation."""
        n = self._generation() + 1
        upserted(self._log("bars", BAR_LOG)).write.mode("overwrite").parquet(f"{self.path}/generation={n}/bars")
        self.fetches().write.mode("overwrite").parquet(f"{self.path}/generation={n}/fetches")
