"""Bars from tables of trades.

walk() reads a price path off lineitem: the steps of a symbol's trades are
summed up in time order. No task accumulates a symbol's path, nor an instant's
trades, which grow with the table while instants don't: trades of an instant are
cut into slices by order key. Steps are added up for each slice (before they are
shuffled), the slices' sums are accumulated, and only within a slice trades are
accumulated one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SYMBOLS = {"A": "EUR_USD", "N": "USD_JPY", "R": "XAU_USD"}
SCALE = {"XAU_USD": 20.0}
#: Order keys of a slice: so many trades of one instant, or a few more, are accumulated one by one.
SLICE = 1 << 16


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, place, price): trades in order; place numbers those of one instant."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    symbol = F.lit(None).cast("string")
    for flag, name in SYMBOLS.items():
        symbol = F.when(F.col("l_returnflag") == flag, name).otherwise(symbol)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        symbol.alias("symbol"),
        F.timestamp_seconds(F.unix_timestamp("l_shipdate") + ((F.col("l_linenumber") - 1) % 6) * 14400).alias("ts"),
        (F.round(F.col("l_extendedprice") * 100).cast("bigint") % 201 - 100).alias("step"),
        *keys,
    )
    rows = rows.withColumn("slice", F.floor(F.col("l_orderkey") / SLICE))
    slices = rows.groupBy("symbol", "ts", "slice").agg(F.sum("step").alias("total"), F.count("*").alias("n"))
    instant, symbol_so_far = Window.partitionBy("symbol", "ts"), Window.partitionBy("symbol")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    instants = slices.groupBy("symbol", "ts").agg(F.sum("total").alias("total"))
    instants = instants.select("symbol", "ts", earlier("total", symbol_so_far.orderBy("ts")).alias("so_far"))
    slices = slices.select("symbol", "ts", "slice", earlier("total", instant.orderBy("slice")).alias("within"), earlier("n", instant.orderBy("slice")).alias("above"))
    slices = slices.join(instants, ["symbol", "ts"]).select("symbol", "ts", "slice", (F.col("so_far") + F.col("within")).alias("before"), "above")
    within = Window.partitionBy("symbol", "ts", "slice").orderBy(*keys)
    moved = F.col("before") + F.sum("step").over(within.rowsBetween(Window.unboundedPreceding, 0))
    scale = F.lit(1.0)
    for name, by in SCALE.items():
        scale = F.when(F.col("symbol") == name, by).otherwise(scale)
    return rows.join(slices, ["symbol", "ts", "slice"]).select("symbol", "ts", (F.col("above") + F.row_number().over(within)).alias("place"), ((100.0 + moved / 1000.0) * scale).alias("price"))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, place, price): events as trades of one symbol for each type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("place"), (100.0 + F.col("value") / 10.0).alias("price"))


def start_of(ts, tf: str):
    """Start of the bar that ts falls into; weeks start on Monday."""
    if tf == "H4":
        return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 14400) * 14400)
    return F.date_trunc({"Daily": "day", "Weekly": "week"}[tf], ts)


def bars_h4(ticks: DataFrame) -> DataFrame:
    order = F.struct("ts", "place")
    return (
        ticks.groupBy("symbol", start_of(F.col("ts"), "H4").alias("start"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume"))
        .select("symbol", F.lit("H4").alias("tf"), F.col("start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def rolled(h4: DataFrame, tf: str) -> DataFrame:
    """Longer bars from H4 bars: trades are read once for all time frames."""
    return (
        h4.groupBy("symbol", start_of(F.col("ts"), tf).alias("start"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.lit(tf).alias("tf"), F.col("start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def all_bars(ticks: DataFrame) -> DataFrame:
    h4 = bars_h4(ticks)
    return h4.unionByName(rolled(h4, "Daily")).unionByName(rolled(h4, "Weekly"))
