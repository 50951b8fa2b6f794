"""Volatility and trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scores import finite
from candela.schema import TF_TREND, by_tf

GROUP = ("symbol", "tf")
PERIOD = 14


def true_range(bars: DataFrame) -> DataFrame:
    """bars with true_range; greatest() skips the first bar's missing previous close."""
    previous = F.lag("close").over(Window.partitionBy(*GROUP).orderBy("bar_idx"))
    return bars.withColumn("previous", previous).withColumn(
        "true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("previous")), F.abs(F.col("low") - F.col("previous")))
    ).drop("previous")


def atr(bars: DataFrame, period: int = PERIOD) -> DataFrame:
    """(symbol, tf, n_bars, last_close, atr); atr is null for fewer than two bars or if it isn't positive."""
    recent = F.avg(F.when(F.col("bar_idx") >= F.col("n_bars") - period, F.col("true_range")))
    found = true_range(bars).groupBy(*GROUP, "n_bars").agg(recent.alias("recent"), F.avg(F.col("high") - F.col("low")).alias("spread"), F.max_by("close", "bar_idx").alias("last_close"))
    value = F.when(F.col("n_bars") > period, F.col("recent")).when(F.col("n_bars") >= 2, F.col("spread"))
    return found.select(*GROUP, "n_bars", "last_close", F.when(value > 0, value).alias("atr"))


def trend_labels(bars: DataFrame) -> DataFrame:
    """(symbol, tf, slope, trend): the slope's t value over the last closes; deviations are taken in a second pass."""
    look = by_tf({k: v[0] for k, v in TF_TREND.items()}, 20)
    limit = by_tf({k: v[1] for k, v in TF_TREND.items()}, 2.0)
    group = Window.partitionBy(*GROUP)
    recent = bars.withColumn("look", look).withColumn("x", F.col("bar_idx") - (F.col("n_bars") - F.col("look")))
    recent = recent.filter("x >= 0").withColumn("base", F.first("close").over(group.orderBy("bar_idx")))
    sound = F.min(finite(F.col("close")).cast("int")).over(group)
    recent = recent.withColumn("sound", (F.col("n_bars") >= F.col("look")) & (sound == 1) & (F.col("base") != 0)).withColumn("y", F.try_divide("close", "base"))
    fit = recent.withColumn("slope", F.regr_slope("y", "x").over(group)).withColumn("intercept", F.regr_intercept("y", "x").over(group))
    left = fit.withColumn("resid", F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept")))
    found = left.groupBy(*GROUP).agg(F.first("sound").alias("sound"), F.first("slope").alias("slope"), F.stddev_samp("resid").alias("std"), F.count("*").alias("n"))
    t = F.try_divide(F.col("slope"), F.col("std") / F.sqrt("n"))
    usable = F.coalesce(F.col("sound") & (F.col("std") > 0), F.lit(False))
    trend = F.when(usable & (t > limit), "HAUSSIER").when(usable & (t < -limit), "BAISSIER").otherwise("NEUTRE")
    return found.select(*GROUP, F.when(F.col("sound"), F.col("slope")).alias("slope"), trend.alias("trend"))
