"""Levels around a log-linear regression of the last bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scores import finite
from candela.operators.indicators import GROUP

LEAST, LOOK = 30, 100


def log_fit(bars: DataFrame) -> DataFrame:
    """The last LOOK bars with fitted ln(close); groups with fewer than LEAST bars or prices that aren't positive have none."""
    group = Window.partitionBy(*GROUP)
    recent = bars.filter((F.col("n_bars") >= LEAST) & (F.col("bar_idx") >= F.col("n_bars") - LOOK))
    sound = finite(F.col("close")) & (F.col("close") > 0) & (F.col("high") > 0) & (F.col("low") > 0)
    recent = recent.withColumn("sound", F.min(sound.cast("int")).over(group)).filter("sound = 1")
    recent = recent.withColumn("x", F.col("bar_idx") - F.greatest(F.col("n_bars") - LOOK, F.lit(0))).withColumn("y", F.ln("close"))
    fit = recent.withColumn("slope", F.regr_slope("y", "x").over(group)).withColumn("intercept", F.regr_intercept("y", "x").over(group))
    return fit.withColumn("fitted", F.col("slope") * F.col("x") + F.col("intercept"))


def levels(bars: DataFrame, context: DataFrame, side: str) -> DataFrame:
    """Zones at one and two deviations beyond the tenth (support) or ninetieth percentile of the residuals.

    context: (symbol, tf, price, atr, asset_class).
    """
    support = side == "Support"
    sign = -1 if support else 1
    resid = F.ln("low" if support else "high") - F.col("fitted")
    fit = (
        log_fit(bars)
        .withColumn("resid", resid)
        .groupBy(*GROUP)
        .agg(F.percentile("resid", F.lit(0.10 if support else 0.90)).alias("anchor"), F.stddev_pop("resid").alias("std"), F.max_by("fitted", "bar_idx").alias("last_fit"))
    )
    price = F.col("price")
    zones = fit.join(context.filter("atr > 0 and price > 0"), list(GROUP))
    spare = F.when(F.abs("anchor") > 0, F.abs("anchor")).otherwise(F.col("atr") / F.greatest(price, F.lit(1e-9)))
    zones = zones.withColumn("band", F.when(finite(F.col("std")) & (F.col("std") > 0), F.col("std")).otherwise(spare))
    zones = zones.withColumn("mult", F.explode(F.array(F.lit(1.0), F.lit(2.0))))
    zones = zones.withColumn("raw", F.exp(F.col("last_fit") + F.col("anchor") + sign * F.col("mult") * F.col("band"))).filter(finite(F.col("raw")) & (F.col("raw") > 0))
    wrong = F.col("raw") >= price if support else F.col("raw") <= price
    zones = zones.withColumn("level", F.when(wrong, price * (1.0 + sign * 0.004 * F.col("mult"))).otherwise(F.col("raw")))
    farthest = F.when(F.col("asset_class") == "INDEX", 15.0).otherwise(8.0)
    zones = zones.filter((sign * (F.col("level") - price) > 0) & (sign * (F.col("level") - price) / price * 100 <= farthest))
    gap = F.abs(price - F.col("level"))
    return zones.select(
        *GROUP, "mult", "level", F.floor(F.col("mult") * 10 + 5).cast("int").alias("strength"), F.lit(0).alias("age_bars"), F.lit("Vierge").alias("status"), F.lit(side).alias("zone_type"),
        gap.alias("prominence"), (gap / F.col("atr")).alias("prominence_atr"), F.lit(True).alias("is_major"),
    )


def deduped(zones: DataFrame) -> DataFrame:
    """Of zones that agree in the fifth decimal of their level the first."""
    same = Window.partitionBy(*GROUP, "zone_type", F.floor(F.col("level") * 1e5 + 0.5)).orderBy("mult")
    return zones.withColumn("place", F.row_number().over(same)).filter("place = 1").drop("place", "mult")


def trend_zones(bars: DataFrame, context: DataFrame) -> DataFrame:
    return deduped(levels(bars, context, "Support")).unionByName(deduped(levels(bars, context, "Resistance")))
