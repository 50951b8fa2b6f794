"""Validation, de-duplication and numbering of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scores import finite
from candela.schema import with_profile

LIMIT = 500
GROUP = ("symbol", "tf")


def geometry_ok() -> Column:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    whole = finite(o) & finite(h) & finite(lo) & finite(c)
    return F.coalesce(whole & (lo > 0) & (h > 0) & (h >= lo) & o.between(lo, h) & c.between(lo, h), F.lit(False))


def valid(max_ratio: Column) -> Column:
    return geometry_ok() & F.coalesce(F.try_divide("high", "low") <= max_ratio, F.lit(False))


def with_validity(bars: DataFrame) -> DataFrame:
    """bars with is_valid: sound geometry and a high/low ratio that the symbol's profile allows."""
    return with_profile(bars).withColumn("is_valid", valid(F.col("max_high_low_ratio"))).select(*bars.columns, "is_valid")


def keep_last(bars: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Of bars with the same start the one that arrived last."""
    last = Window.partitionBy(*GROUP, "ts").orderBy(F.col(arrival).desc())
    return bars.withColumn("place", F.row_number().over(last)).filter("place = 1").drop("place")


def sanitized(bars: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Without nulls, then one bar for each start, then the valid ones: a late invalid bar hides an earlier valid one."""
    whole = bars.dropna(subset=["open", "high", "low", "close"])
    return with_validity(keep_last(whole, arrival)).filter("is_valid").drop("is_valid")


def last_n(bars: DataFrame, limit: int = LIMIT, order: str = "ts") -> DataFrame:
    latest = Window.partitionBy(*GROUP).orderBy(F.col(order).desc())
    return bars.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= limit).drop("place")


def numbered(bars: DataFrame) -> DataFrame:
    """bars with bar_idx (from 0) and n_bars of their (symbol, tf)."""
    group = Window.partitionBy(*GROUP)
    return bars.withColumn("bar_idx", F.row_number().over(group.orderBy("ts")) - 1).withColumn("n_bars", F.count("*").over(group).cast("int"))


def prepared(bars: DataFrame, limit: int = LIMIT, arrival: str = "arrival") -> DataFrame:
    """What the operators work on: of each (symbol, tf) the last `limit` valid bars by arrival, then the last of each start, numbered.

    Bars without a column of that name arrive in order of their start; repeated
    starts then have no order of their own, and the one with the greatest
    values stays.
    """
    valid_bars = with_validity(bars).filter("is_valid").drop("is_valid")
    if arrival in bars.columns:
        return numbered(sanitized(last_n(valid_bars, limit, arrival), arrival).drop(arrival))
    latest = last_n(valid_bars.withColumn("its_order", F.struct("ts", *(F.col(c) for c in ("open", "high", "low", "close", "volume") if c in bars.columns))), limit, "its_order")
    return numbered(sanitized(latest, "its_order").drop("its_order"))
