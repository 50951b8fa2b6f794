"""Types, time frames and instrument profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume bigint"

# Names of time frames and states, weights, and calibrations of instruments.
TIMEFRAMES = ("H4", "Daily", "Weekly")
TF_WEIGHT = {"H4": 1.0, "Daily": 2.0, "Weekly": 3.0}
TF_LAMBDA = {"H4": 2.0, "Daily": 1.0, "Weekly": 0.5}
TF_TREND = {"H4": (50, 2.0), "Daily": (50, 1.8), "Weekly": (20, 1.5)}
TF_PEAK_DISTANCE = {"H4": 5, "Daily": 8, "Weekly": 10}
STATUSES = ("Vierge", "Testee", "Role Reverse", "Consommee")
CONFLUENCE_THRESHOLDS = {"US30_USD": 1.5, "NAS100_USD": 1.5, "SPX500_USD": 1.2, "XAU_USD": 1.5, "DE30_EUR": 1.3}
UI_CONFLUENCE_THRESHOLD, UI_MIN_TOUCHES = 0.8, 2
CORRUPTION_FACTOR = 10.0
FOREX_BASES = ("EUR", "GBP", "AUD", "NZD", "CAD", "CHF", "USD")

PROFILE = (
    "profile_key string, asset_class string, cluster_radius_atr double, merge_threshold_atr double, pivot_prominence_atr double,"
    " skip_ratio_check boolean, wick_intraday double, wick_htf double, confluence_threshold_pct double,"
    " max_live_vs_close_pct double, pdf_max_dist_pct double, price_min double, price_max double, min_touches_h4 int, min_touches_daily int,"
    " min_touches_weekly int, ignore_wick_filter boolean, major_pivot_mult double, max_high_low_ratio double, max_cluster_width_pct double"
)


def _profile(key, kind, cluster, merge, prominence, skip, low=None, high=None, touches=(2, 2, 2), wickless=False, major=3.0, ratio=1.8, width=1.0):
    return (key, kind, cluster, merge, prominence, skip, 0.20, 0.30, 1.0, 5.0, 5.0, low, high, *touches, wickless, major, ratio, width)


_FREE = {"touches": (1, 2, 2), "wickless": True, "major": 0.5, "ratio": 2.5, "width": 1.5}
_YEN = {"touches": (1, 1, 1), "wickless": True, "major": 0.5}
# Calibrations of instruments.
PROFILES = [
    _profile("EUR_USD", "FOREX", 1.2, 0.8, 0.6, False),
    _profile("GBP_USD", "FOREX", 1.3, 0.85, 0.65, False, touches=(2, 2, 1)),
    _profile("USD_JPY", "FOREX", 0.9, 0.5, 0.2, False, **_YEN),
    _profile("XAU_USD", "METAL", 2.5, 1.5, 0.3, True, 1500.0, 8000.0, **_FREE),
    _profile("US30_USD", "INDEX", 2.5, 1.5, 0.4, True, 25000.0, 60000.0, **_FREE),
    _profile("NAS100_USD", "INDEX", 2.5, 1.5, 0.4, True, 10000.0, 50000.0, **_FREE),
    _profile("SPX500_USD", "INDEX", 2.2, 1.2, 0.35, True, 3000.0, 12000.0, **_FREE),
    _profile("DE30_EUR", "INDEX", 2.2, 1.2, 0.35, True, 10000.0, 30000.0, **_FREE),
    _profile("*JPY", "FOREX", 0.9, 0.5, 0.2, False, **_YEN),
    _profile("*BASE", "FOREX", 1.2, 0.8, 0.5, False),
    _profile("DEFAULT", "FOREX", 1.2, 0.8, 0.6, False),
]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE)


def normal_symbol(symbol: Column) -> Column:
    return F.trim(F.replace(F.upper(symbol), F.lit("/"), F.lit("_")))


def profile_key(symbol: Column) -> Column:
    """The profile a symbol gets: its own, else by quote currency, else by base currency, else the default."""
    name = normal_symbol(symbol)
    exact = [p[0] for p in PROFILES if p[0][0] != "*" and p[0] != "DEFAULT"]
    parts = F.split(name, "_")
    return F.when(name.isin(exact), name).when(F.get(parts, F.lit(1)) == "JPY", "*JPY").when(F.get(parts, F.lit(0)).isin(list(FOREX_BASES)), "*BASE").otherwise("DEFAULT")


def with_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df (with symbol) and the columns of its profile, all (profile_key too) or those that are named; profiles are a constant handful of rows."""
    known = profiles(df.sparkSession)
    wanted = known.columns if columns is None else columns
    if clash := sorted(set(wanted) & set(df.columns)):
        raise ValueError(f"columns of the profile that the rows have already: {', '.join(clash)}")
    rows = df.withColumn("its_profile", profile_key(F.col("symbol"))).join(F.broadcast(known.select(F.col("profile_key").alias("its_profile"), *wanted)), "its_profile")
    return rows.drop("its_profile") if "profile_key" in wanted or columns is not None else rows.withColumnRenamed("its_profile", "profile_key")


def by_tf(values: dict, default, tf: Column | str = "tf") -> Column:
    tf = F.col(tf) if isinstance(tf, str) else tf
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(tf == name, F.lit(value)).otherwise(out)
    return out


def severity(status: Column) -> Column:
    out = F.lit(1)
    for i, name in enumerate(STATUSES):
        out = F.when(status == name, i).otherwise(out)
    return out


def status_of(level: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATUSES)), level)


def pivot_reach(tf: Column | str = "tf") -> Column:
    """Bars on either side that a pivot must top."""
    return by_tf({"Weekly": 5}, 3, tf)
