"""Prices to work with, their bounds, anomalies and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.scores import finite
from candela.schema import CORRUPTION_FACTOR, with_profile


def last_closes(bars: DataFrame) -> DataFrame:
    """(symbol, last_Daily, last_H4, last_Weekly)."""
    own = lambda tf: F.max_by(F.when(F.col("tf") == tf, F.col("close")), F.when(F.col("tf") == tf, F.col("ts"))).alias(f"last_{tf}")
    return bars.groupBy("symbol").agg(*map(own, ("Daily", "H4", "Weekly")))


def working_price(symbols: DataFrame, quotes: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, raw_price, is_fallback, source): the quote, else the last close of daily, H4 or weekly bars, else null."""
    rows = symbols.join(quotes.select("symbol", F.col("price").alias("quote"), F.col("source").alias("quoted")), "symbol", "left").join(last_closes(bars), "symbol", "left")
    good = lambda c: F.when(finite(F.col(c)) & (F.col(c) > 0), F.col(c))
    live, close = good("quote"), F.coalesce(good("last_Daily"), good("last_H4"), good("last_Weekly"))
    source = F.when(live.isNotNull(), F.when(F.col("quoted").isin("live", "stale"), F.col("quoted")).otherwise("live")).when(close.isNotNull(), "candle_close")
    return rows.select("symbol", F.coalesce(live, close).alias("raw_price"), (live.isNull() & close.isNotNull()).alias("is_fallback"), source.alias("source"), F.col("last_Daily").alias("daily_close"))


def bounded(prices: DataFrame) -> DataFrame:
    """prices with price (clipped to the profile's bounds; null if it is ten times beyond) and price_error."""
    rows, p = with_profile(prices), F.col("raw_price")
    low, high = F.col("price_min"), F.col("price_max")
    corrupt_low, corrupt_high = p < low / CORRUPTION_FACTOR, p > high * CORRUPTION_FACTOR
    message = lambda sign, bound: F.format_string(f"PRIX CORROMPU (%.2f {sign} %.0f)", p, bound)
    error = F.when(p.isNull(), "Aucune donnee disponible").when(corrupt_low, message("<<", low)).when(corrupt_high, message(">>", high))
    price = F.when(error.isNotNull(), None).when(p < low, low).when(p > high, high).otherwise(p)
    return rows.withColumn("price_error", error).withColumn("price", price).select(*prices.columns, "price", "price_error")


def support_ratio(zones: DataFrame) -> DataFrame:
    """(symbol, n_supports, median_support): the median of all time frames' support levels."""
    return zones.filter("side = 'Support'").groupBy("symbol").agg(F.count("*").alias("n_supports"), F.median("level").alias("median_support"))


def anomalies(prices: DataFrame, zones: DataFrame) -> DataFrame:
    """(symbol, anomaly), null if nothing is odd. prices: symbol, price, source, is_fallback, daily_close."""
    rows = with_profile(prices.join(support_ratio(zones), "symbol", "left"))
    p = F.col("price")
    aberrant = ~F.col("skip_ratio_check") & (F.col("n_supports") >= 3) & (F.col("median_support") > 0) & (F.try_divide(p, F.col("median_support")) > 3.0)
    off = F.when(F.col("daily_close") > 0, F.abs(p - F.col("daily_close")) / F.col("daily_close") * 100)
    flags = F.concat_ws(
        " | ",
        F.when(p < F.col("price_min"), "PRIX < MIN"),
        F.when(p > F.col("price_max"), "PRIX > MAX"),
        F.when(aberrant, "Ecart aberrant"),
        F.when(off > F.col("max_live_vs_close_pct"), F.format_string("Ecart live/close (%.1f%%)", off)),
        F.when(F.col("is_fallback"), "Prix fallback"),
        F.when(F.col("source") == "stale", "Prix STALE (marché fermé)"),
    )
    return rows.select("symbol", F.when(p.isNull() | ~finite(p) | ~(p > 0), "Prix indisponible").otherwise(F.nullif(flags, F.lit(""))).alias("anomaly"))


def coverage(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """(symbol, gap): requested but missing, and returned without request."""
    missing = requested.join(returned, "symbol", "left_anti").select("symbol", F.lit("missing").alias("gap"))
    return missing.unionByName(returned.join(requested, "symbol", "left_anti").select("symbol", F.lit("extra").alias("gap"))).distinct()


def patched(results: DataFrame, requested: DataFrame) -> DataFrame:
    """results and an error row for each requested symbol without one."""
    gaps = requested.join(results, "symbol", "left_anti").select("symbol", F.lit("Symbole manquant dans les resultats").alias("scan_error"))
    return results.unionByName(gaps, allowMissingColumns=True)
