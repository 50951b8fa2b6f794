"""A whole scan: bars and quotes in, zones, confluences, summaries and anomalies out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scores import finite
from candela.operators import confluence, exports, indicators, pivots, quality, trend_zones, zones
from candela.operators import bars as bar_ops
from candela.schema import TIMEFRAMES, UI_CONFLUENCE_THRESHOLD, UI_MIN_TOUCHES, with_profile
from candela.sources import payloads
from candela.storage import written

#: What readers see of numbers that overflow.
INNER_ERROR = "Erreur interne : ValueError"
GROUP = ["symbol", "tf"]


def min_touches(own: int = UI_MIN_TOUCHES) -> Column:
    """The profile's for indices, metals and yen pairs, else the larger of that and the user's."""
    of_profile = F.when(F.col("tf") == "H4", F.col("min_touches_h4")).when(F.col("tf") == "Daily", F.col("min_touches_daily")).when(F.col("tf") == "Weekly", F.col("min_touches_weekly")).otherwise(2)
    fixed = F.col("asset_class").isin("INDEX", "METAL") | F.col("symbol").endswith("_JPY")
    return F.when(fixed, of_profile).otherwise(F.greatest(of_profile, F.lit(own)))


@dataclass
class Scan:
    """Each property is a lazy DataFrame; symbols that were asked for are a column `symbol`.

    Bars, context, pivots and zones are written once, as many later stages
    read them; none has more than a few hundred rows for each (symbol, tf).
    """

    raw_bars: DataFrame
    quotes: DataFrame
    symbols: DataFrame
    own_min_touches: int = UI_MIN_TOUCHES
    own_threshold: float | None = UI_CONFLUENCE_THRESHOLD
    frame_errors: DataFrame | None = None  # (symbol, tf, error): frames that couldn't be read

    @classmethod
    def of_payloads(cls, candles: DataFrame, quotes: DataFrame, symbols: DataFrame, **kw) -> Scan:
        """From what the services sent: candles (symbol, tf, payload), quotes (symbol, payload). A body that can't be read costs its own frame only."""
        rows = written(payloads.parsed(candles))
        return cls(payloads.usable_candles(rows), payloads.quotes(quotes), symbols, frame_errors=payloads.frame_errors(rows), **kw)

    @cached_property
    def bars(self) -> DataFrame:
        return written(bar_ops.prepared(self.raw_bars))

    @cached_property
    def prices(self) -> DataFrame:
        return quality.bounded(quality.working_price(self.symbols, self.quotes, self.bars))

    @cached_property
    def context(self) -> DataFrame:
        """One row for each (symbol, tf): n_bars, last_close, atr, price, the profile and min_touches."""
        rows = indicators.atr(self.bars).join(self.prices.select("symbol", "price", "daily_close", "source", "is_fallback"), "symbol")
        rows = rows.withColumn("broken", F.max(F.col("atr").isNotNull() & ~finite(F.col("atr"))).over(Window.partitionBy("symbol")))
        return written(with_profile(rows).withColumn("min_touches", min_touches(self.own_min_touches)))

    @cached_property
    def usable(self) -> DataFrame:
        return self.context.filter("atr > 0 and price > 0 and not broken").drop("broken")

    @cached_property
    def symbol_errors(self) -> DataFrame:
        """(symbol, scan_error) of the symbols that give no result: without a price, with a corrupt one, or with numbers that overflow."""
        inner = self.context.filter("broken").select("symbol").distinct().withColumn("inner_error", F.lit(INNER_ERROR))
        rows = self.prices.select("symbol", "price_error").join(inner, "symbol", "left")
        return rows.select("symbol", F.coalesce("price_error", "inner_error").alias("scan_error")).filter("scan_error is not null")

    @cached_property
    def pivots(self) -> DataFrame:
        return written(pivots.pivots(self.bars, self.usable))

    @cached_property
    def clusters(self) -> DataFrame:
        return zones.clustered(self.pivots, self.usable)

    @cached_property
    def raw_zones(self) -> DataFrame:
        return zones.from_clusters(self.clusters, self.usable)

    @cached_property
    def trend_zones(self) -> DataFrame:
        return trend_zones.trend_zones(self.bars, self.usable.filter("asset_class in ('INDEX', 'METAL')"))

    @cached_property
    def merged(self) -> DataFrame:
        swing = zones.with_status(self.raw_zones, self.bars)
        return zones.merged(swing.unionByName(self.trend_zones.select(*swing.columns)), self.usable)

    @cached_property
    def zones(self) -> DataFrame:
        """Strong zones with side, near_price and their context's price, atr and n_bars."""
        rows = self.merged.join(self.usable.select(*GROUP, "price", "atr", "n_bars", "pdf_max_dist_pct"), GROUP)
        return written(zones.sided(zones.reclassified(rows)).withColumn("near_price", zones.near_price()))

    @cached_property
    def confluences(self) -> DataFrame:
        return confluence.confluences(self.zones, self.own_threshold)

    @cached_property
    def anomalies(self) -> DataFrame:
        return quality.anomalies(self.prices, self.zones)

    @cached_property
    def trends(self) -> DataFrame:
        return indicators.trend_labels(self.bars)

    @cached_property
    def rows(self) -> DataFrame:
        return exports.display_rows(self.zones)

    @cached_property
    def summary(self) -> DataFrame:
        """One row for each symbol asked for, also for those without data."""
        trend = self.trends.groupBy("symbol").agg(*(F.max(F.when(F.col("tf") == tf, F.col("trend"))).alias(f"trend_{tf.lower()}") for tf in TIMEFRAMES))
        rows = self.symbols.join(trend, "symbol", "left").join(exports.price_context(self.zones), "symbol", "left").join(self.prices, "symbol", "left").join(self.symbol_errors, "symbol", "left")
        neutral = [F.coalesce(f"trend_{tf.lower()}", F.lit("NEUTRE")).alias(f"trend_{tf.lower()}") for tf in TIMEFRAMES]
        price = F.when(F.col("scan_error").isNull(), F.col("price"))
        return rows.select("symbol", *neutral, F.coalesce("price_context", F.lit("")).alias("price_context"), price.alias("current_price"), F.when(price.isNotNull(), F.col("source")).alias("current_price_source"), "scan_error")

    def results(self) -> DataFrame:
        """scan_results: a row for each symbol with maps and lists; a symbol with an error has no other values but its frames' errors."""
        fine = F.col("scan_error").isNull()
        per_tf = self.trends.join(self.context.select(*GROUP, "n_bars"), GROUP).groupBy("symbol").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("tf", "trend")))).alias("trends"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tf", "n_bars")))).alias("bars_map"), F.collect_set("tf").alias("tfs")
        )
        rows = self.summary.join(per_tf, "symbol", "left").join(self.anomalies, "symbol", "left")
        if self.frame_errors is not None:
            broken = self.frame_errors.groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tf", "error")))).alias("frame_errors"))
            rows = rows.join(broken, "symbol", "left")
        missing = F.array_except(F.array(*map(F.lit, TIMEFRAMES)), F.coalesce("tfs", F.array().cast("array<string>")))
        rows = rows.withColumn("missing_tfs", missing).drop("tfs")
        return rows.withColumns({c: F.when(fine, F.col(c)) for c in ("trends", "bars_map", "anomaly", "missing_tfs", "price_context", *(f"trend_{tf.lower()}" for tf in TIMEFRAMES))})

    def totals(self, max_dist: float = 2.0, json_score: float = 20.0, brief_score: float = 57.0) -> DataFrame:
        """Counts for each (symbol, tf), each symbol and all, in one pass of grouping sets."""
        item = lambda df, kind, tf="tf": df.select("symbol", F.col(tf) if tf else F.lit(None).cast("string").alias("tf"), F.lit(kind).alias("kind"))
        kinds = [
            item(self.pivots, "pivots"), item(self.trend_zones, "trend_zones"), item(self.zones, "zones"), item(self.confluences, "after_confluence", None),
            item(confluence.filtered(self.confluences, max_dist, json_score), "exported_json", None), item(confluence.filtered(self.confluences, max_dist, brief_score), "exported_llm", None),
        ]
        rows = kinds[0]
        for more in kinds[1:]:
            rows = rows.unionByName(more)
        counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("pivots", "trend_zones", "zones", "after_confluence", "exported_json", "exported_llm")]
        grouped = rows.groupingSets([["symbol", "tf"], ["symbol"], []], "symbol", "tf").agg(F.grouping_id().alias("level"), *counts)
        return grouped.filter("not (level = 0 and tf is null)")


def scan(bars: DataFrame, quotes: DataFrame, symbols: DataFrame, own_min_touches: int = UI_MIN_TOUCHES, own_threshold: float | None = UI_CONFLUENCE_THRESHOLD) -> dict[str, DataFrame]:
    """The tables that a scan gives. own_threshold: percent between zones of a confluence; None takes each profile's."""
    s = Scan(bars, quotes, symbols, own_min_touches, own_threshold)
    return {"zones": s.zones, "confluences": s.confluences, "rows": s.rows, "summary": s.summary, "anomalies": s.anomalies, "results": s.results()}
