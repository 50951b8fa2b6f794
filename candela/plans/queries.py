"""Each operator applied to whole tables. Doubles are quantised, times are text, so that engines agree."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.functions import hashes
from candela.functions.scores import decay_weight, quantised, structural_score
from candela.functions.text import latin_text, redact
from candela.operators import bars as bar_ops
from candela.operators import confluence, exports, indicators, pages, pivots, quality, trend_zones, zones
from candela.plans import memo
from candela.plans.scan import Scan, min_touches
from candela.schema import TIMEFRAMES, with_profile
from candela.sources import payloads, store, ticks
from candela.storage import written

#: What a scan of the fixture asks for; two have no bars.
REQUESTED = ("EUR_USD", "USD_JPY", "XAU_USD", "GBP_USD", "NAS100_USD")
NAMES = ("eur/usd", "GBP_USD", " usd_jpy ", "XAU_USD", "US30_USD", "NAS100_USD", "SPX500_USD", "DE30_EUR", "CAD_JPY", "AUD_NZD", "BTC_USDT", "CHF", "")


def symbols(spark: SparkSession, names=REQUESTED) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def quotes(bars: DataFrame) -> DataFrame:
    """A live quote for one symbol and a stale one for another, near the last daily close."""
    last = bars.filter("tf = 'Daily' and symbol in ('EUR_USD', 'USD_JPY')").groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    return last.select("symbol", (F.col("close") * 1.001).alias("price"), F.when(F.col("symbol") == "EUR_USD", "live").otherwise("stale").alias("source"))


#: Scans that the session has begun, by folder: their bars, pivots and zones are written once and serve every query.
_scans: dict[tuple[str, str], Scan] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Scan:
    """The scan of a folder's trades, shared by the session's queries."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _scans:
        for old in [k for k in _scans if k[0] != key[0]]:  # of sessions that have ended
            del _scans[old]
        _scans[key] = begun(spark, sf_dir)
    return _scans[key]


def begun(spark: SparkSession, sf_dir: str) -> Scan:
    h4 = written(ticks.bars_h4(ticks.walk(spark, sf_dir)))  # bars, no longer trades
    raw = h4.unionByName(ticks.rolled(h4, "Daily")).unionByName(ticks.rolled(h4, "Weekly"))
    return Scan(raw, quotes(raw), symbols(spark))


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.prepared(ticks.all_bars(ticks.event_ticks(spark, sf_dir)))


def shown(df: DataFrame) -> DataFrame:
    """Doubles quantised, timestamps as text."""
    turn = {"double": lambda c: quantised(F.col(c)), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    return df.select(*(turn[kind](c).alias(c) if kind in turn else F.col(c) for c, kind in df.dtypes))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: shown(fn(spark, sf_dir))
    return fn


def on_fixture(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: shown(fn(fixture(spark, sf_dir)))
    return fn


BAR = ("symbol", "ts", "open", "high", "low", "close", "volume")


def _bars(spark, sf_dir, tf):
    h4 = ticks.bars_h4(ticks.walk(spark, sf_dir))
    return (h4 if tf == "H4" else ticks.rolled(h4, tf)).select(*BAR)


@query
def bars_h4(spark, sf_dir):
    return _bars(spark, sf_dir, "H4")


@query
def bars_daily(spark, sf_dir):
    return _bars(spark, sf_dir, "Daily")


@query
def bars_weekly(spark, sf_dir):
    return _bars(spark, sf_dir, "Weekly")


def order_bars(spark, sf_dir):
    """Bars with every kind of fault, made of orders: five symbols, a bar a day, several arrivals for most days."""
    price = F.col("o_totalprice") / 1000.0
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("SYM"), (F.col("o_custkey") % 5).cast("string"), F.when(k % 2 == 0, "_USD").otherwise("_JPY")).alias("symbol"), F.lit("Daily").alias("tf"), F.to_timestamp("o_orderdate").alias("ts"),
        price.alias("open"), F.when(k % 7 == 0, price * 2.5).when(k % 11 == 0, price * 0.5).otherwise(price * 1.01).alias("high"), F.when(k % 13 == 0, -price).otherwise(price * 0.99).alias("low"),
        F.when(k % 17 == 0, None).otherwise(price).alias("close"), F.lit(1).cast("bigint").alias("volume"), k.alias("arrival"),
    )


@query
def bar_validity(spark, sf_dir):
    return bar_ops.with_validity(order_bars(spark, sf_dir)).select("arrival", "symbol", "is_valid")


@query
def bar_dedupe_keep_last(spark, sf_dir):
    return bar_ops.sanitized(order_bars(spark, sf_dir)).select("symbol", "ts", "arrival", "close")


@on_fixture
def last_n_bars(s):
    return s.bars.select("symbol", "tf", "bar_idx", "n_bars", "ts", "close")


@query
def profile_lookup(spark, sf_dir):
    rows = symbols(spark, NAMES)
    return with_profile(rows).select("symbol", "profile_key", "asset_class", "cluster_radius_atr", "merge_threshold_atr", "pivot_prominence_atr", "skip_ratio_check", "price_min", "price_max", "ignore_wick_filter", "major_pivot_mult", "max_high_low_ratio", "max_cluster_width_pct")


@query
def min_touches_by_tf(spark, sf_dir):
    rows = symbols(spark, NAMES[1:]).filter("trim(symbol) = symbol and symbol <> ''").withColumn("tf", F.explode(F.array(*map(F.lit, TIMEFRAMES))))
    return with_profile(rows).select("symbol", "tf", min_touches().alias("min_touches"))


@on_fixture
def true_range(s):
    return indicators.true_range(s.bars).select("symbol", "tf", "bar_idx", "true_range")


@on_fixture
def atr(s):
    return indicators.atr(s.bars)


@query
def atr_short_frame(spark, sf_dir):
    return indicators.atr(bar_ops.prepared(noise(spark, sf_dir).drop("bar_idx", "n_bars"), 9))


@on_fixture
def trend_label(s):
    return s.trends


@on_fixture
def trend_log_fit(s):
    return trend_zones.log_fit(s.bars).select("symbol", "tf", "bar_idx", "slope", "intercept", "fitted")


@on_fixture
def trend_support_levels(s):
    return trend_zones.levels(s.bars, s.usable, "Support").drop("status", "is_major", "age_bars")


@on_fixture
def trend_resistance_levels(s):
    return trend_zones.levels(s.bars, s.usable, "Resistance").drop("status", "is_major", "age_bars")


@on_fixture
def trend_zone_dedupe(s):
    return trend_zones.trend_zones(s.bars, s.usable).groupBy("symbol", "tf", "zone_type").agg(F.count("*").alias("n"), F.min("level").alias("lowest"), F.max("level").alias("highest"))


@on_fixture
def decay_weights(s):
    return s.bars.select("symbol", "tf", "bar_idx", decay_weight(F.col("bar_idx"), F.col("n_bars")).alias("weight"))


@on_fixture
def prominence_threshold(s):
    return s.usable.select("symbol", "tf", pivots.prominence_floor().alias("full"), pivots.prominence_floor(0.5).alias("half"))


@on_fixture
def swing_highs(s):
    return pivots.swings(s.bars).filter("is_high").select("symbol", "tf", "bar_idx", "high")


@on_fixture
def swing_lows(s):
    return pivots.swings(s.bars).filter("is_low").select("symbol", "tf", "bar_idx", "low")


@on_fixture
def swing_wick_filtered(s):
    return pivots.candidates(s.bars, s.usable).select("symbol", "tf", "kind", "bar_idx", "price")


@on_fixture
def pivot_prominence(s):
    return pivots.candidates(s.bars, s.usable).select("symbol", "tf", "kind", "bar_idx", "prominence", "full", "half")


@on_fixture
def pivot_fallback_tier(s):
    return pivots.tiered(pivots.candidates(s.bars, s.usable)).groupBy("symbol", "tf", "tier").agg(F.count("*").alias("n"), F.sum("prominence").alias("prominence"))


@on_fixture
def pivot_merge(s):
    found = pivots.candidates(s.bars, s.usable)
    lifted = found.filter("half").withColumn("prominence", F.col("prominence") * F.when(F.col("bar_idx") % 2 == 0, 1.5).otherwise(0.5))
    return pivots.merged(found.filter("full"), lifted).select("symbol", "tf", "kind", "bar_idx", "price", "prominence")


@on_fixture
def cluster_1d(s):
    return s.clusters.select("symbol", "tf", "kind", "bar_idx", "price", "cluster_id")


@on_fixture
def cluster_metrics(s):
    return zones.metrics(s.clusters)


@on_fixture
def zone_from_cluster(s):
    return s.raw_zones.select("symbol", "tf", "zone_type", "level", "strength", "age_bars", "prominence", "prominence_atr", "is_major")


@on_fixture
def zone_break_index(s):
    return zones.stages(s.raw_zones, s.bars).select("symbol", "tf", "zone_type", "level", "last_idx", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("break_idx", "retest_idx", "undone")))


@on_fixture
def zone_test_flags(s):
    count = lambda c: F.sum(F.col(c).cast("int")).alias(f"n_{c}")
    return zones.tests_and_breaks(s.raw_zones, s.bars).groupBy("symbol", "tf", "zone_type", "last_idx", "level").agg(*map(count, ("tested", "broke", "near", "undone")))


@on_fixture
def zone_status(s):
    return zones.with_status(s.raw_zones, s.bars).select("symbol", "tf", "zone_type", "level", "strength", "status")


@on_fixture
def zone_merge(s):
    return s.merged


@on_fixture
def zone_reclassify(s):
    rows = s.merged.join(s.usable.select("symbol", "tf", "price"), ["symbol", "tf"])
    return zones.reclassified(rows).select("symbol", "tf", "level", "zone_type", "strength")


@on_fixture
def zone_split(s):
    return s.zones.select("symbol", "tf", "side", "zone_type", "level", "strength", "age_bars", "status")


@on_fixture
def near_price(s):
    return s.zones.select("symbol", "tf", "level", "side", "near_price")


@on_fixture
def structural_scores(s):
    return s.zones.select("symbol", "tf", "side", "level", structural_score(F.col("strength"), F.lit(1), F.col("tf"), F.col("age_bars"), F.col("n_bars")).alias("score"))


@on_fixture
def level_islands(s):
    return confluence.islands(s.zones).select("symbol", "island", "tf", "level", "side")


@on_fixture
def confluence_filter(s):
    return confluence.kept_islands(confluence.islands(s.zones)).select("symbol", "island", "tf", "level", "is_major")


@on_fixture
def nearest_per_tf(s):
    return confluence.nearest(confluence.kept_islands(confluence.islands(s.zones))).select("symbol", "island", "tf", "level", "strength")


@on_fixture
def confluence_score(s):
    return s.confluences.select("symbol", "island", "level", "n_tf", "force", "score")


@on_fixture
def confluence_type(s):
    return s.confluences.select("symbol", "island", "type", "signal", "status", "alert", "dist_pct")


@on_fixture
def confluences(s):
    return s.confluences


@on_fixture
def working_price(s):
    return quality.working_price(s.symbols, s.quotes, s.bars)


@query
def price_bounds(spark, sf_dir):
    rows = spark.range(0, 40).select(F.element_at(F.array(*map(F.lit, REQUESTED)), (F.col("id") % 5 + 1).cast("int")).alias("symbol"), (F.pow(F.lit(2.0), (F.col("id") - 10).cast("double") / 2.0) * 1.013).alias("raw_price"))
    return quality.bounded(rows)


@on_fixture
def data_anomaly(s):
    return s.anomalies


@on_fixture
def support_ratio(s):
    return quality.support_ratio(s.zones)


@on_fixture
def coverage_gaps(s):
    returned = s.bars.select("symbol").distinct().unionByName(s.symbols.sparkSession.createDataFrame([("ZZZ_USD",)], "symbol string"))
    return quality.coverage(s.symbols, returned)


@on_fixture
def price_context(s):
    return exports.price_context(s.zones)


@on_fixture
def display_rows(s):
    return s.rows


@on_fixture
def filter_confluences(s):
    return confluence.filtered(s.confluences, 2.0, 20.0).select("symbol", "island", "score", "dist_pct", "status")


@on_fixture
def json_export(s):
    rows = exports.assets(s.summary, confluence.filtered(s.confluences, 2.0, 20.0))
    text = F.transform("zones", lambda z: F.format_string("%.5f|%s|%s|%d", z["level"], z["type"], z["status"], z["force"].cast("int")))
    return rows.select("symbol", "current_price", "current_price_source", "zones_scan_status", F.coalesce(F.array_join(text, ";"), F.lit("")).alias("zones"))


@on_fixture
def llm_brief(s):
    return exports.brief(confluence.filtered(s.confluences, 5.0, 10.0))


@query
def safe_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", latin_text(F.concat(F.lit("🟢⚠️ "), F.col("text"))).alias("text"))


@query
def redact_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", redact(F.col("text")).alias("text"))


@on_fixture
def scan_summary(s):
    return s.summary


@on_fixture
def class_a_totals(s):
    return s.totals()


@on_fixture
def requested_frames(s):
    """Every symbol asked for with every time frame, and how many bars there are."""
    frames = s.symbols.withColumn("tf", F.explode(F.array(*map(F.lit, TIMEFRAMES))))
    return frames.join(s.bars.groupBy("symbol", "tf").agg(F.count("*").alias("n_bars")), ["symbol", "tf"], "left").select("symbol", "tf", F.coalesce("n_bars", F.lit(0)).alias("n_bars"))


@query
def candle_payloads(spark, sf_dir):
    """Bars to the service's JSON and back; every fifth candle is incomplete."""
    rows = noise(spark, sf_dir)
    mid = F.struct(*(F.col(c).cast("string").alias(c[0]) for c in ("open", "high", "low", "close")))
    candle = F.struct("bar_idx", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), (F.col("bar_idx") % 5 != 0).alias("complete"), "volume", mid.alias("mid"))
    bodies = rows.groupBy("symbol", "tf").agg(F.to_json(F.struct(F.array_sort(F.collect_list(candle)).alias("candles"))).alias("payload"))
    return payloads.candles(bodies).select("symbol", "tf", "ts", "close", "volume")


@query
def quote_payloads(spark, sf_dir):
    k = F.col("n_nationkey")
    price = F.struct(F.when(k % 7 == 0, F.lit("none")).otherwise(k.cast("string")).alias("closeoutBid"), (k + 1).cast("string").alias("closeoutAsk"), F.when(k % 3 == 0, F.lit(None)).otherwise(k % 2 == 0).alias("tradeable"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("symbol"), F.to_json(F.struct(F.array(price).alias("prices"))).alias("payload"))
    return payloads.quotes(rows)


@query
def cache_freshness(spark, sf_dir):
    tf = F.element_at(F.array(*map(F.lit, (*TIMEFRAMES, "M1"))), (F.col("id") % 4 + 1).cast("int"))
    rows = spark.range(400).select("id", tf.alias("tf"), ((F.col("id") * 37) % 700).alias("age"), (F.col("id") % 5).alias("rows"))
    return rows.select("id", hashes.is_fresh(F.col("tf"), F.col("age"), F.col("rows")).alias("fresh"))


@on_fixture
def coverage_patched(s):
    return quality.patched(s.trends.select("symbol", F.lit(None).cast("string").alias("scan_error")).distinct(), s.symbols)


@on_fixture
def confluence_thresholds(s):
    return s.symbols.select("symbol", confluence.threshold().alias("threshold"))


@on_fixture
def report_lines(s):
    return exports.sections(s.rows, s.anomalies)


@query
def scan_sanitized(spark, sf_dir):
    """What a scan makes of bars that come several times for one start, with faulty ones among them."""
    return bar_ops.prepared(order_bars(spark, sf_dir)).select("symbol", "tf", "bar_idx", "n_bars", "ts", "close")


@on_fixture
def confluences_user_threshold(s):
    return confluence.confluences(s.zones, 0.3)


@on_fixture
def confluences_profile_threshold(s):
    return confluence.confluences(s.zones, None)


@on_fixture
def filter_rounded(s):
    return confluence.stored_values(s.confluences).select("symbol", "island", "score", "dist_pct", "level")


@on_fixture
def json_document(s):
    """The document, read again."""
    body = exports.json_document(s.summary, confluence.filtered(s.confluences, 5.0, 20.0), "2024-01-02T00:00:00Z")
    kind = "assets array<struct<symbol: string, current_price: double, current_price_source: string, zones_scan_status: string, zones: array<struct<force: bigint>>>>, diagnostics struct<assets_with_no_zones: array<string>>"
    read = body.select(F.from_json("document", kind).alias("d"))
    rows = read.select(F.posexplode("d.assets").alias("place", "a"), F.array_join("d.diagnostics.assets_with_no_zones", ",").alias("assets_with_no_zones"))
    force = F.when(F.size("a.zones") > 0, F.aggregate("a.zones.force", F.lit(0).cast("bigint"), lambda x, y: x + y))
    return rows.select("a.symbol", "place", "a.current_price", "a.current_price_source", "a.zones_scan_status", F.size("a.zones").alias("n_zones"), force.alias("force"), "assets_with_no_zones")


@on_fixture
def brief_document(s):
    return exports.brief_document(confluence.filtered(s.confluences, 5.0, 10.0), "01/02/2024 00:00", list(REQUESTED)).select(F.lit(1).alias("part"), "brief")


@on_fixture
def report_confluences(s):
    near = confluence.by_score(confluence.stored_values(s.confluences), 3.0)
    return near.select(F.row_number().over(Window.orderBy(F.col("score").desc(), "symbol", "level")).alias("place"), "symbol", "level", "score", "dist_pct")


#: Payloads that break on the way: (symbol, time frame) -> what becomes of the body.
BROKEN = {("USD_JPY", "H4"): "cut", ("USD_JPY", "Daily"): "time", ("USD_JPY", "Weekly"): "lost", ("XAU_USD", "Weekly"): "volume"}


def sent(s: Scan) -> Scan:
    """The fixture as the services would have sent it, some bodies broken; a quote for one symbol only."""
    text = lambda c: F.col(c).cast("string").alias(c[0])
    kind = F.lit("")
    for (symbol, tf), how in BROKEN.items():
        kind = F.when((F.col("symbol") == symbol) & (F.col("tf") == tf), how).otherwise(kind)
    last = F.col("bar_idx") == F.col("n_bars") - 1
    rows = s.bars.withColumn("kind", kind)
    time = F.when(last & (F.col("kind") == "time"), "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    volume = F.when(last & (F.col("kind") == "volume"), "many").otherwise(F.col("volume").cast("string"))
    mid = F.struct(*map(text, ("open", "high", "low", "close")))
    candle = F.struct("bar_idx", time.alias("time"), F.lit(True).alias("complete"), volume.alias("volume"), mid.alias("mid"))
    bodies = rows.groupBy("symbol", "tf", "kind").agg(F.to_json(F.struct(F.array_sort(F.collect_list(candle)).alias("candles"))).alias("body"))
    body = F.when(F.col("kind") == "cut", F.substring("body", 1, 100)).when(F.col("kind") == "lost", F.lit(None)).otherwise(F.col("body"))
    price = F.struct((F.col("price") * 1.0).cast("string").alias("closeoutBid"), F.col("price").cast("string").alias("closeoutAsk"), F.lit(True).alias("tradeable"))
    quoted = s.quotes.filter("symbol = 'EUR_USD'").select("symbol", F.to_json(F.struct(F.array(price).alias("prices"))).alias("payload"))
    return Scan.of_payloads(bodies.select("symbol", "tf", body.alias("payload")), quoted, s.symbols)


@on_fixture
def scan_errors(s):
    """What each symbol's broken payloads cost it, and that the others keep their zones."""
    s = sent(s)
    zones = s.zones.groupBy("symbol").agg(F.count("*").alias("n_zones"), F.sum("level").alias("levels"))
    pairs = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    rows = s.results().join(zones, "symbol", "left")
    return rows.select("symbol", "scan_error", "current_price", F.array_join("missing_tfs", ",").alias("missing_tfs"), pairs("frame_errors").alias("frame_errors"), pairs("bars_map").alias("bars_map"), "n_zones", "levels")


@on_fixture
def scan_results(s):
    pairs = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.results().select("symbol", "scan_error", "current_price", "current_price_source", "price_context", "anomaly", F.array_join("missing_tfs", ",").alias("missing_tfs"), pairs("trends").alias("trends"), pairs("bars_map").alias("bars_map"))


def fetch_log(spark, sf_dir):
    """Events as fetches: a frame for each of 40 groups of users and time frame, one fetch a second; a few are empty."""
    tf = F.element_at(F.array(*map(F.lit, TIMEFRAMES)), (F.col("event_id") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("U"), (F.col("user_id") % 40).cast("string")).alias("symbol"), tf.alias("tf"), F.timestamp_seconds("event_id").alias("fetched_at"), F.when(F.col("value") < 8, 0).otherwise(100).cast("long").alias("rows")
    )


@query
def stale_frames(spark, sf_dir):
    """Which frames a scan has to ask for, a while after the last fetch."""
    log = fetch_log(spark, sf_dir)
    requested = log.select("symbol").distinct().unionByName(symbols(spark, ["ZZZ_USD"])).withColumn("tf", F.explode(F.array(*map(F.lit, TIMEFRAMES))))
    now = log.agg((F.max("fetched_at") + F.expr("interval 3 seconds")).alias("now"))
    return store.stale(requested, log, F.lit(now.first()["now"]))


@query
def candles_upserted(spark, sf_dir):
    """Of several arrivals for one start the last, whatever it holds."""
    return store.upserted(order_bars(spark, sf_dir), ("arrival",)).select("symbol", "ts", "arrival", "close")


def noise_context(bars):
    return with_profile(indicators.atr(bars)).filter("atr > 0")


@query
def pivot_peaks(spark, sf_dir):
    """The last resort alone, over every frame."""
    rows = noise(spark, sf_dir)
    context = noise_context(rows)
    return pivots.fallback(rows, context, context.select("symbol", "tf"))


@query
def pivots_with_fallback(spark, sf_dir):
    """Pivots of frames whose wick filter leaves few: all three tiers."""
    rows = noise(spark, sf_dir)
    return pivots.pivots(rows, noise_context(rows))


@query
def pivots_of_short_frames(spark, sf_dir):
    """Frames of 12 bars have no swings, only peaks."""
    rows = bar_ops.prepared(noise(spark, sf_dir).drop("bar_idx", "n_bars"), 12)
    return pivots.pivots(rows, noise_context(rows))


@on_fixture
def rescan_changed_frames(s):
    """A second scan after one frame has got a bar more: which frames it computes, and the zones it gives."""
    earlier = dataclasses.replace(s)
    missing = (F.col("symbol") == "XAU_USD") & (F.col("tf") == "H4") & (F.col("bar_idx") == F.col("n_bars") - 1)
    earlier.__dict__["bars"] = written(bar_ops.numbered(s.bars.filter(~missing).drop("bar_idx", "n_bars")))
    second = memo.rescanned(s, memo.rescanned(earlier))
    zones_of = second.zones.groupBy("symbol", "tf").agg(F.count("*").alias("n_zones"), F.sum("level").alias("levels"))
    return second.frames.join(zones_of, ["symbol", "tf"], "left").select("symbol", "tf", "recomputed", F.coalesce("n_zones", F.lit(0)).alias("n_zones"), "levels")


@on_fixture
def report_pages(s):
    """The whole report, laid out; pages are short here so that tables have several."""
    return pages.pages(s.rows, s.anomalies, confluence.stored_values(s.confluences), 12)
