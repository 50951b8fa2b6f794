import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from candela.functions import hashes, scores
from candela.functions import text as texts
from candela.operators import bars, confluence, exports, indicators, pivots, quality, trend_zones, zones
from candela.schema import with_profile
from candela.sources import payloads, rest

START = datetime.datetime(2024, 1, 1)
BAR = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume bigint, arrival int"


def frame(spark, rows, symbol="EUR_USD", tf="Daily"):
    """rows of (open, high, low, close), a day apart."""
    data = [(symbol, tf, START + datetime.timedelta(days=i), *map(float, r), 1, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, BAR)


def closes(spark, values, **kw):
    return bars.numbered(frame(spark, [(v, v, v, v) for v in values], **kw))


def context(spark, symbol="EUR_USD", tf="Daily", price=100.0, atr=1.0, n_bars=10, last_close=100.0, touches=2):
    df = spark.createDataFrame([(symbol, tf, n_bars, last_close, atr, price, touches)], "symbol string, tf string, n_bars int, last_close double, atr double, price double, min_touches int")
    return with_profile(df)


def test_validity_of_odd_bars(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 2, 1, 1.5), (1, 2, 1, nan), (1, inf, 1, 1), (3, 2, 1, 1), (1, 2, 0, 1), (1, 1.9, 1, 1), (1, 1, 2, 1)]
    got = [r["is_valid"] for r in bars.with_validity(frame(spark, rows)).orderBy("arrival").collect()]
    assert not any(got)  # the first for its ratio
    assert bars.with_validity(frame(spark, [(1, 1.7, 1, 1.5)])).first()["is_valid"]


def test_a_late_invalid_bar_hides_the_valid_one(spark):
    rows = frame(spark, [(1, 1.1, 1, 1), (1, 1.1, 1, 1.05), (9, 1, 2, 3)]).withColumn("ts", F.lit(START))
    assert bars.sanitized(rows.filter("arrival < 2")).first()["close"] == 1.05
    assert bars.sanitized(rows).count() == 0


@pytest.mark.parametrize("n, want", [(1, None), (2, 2.0), (14, 2.0), (15, 2.0)])
def test_atr_by_length(spark, n, want):
    got = indicators.atr(bars.numbered(frame(spark, [(10, 11, 9, 10)] * n))).first()
    assert got["n_bars"] == n and got["atr"] == want


def test_trend_labels(spark):
    rng = random.Random(1)
    noise = lambda slope: [100 + slope * i + rng.uniform(-0.1, 0.1) for i in range(60)]
    label = lambda v: indicators.trend_labels(closes(spark, v)).first()
    assert label(noise(1))["trend"] == "HAUSSIER" and label(noise(-1))["trend"] == "BAISSIER"
    assert label([100.0] * 60)["trend"] == "NEUTRE"
    assert label(noise(1)[:40])["trend"] == "NEUTRE"  # fewer bars than looked back on


def test_trend_levels_stay_on_their_side(spark):
    rng = random.Random(2)
    rows = bars.numbered(frame(spark, [(p, p + 1, p - 1, p) for p in (2000 + rng.uniform(-5, 5) for _ in range(40))], symbol="XAU_USD"))
    got = trend_zones.trend_zones(rows, context(spark, "XAU_USD", price=2000.0)).collect()
    assert {(r["zone_type"], r["strength"]) for r in got} == {(s, k) for s in ("Support", "Resistance") for k in (15, 25)}
    assert all((r["level"] < 2000) == (r["zone_type"] == "Support") for r in got)


def test_swings_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(p, p + rng.random(), p - rng.random(), p) for p in (100 + rng.uniform(-3, 3) for _ in range(80))]
    got = {(r["bar_idx"], r["is_high"], r["is_low"]) for r in pivots.swings(bars.numbered(frame(spark, rows))).filter("is_high or is_low").collect()}
    want = set()
    for i in range(3, len(rows) - 3):
        near = [rows[j] for j in range(i - 3, i + 4) if j != i]
        high, low = all(rows[i][1] > r[1] for r in near), all(rows[i][2] < r[2] for r in near)
        if high or low:
            want.add((i, high, low))
    assert got == want


def test_peaks_of_short_frames(spark):
    price = [1, 2, 3, 9, 3, 2, 1, 2, 3, 8, 3, 2, 1]
    rows = bars.numbered(frame(spark, [(p, p, p, p) for p in price], tf="H4"))
    got = pivots.pivots(rows, context(spark, tf="H4", n_bars=len(price), last_close=1.0)).collect()
    assert {(r["kind"], r["bar_idx"]) for r in got} == {("high", 3), ("high", 9), ("low", 6)}


def pivot_rows(spark, prices, kind="high"):
    data = [("EUR_USD", "Daily", kind, i, float(p), 1.0, 1.0) for i, p in enumerate(prices)]
    return spark.createDataFrame(data, pivots.PIVOT)


def test_clusters_equal_a_loop(spark):
    rng = random.Random(4)
    prices = [round(100 + rng.uniform(0, 12), 3) for _ in range(60)]
    ctx = context(spark)
    got = [(r["price"], r["cluster_id"]) for r in zones.clustered(pivot_rows(spark, prices), ctx).orderBy("price", "bar_idx").collect()]
    band, want, first, last, number = min(max(1.2, 0.15), 1.0), [], None, None, 0
    for p in sorted(prices):
        if last is None or p - last > band or p - first > 2.5 * band:
            number, first = number + 1, p
        want.append((p, number))
        last = p
    assert got == want and number > 2


@pytest.mark.parametrize(
    "after, want",
    [
        ([(106, 107, 105, 106)], "Vierge"),
        ([(101, 102, 100, 101)], "Testee"),
        ([(98, 99, 97, 98), (90, 91, 90, 90)], "Consommee"),
        ([(98, 99, 97, 98), (99.8, 100.2, 99, 99.8), (95, 96, 94, 95)], "Role Reverse"),
        ([(98, 99, 97, 98), (99.8, 100.2, 99, 99.8), (103, 104, 102, 103)], "Consommee"),
    ],
)
def test_status_of_a_support(spark, after, want):
    rows = bars.numbered(frame(spark, [(100, 101, 100, 100), *after]))
    columns = "symbol string, tf string, zone_type string, level double, strength int, age_bars int, last_idx int, prominence double, prominence_atr double, is_major boolean, atr double, n_bars int"
    zone = spark.createDataFrame([("EUR_USD", "Daily", "Support", 100.0, 2, 0, 0, 1.0, 1.0, False, 1.0, len(after) + 1)], columns)
    assert zones.with_status(zone, rows).first()["status"] == want


def test_merging_compares_with_the_drifting_level(spark):
    columns = "symbol string, tf string, zone_type string, level double, strength int, age_bars int, status string, prominence double, prominence_atr double, is_major boolean"
    rows = [("EUR_USD", "Daily", "Support", v, s, 5, st, 1.0, 1.0, False) for v, s, st in ((90.0, 1, "Vierge"), (90.7, 3, "Testee"), (91.2, 1, "Vierge"), (91.5, 1, "Vierge"), (95.0, 2, "Consommee"))]
    got = zones.merged(spark.createDataFrame(rows, columns), context(spark)).orderBy("level").collect()
    want = []  # reach 0.75: the price's cap
    for v, s in ((90.0, 1), (90.7, 3), (91.2, 1), (91.5, 1)):
        if want and abs(v - want[-1][0]) <= 0.75:
            level, strength = want[-1]
            want[-1] = ((level * strength + v * s) / (strength + s), strength + s)
        else:
            want.append((v, s))
    assert [(r["level"], r["strength"]) for r in got] == [(pytest.approx(a), b) for a, b in want]
    assert sum(r["strength"] for r in got) == 6 and got[0]["status"] == "Testee"


def test_islands_equal_linked_pairs(spark):
    rng = random.Random(5)
    levels = sorted(round(rng.uniform(90, 110), 4) for _ in range(60))
    rows = spark.createDataFrame([("EUR_USD", "H4", v, 1, "Vierge", "Support", False, 1) for v in levels], "symbol string, tf string, level double, strength int, status string, side string, is_major boolean, age_bars int")
    got = [r["island"] for r in confluence.islands(rows).orderBy("level").collect()]
    parent = list(range(len(levels)))
    for i, j in itertools.combinations(range(len(levels)), 2):
        if (levels[j] - levels[i]) / levels[i] * 100 <= 0.8:
            old, new = parent[j], parent[i]
            parent = [new if p == old else p for p in parent]
    assert [got[i] == got[i + 1] for i in range(59)] == [parent[i] == parent[i + 1] for i in range(59)]


@pytest.mark.parametrize("price, want", [(140.0, (None, True)), (1400.0, (1500.0, False)), (2000.0, (2000.0, False)), (9000.0, (8000.0, False)), (90000.0, (None, True))])
def test_price_bounds(spark, price, want):
    got = quality.bounded(spark.createDataFrame([("XAU_USD", price)], "symbol string, raw_price double")).first()
    assert (got["price"], got["price_error"] is not None) == want


def test_boundary_of_type_and_alert(spark):
    rows = spark.createDataFrame([("EUR_USD", 1, "H4", 99.5, 100.0, 2, 1, 10, True, "Vierge", "Support")], "symbol string, island int, tf string, level double, price double, strength int, age_bars int, n_bars int, is_major boolean, status string, side string")
    got = confluence.scored(rows).first()
    assert got["dist_pct"] == 0.5 and got["type"] == "Pivot" and got["alert"] == "⚠️ Proche"


def test_filter_reads_text(spark):
    rows = spark.createDataFrame([("1.5%", "30", "Vierge"), ("x", "30", "Vierge"), ("1", "y", "Vierge"), ("1", "30", "Consommee")], "dist_pct string, score string, status string")
    assert confluence.filtered(rows, 2.0, 20.0).count() == 1


def test_redaction_and_plain_text(spark):
    samples = ["Bearer abc.DEF==", "authorization: xyz", "access_token=q1", "token='abcdefghijkl'", "api-key: 12345678", "0123456789abcdef0123456789abcdef-0123456789abcdef0123456789abcdef", "token=short"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r["t"] for r in rows.select(texts.redact(F.col("t")).alias("t")).collect()]
    assert all("***REDACTED***" in g for g in got[:6]) and got[6] == "token=short" and got[0].startswith("Bearer ***")
    plain = spark.createDataFrame([("été 🔥 ⚠️ 漢" + "x" * 300,)], "t string").select(texts.latin_text(F.col("t")).alias("t")).first()["t"]
    assert plain.startswith("ete [CHAUD] [PROCHE] ?x") and len(plain) == 200 and plain.endswith("...")


def test_payloads(spark):
    body = '{"candles": [{"time": "2024-01-01T00:00:00Z", "complete": true, "mid": {"o": "1", "h": "1.2", "l": "1", "c": "1.1"}}, {"time": "2024-01-02T00:00:00Z", "complete": false, "mid": {"o": "1", "h": "1", "l": "1", "c": "1"}}, {"time": "2024-01-03T00:00:00Z", "complete": true, "mid": {"o": "z", "h": "1", "l": "1", "c": "1"}}]}'
    got = payloads.candles(spark.createDataFrame([("EUR_USD", "Daily", body)], "symbol string, tf string, payload string")).collect()
    assert [(r["close"], r["volume"]) for r in got] == [(1.1, 0)]
    quote = '{"prices": [{"closeoutBid": "1.0", "closeoutAsk": "1.2", "tradeable": false}]}'
    got = payloads.quotes(spark.createDataFrame([("A", quote), ("B", '{"prices": []}'), ("C", "nonsense")], "symbol string, payload string")).orderBy("symbol").collect()
    assert [(r["price"], r["source"]) for r in got] == [(1.1, "stale"), (None, None), (None, None)]


def test_fetch_repeats_only_what_may_pass():
    import io
    import urllib.error

    calls, waits = [], []

    def opener(replies):
        def run(request, timeout):
            calls.append(request.full_url)
            reply = replies.pop(0)
            if isinstance(reply, int):
                raise urllib.error.HTTPError(request.full_url, reply, "", {}, io.BytesIO())
            return io.BytesIO(reply)

        return run

    assert rest.fetch("http://x", "t", opener=opener([503, 429, b"ok"]), sleep=waits.append) == "ok" and waits == [0.5, 1.0]
    assert rest.fetch("http://x", "t", opener=opener([401, b"no"]), sleep=waits.append) is None and len(calls) == 4


def test_hashes_ignore_order(spark):
    rows = spark.range(50).select("id", (F.col("id") % 3).alias("g"))
    a, b = (hashes.frame_hash(df).first()["hash"] for df in (rows, rows.orderBy(F.desc("id")).repartition(7)))
    assert a == b != hashes.frame_hash(rows.filter("id > 0")).first()["hash"]


def test_stream_of_ticks(spark, tmp_path):
    from candela.streaming.bars import stream_bars

    ticks = [("A", START + datetime.timedelta(hours=h), h, 100.0 + h) for h in (0, 1, 3, 5, 30)]
    spark.createDataFrame(ticks, "symbol string, ts timestamp, place int, price double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("symbol string, ts timestamp, place int, price double").parquet(str(tmp_path / "in"))
    run = stream_bars(source).writeStream.format("memory").queryName("made").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = [(r["ts"].hour, r["open"], r["close"], r["volume"]) for r in spark.table("made").orderBy("ts").collect()]
    assert got[:2] == [(0, 100.0, 103.0, 3), (4, 105.0, 105.0, 1)]


def test_context_text(spark):
    rows = spark.createDataFrame([("A", "Daily", "Support", 99.9, 100.0), ("A", "Daily", "Resistance", 103.0, 100.0), ("B", "Daily", "Support", 50.0, 100.0)], "symbol string, tf string, side string, level double, price double")
    got = {r["symbol"]: r["price_context"] for r in exports.price_context(rows).collect()}
    assert got == {"A": "SUR support: 99.90000 (-0.10%)  |  R proche: 103.00000 (+3.00%)", "B": "Zone intermediaire"}


def test_decay_weight(spark):
    got = [r["w"] for r in spark.range(3).select(scores.decay_weight(F.col("id"), F.lit(3)).alias("w")).collect()]
    assert got == [pytest.approx(x) for x in (0.35, 0.675, 1.0)]


def test_scan_takes_the_last_of_equal_starts(spark):
    rows = frame(spark, [(1, 1.1, 1, 1 + i / 1000) for i in range(30)])
    again = rows.filter("arrival < 5").withColumn("close", F.lit(1.09)).withColumn("arrival", F.col("arrival") + 100)
    got = bars.prepared(rows.unionByName(again)).orderBy("bar_idx").collect()
    assert len(got) == 30 and got[0]["n_bars"] == 30 and [r["close"] for r in got[:6]] == [1.09] * 5 + [1.005]
    assert bars.prepared(rows.unionByName(again).drop("arrival")).count() == 30


def test_rounding_follows_the_binary_value(spark):
    values = [2.675, 0.285, 0.25, 0.35, 0.125, 56.96, -2.675, 0.05, 1234567.125] + [random.Random(6).uniform(-300, 300) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 3, 5):
        assert all(r["y"] == round(r["x"], digits) for r in rows.select("x", scores.half_even(F.col("x"), digits).alias("y")).collect())
    kept = confluence.filtered(spark.createDataFrame([(56.96, 1.0, 1.0, "Vierge")], "score double, dist_pct double, level double, status string"), 2.0, 57.0)
    assert kept.count() == 1  # 57.0 for its readers


def test_majors_of_different_types_merge_to_a_pivot(spark):
    columns = "symbol string, tf string, zone_type string, level double, strength int, age_bars int, status string, prominence double, prominence_atr double, is_major boolean"
    rows = [("EUR_USD", "Daily", t, v, 1, 5, "Vierge", 1.0, 1.0, m) for t, v, m in (("Support", 90.0, True), ("Resistance", 90.2, True), ("Support", 95.0, False), ("Resistance", 95.1, True))]
    got = zones.merged(spark.createDataFrame(rows, columns), context(spark), across=True).orderBy("level").collect()
    assert [(r["zone_type"], r["strength"]) for r in got] == [("Pivot", 2), ("Support", 1), ("Resistance", 1)]


def test_first_host_and_quotes():
    import io
    import urllib.error

    def opener(request, timeout):
        if "a.example" in request.full_url:
            raise urllib.error.HTTPError(request.full_url, 401, "", {}, io.BytesIO())
        return io.BytesIO(b'{"prices": []}')

    assert rest.first_host(["http://a.example", "http://b.example"], "1", "t", opener=opener) == "http://b.example"
    assert rest.first_host(["http://a.example"], "1", "t", opener=opener) is None
    reader = rest.QuoteReader({"symbols": "EUR_USD, XAU_USD", "url": "http://127.0.0.1:9", "account": "1"})
    assert [p.symbol for p in reader.partitions()] == ["EUR_USD", "XAU_USD"]


def test_cached_frames_go_by_age_number_and_size(spark):
    from candela.storage import FrameCache

    now, made = [0.0], []
    cache = FrameCache(max_entries=2, clock=lambda: now[0])
    make = lambda n: lambda: (made.append(n), spark.range(n))[1]
    cache.get(("a",), "H4", make(3))
    cache.get(("a",), "H4", make(3))
    cache.get(("b",), "Daily", make(0))
    assert made == [3, 0] and len(cache.frames) == 2
    now[0] = 30.0
    cache.get(("c",), "Weekly", make(1))
    assert list(cache.frames) == [("a",), ("c",)]  # an empty frame lives 20 seconds
    now[0] = 61.0
    cache.evict()
    assert list(cache.frames) == [("c",)] and cache.clear() == 1 and cache.size == 0
