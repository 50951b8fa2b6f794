"""Requests, payloads, kept candles, and errors that stay with their symbol."""

import datetime
import http.client
import http.server
import io
import json
import threading
import urllib.error
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from candela.operators import exports
from candela.plans.scan import INNER_ERROR, Scan, scan
from candela.sources import payloads, rest, store

NOW = datetime.datetime(2024, 3, 1, 12)


def body(n=40, base=100.0, **odd):
    """A payload of n daily candles; odd: place -> fields that replace those of the candle."""
    out = []
    for i in range(n):
        p = base + (i % 7) - (i % 3) / 2
        day = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)
        out.append({"time": f"{day:%Y-%m-%dT00:00:00Z}", "complete": True, "volume": 5, "mid": {"o": str(p), "h": str(p + 1), "l": str(p - 1), "c": str(p + 0.5)}} | odd.get(f"c{i}", {}))
    return json.dumps({"candles": out})


def opener(replies):
    def run(request, timeout):
        reply = replies.pop(0)
        if isinstance(reply, int):
            raise urllib.error.HTTPError(request.full_url, reply, "", {}, io.BytesIO())
        if isinstance(reply, Exception):
            raise reply
        return io.BytesIO(reply)

    return run


@pytest.mark.parametrize("fault", [ConnectionResetError(), http.client.RemoteDisconnected(), http.client.IncompleteRead(b""), TimeoutError(), urllib.error.URLError("x"), b"<html>busy</html>", b"[1]", b"\xff", 503])
def test_faults_that_may_pass_are_tried_again(fault):
    waits = []
    assert rest.fetch("http://x", "t", opener=opener([fault, fault, b"{}"]), sleep=waits.append, accept=rest.json_object) == "{}" and waits == [0.5, 1.0]
    assert rest.fetch("http://x", "t", opener=opener([fault] * 3), sleep=waits.append, accept=rest.json_object) is None


def test_other_statuses_end_at_once():
    assert all(rest.fetch("http://x", "t", opener=opener([code, b"{}"]), sleep=None, accept=rest.json_object) is None for code in (401, 403, 404))


def test_no_more_requests_at_once_than_allowed():
    many = ",".join(f"S{i}_USD" for i in range(33))
    for reader, n in ((rest.CandleReader, 99), (rest.QuoteReader, 33)):
        parts = reader({"symbols": many}).partitions()
        assert len(parts) == 12 and sorted(len(p.keys) for p in parts)[::11] == [n // 12, -(-n // 12)] and len({k for p in parts for k in p.keys}) == n
        assert len(reader({"symbols": many, "concurrency": "3"}).partitions()) == 3
    assert rest.CandleReader({"frames": "A_USD:H4, B_USD:Daily"}).keys() == [("A_USD", "H4"), ("B_USD", "Daily")]
    assert rest.CandleReader({"symbols": ""}).partitions() == []


def test_each_request_of_a_partition_backs_off_alone():
    waits = []
    reader = rest.CandleReader({"url": "http://x", "symbols": "A_USD", "concurrency": "1"}, opener=opener([503, b"{}", 401, b"no", b"no", b"no"]), sleep=waits.append)
    assert list(reader.read(reader.partitions()[0])) == [("A_USD", "H4", "{}"), ("A_USD", "Daily", None), ("A_USD", "Weekly", None)] and waits == [0.5, 0.5, 1.0]


def frames(spark, rows):
    return spark.createDataFrame(rows, "symbol string, tf string, payload string")


def test_what_spoils_a_frame_and_what_only_a_candle(spark):
    cases = {
        "fine": (body(5), None, 5), "none": (None, "no answer", 0), "cut": (body(5)[:60], "not JSON", 0), "list": ("[1, 2]", None, 0), "other": ('{"a": 1}', None, 0), "empty": ("", "not JSON", 0),
        "time": (body(5, c2={"time": "soon"}), "unreadable candle", 0), "volume": (body(5, c2={"volume": "many"}), "unreadable candle", 0), "no volume": (body(5, c2={"volume": None}), None, 5),
        "half": (body(5, c2={"complete": False, "time": "soon"}), None, 4), "no prices": (body(5, c2={"mid": None, "time": "soon"}), None, 4), "word": (body(5, c2={"mid": {"o": "x", "h": "1", "l": "1", "c": "1"}}), None, 4),
    }
    rows = payloads.parsed(frames(spark, [(name, "Daily", text) for name, (text, _, _) in cases.items()]))
    errors = {r["symbol"]: r["error"] for r in payloads.frame_errors(rows).collect()}
    counts = {r["symbol"]: r["count"] for r in payloads.usable_candles(rows).groupBy("symbol").count().collect()}
    assert errors.get("list") in (None, "not JSON") and counts.get("list") is None
    assert {k: (errors.get(k), counts.get(k, 0)) for k in cases if k != "list"} == {k: v[1:] for k, v in cases.items() if k != "list"}


def test_one_symbols_errors_are_its_own(spark):
    symbols = spark.createDataFrame([("EUR_USD",), ("USD_JPY",), ("GBP_USD",), ("AUD_USD",)], "symbol string")
    quotes = spark.createDataFrame([("AUD_USD", '{"prices": [{"closeoutBid": "100", "closeoutAsk": "101"}]}'), ("EUR_USD", "broken"), ("USD_JPY", None)], "symbol string, payload string")
    huge = {f"c{i}": {"mid": {"o": "1.6e308", "h": "1.7e308", "l": "1.1e308", "c": "1.6e308"}} for i in range(40)}
    sent = [("EUR_USD", "Daily", body(40)), ("EUR_USD", "H4", body(40)[:99]), ("USD_JPY", "Daily", body(40, c3={"time": "x"})), ("GBP_USD", "Daily", body(40, **huge)), ("AUD_USD", "Daily", body(40))]
    whole = Scan.of_payloads(frames(spark, sent), quotes, symbols)
    got = {r["symbol"]: r for r in whole.results().collect()}
    assert got["USD_JPY"]["scan_error"] == "Aucune donnee disponible" and got["USD_JPY"]["frame_errors"] == {"Daily": "unreadable candle"} and got["USD_JPY"]["trends"] is None
    assert got["GBP_USD"]["scan_error"] == INNER_ERROR and got["GBP_USD"]["current_price"] is None and got["GBP_USD"]["bars_map"] is None
    assert got["EUR_USD"]["scan_error"] is None and got["EUR_USD"]["bars_map"] == {"Daily": 40} and got["EUR_USD"]["missing_tfs"] == ["H4", "Weekly"] and got["EUR_USD"]["frame_errors"] == {"H4": "not JSON"}
    assert got["AUD_USD"]["current_price"] == 100.5 and got["AUD_USD"]["frame_errors"] is None
    alone = Scan.of_payloads(frames(spark, [s for s in sent if s[0] == "AUD_USD"]), quotes, symbols.filter("symbol = 'AUD_USD'"))
    zones = lambda s: sorted(map(str, s.zones.filter("symbol = 'AUD_USD'").collect()))
    assert zones(whole) == zones(alone) and not whole.zones.filter("symbol in ('USD_JPY', 'GBP_USD')").count()
    report = exports.report(whole.rows, whole.anomalies, whole.confluences).orderBy("section", "place", "line").collect()
    assert [r["section"] for r in report] == sorted(r["section"] for r in report) and any(r["section"] == 2 for r in report)


def test_scan_without_a_threshold_of_the_users(spark):
    symbols = spark.createDataFrame([("XAU_USD",), ("EUR_USD",)], "symbol string")
    bars = payloads.candles(frames(spark, [("XAU_USD", "Daily", body(60, 2000.0)), ("XAU_USD", "H4", body(60, 2001.0)), ("EUR_USD", "Daily", body(60))]))
    quotes = spark.createDataFrame([], "symbol string, price double, source string")
    got = {name: df.count() for name, df in scan(bars, quotes, symbols, own_threshold=None).items()}
    assert got["summary"] == got["results"] == 2 and got["zones"] > 0 and got["confluences"] > 0


class Service(http.server.BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        place, wanted = urlparse(self.path), parse_qs(urlparse(self.path).query)
        symbol, granularity = place.path.split("/")[-2], wanted["granularity"][0]
        self.asked.append((symbol, granularity))
        if symbol == "BAD_USD":
            return self.send_error(404)
        if self.asked.count((symbol, granularity)) == 1 and symbol == "XAU_USD":
            self.send_response(200)
            self.end_headers()
            return self.wfile.write(b"<html>busy</html>")
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body(3 if granularity == "D" else 4, 2000.0).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    Service.asked = []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_only_stale_frames_are_fetched(spark, service, tmp_path):
    spark.dataSource.register(rest.CandleSource)
    kept = store.CandleStore(spark, str(tmp_path / "kept"))
    wanted = spark.createDataFrame([("XAU_USD", "H4"), ("XAU_USD", "Daily"), ("BAD_USD", "H4")], "symbol string, tf string")
    assert kept.bars().count() == 0
    first = kept.refresh(wanted, NOW, url=service).collect()
    assert len(first) == 7 and sorted(set(Service.asked)) == [("BAD_USD", "H4"), ("XAU_USD", "D"), ("XAU_USD", "H4")] and len(Service.asked) == 5  # both frames once more after the busy page
    assert {(r["symbol"], r["tf"], r["rows"]) for r in kept.fetches().collect()} == {("XAU_USD", "H4", 4), ("XAU_USD", "Daily", 3), ("BAD_USD", "H4", 0)}
    Service.asked.clear()
    assert len(kept.refresh(wanted, NOW + datetime.timedelta(seconds=15), url=service).collect()) == 7 and Service.asked == []
    assert {r["reason"] for r in kept.stale(wanted, NOW + datetime.timedelta(seconds=30)).collect()} == {"empty"}
    assert {(r["symbol"], r["tf"], r["reason"]) for r in kept.stale(wanted, NOW + datetime.timedelta(seconds=100)).collect()} == {("BAD_USD", "H4", "empty"), ("XAU_USD", "H4", "old")}
    before = sorted(map(str, kept.bars().collect()))
    kept.compact()
    assert sorted(map(str, kept.bars().collect())) == before and kept.fetches().count() == 3
    later = kept.record(spark.createDataFrame([("XAU_USD", "Daily", body(5, 3000.0))], "symbol string, tf string, payload string"), NOW + datetime.timedelta(hours=1))
    assert later.count() == 0 and kept.bars().filter("tf = 'Daily'").agg(F.min("close"), F.count("*")).first()[1] == 5 and kept.bars().filter("tf = 'Daily' and close < 2500").count() == 0
    kept.record(spark.createDataFrame([("XAU_USD", "Daily", None)], "symbol string, tf string, payload string"), NOW + datetime.timedelta(hours=2))
    assert kept.bars().filter("tf = 'Daily'").count() == 0  # the last answer was none


def test_stored_tables_go_when_their_scope_ends(spark):
    from candela.storage import cleared, stored, stored_within

    outer = stored(spark.range(3))
    with stored_within(spark):
        inner = stored(spark.range(5))
        assert inner.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|FileNotFound|does not exist"):
        spark.read.parquet(inner.inputFiles()[0]).count()
    assert outer.count() == 3 and cleared(spark) >= 1
