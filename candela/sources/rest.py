"""Spark data sources that fetch candle and quote payloads from a REST service.

    spark.dataSource.register(CandleSource)
    spark.read.format("candles_rest").options(url=..., token=..., symbols="EUR_USD,XAU_USD").load()

Requests are dealt to as many input partitions as may be open at once
(`concurrency`, 12 at most unless it says otherwise); each partition sends one
request after the other and backs off on its own. A request that fails for good
gives a row without payload, so that failures can be kept as well.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The service's names of time frames, when a request is worth repeating, and how many may be open at once.
GRANULARITY = {"H4": "H4", "Daily": "D", "Weekly": "W"}
RETRY_STATUSES = (429, 500, 502, 503, 504)
CONCURRENCY = 12


def fetch(url: str, token: str, timeout: float = 10.0, retries: int = 3, wait: float = 0.5, opener=urllib.request.urlopen, sleep=time.sleep, accept=None) -> str | None:
    """The body, or None if access is denied or every try failed.

    Dropped and refused connections, time-outs and bodies that `accept` raises
    ValueError for are tried again, as are the statuses that may pass.
    """
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"})
    for attempt in range(retries):
        try:
            with opener(request, timeout=timeout) as reply:
                body = reply.read().decode()
            if accept is not None:
                accept(body)
            return body
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUSES:
                return None
        except (OSError, http.client.HTTPException, ValueError):  # ValueError: not UTF-8, not JSON
            pass
        if attempt + 1 < retries:
            sleep(wait * 2**attempt)
    return None


def json_object(body: str) -> None:
    """Raises ValueError for what is no JSON object."""
    if not isinstance(json.loads(body), dict):
        raise ValueError("not a JSON object")


class Requests(InputPartition):
    """Requests that follow each other."""

    def __init__(self, keys: list[tuple[str, ...]]):
        self.keys = keys

    @property
    def symbol(self) -> str:
        """The first request's."""
        return self.keys[0][0]


def dealt(keys: list[tuple[str, ...]], at_once: int) -> list[Requests]:
    """The keys over at most `at_once` partitions, as evenly as they go."""
    n = min(at_once, len(keys))
    return [Requests(keys[k::n]) for k in range(n)]


def names(options: dict) -> list[str]:
    return [s.strip() for s in options["symbols"].split(",") if s.strip()]


def first_host(hosts: list[str], account: str, token: str, **kw) -> str | None:
    """The first host that knows the account; None if none does."""
    for host in hosts:
        if fetch(f"{host}/accounts/{account}/summary", token, timeout=5.0, retries=1, **kw) is not None:
            return host
    return None


class CandleReader(DataSourceReader):
    """Option `frames` (as EUR_USD:H4,XAU_USD:Daily) asks for these only, else all time frames of the option `symbols`."""

    def __init__(self, options: dict, **kw):
        self.options, self.kw = options, kw

    def keys(self) -> list[tuple[str, ...]]:
        if "frames" in self.options:
            return [tuple(f.strip().rsplit(":", 1)) for f in self.options["frames"].split(",") if f.strip()]
        return [(s, tf) for s in names(self.options) for tf in GRANULARITY]

    def partitions(self) -> list[Requests]:
        return dealt(self.keys(), int(self.options.get("concurrency", CONCURRENCY)))

    def read(self, partition: Requests) -> Iterator[tuple]:
        count = int(self.options.get("limit", 500)) + 1
        for symbol, tf in partition.keys:
            url = f"{self.options['url']}/instruments/{symbol}/candles?count={count}&granularity={GRANULARITY[tf]}&price=M"
            yield symbol, tf, fetch(url, self.options.get("token", ""), accept=json_object, **self.kw)


class CandleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "candles_rest"

    def schema(self) -> str:
        return "symbol string, tf string, payload string"

    def reader(self, schema) -> CandleReader:
        return CandleReader(dict(self.options))


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict, **kw):
        self.options, self.kw = options, kw

    def partitions(self) -> list[Requests]:
        return dealt([(s,) for s in names(self.options)], int(self.options.get("concurrency", CONCURRENCY)))

    def read(self, partition: Requests) -> Iterator[tuple]:
        """A row for each symbol; its payload is null if the request failed."""
        for (symbol,) in partition.keys:
            url = f"{self.options['url']}/accounts/{self.options['account']}/pricing?instruments={symbol}"
            yield symbol, fetch(url, self.options.get("token", ""), timeout=5.0, accept=json_object, **self.kw)


class QuoteSource(DataSource):
    """Quote payloads; payloads.quotes() reads them."""

    @classmethod
    def name(cls) -> str:
        return "quotes_rest"

    def schema(self) -> str:
        return "symbol string, payload string"

    def reader(self, schema) -> QuoteReader:
        return QuoteReader(dict(self.options))
