"""Bars and quotes from the JSON that brokers' REST services send."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scores import finite
from candela.operators.bars import LIMIT, keep_last, valid
from candela.schema import with_profile

CANDLES = "candles array<struct<time: string, complete: string, volume: string, mid: struct<o: string, h: string, l: string, c: string>>>"
PRICES = "prices array<struct<closeoutBid: string, closeoutAsk: string, tradeable: boolean>>"


def parsed(payloads: DataFrame) -> DataFrame:
    """(symbol, tf, payload) -> a row for each candle, and one for each payload without any; answer says what is wrong with the payload.

    Bodies that can't be read land in Spark's column for corrupt records and
    don't end the job. unreadable: a complete candle of sound prices whose time or
    volume can't be read, which spoils its frame; single unsound candles don't.
    """
    body = F.from_json("payload", f"{CANDLES}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    rows = with_profile(payloads.select("symbol", "tf", "payload", body.alias("j")), ["max_high_low_ratio"])
    answer = F.when(F.col("payload").isNull(), "no answer").when(F.col("j").isNull() | (F.col("j.candles").isNull() & F.col("j.corrupt").isNotNull()), "not JSON")
    rows = rows.select("symbol", "tf", "max_high_low_ratio", answer.alias("answer"), F.posexplode_outer("j.candles").alias("arrival", "c"))
    price = lambda field: F.col(f"c.mid.{field}").try_cast("double")
    rows = rows.select(
        "symbol", "tf", "answer", "max_high_low_ratio", "arrival", F.coalesce(F.lower("c.complete") == "true", F.lit(False)).alias("complete"), F.try_to_timestamp("c.time").alias("ts"),
        price("o").alias("open"), price("h").alias("high"), price("l").alias("low"), price("c").alias("close"),
        F.when(F.col("c.volume").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("c.volume").try_cast("double").try_cast("bigint")).alias("volume"),
    )
    sound = F.col("complete") & valid(F.col("max_high_low_ratio"))
    return rows.withColumn("sound", sound).withColumn("unreadable", sound & (F.col("ts").isNull() | F.col("volume").isNull())).drop("max_high_low_ratio", "complete")


def frame_errors(rows: DataFrame) -> DataFrame:
    """parsed() -> (symbol, tf, error): frames that can't be used."""
    found = rows.groupBy("symbol", "tf").agg(F.min("answer").alias("answer"), F.max("unreadable").alias("unreadable"))
    return found.select("symbol", "tf", F.coalesce("answer", F.when(F.col("unreadable"), F.lit("unreadable candle"))).alias("error")).filter("error is not null")


def usable_candles(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """parsed() -> bars: the last `limit` sound candles in order of arrival, then one for each start; none of a frame with an error."""
    frame = Window.partitionBy("symbol", "tf")
    rows = rows.withColumn("spoilt", F.max(F.col("unreadable") | F.col("answer").isNotNull()).over(frame)).filter(F.col("sound") & ~F.col("spoilt"))
    rows = rows.withColumn("place", F.row_number().over(frame.orderBy(F.col("arrival").desc()))).filter(F.col("place") <= limit)
    return keep_last(rows.drop("place", "spoilt", "sound", "unreadable", "answer")).drop("arrival")


def candles(payloads: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(symbol, tf, payload) -> bars."""
    return usable_candles(parsed(payloads), limit)


def quotes(payloads: DataFrame) -> DataFrame:
    """(symbol, payload) -> (symbol, price, source): the middle of bid and ask, live or stale; null without a sound quote."""
    p = F.get(F.from_json("payload", PRICES)["prices"], F.lit(0))
    rows = payloads.select("symbol", p.alias("p"))
    bid, ask = F.expr("try_cast(p.closeoutBid as double)"), F.expr("try_cast(p.closeoutAsk as double)")
    sound = finite(bid) & finite(ask) & (bid > 0)
    return rows.select("symbol", F.when(sound, (bid + ask) / 2).alias("price"), F.when(sound, F.when(F.coalesce("p.tradeable", F.lit(True)), "live").otherwise("stale")).alias("source"))
