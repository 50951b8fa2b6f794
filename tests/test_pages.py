"""The laid-out report, and files that are written whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from candela.operators import pages
from candela.sinks import write_files


def zones(spark, n):
    rows = [("EUR/USD", "Daily", "1.10000", "SUPPORT", f"{i:09.5f}", "3 touches", float(i), "Testée", "1.00%", "0.5x", True) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, tf string, price_text string, type string, level_text string, force string, score double, status string, dist string, dist_atr string, in_pdf boolean")


CONFLUENCES = "symbol string, island int, signal string, level double, type string, timeframes string, n_tf int, force bigint, score double, status string, dist_pct double, alert string"


def test_pages_break_and_repeat_their_head(spark):
    none = spark.createDataFrame([], CONFLUENCES)
    odd = spark.createDataFrame([("EUR_USD", "PRIX < MIN"), ("XAU_USD", None), ("USD_JPY", "Prix STALE (marché fermé)")], "symbol string, anomaly string")
    got = {}
    for r in pages.pages(zones(spark, 7), odd, none, 3).orderBy("page", "line").collect():
        got.setdefault(r["page"], []).append((r["line"], r["text"]))
    assert sorted(got) == [1, 2, 3, 4] and [len(got[k]) for k in (1, 2, 3, 4)] == [2, 5, 5, 3]
    assert got[1] == [(0, "ALERTES ANOMALIES"), (1, "[!] EUR/USD : PRIX < MIN")]
    assert all(got[k][0] == (0, "Analyse Daily") and got[k][1] == got[2][1] for k in (2, 3, 4)) and "Prix Actuel" in got[2][1][1]
    assert all(len(text) == len(got[2][1][1]) for k in (2, 3, 4) for _, text in got[k][1:]) and "Testee" in got[2][2][1]
    assert pages.pages(zones(spark, 0), odd.limit(0), none).count() == 0


def test_long_cells_are_cut_with_a_dot(spark):
    row = spark.range(1).select(pages.cell(F.lit("x" * 50), 20).alias("a"), pages.cell(F.lit("ab"), 5).alias("b"), pages.cell(F.lit(None).cast("string"), 5).alias("c")).first()
    assert row["a"] == "x" * 15 + "." and row["b"] == " ab " and row["c"] == "    "


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "report")
    first = spark.createDataFrame([("a b.txt", "one\ntwo"), ("page=2.txt", "")], "name string, body string")
    assert write_files(first, folder) == ["a b.txt", "page=2.txt"] == sorted(f for f in os.listdir(folder) if not f.startswith("."))
    assert open(f"{folder}/a b.txt").read() == "one\ntwo\n"
    broken = spark.createDataFrame([("a b.txt", "new"), ("c.txt", "boom")], "name string, body string").withColumn("body", F.when(F.col("body") == "boom", F.raise_error(F.lit("no"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="no"):
        write_files(broken, folder)
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == ["a b.txt", "page=2.txt"] and open(f"{folder}/a b.txt").read() == "one\ntwo\n"
    assert write_files(first.withColumn("body", F.lit("again")), folder) and open(f"{folder}/a b.txt").read() == "again\n"
    assert write_files(pages.page_texts(spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "page int, line int, text string")), folder) == ["page-0001.txt", "page-0002.txt"]
    assert open(f"{folder}/page-0001.txt").read() == "a\nb\n"
