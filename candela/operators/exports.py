"""Rows, labels and documents for readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scores import half_even, structural_score
from candela.schema import TIMEFRAMES
from candela.sinks import text_table


def price_context(zones: DataFrame, tf: str = "Daily") -> DataFrame:
    """(symbol, price_context): the nearest support and resistance within 5 percent. zones: side, level, price."""
    p, level = F.col("price"), F.col("level")
    close = F.abs(level - p) / p * 100 <= 5.0
    rows = zones.filter(F.col("tf") == tf).groupBy("symbol", "price").agg(
        F.max(F.when((F.col("side") == "Support") & (level < p) & close, level)).alias("s"), F.min(F.when((F.col("side") == "Resistance") & (level > p) & close, level)).alias("r")
    )
    dist = lambda x: F.abs(p - F.col(x)) / p * 100
    label = lambda x, on, by, sign: F.when(F.col(x).isNotNull(), F.format_string(f"%s: %.5f ({sign}%.2f%%)", F.when(dist(x) < 0.5, on).otherwise(by), F.col(x), dist(x)))
    text = F.concat_ws("  |  ", label("s", "SUR support", "S proche", "-"), label("r", "SUR resistance", "R proche", "+"))
    return rows.select("symbol", F.coalesce(F.nullif(text, F.lit("")), F.lit("Zone intermediaire")).alias("price_context"))


def display_rows(zones: DataFrame) -> DataFrame:
    """One formatted row for each level text and type of a (symbol, tf), supports first. zones: side, price, atr, n_bars, pdf_max_dist_pct."""
    p, level = F.col("price"), F.col("level")
    dist = F.abs(p - level) / p * 100
    rows = zones.withColumn("type", F.when(F.col("near_price"), "PIVOT").otherwise(F.col("side"))).withColumn("level_text", F.format_string("%.5f", level))
    first = Window.partitionBy("symbol", "tf", "level_text", "type").orderBy((F.col("side") != "Support").cast("int"), "level", "age_bars")
    rows = rows.withColumn("place", F.row_number().over(first)).filter("place = 1")
    return rows.select(
        F.replace(F.col("symbol"), F.lit("_"), F.lit("/")).alias("symbol"), "tf", F.format_string("%.5f", p).alias("price_text"), "type", "level_text", F.format_string("%d touches", F.col("strength").cast("int")).alias("force"),
        structural_score(F.col("strength"), F.lit(1), F.col("tf"), F.col("age_bars"), F.col("n_bars")).alias("score"), "status", F.format_string("%.2f%%", dist).alias("dist"),
        F.when(F.col("atr") > 0, F.format_string("%.1fx", F.abs(p - level) / F.col("atr"))).otherwise("N/A").alias("dist_atr"), (dist <= F.col("pdf_max_dist_pct")).alias("in_pdf"),
    )


def line(signal: Column, level: Column, score: Column, status: Column, dist: Column, timeframes: Column) -> Column:
    return F.format_string("- %s `%.5f` | Sc:%.1f | %s | %.3f | %s", signal, level, score, status, dist, timeframes)


def brief(confluences: DataFrame) -> DataFrame:
    """(symbol, brief): Markdown, a heading and a line for each confluence by level."""
    rows = confluences.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("level", line(*(F.col(c) for c in ("signal", "level", "score", "status", "dist_pct", "timeframes"))).alias("line")))).alias("lines")
    )
    return rows.select("symbol", F.concat_ws("\n", F.concat(F.lit("### "), F.col("symbol")), F.concat_ws("\n", F.transform("lines", lambda x: x["line"]))).alias("brief"))


def assets(summaries: DataFrame, confluences: DataFrame) -> DataFrame:
    """(symbol, current_price, current_price_source, zones_scan_status, zones): what the JSON export writes, one document for each symbol."""
    found = confluences.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("level", "signal", "type", "timeframes", "n_tf", "force", "score", "status", "dist_pct", "alert"))).alias("zones"))
    rows = summaries.join(found, "symbol", "left")
    return rows.select("symbol", "current_price", "current_price_source", F.when(F.col("zones").isNotNull(), "found").otherwise("none_detected").alias("zones_scan_status"), "zones")


def write_json(documents: DataFrame, path: str) -> None:
    documents.orderBy("symbol").write.mode("overwrite").json(path)


def write_brief(briefs: DataFrame, path: str) -> None:
    briefs.orderBy("symbol").select("brief").write.mode("overwrite").text(path)


ZONE_FIELDS = ("signal", "level", "type", "timeframes", "n_tf", "force", "score", "status", "dist_pct", "alert")


def json_document(summaries: DataFrame, confluences: DataFrame, generated_at: str, version: str = "1") -> DataFrame:
    """(document): one JSON text; assets by symbol with prices of five digits, and which of them have no zones.

    Of several summaries of a symbol the last counts, by their column place if
    they have one. One document holds a row for each symbol, so its size is that
    of the list of instruments.
    """
    if "place" in summaries.columns:
        summaries = summaries.groupBy("symbol").agg(*(F.max_by(c, "place").alias(c) for c in ("current_price", "current_price_source")))
    else:
        summaries = summaries.select("symbol", "current_price", "current_price_source").dropDuplicates(["symbol"])
    found = confluences.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("island", *ZONE_FIELDS))).alias("zones"))
    rows = summaries.join(found, "symbol", "left").withColumn("zones", F.coalesce(F.transform("zones", lambda z: z.dropFields("island")), F.expr("array()")))
    asset = F.struct("symbol", half_even(F.col("current_price"), 5).alias("current_price"), "current_price_source", F.when(F.size("zones") > 0, "found").otherwise("none_detected").alias("zones_scan_status"), "zones")
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("symbol", asset.alias("asset")))).alias("all"), F.array_sort(F.collect_list(F.when(F.size("zones") == 0, F.col("symbol")))).alias("empty"))
    document = F.struct(F.lit(generated_at).alias("generated_at"), F.lit(version).alias("scanner_version"), F.transform("all", lambda x: x["asset"]).alias("assets"), F.struct(F.col("empty").alias("assets_with_no_zones")).alias("diagnostics"))
    return whole.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def brief_document(confluences: DataFrame, generated: str, symbols: list[str] | None = None, title: str = "# BRIEF S/R") -> DataFrame:
    """(brief): the whole Markdown text; symbols in the given order, their lines by level; only the header if nothing is left."""
    place = F.array_position(F.array(*map(F.lit, symbols)), F.col("symbol")) if symbols else F.lit(0)
    lines = F.array_sort(F.collect_list(F.struct("island", line(*(F.col(c) for c in ("signal", "level", "score", "status", "dist_pct", "timeframes"))).alias("line"))))
    bodies = confluences.groupBy("symbol").agg(F.concat_ws("\n", F.concat(F.lit("### "), F.first("symbol")), F.concat_ws("\n", F.transform(lines, lambda x: x["line"])), F.lit("")).alias("body"))
    whole = bodies.agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "symbol", "body"))).alias("all"))
    header = f"{title}\n_Genere le {generated}_\n\n"
    return whole.select(F.concat(F.lit(header), F.concat_ws("\n", F.transform("all", lambda x: x["body"]))).alias("brief"))


def report(rows: DataFrame, anomalies: DataFrame, confluences: DataFrame) -> DataFrame:
    """(section, place, line): sections() with the confluences, highest score first, between odd data and tables."""
    shown = confluences.withColumn("level", F.format_string("%.5f", "level")).withColumn("score_text", F.format_string("%.1f", "score")).withColumn("dist", F.format_string("%.3f", "dist_pct")).withColumn("force", F.col("force").cast("string"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "symbol", "level"))  # a few rows for each symbol
    own = text_table(shown, ["symbol", "signal", "level", "type", "timeframes", "force", "score_text", "status", "dist"], 14).select(F.lit(0.5).alias("section"), place.alias("place"), "line")
    return sections(rows, anomalies).select(F.col("section").cast("double").alias("section"), F.lit(0).alias("place"), "line").unionByName(own)


def sections(rows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(section, line): the report's text, in order: odd data first, then a table for each time frame."""
    odd = anomalies.filter("anomaly is not null and anomaly <> 'Prix STALE (marché fermé)'").select(F.lit(0).alias("section"), F.format_string("[!] %s : %s", F.col("symbol"), F.col("anomaly")).alias("line"))
    out = odd
    for i, tf in enumerate(TIMEFRAMES, 1):
        part = text_table(rows.filter((F.col("tf") == tf) & F.col("in_pdf")), ["symbol", "price_text", "type", "level_text", "force", "status", "dist", "dist_atr"], 14)
        out = out.unionByName(part.select(F.lit(i).alias("section"), "line"))
    return out
