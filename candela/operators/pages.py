"""The report as pages: tables cut to their columns' widths, each beginning on a page of its own, the head row on every page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.text import latin_text
from candela.schema import TIMEFRAMES

# Widths of the columns in millimetres, and the millimetres that a character takes.
ZONE_WIDTHS = {"symbol": 24, "price_text": 24, "type": 20, "level_text": 24, "force": 20, "score_text": 18, "status": 22, "dist": 16, "dist_atr": 16}
CONFLUENCE_WIDTHS = {"symbol": 20, "signal": 26, "level_text": 22, "type": 22, "timeframes": 50, "n_tf": 12, "force": 20, "score_text": 18, "status": 22, "dist_text": 18, "alert": 55}
HEADS = {
    "symbol": "Actif", "price_text": "Prix Actuel", "type": "Type", "level_text": "Niveau", "force": "Force", "score_text": "Score (1TF)", "status": "Statut", "dist": "Dist. %", "dist_atr": "Dist. ATR",
    "signal": "Signal", "timeframes": "Timeframes", "n_tf": "Nb TF", "dist_text": "Distance %", "alert": "Alerte",
}
CHARACTER = 1.25
#: Data rows that fit a page below its title and its head row.
ROWS = 32


def cell(value: Column, width: int) -> Column:
    """Text as the page shows it: cut, with a dot, to the characters that fit, and in the middle of them."""
    n = int(width / CHARACTER)
    text = latin_text(value.cast("string"))
    text = F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("."))).otherwise(text)
    return F.rpad(F.concat(F.repeat(F.lit(" "), F.floor((n - F.length(text)) / 2).cast("int")), text), n, " ")


def row_text(values: dict[str, Column], widths: dict[str, int]) -> Column:
    return F.concat(F.lit("|"), F.concat_ws("|", *(cell(values[c], w) for c, w in widths.items())), F.lit("|"))


def table(rows: DataFrame, title: str, section: int, widths: dict[str, int], order: list, rows_a_page: int = ROWS) -> DataFrame:
    """(section, part, line, text): part counts the section's pages from 0; line 0 is the title, line 1 the head row.

    A report has a few rows for each instrument; a section is put in order as one.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(*order)) - 1
    shown = rows.select(place.alias("place"), row_text({c: F.col(c) for c in widths}, widths).alias("text"))
    shown = shown.select(F.floor(F.col("place") / rows_a_page).cast("int").alias("part"), (F.col("place") % rows_a_page + 2).cast("int").alias("line"), "text")
    heads = {0: latin_text(F.lit(title)), 1: row_text({c: F.lit("Score" if c == "score_text" and "timeframes" in widths else "Force Totale" if c == "force" and "timeframes" in widths else HEADS[c]) for c in widths}, widths)}
    above = F.explode(F.array(*(F.struct(F.lit(k).alias("line"), text.alias("text")) for k, text in heads.items())))
    tops = shown.select("part").distinct().withColumn("h", above).select("part", "h.line", "h.text")
    return tops.unionByName(shown).select(F.lit(section).alias("section"), "part", "line", "text")


def pages(rows: DataFrame, anomalies: DataFrame, confluences: DataFrame, rows_a_page: int = ROWS) -> DataFrame:
    """(page, line, text): odd data, confluences from the highest score down, then a table for each time frame; pages count from 1."""
    odd = anomalies.filter("anomaly is not null and anomaly <> 'Prix STALE (marché fermé)'").select(latin_text(F.format_string("[!] %s : %s", F.replace("symbol", F.lit("_"), F.lit("/")), F.col("anomaly"))).alias("text"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("text"))
    first = F.when(F.col("place") == 0, 0).otherwise(F.floor((F.col("place") - 1) / rows_a_page)).cast("int")
    odd = odd.select(place.alias("place"), "text").unionByName(odd.limit(1).select(F.lit(0).alias("place"), F.lit("ALERTES ANOMALIES").alias("text")))
    out = odd.select(F.lit(0).alias("section"), first.alias("part"), F.when(F.col("place") == 0, 0).otherwise((F.col("place") - 1) % rows_a_page + 1).cast("int").alias("line"), "text")
    number = lambda c, digits: F.format_string(f"%.{digits}f", F.col(c))
    found = confluences.withColumns({"level_text": number("level", 5), "score_text": number("score", 1), "dist_text": number("dist_pct", 3), "symbol": F.replace("symbol", F.lit("_"), F.lit("/"))})
    out = out.unionByName(table(found, "ZONES DE CONFLUENCE", 1, CONFLUENCE_WIDTHS, [F.col("score").desc(), F.col("symbol"), F.col("level")], rows_a_page))
    for k, tf in enumerate(TIMEFRAMES, 2):
        own = rows.filter((F.col("tf") == tf) & F.col("in_pdf")).withColumn("score_text", number("score", 1))
        out = out.unionByName(table(own, f"Analyse {tf}", k, ZONE_WIDTHS, [F.col(c) for c in ("symbol", "type", "level_text")], rows_a_page))
    sizes = out.groupBy("section").agg((F.max("part") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each section
    return out.join(sizes.select("section", before.alias("before")), "section").select((F.col("before") + F.col("part") + 1).cast("int").alias("page"), "line", "text")


def page_texts(pages: DataFrame) -> DataFrame:
    """(name, body): a text for each page."""
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]))
    return pages.groupBy("page").agg(body.alias("body")).select(F.format_string("page-%04d.txt", "page").alias("name"), "body")
