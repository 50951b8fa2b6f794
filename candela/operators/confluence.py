"""Zones of several time frames that lie close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scores import half_even
from candela.schema import CONFLUENCE_THRESHOLDS, TF_LAMBDA, TF_WEIGHT, UI_CONFLUENCE_THRESHOLD, by_tf, severity, status_of, with_profile


def threshold(own: float | None = UI_CONFLUENCE_THRESHOLD, symbol: str = "symbol") -> Column:
    """Percent: the symbol's own where it has one, else the user's; without a user's value (own is None) the profile's, from its columns."""
    if own is None:
        return F.col("confluence_threshold_pct")
    return by_tf(CONFLUENCE_THRESHOLDS, float(own), symbol)


def with_threshold(zones: DataFrame, own: float | None = UI_CONFLUENCE_THRESHOLD) -> DataFrame:
    """zones with threshold; zones may hold columns of their profile already, so only the one that is needed is joined."""
    rows = zones if own is not None else with_profile(zones.drop("confluence_threshold_pct"), ["confluence_threshold_pct"])
    return rows.withColumn("threshold", threshold(own)).select(*(F.col(c) for c in zones.columns if c in rows.columns), "threshold")


def islands(zones: DataFrame, own: float | None = UI_CONFLUENCE_THRESHOLD) -> DataFrame:
    """zones with island: levels of a symbol whose neighbours are no farther apart than its threshold, in percent of the lower.

    Linking every pair within the threshold gives the same groups, as a linked
    pair's inner gaps are smaller and their bases larger.
    """
    order = Window.partitionBy("symbol").orderBy("level", "tf", "side", "age_bars")
    before = F.lag("level").over(order)
    gap = F.when(before.isNull() | ~(before > 0), F.lit(1)).when((F.col("level") - before) / before * 100 > F.col("threshold"), 1).otherwise(0)
    rows = with_threshold(zones.filter("status <> 'Consommee'"), own)
    return rows.withColumn("gap", gap).withColumn("island", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("gap", "threshold")


def kept_islands(rows: DataFrame) -> DataFrame:
    """Islands with at least two time frames or a major zone."""
    island = Window.partitionBy("symbol", "island")
    rows = rows.withColumn("n_tf", F.size(F.collect_set("tf").over(island))).withColumn("any_major", F.max(F.col("is_major").cast("int")).over(island))
    return rows.filter("n_tf >= 2 or any_major = 1").drop("n_tf", "any_major")


def nearest(rows: DataFrame) -> DataFrame:
    """Of each island and time frame the zone nearest the island's mean level."""
    mean = F.avg("level").over(Window.partitionBy("symbol", "island"))
    rows = rows.withColumn("off", F.abs(F.col("level") - mean))
    best = Window.partitionBy("symbol", "island", "tf").orderBy("off", "level", "side", "age_bars")
    return rows.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place", "off")


def scored(rows: DataFrame) -> DataFrame:
    """One row for each island. rows has price and n_bars."""
    age = F.least(F.greatest(F.col("age_bars") / F.greatest(F.col("n_bars"), F.lit(1)), F.lit(0.0)), F.lit(1.0))
    term = F.col("strength") * by_tf(TF_WEIGHT, 1.0) * F.exp(-by_tf(TF_LAMBDA, 1.5) * age)
    groups = rows.groupBy("symbol", "island").agg(
        F.avg("level").alias("level"), F.first("price").alias("price"), F.count("*").alias("n"), F.count_if(F.col("level") < F.col("price")).alias("below"), F.size(F.collect_set("tf")).alias("n_tf"),
        F.array_join(F.array_sort(F.collect_set("tf")), " + ").alias("timeframes"), F.sum("strength").alias("force"), F.sum(term).alias("terms"), F.sum(F.col("is_major").cast("int")).alias("majors"), F.max(severity(F.col("status"))).alias("severity"),
    )
    bonus = 1.0 + 0.3 * F.least(F.col("majors"), F.lit(2))
    groups = groups.withColumn("dist_pct", F.abs(F.col("price") - F.col("level")) / F.col("price") * 100).withColumn("score", F.col("terms") * F.sqrt(F.greatest("n_tf", F.lit(1))) * bonus)
    kind = F.when(F.col("dist_pct") <= 0.50, "Pivot").when(F.col("below") >= F.col("n") - F.col("below"), "Support").otherwise("Resistance")
    groups = groups.withColumn("type", kind)
    signal = F.when(F.col("type") == "Pivot", "↔ PIVOT ZONE").when(F.col("type") == "Support", "🟢 BUY ZONE").otherwise("🔴 SELL ZONE")
    alert = F.when(F.col("dist_pct") < 0.5, "🔥 ZONE CHAUDE").when(F.col("dist_pct") < 1.5, "⚠️ Proche").otherwise("")
    return groups.select("symbol", "island", signal.alias("signal"), "level", "type", "timeframes", "n_tf", "force", "score", status_of(F.col("severity")).alias("status"), "dist_pct", alert.alias("alert"))


def confluences(zones: DataFrame, own: float | None = UI_CONFLUENCE_THRESHOLD) -> DataFrame:
    return scored(nearest(kept_islands(islands(zones, own))))


def as_number(value: str, otherwise: float) -> Column:
    """What may come as text, with a percent sign; what can't be read is otherwise."""
    return F.coalesce(F.expr(f"try_cast(replace(cast({value} as string), '%', '') as double)"), F.lit(otherwise))


def stored_values(rows: DataFrame) -> DataFrame:
    """Confluences as readers get them: scores of one decimal, distances of three, levels of five."""
    return rows.withColumns({name: half_even(F.col(name), digits) for name, digits in (("score", 1), ("dist_pct", 3), ("level", 5)) if dict(rows.dtypes).get(name) == "double"})


def filtered(rows: DataFrame, max_dist: float, min_score: float, statuses=("Vierge", "Testee", "Role Reverse")) -> DataFrame:
    """By the values that readers get. Distances and scores may come as text; what can't be read counts as far away and worthless."""
    rows = stored_values(rows)
    return rows.filter((as_number("dist_pct", 999999.0) <= max_dist) & (as_number("score", 0.0) >= min_score) & F.col("status").isin(list(statuses)))


def by_score(rows: DataFrame, max_dist: float) -> DataFrame:
    """Those near enough, the highest score first."""
    return rows.filter(as_number("dist_pct", 999999.0) <= max_dist).orderBy(F.col("score").desc(), "symbol", "level")
