"""Pivots to zones: clustering, status, merging, sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.operators.indicators import GROUP
from candela.schema import severity, status_of

ZONE = (*GROUP, "zone_type", "level", "strength", "age_bars", "status", "prominence", "prominence_atr", "is_major")


def bandwidth() -> Column:
    """From the columns price, atr and those of the profile."""
    wide = F.greatest(F.col("atr") * F.col("cluster_radius_atr"), F.col("price") * 0.0015)
    return F.least(wide, F.col("price") * (F.col("max_cluster_width_pct") / 100.0))


def clustered(pivots: DataFrame, context: DataFrame) -> DataFrame:
    """pivots with cluster_id (from 1) within (symbol, tf, kind), in price order.

    A new cluster begins where the gap to the pivot before passes the bandwidth
    or the span from the cluster's first passes 2.5 of it. The span starts
    anew with each cluster, so this is a fold over the group's ordered pivots,
    of which there are fewer than bars.
    """
    group = [*GROUP, "kind"]
    rows = pivots.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("price", "bar_idx", "weight", "prominence"))).alias("all"))
    rows = rows.join(context.select(*GROUP, bandwidth().alias("band")), list(GROUP))
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("id"), F.lit(0.0).alias("first"), F.lit(0.0).alias("last"))

    def step(s: Column, p: Column, band: Column) -> Column:
        new = (s["id"] == 0) | ~(band > 0) | (p["price"] - s["last"] > band) | (p["price"] - s["first"] > 2.5 * band)
        number = F.when(new, s["id"] + 1).otherwise(s["id"])
        return F.struct(F.concat(s["ids"], F.array(number)).alias("ids"), number.alias("id"), F.when(new, p["price"]).otherwise(s["first"]).alias("first"), p["price"].alias("last"))

    ids = F.aggregate("all", start, lambda s, p: step(s, p, F.col("band")), lambda s: s["ids"])
    out = rows.withColumn("pair", F.explode(F.arrays_zip(F.col("all").alias("pivot"), ids.alias("cluster_id"))))
    return out.select(*group, "pair.pivot.bar_idx", "pair.pivot.price", "pair.pivot.weight", "pair.pivot.prominence", "pair.cluster_id")


def metrics(clusters: DataFrame) -> DataFrame:
    """One row for each cluster: weighted level and prominence, touches, last pivot."""
    total = F.sum("weight")
    mean = lambda x: F.when(total > 0, F.sum(F.col(x) * F.col("weight")) / total).otherwise(F.avg(x))
    return clusters.groupBy(*GROUP, "kind", "cluster_id").agg(
        mean("price").alias("level"), mean("prominence").alias("prominence"), F.max("prominence").alias("max_prominence"), F.count_distinct("bar_idx").cast("int").alias("touches"), F.max("bar_idx").alias("last_idx"), F.count("*").alias("n_pivots")
    )


def from_clusters(clusters: DataFrame, context: DataFrame) -> DataFrame:
    """Zones without status: clusters with enough touches, or with one major pivot. context has min_touches."""
    rows = metrics(clusters).join(context.filter("atr > 0"), list(GROUP))
    major = (F.col("touches") == 1) & (F.col("max_prominence") >= F.col("atr") * F.col("major_pivot_mult"))
    rows = rows.withColumn("is_major", major).filter((F.col("touches") >= F.col("min_touches")) | F.col("is_major")).filter("level > 0")
    return rows.select(
        *GROUP, F.when(F.col("kind") == "high", "Resistance").otherwise("Support").alias("zone_type"), "level", F.col("touches").alias("strength"),
        F.greatest(F.lit(0), F.col("n_bars") - 1 - F.col("last_idx")).alias("age_bars"), "last_idx", "prominence", (F.col("prominence") / F.col("atr")).alias("prominence_atr"), "is_major", "atr", "n_bars",
    )


def tests_and_breaks(zones: DataFrame, bars: DataFrame) -> DataFrame:
    """A row for each zone and later bar, with the flags tested, broke, near (twice the tolerance) and undone."""
    rows = zones.withColumn("tol", F.col("atr") * 0.25).join(bars.select(*GROUP, "bar_idx", "high", "low", "close"), list(GROUP)).filter(F.col("bar_idx") > F.col("last_idx"))
    support, level, tol, close = F.col("zone_type") == "Support", F.col("level"), F.col("tol"), F.col("close")
    return (
        rows.withColumn("tested", F.when(support, (F.col("low") <= level + tol) & (close > level - tol)).otherwise((F.col("high") >= level - tol) & (close < level + tol)))
        .withColumn("broke", F.when(support, close < level - tol).otherwise(close > level + tol))
        .withColumn("near", (F.col("low") <= level + tol * 2) & (F.col("high") >= level - tol * 2))
        .withColumn("undone", F.when(support, close > level + tol).otherwise(close < level - tol))
    )


def stages(zones: DataFrame, bars: DataFrame) -> DataFrame:
    """zones with tested, break_idx, retest_idx and undone; the three minima follow from one another in one pass over each zone's bars."""
    key = [*GROUP, "zone_type", "level", "last_idx"]
    zone = Window.partitionBy(*key)
    rows = tests_and_breaks(zones, bars)
    rows = rows.withColumn("break_idx", F.min(F.when(F.col("broke"), F.col("bar_idx"))).over(zone))
    rows = rows.withColumn("retest_idx", F.min(F.when(F.col("near") & (F.col("bar_idx") > F.col("break_idx")), F.col("bar_idx"))).over(zone))
    found = rows.groupBy(*key).agg(
        F.max(F.col("tested").cast("int")).alias("tested"), F.first("break_idx").alias("break_idx"), F.first("retest_idx").alias("retest_idx"),
        F.max(F.when(F.col("bar_idx") > F.col("retest_idx"), F.col("undone").cast("int")).otherwise(0)).alias("undone"),
    )
    return zones.join(found, key, "left")


def with_status(zones: DataFrame, bars: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("break_idx").isNull(), F.when(F.col("tested") == 1, "Testee").otherwise("Vierge"))
        .when(F.col("retest_idx").isNull() | (F.col("undone") == 1), "Consommee")
        .otherwise("Role Reverse")
    )
    return stages(zones, bars).withColumn("status", status).select(*ZONE)


def merged(zones: DataFrame, context: DataFrame, across: bool = False) -> DataFrame:
    """Adjacent zones of one type joined; across: of all types, where two major zones of different types make a Pivot.

    Each zone is compared with the merged zone before it, whose level has
    drifted to the mean by strength; so this is a fold over the side's zones.
    """
    fields = ["level", "zone_type", "age_bars", "strength", "severity", "prominence", "prominence_atr", "is_major"]
    side = [*GROUP] if across else [*GROUP, "zone_type"]
    rows = zones.filter("status <> 'Consommee'").withColumn("severity", severity(F.col("status")))
    rows = rows.groupBy(*side).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all")).drop("zone_type")
    rows = rows.join(context.select(*GROUP, F.least(F.col("atr") * F.col("merge_threshold_atr"), F.col("price") * 0.0075).alias("reach")), list(GROUP))

    def step(done: Column, z: Column, reach: Column) -> Column:
        p = F.try_element_at(done, F.lit(-1))
        weight = lambda x: F.greatest(x["strength"], F.lit(1))
        strength = weight(p) + weight(z)
        same = p["zone_type"] == z["zone_type"]
        both = F.struct(
            ((p["level"] * weight(p) + z["level"] * weight(z)) / strength).alias("level"), F.when(same, p["zone_type"]).otherwise("Pivot").alias("zone_type"), F.least(p["age_bars"], z["age_bars"]).alias("age_bars"), strength.alias("strength"), F.greatest(p["severity"], z["severity"]).alias("severity"),
            F.greatest(p["prominence"], z["prominence"]).alias("prominence"), F.greatest(F.coalesce(p["prominence_atr"], F.lit(0.0)), F.coalesce(z["prominence_atr"], F.lit(0.0))).alias("prominence_atr"), (p["is_major"] | z["is_major"]).alias("is_major"),
        )
        close = (reach > 0) & (F.abs(z["level"] - p["level"]) <= reach) & (same | (p["is_major"] & z["is_major"]))
        return F.when((F.size(done) == 0) | ~close, F.concat(done, F.array(z))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both)))

    empty = F.slice("all", 1, 0)
    out = rows.withColumn("z", F.explode(F.aggregate("all", empty, lambda done, z: step(done, z, F.col("reach")))))
    return out.select(*GROUP, "z.zone_type", "z.level", "z.strength", "z.age_bars", status_of(F.col("z.severity")).alias("status"), "z.prominence", "z.prominence_atr", "z.is_major")


def reclassified(zones: DataFrame, price: str = "price") -> DataFrame:
    """A resistance below the price and a support at or above it become pivots."""
    wrong = ((F.col("zone_type") == "Resistance") & (F.col("level") < F.col(price))) | ((F.col("zone_type") == "Support") & (F.col("level") >= F.col(price)))
    return zones.withColumn("zone_type", F.when(wrong, "Pivot").otherwise(F.col("zone_type")))


def sided(zones: DataFrame, price: str = "price") -> DataFrame:
    """zones with side, Support below the price and Resistance from it on; types that don't fit their side go."""
    below = F.col("level") < F.col(price)
    return zones.withColumn("side", F.when(below, "Support").otherwise("Resistance")).filter((F.col("zone_type") == F.col("side")) | (F.col("zone_type") == "Pivot"))


def near_price(price: str = "price") -> Column:
    return F.abs(F.col("level") - F.col(price)) / F.col(price) * 100 <= 0.50
