"""Swing pivots: strict local extremes with a wick and a prominence condition, and two fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scores import decay_weight
from candela.operators.indicators import GROUP
from candela.schema import TF_PEAK_DISTANCE, by_tf, pivot_reach

LEAST = 15
PIVOT = "symbol string, tf string, kind string, bar_idx int, price double, weight double, prominence double"


def prominence_floor(share: float = 1.0) -> Column:
    """Least prominence; share 0.5 is the softer tier."""
    cap = F.when(F.col("asset_class").isin("INDEX", "METAL"), 0.012).otherwise(0.008)
    own = F.col("atr") * F.col("pivot_prominence_atr") * share
    return F.when(F.col("last_close") > 0, F.least(own, F.col("last_close") * cap)).otherwise(own)


def swings(bars: DataFrame) -> DataFrame:
    """bars with the neighbours' extremes over full frames, prominences and wick shares."""
    w = Window.partitionBy(*GROUP).orderBy("bar_idx")

    def over(fn, column: str, reach: int) -> tuple[Column, Column, Column]:
        return tuple(fn(column).over(w.rowsBetween(a, b)) for a, b in ((-reach, -1), (1, reach), (-reach, reach)))

    out = bars.withColumn("reach", pivot_reach())
    for name, fn, column in (("hi", F.max, "high"), ("lo", F.min, "low")):
        near, far = over(fn, column, 3), over(fn, column, 5)
        for part, a, b in zip(("left", "right", "around"), near, far):
            out = out.withColumn(f"{name}_{part}", F.when(F.col("reach") == 5, b).otherwise(a))
    full = (F.col("bar_idx") >= F.col("reach")) & (F.col("bar_idx") < F.col("n_bars") - F.col("reach"))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-10))
    return (
        out.withColumn("is_high", full & (F.col("high") > F.col("hi_left")) & (F.col("high") > F.col("hi_right")))
        .withColumn("is_low", full & (F.col("low") < F.col("lo_left")) & (F.col("low") < F.col("lo_right")))
        .withColumn("upper_wick", (F.col("high") - F.greatest("open", "close")) / span)
        .withColumn("lower_wick", (F.least("open", "close") - F.col("low")) / span)
        .withColumn("high_prominence", F.col("high") - F.col("lo_around"))
        .withColumn("low_prominence", F.col("hi_around") - F.col("low"))
    )


def candidates(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Swings that pass the wick condition, as pivots, with the tiers (full, half) whose prominence they reach.

    context: (symbol, tf, atr, last_close and the profile).
    """
    rows = swings(bars.filter(F.col("n_bars") >= LEAST)).join(context.filter("atr > 0").drop("n_bars"), list(GROUP))
    need = F.when(F.col("tf") == "H4", F.col("wick_intraday")).otherwise(F.col("wick_htf"))
    both = F.array(
        *(
            F.struct(F.lit(kind).alias("kind"), (F.col(f"is_{kind}") & (F.col("ignore_wick_filter") | (F.col(wick) >= need))).alias("found"), F.col(kind).alias("price"), F.col(f"{kind}_prominence").alias("prominence"))
            for kind, wick in (("high", "upper_wick"), ("low", "lower_wick"))
        )
    )
    rows = rows.withColumn("p", F.explode(both)).filter("p.found")
    return rows.select(
        *GROUP, "p.kind", "bar_idx", "p.price", decay_weight(F.col("bar_idx"), F.col("n_bars")).alias("weight"), "p.prominence",
        (F.col("p.prominence") >= prominence_floor()).alias("full"), (F.col("p.prominence") >= prominence_floor(0.5)).alias("half"),
    )


def tiered(found: DataFrame) -> DataFrame:
    """Candidates of the full tier; where there are fewer than three, of the half tier if it has more."""
    group = Window.partitionBy(*GROUP)
    counts = found.withColumn("n_full", F.sum(F.col("full").cast("int")).over(group)).withColumn("n_half", F.sum(F.col("half").cast("int")).over(group))
    tier = F.when((F.col("n_full") >= 3) | (F.col("n_half") <= F.col("n_full")), "full").otherwise("half")
    return counts.withColumn("tier", tier).filter(F.when(F.col("tier") == "full", F.col("full")).otherwise(F.col("half")))


def points(bars: DataFrame) -> DataFrame:
    """A row for each bar and kind: x, the height that peaks are looked for in (a low's is its negative), and the extremes of `reach` bars on either side."""
    w = Window.partitionBy(*GROUP, "kind").orderBy("bar_idx")
    heights = F.array(F.struct(F.lit("high").alias("kind"), F.col("high").alias("x")), F.struct(F.lit("low").alias("kind"), (-F.col("low")).alias("x")))
    rows = bars.select(*GROUP, "bar_idx", "n_bars", pivot_reach().alias("reach"), F.explode(heights).alias("p")).select(*GROUP, "bar_idx", "n_bars", "reach", "p.kind", "p.x")
    for side, sign in (("left", -1), ("right", 1)):
        for name, fn in (("top", F.max), ("low", F.min)):
            near, far = (fn("x").over(w.rowsBetween(*sorted((sign, sign * reach)))) for reach in (3, 5))
            rows = rows.withColumn(f"{side}_{name}", F.when(F.col("reach") == 5, far).otherwise(near))
    return rows


def tops(rows: DataFrame) -> DataFrame:
    """(symbol, tf, kind, bar_idx, x): local maxima; of a flat one the middle bar, none at the ends."""
    w = Window.partitionBy(*GROUP, "kind").orderBy("bar_idx")
    level = F.sum(F.coalesce((F.col("x") != F.lag("x").over(w)).cast("int"), F.lit(0))).over(w)
    flats = rows.select(*GROUP, "kind", "bar_idx", "x").withColumn("flat", level.alias("flat")).groupBy(*GROUP, "kind", "flat").agg(F.first("x").alias("x"), F.min("bar_idx").alias("first"), F.max("bar_idx").alias("last"))
    beside = Window.partitionBy(*GROUP, "kind").orderBy("flat")
    flats = flats.withColumn("before", F.lag("x").over(beside)).withColumn("after", F.lead("x").over(beside)).filter((F.col("before") < F.col("x")) & (F.col("after") < F.col("x")))
    return flats.select(*GROUP, "kind", F.floor((F.col("first") + F.col("last")) / 2).cast("int").alias("bar_idx"), "x")


def spaced(found: DataFrame) -> DataFrame:
    """Of the tops those that no higher one (of equals: later one) that stays is too near to.

    Each decision needs the ones before, so it is a fold over the group's tops from
    the highest down; a group has fewer than LIMIT bars.
    """
    downwards = F.reverse(F.array_sort(F.collect_list(F.struct("x", "bar_idx"))))
    groups = found.groupBy(*GROUP, "kind").agg(downwards.alias("all")).withColumn("distance", by_tf(TF_PEAK_DISTANCE, 5))

    def step(kept: Column, top: Column) -> Column:
        near = F.exists(kept, lambda k: F.abs(k - top["bar_idx"]) < F.col("distance"))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(top["bar_idx"])))

    kept = F.aggregate("all", F.array().cast("array<int>"), step)
    return groups.select(*GROUP, "kind", F.explode(kept).alias("bar_idx"))


def fallback(bars: DataFrame, context: DataFrame, poor: DataFrame) -> DataFrame:
    """Peaks of the (symbol, tf) in poor: spaced tops that are strict extremes over full `reach` bars on both sides and prominent enough."""
    own = points(bars.join(poor, list(GROUP), "left_semi"))
    floors = context.filter("atr > 0").select(*GROUP, prominence_floor(0.5).alias("least"))
    rows = own.join(spaced(tops(own)), [*GROUP, "kind", "bar_idx"]).join(floors, list(GROUP))
    full = (F.col("bar_idx") >= F.col("reach")) & (F.col("bar_idx") < F.col("n_bars") - F.col("reach"))
    strict = (F.col("x") > F.col("left_top")) & (F.col("x") > F.col("right_top"))
    prominence = F.col("x") - F.greatest("left_low", "right_low")
    rows = rows.withColumn("prominence", prominence).filter(full & strict & (F.col("prominence") >= F.col("least")))
    return rows.select(*GROUP, "kind", "bar_idx", F.abs("x").alias("price"), decay_weight(F.col("bar_idx"), F.col("n_bars")).alias("weight"), "prominence")


def merged(first: DataFrame, more: DataFrame) -> DataFrame:
    """Both, and of pivots at the same place the more prominent (of equals the first's)."""
    columns = ["symbol", "tf", "kind", "bar_idx", "price", "weight", "prominence"]
    both = first.select(*columns).withColumn("origin", F.lit(0)).unionByName(more.select(*columns).withColumn("origin", F.lit(1)))
    best = Window.partitionBy(*GROUP, "bar_idx", "kind").orderBy(F.col("prominence").desc(), "origin")
    return both.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place", "origin")


def pivots(bars: DataFrame, context: DataFrame) -> DataFrame:
    """(symbol, tf, kind, bar_idx, price, weight, prominence)."""
    chosen = tiered(candidates(bars, context))
    rich = chosen.groupBy(*GROUP).count().filter("count >= 3")
    poor = context.select(*GROUP).join(rich, list(GROUP), "left_anti")
    return merged(chosen, fallback(bars, context, poor))
