"""Zones kept between scans by what they follow from, so that a scan computes only the frames that have changed.

A frame's key is a hash over all its bars, the working price, the touches that
are asked for and its profile: what its zones follow from, and nothing else. A
rescan joins the keys of the frames at hand with the kept ones; frames whose key
is known keep their zones, the others go through pivots, clusters and merging.
Frames without zones are kept as well, else they would be computed every time.
"""

from __future__ import annotations

import dataclasses
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.hashes import frame_hash
from candela.plans.scan import GROUP, Scan
from candela.storage import written


class Memo(NamedTuple):
    frames: DataFrame  # symbol, tf, key, recomputed: whether the scan that gave this memo computed it
    zones: DataFrame  # as Scan.zones, with key


def keys(scan: Scan) -> DataFrame:
    """(symbol, tf, key) of the frames that can have zones."""
    bars = frame_hash(scan.bars.select(*GROUP, "ts", "open", "high", "low", "close", "volume"), *GROUP).select(*GROUP, "hash")
    given = [F.col(c).cast("string") for c in ("hash", "price", "min_touches", "profile_key")]
    return bars.join(scan.usable, GROUP).select(*GROUP, F.sha2(F.concat_ws("|", *given), 256).alias("key"))


def of_frames(scan: Scan, frames: DataFrame) -> Scan:
    """The same scan for these frames only; prices are those of the whole scan."""
    part = dataclasses.replace(scan)
    for name in ("bars", "context"):
        part.__dict__[name] = getattr(scan, name).join(frames.select(*GROUP), GROUP, "left_semi")
    part.__dict__["prices"] = scan.prices
    return part


def rescanned(scan: Scan, known: Memo | None = None) -> Memo:
    """The scan's zones; those of frames that `known` has under the same key come from there."""
    now = written(keys(scan))
    if known is None:
        return Memo(now.withColumn("recomputed", F.lit(True)), written(scan.zones.join(now, GROUP)))
    changed = written(now.join(known.frames.select(*GROUP, "key"), [*GROUP, "key"], "left_anti"))
    fresh = of_frames(scan, changed).zones.join(changed, GROUP)
    kept = known.zones.join(now, [*GROUP, "key"], "left_semi")
    frames = now.join(changed.withColumn("recomputed", F.lit(True)), [*GROUP, "key"], "left").withColumn("recomputed", F.coalesce("recomputed", F.lit(False)))
    return Memo(frames, written(kept.unionByName(fresh)))
