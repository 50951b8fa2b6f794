"""Content hashes over all rows, for knowing whether a frame has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_hash(df: DataFrame, *group: str) -> DataFrame:
    """(group, rows, hash): equal for the same rows in any order; every row counts, none is sampled."""
    row = F.xxhash64(*(F.col(c) for c in df.columns if c not in group))
    rows = df.groupBy(*group) if group else df.groupBy()
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.bit_xor(row).cast("string")), 256).alias("hash"))


def map_hash(values: Column) -> Column:
    """Of a map, whatever the order of its keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values)))), 256)


def list_hash(values: Column) -> Column:
    return F.sha2(F.to_json(values), 256)


# Seconds that a fetched frame stays fresh; of unknown time frames, of empty frames.
TTL = {"H4": 60, "Daily": 300, "Weekly": 600}
TTL_OTHER, TTL_EMPTY = 300, 20


def time_to_live(tf: str, empty: bool) -> int:
    return TTL_EMPTY if empty else TTL.get(tf, TTL_OTHER)


def is_fresh(tf: Column, age_seconds: Column, rows: Column) -> Column:
    """Whether a cached frame may be used."""
    ttl = F.lit(TTL_OTHER)
    for name, seconds in TTL.items():
        ttl = F.when(tf == name, seconds).otherwise(ttl)
    return age_seconds <= F.when(rows == 0, TTL_EMPTY).otherwise(ttl)
