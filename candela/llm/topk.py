"""Exact top-k search by inner product of scaled integer vectors.

Candidates are dealt into shards and queries into tiles. Each pair of tile and
shard is one task group: a matrix product of at most BLOCK rows each, in strips
of STRIP queries, from which every query keeps its k best; the lists of 16
shards are merged at a time, until one list is left for each query.

Defined results: a component x counts as floor(scale * x), taken as double;
vectors that are null, or hold null or non-finite components, take no part;
vectors of other length than the query's aren't candidates; ties go to the
smaller id; a query is a distinct pair of id and vector, and one row that
equals it is its own and left out, so further copies of that row are
candidates; null ids take no part; other columns don't matter. Products whose
sums may pass 2**53 are put together from products of parts of components; a
score beyond 64 bits counts as the nearest number that a long holds; a vector
takes no part either if a scaled component isn't finite.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a tile or a shard at most, on average; queries in a strip; lists merged at once.
BLOCK, STRIP, FAN = 32_768, 256, 16


def usable(vec: Column, scale: float) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))


def scaled(vectors: pd.Series, scale: float) -> np.ndarray:
    return np.floor(scale * np.stack([np.asarray(v, np.float64) for v in vectors]))


#: Components are cut into parts of so many bits, whose products can be summed exactly in doubles.
PART_BITS, MOST = 20, 2**63 - 1


def parts_of(matrix: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as sums of parts: the k-th times 2**(PART_BITS * k), each below 2**PART_BITS; as many as the largest needs."""
    out, rest = [], matrix
    while not out or rest.any():
        left = np.trunc(rest / 2.0**PART_BITS)
        out.append(rest - left * 2.0**PART_BITS)
        rest = left
    return out


def product(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products, exact; beyond 64 bits the nearest number that a long holds."""
    width = max(1, shard.shape[1])
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * width
    if largest < 2**53:
        return (queries @ shard.T).astype(np.int64)
    own, other = parts_of(queries), parts_of(shard)
    kind = np.int64 if largest < 2**62 else object
    out = np.zeros((len(queries), len(shard)), kind)
    for i, a in enumerate(own):
        for j, b in enumerate(other):
            if a.any() and b.any():
                out += (a @ b.T).astype(np.int64).astype(kind) * (1 << PART_BITS * (i + j))
    return out if kind is np.int64 else np.maximum(np.minimum(out, MOST), -MOST - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query selects, its k best of all other rows."""
    spark = vectors.sparkSession
    rows = vectors.filter(is_query & F.lit(True)).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vec"))
    everything = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vec"))
    good = F.col("id").isNotNull() & usable(F.col("vec"), scale)
    rows, everything = rows.filter(good), everything.filter(good)
    dims, own = F.size("vec").alias("dims"), F.xxhash64("id", "vec").alias("own")
    queries = rows.select("id", "vec", dims, own).dropDuplicates(["id", "own"])
    everything = everything.select("id", "vec", dims, own)

    n, n_queries = everything.count(), queries.count()
    shards = max(-(-n // BLOCK), min(spark.sparkContext.defaultParallelism * 2, -(-n // 1024)), 1)
    tiles = max(-(-n_queries // BLOCK), 1)
    left = queries.withColumn("tile", F.pmod("own", F.lit(tiles)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = everything.withColumn("shard", F.pmod("own", F.lit(shards)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def meet(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(queries) and len(shard):
            shard = shard.sort_values("id", kind="stable")
            ids, owns, matrix = shard["id"].to_numpy(), shard["own"].to_numpy(), scaled(shard["vec"], scale)
            for at in range(0, len(queries), STRIP):
                strip = queries.iloc[at : at + STRIP]
                scores = product(scaled(strip["vec"], scale), matrix)
                for i, (query, own) in enumerate(zip(strip["id"].to_numpy(), strip["own"].to_numpy())):
                    low, high = np.searchsorted(ids, [query, query + 1] if query < 2**63 - 1 else [query, query])
                    mine = low + np.flatnonzero(owns[low:high] == own)[:1]
                    places = best(scores[i], ids, k + len(mine))
                    places = places[~np.isin(places, mine)][:k]
                    found.append(pd.DataFrame({"query_id": query, "own": own, "shard": int(shard["shard"].iloc[0]), "vec_id": ids[places], "score": scores[i][places]}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("query_id", "own", "shard", "vec_id", "score")})

    keys = ("dims", "tile", "shard")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, own long, shard int, vec_id long, score long")
    order = (F.col("score").desc(), F.col("vec_id"))
    while shards > FAN:
        shards = -(-shards // FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "own", "shard").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
    merged = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "own").orderBy(*order))).filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


ORACLE = """
with scaled as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scores as (
  select q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
  from scaled q join scaled c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scores qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
