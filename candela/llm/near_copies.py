"""Near-duplicate groups by the Jaccard similarity of word shingles: candidates by SimHash and MinHash bands, verified by exact sets.

Each distinct set of shingles has a SimHash fingerprint; those within
simhash.RADIUS of its 64 bits are found by its covering family. That alone can't
give these groups: a pair of similarity 0.8 is expected to differ in 9.7 bits, and
a covering family for the radius that finds nearly all of those has over 2^16
masks. So each set also gets BANDS keys of ROWS least hashes; a pair of similarity
s shares a key with probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8. No other
step loses a pair: of every bucket all members are compared with one of them, that
of most and largest buckets, and where this leaves several groups in a bucket, all
pairs of different groups are compared, large buckets by tiles of two strips of
STRIP members. No bucket is capped. There the parities of shingles by PLACES places
of their hashes are compared first: sets differ in at least as many shingles as
parities do, so pairs that differ in too many go without any loss. Every link is
verified by its two whole sets of shingles.

Defined results: words and letter case as in simhash; a text of fewer words than
the width is one shingle; texts without words (null too) are one group; a group's
id is its smallest non-null id. Sets are told apart by 64 bits, shingles too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm import simhash
from candela.llm.common import held, small, written

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS, STRIP, PLACES = 20, 5, 256, 1024
#: Odd multipliers and masks of the BANDS * ROWS hash functions.
_mixed = np.array([xxhash.xxh64_intdigest(bytes([k & 255, k >> 8]), 7) for k in range(2 * BANDS * ROWS)], np.uint64)
ODD, FLIP = _mixed[::2] | np.uint64(1), _mixed[1::2]


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(simhash.shingles(text, width))


def set_key(found: np.ndarray) -> int:
    """64 signed bits that stand for the set; 0 for the empty one."""
    return simhash.signed(xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED)) if len(found) else 0


def band_keys(found: np.ndarray) -> list[int]:
    """A key for each band; none for the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[at : at + 1024, None] ^ FLIP) * ODD).min(axis=0))
    return [simhash.signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def parities(found: np.ndarray) -> bytes:
    """For each place whether an odd number of the set's shingles fall on it."""
    return np.packbits(np.bincount((found % np.uint64(PLACES)).astype(np.int64), minlength=PLACES) & 1).tobytes()


def with_keys(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, bits, n, print, odd, bands): bits stands for the text's set of n shingles, print is its SimHash, odd its parities."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near_copies", dict)  # it has no tables, but other operators' may go
        for batch in batches:
            rows = []
            for value in batch.column(1):
                found = shingle_set(value.as_py(), width)
                rows.append((set_key(found), len(found), simhash.signed(simhash.majority(found)), parities(found), band_keys(found)))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "bits", "n", "print", "odd", "bands"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, bits long, n long, print long, odd binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, text: str) -> DataFrame:
    """(bits, found): the whole set of shingles of each of the wanted bits."""
    listed = small(wanted, 24)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t.as_py(), width) for t in batch.column(0).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["bits", "found"])

    made = docs.select(F.col(text).alias("text")).mapInArrow(run, "bits long, found binary")
    return written(made.join(listed, "bits", "left_semi").dropDuplicates(["bits"]))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are that similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("bits").alias("a"), F.col("found").alias("x")), sets.select(F.col("bits").alias("b"), F.col("found").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def pairs_across(similarity: float):
    """Tiles in, rows (members); out: pairs of different roots whose sizes and parities allow the similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                listed = sorted(members.as_py(), key=lambda m: m["bits"])
                bits, root, n, strip = np.array([[m["bits"], m["root"], m["n"], m["strip"]] for m in listed], np.int64).T
                odd = np.frombuffer(b"".join(m["odd"] for m in listed), np.uint64).reshape(len(listed), -1)
                lone = strip.min() == strip.max()  # a tile of two strips leaves the pairs inside one to that strip's own tile
                for i in range(len(bits) - 1):
                    low, high = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
                    ok = (root[i + 1 :] != root[i]) & (low >= similarity * high) & (lone | (strip[i + 1 :] != strip[i]))
                    maybe = i + 1 + np.flatnonzero(ok)
                    apart = np.bitwise_count(odd[maybe] ^ odd[i]).sum(axis=1, dtype=np.int64)  # shingles in one set only: so many at least
                    there = bits[maybe[apart * (1 + similarity) <= (n[maybe] + n[i]) * (1 - similarity) + 1e-6]]
                    if len(there):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), bits[i])), pa.array(there)], names=["a", "b"])

    return run


def simhash_candidates(distinct: DataFrame) -> DataFrame:
    """(bits, print) -> (a, b): every set of a group of near SimHashes and the group's least."""
    prints = written(distinct.select(F.col("print").alias("bits")).distinct())
    roots = simhash.components(simhash.links(prints))
    rows = written(distinct.select("bits", "print").join(small(roots.withColumnRenamed("node", "print"), 24), "print", "left").select("bits", F.coalesce("root", "print").alias("root")))
    heads = written(rows.groupBy("root").agg(F.min("bits").alias("b"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    return written(rows.join(small(heads, 24), "root").filter("bits <> b").select(F.col("bits").alias("a"), "b"))


def links(docs: DataFrame, distinct: DataFrame, width: int, similarity: float, text: str) -> DataFrame:
    """(bits, n, print, odd, bands) -> (a, b): links that join all similar sets that share a band, and those of near SimHashes that are similar to their group's least, directly or by others."""
    by_print = simhash_candidates(distinct)
    rows = distinct.select("bits", "n", F.explode("bands").alias("key"))
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    inside = written(rows.join(small(sizes, 40), "key"))
    weights = written(inside.groupBy("bits").agg(F.sum("size").alias("weight")))
    heads = inside.join(small(weights, 40), "bits").groupBy("key").agg(F.max(F.struct("weight", "bits", "n")).alias("head")).select("key", F.col("head.bits").alias("b"), F.col("head.n").alias("m"))
    wanted = written(weights.select("bits").union(by_print.select("a")).union(by_print.select("b")).distinct())
    sets = sets_of(docs, wanted, width, text)
    fits = F.least("n", "m") >= similarity * F.greatest("n", "m")
    star = inside.join(heads, "key").filter(fits).select(F.col("bits").alias("a"), "b").filter("a <> b").unionByName(by_print).distinct()
    first = written(verified(star, sets, similarity))
    roots = simhash.components(first)
    rooted = inside.join(small(roots.select(F.col("node").alias("bits"), "root"), 40), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    rooted = written(rooted)
    open_keys = written(rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key"))
    parts = F.ceil(F.col("size") / STRIP).cast("int")
    split = written(rooted.join(small(open_keys, 24), "key").withColumn("strip", F.pmod(F.xxhash64("bits"), parts).cast("int")))
    split = split.join(distinct.select("bits", "odd"), "bits")
    tiled = split.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tile = [F.least("strip", "other").alias("low"), F.greatest("strip", "other").alias("high")]
    tiles = tiled.groupBy("key", *tile).agg(F.collect_list(F.struct("bits", "root", "n", "strip", "odd")).alias("members"))
    pairs = tiles.select("members").mapInArrow(pairs_across(similarity), "a long, b long").distinct()
    return first.unionByName(written(verified(pairs, sets, similarity)))


def groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bits, root (the group, as one of its sets), component_id: one row for each document."""
    marked = written(with_keys(docs, width, doc_id, text))
    distinct = written(marked.groupBy("bits").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "print", "odd", "bands"))))
    return simhash.rooted(marked.select("doc_id", "bits"), distinct.select("bits", "least"), links(docs, distinct, width, similarity, text))


def deduplicate(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates of that similarity; which row of a group stays is as in simhash.deduplicate."""
    return simhash.without_copies(docs, groups(docs, width, similarity, doc_id, text), lambda t: set_key(shingle_set(t, width)), doc_id, text)
