"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Each of the 64 bit positions gets a vector of RADIUS+1 bits; table v keeps the
positions whose vector has an odd inner product with v. Two fingerprints that
differ in at most RADIUS positions leave some v orthogonal to all of those
positions' vectors, so they agree in table v: every pair within the radius
collides in some table, and each table keeps about half the bits.

A bucket of more than BUCKET distinct fingerprints is dealt again by a family
of masks over the positions that its own mask leaves free, which covers its
pairs the same way. The vectors follow each other as powers in the field of 32
elements, so any few of them are spread over all dimensions: a third family
leaves ten free positions or fewer, hence at most 1,024 fingerprints; no bucket
grows with the corpus and none is cut.
Within a bucket near pairs are joined to local groups, of which only a star of
links leaves the task. Groups of distinct fingerprints then are found by
alternating large and small stars.

Defined results: null text counts as empty; texts without words have the
fingerprint zero and are linked like any other; rows with equal fingerprints
share a group, equal or null ids included; a group's id is its smallest
non-null id, null if it has none; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import appended, fresh, held, small, written

RADIUS, WIDTH, SEED, BUCKET = 4, 4, 42, 256
#: So many tasks may share the members of one group when they get its id.
SLICES = 32
#: Vectors of the positions, in order: powers of x modulo x^5 + x^2 + 1, each nonzero vector once.
VECTORS = [1]
while len(VECTORS) < (1 << RADIUS + 1) - 1:
    VECTORS.append(VECTORS[-1] << 1 ^ (0b100101 if VECTORS[-1] & 16 else 0))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, width: int = WIDTH, lower: bool = True) -> np.ndarray:
    """Hashes of the text's word shingles, with repeats; a text of fewer words is one shingle."""
    data = (text or "").encode()
    words = (data.translate(LOWER) if lower else data).split()  # at space and \\t to \\r
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, width: int = WIDTH, lower: bool = True) -> int:
    """64 bits; a bit is set if it is in over half the hashes of the text's word shingles."""
    return majority(shingles(text, width, lower))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits): bits is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash", dict)  # it has no tables, but other operators' may go
        for batch in batches:
            bits = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["doc_id", "bits"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, bits long")


def family(positions: list[int]) -> list[int]:
    """Masks over these bit positions, as signed integers, that cover every pair within RADIUS."""
    masks = [sum(1 << p for i, p in enumerate(positions) if (VECTORS[i % len(VECTORS)] & v).bit_count() & 1) for v in range(1, len(VECTORS) + 1)]
    return sorted({m - (1 << 64) if m >> 63 else m for m in masks})


def free(fixed: int) -> list[int]:
    return [p for p in range(64) if not fixed >> p & 1]


def deal(rows: DataFrame, fixed: list[int], spark: SparkSession) -> DataFrame:
    """(fixed, bits) -> (fixed, bits) once for each mask of the family over what fixed leaves free; fixed grows by that mask."""
    steps = [(f, f | m) for f in fixed for m in family(free(f & ((1 << 64) - 1)))]
    table = spark.createDataFrame(steps, "fixed long, wider long")  # 31 rows for each value of fixed: a constant
    return rows.join(F.broadcast(table), "fixed").select(F.col("wider").alias("fixed"), "bits")


def local_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets in; for each local group of near fingerprints a link from every member to its least."""
    for batch in batches:
        left, right = [], []
        for bucket in batch.column(0):
            bits = np.sort(np.array(bucket.as_py(), np.int64))
            near = np.bitwise_count((bits[:, None] ^ bits[None, :]).view(np.uint64)) <= RADIUS
            root = np.arange(len(bits))
            while True:
                lower = np.where(near, root[None, :], len(bits)).min(axis=1)
                lower = lower[lower]
                if (lower == root).all():
                    break
                root = lower
            linked = np.flatnonzero(root != np.arange(len(bits)))
            left.append(bits[linked])
            right.append(bits[root[linked]])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """(bits), each once -> (a, b): links that join all fingerprints within RADIUS of each other, directly or by others."""
    spark = distinct.sparkSession
    rows, fixed, found = distinct.select(F.lit(0).cast("long").alias("fixed"), "bits"), [0], []
    for level in (1, 2, 3):
        rows = deal(rows, fixed, spark)
        fixed = sorted({f | m for f in fixed for m in family(free(f & ((1 << 64) - 1)))})
        keyed = rows.withColumn("key", F.col("bits").bitwiseAND(F.col("fixed")))
        sizes = written(keyed.groupBy("fixed", "key").agg(F.count("*").alias("size")).filter("size > 1"))
        inside = keyed.join(small(sizes, 64), ["fixed", "key"])
        buckets = inside.filter(F.col("size") <= BUCKET) if level < 3 else inside
        buckets = buckets.groupBy("fixed", "key").agg(F.collect_set("bits").alias("members"))
        found.append(written(buckets.select("members").mapInArrow(local_links, "a long, b long").distinct()))
        if level == 3 or sizes.filter(F.col("size") > BUCKET).isEmpty():
            break
        rows = written(inside.filter(F.col("size") > BUCKET).select("fixed", "bits"))
        fixed = sorted(x[0] for x in rows.select("fixed").distinct().collect())  # masks, a constant number
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): every node of the graph but the roots, and the least node that it is connected with."""

    def large(edges: DataFrame) -> DataFrame:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        return ways.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def little(edges: DataFrame) -> DataFrame:
        ways = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = ways.groupBy("u").agg(F.min("v").alias("m"))
        hops = ways.join(least, "u")
        return hops.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()

    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    tasks = 2 * edges.sparkSession.sparkContext.defaultParallelism  # links are few for their documents: no more files than tasks run at once
    edges = written(edges.filter("a <> b").coalesce(tasks))
    before = mark(edges)
    while True:
        edges = written(little(large(edges)).coalesce(tasks))
        after = mark(edges)
        if tuple(after) == tuple(before):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bits, root (the group, as one of its fingerprints), component_id: one row for each document."""
    marked = written(with_fingerprints(docs, doc_id, text))
    distinct = written(marked.groupBy("bits").agg(F.min("doc_id").alias("least")))
    return rooted(marked, distinct, links(distinct.select("bits")))


def rooted(marked: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, bits), (bits, least id) and links between bits -> the rows of groups()."""
    roots = components(edges)
    found = distinct.join(roots, distinct["bits"] == roots["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    # members of a group are dealt over SLICES parts of it, its root (or a fingerprint without links) is in part 0
    found = found.withColumn("slice", F.when(F.col("bits") == F.col("root"), F.lit(0)).otherwise(F.pmod(F.xxhash64("bits"), F.lit(SLICES)).cast("int")))
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    parts = F.when(F.col("size") > 1, F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0)))
    ids = ids.select("root", "component_id", F.explode(parts).alias("slice"))
    return marked.join(found.join(ids, ["root", "slice"]).select("bits", "root", "component_id"), "bits").select("doc_id", "bits", "root", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest id stays (null ids last, one of equal ids)."""
    return without_copies(docs, groups(docs, doc_id, text), lambda t: signed(fingerprint(t)), doc_id, text)


def without_copies(docs: DataFrame, grouped: DataFrame, bits_of: Callable[[str | None], int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """deduplicate() by the rows of groups(); bits_of gives a text's bits again."""
    found = written(grouped)
    if found.agg((F.count("*") == F.countDistinct("doc_id")).alias("unique")).first()["unique"]:
        gone = written(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(doc_id)))
        return docs.join(small(gone, 24), doc_id, "left_anti")
    bits, root, key = (fresh(docs, x) for x in ("its_bits", "its_root", "its_key"))
    at = docs.columns.index(text)
    marked = appended(docs, lambda batch: [bits_of(t.as_py()) for t in batch.column(at)], bits, T.LongType(), pa.int64())
    row = F.xxhash64(F.to_json(F.struct(*(F.col(c) for c in docs.columns))))
    roots = found.select(F.col("bits").alias(bits), F.col("root").alias(root)).distinct()
    rooted = marked.join(roots, bits).withColumn(key, F.struct(F.col(doc_id).isNull().alias("absent"), F.col(doc_id).alias("id"), row.alias("row")))
    first = rooted.groupBy(root).agg(F.min(key).alias(key))
    return rooted.join(first, [root, key], "left_semi").dropDuplicates([root]).select(*docs.columns)
