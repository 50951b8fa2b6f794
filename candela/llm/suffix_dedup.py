"""Removal of repeated passages by a distributed, sparse suffix array.

A passage is SPAN bytes. Of the suffixes that start in the first REACH bytes of
a passage the one whose leading LEAD bytes hash lowest is its anchor: equal
passages have their anchors at equal places, so only suffixes at anchors are
kept, about one in a hundred and thirty bytes. An anchor's context is all the
passages that it stands for. Anchors are found once and written; those whose
lead occurs once can't match and go. Equal contexts are one entry with a
multiplicity, told apart by 128 bits of hash, so copies meet in no task.

An entry whose lead no other context has is repeated exactly if its multiplicity
is above one. All others go through the suffix array: they are dealt by range
of their first KEY bytes and their lead (Spark samples the splitters from these
short keys), sorted in each bucket by multikey quicksort, and compared by bytes.
A bucket's edge never cuts a group of suffixes with a common lead, as splitters
fall between different leads; so no match is lost at a boundary. What two
suffixes of a group share to the right of the anchor is the least that
neighbours between them share, and the same holds to the left of it in the order
of the reversed bytes; a passage occurs in both if it fits into both stretches.

A lead with more than CROWD different contexts doesn't go there, as its group
would meet in one task. Its repeated passages are found by counting hashes of
128 bits in Spark: first of what all passages of a block of BLOCK offsets have in
common, then, where that occurs again, of each passage of the block.

Defined results: null text counts as empty; texts shorter than SPAN lose
nothing; copies of a text of SPAN bytes or more all go whole; rows are told
apart by nothing but their text, so equal or null ids don't matter; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import small, stored, written

SPAN, LEAD = 400, 128
REACH = SPAN - LEAD
#: In a hash with a position in its low bits: their number. Longer texts are scanned in parts.
PLACE_BITS, PART = 27, 1 << 24
#: Leads with more different contexts than this are settled by counts in Spark, for BLOCK offsets at once at first.
CROWD, BLOCK = 512, 32
#: Bytes of a suffix in the keys that splitters are sampled from.
KEY = 16
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
ANCHOR = "t1 long, t2 long, at long, lead long, context long, low int, high int"


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64))])


class Scanner:
    """Anchors of texts; holds tables of powers as long as the longest part so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def anchors(self, data: bytes) -> list[tuple[int, int, int, int, int]]:
        """(at, lead hash, context hash, low, high): the anchor's passages start low to high bytes before it."""
        out = []
        for begin in range(0, max(1, len(data) - SPAN + 1), PART):
            out += self._part(data, begin, min(len(data), begin + PART + SPAN - 1))
        return out

    def _part(self, data: bytes, begin: int, end: int) -> list[tuple[int, int, int, int, int]]:
        n = end - begin
        if n < SPAN:
            return []
        if len(self.up) <= n:
            self.up, self.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        text = np.frombuffer(data, np.uint8, n, begin).astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * self.down[:n], dtype=np.uint64)])
        leads = (total[LEAD:] - total[:-LEAD]) * self.up[: n - LEAD + 1]
        leads ^= leads >> np.uint64(31)
        leads *= np.uint64(0xBF58476D1CE4E5B9)
        leads ^= leads >> np.uint64(29)
        mixed = (leads >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(leads), dtype=np.uint64)
        width = REACH + 1
        padded = np.full(-(-len(mixed) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(mixed)] = mixed
        blocks = padded.reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        passages = n - SPAN + 1
        least = np.minimum(right[:passages], left[REACH : REACH + passages])
        chosen = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(first[1:] - 1, passages - 1)
        at = chosen[first]
        out = []
        for a, lead, p, q in zip(at.tolist(), leads[at].view(np.int64).tolist(), first.tolist(), last.tolist()):
            low, high = a - q, a - p
            context = xxhash.xxh64_intdigest(data[begin + p : begin + q + SPAN], high << 10 | low)
            out.append((begin + a, lead, context - (1 << 64) if context >> 63 else context, low, high))
        return out


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """(t1, t2, text): a text's own 128 bits stand for it."""
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.select(F.xxhash64(F.lit("a"), "text").alias("t1"), F.xxhash64(F.lit("b"), "text").alias("t2"), "text")


def anchors(texts: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                rows = [(t1, t2, *found) for t1, t2, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)) for found in scanner.anchors(x.as_py().encode())]
                if rows:
                    columns = np.array(rows, dtype=np.int64).T
                    kinds = [pa.int64()] * 5 + [pa.int32()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], names=["t1", "t2", "at", "lead", "context", "low", "high"])

    return texts.filter(F.octet_length("text") >= SPAN).mapInArrow(run, ANCHOR)


def multikey_sort(suffixes: list[bytes]) -> list[int]:
    """Order of byte strings: three-way partitions on one eight-byte word at a time."""
    longest = -(-max(map(len, suffixes), default=0) // 8) * 8
    words = np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in suffixes), ">u8").reshape(len(suffixes), -1) if longest else np.zeros((len(suffixes), 0), ">u8")
    out: list[int] = []
    todo = [(np.arange(len(suffixes)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= 16 or depth == words.shape[1]:
            out += sorted(rows.tolist(), key=suffixes.__getitem__)
            continue
        word = words[rows, depth]
        pivot = np.sort(word[:: max(1, len(word) // 9)])[4 if len(word) >= 9 else 0]
        same = rows[word == pivot]
        todo += [(part, d) for part, d in ((rows[word > pivot], depth), (same, depth + 1), (rows[word < pivot], depth)) if len(part)]
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def runs_of(flags: np.ndarray, low: int) -> list[int]:
    """Pairs (first, last) of offsets whose flag is set, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [int(x) + low - k % 2 for k, x in enumerate(edge)]


class Member:
    __slots__ = ("flags", "high", "key", "left", "low", "right")

    def __init__(self, key, rows: int, low: int, high: int, data: bytes):
        self.key, self.low, self.high = key, low, high
        self.left, self.right = data[:high][::-1], data[high:]
        self.flags = np.full(high - low + 1, rows > 1)  # by offset before the anchor: does the passage there occur again


def shared_with(i: int, between: np.ndarray) -> np.ndarray:
    """What the i-th of sorted strings shares with each of them, from what neighbours share; for itself SPAN."""
    after = np.minimum.accumulate(between[i:])
    before = np.minimum.accumulate(between[:i][::-1])[::-1]
    return np.concatenate([before, [SPAN], after])


def compare(group: list[Member]) -> None:
    """Members in suffix order with a common lead, CROWD at most: marks every passage that another member has too."""
    n = len(group)
    if n < 2:
        return
    right = np.array([common(a.right, b.right) for a, b in zip(group, group[1:])], np.int64)
    order = sorted(range(n), key=lambda i: group[i].left)
    left = np.array([common(group[i].left, group[j].left) for i, j in zip(order, order[1:])], np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    low, high = (np.array([getattr(m, x) for m in group]) for x in ("low", "high"))
    for i, m in enumerate(group):
        first = np.maximum(np.maximum(SPAN - shared_with(i, right), low), m.low)
        last = np.minimum(np.minimum(shared_with(place[i], left)[place], high), m.high)
        last[i] = -1
        there = first <= last
        if there.any():
            size = m.high - m.low + 2
            change = np.bincount(first[there] - m.low, minlength=size) - np.bincount(last[there] - m.low + 1, minlength=size)
            m.flags |= np.cumsum(change)[:-1] > 0


def sorted_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of contexts in; for each its repeated passages, as runs of offsets before the anchor."""
    members: list[Member] = []
    for batch in batches:
        lead, context, rows, low, high, data = (batch.column(i).to_pylist() for i in range(6))
        members += [Member((a, c), n, lo, hi, d) for a, c, n, lo, hi, d in zip(lead, context, rows, low, high, data)]
    order = multikey_sort([m.right for m in members])
    group: list[Member] = []
    for i in [*order, None]:
        if group and (i is None or members[i].right[:LEAD] != group[-1].right[:LEAD]):
            compare(group)
            group = []
        if i is not None:
            group.append(members[i])
    for begin in range(0, len(members), 1 << 14):
        part = [(m.key, runs) for m in members[begin : begin + (1 << 14)] if (runs := runs_of(m.flags, m.low))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[1] for k, _ in part], pa.int64()), pa.array([r for _, r in part], pa.list_(pa.int32()))], names=["lead", "context", "runs"]
        )


def block_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in; for each block of offsets a hash of the bytes that all of its passages share, which every context that has one of them holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = []
            for lead, context, low, high, data in zip(*(batch.column(i).slice(at, 1024).to_pylist() for i in range(5))):
                for block in range(low // BLOCK, high // BLOCK + 1):
                    begin = high - block * BLOCK
                    rows.append((lead, context, block, xxhash.xxh3_128_digest(data[begin : begin + SPAN - BLOCK + 1])))
            yield coded(rows)


def passage_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts and their blocks in; a hash of each passage of these blocks by its offset before the anchor."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for lead, context, low, high, data, blocks in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in range(6))):
                for block in blocks:
                    for offset in range(max(low, block * BLOCK), min(high, block * BLOCK + BLOCK - 1) + 1):
                        rows.append((lead, context, offset, xxhash.xxh3_128_digest(data[high - offset : high - offset + SPAN])))
            yield coded(rows)


def coded(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["lead", "context", "place", "code"])


def offset_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, context, offsets) in; offsets as runs."""
    for batch in batches:
        runs = []
        for offsets in batch.column(2).to_pylist():
            flags = np.zeros(REACH + 1, bool)
            flags[offsets] = True
            runs.append(runs_of(flags, 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int32()))], names=["lead", "context", "runs"])


def counted_runs(contexts: DataFrame) -> DataFrame:
    """(lead, context, runs) of the passages that occur in several contexts of a lead, by counts; no task holds a lead's contexts."""

    def again(codes: DataFrame) -> DataFrame:  # those whose code another context of the lead has too
        often = written(codes.groupBy("lead", "place", "code").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
        return codes.join(small(often, 60), ["lead", "place", "code"], "left_semi")

    kind = "lead long, context long, place int, code binary"
    own = stored(contexts.select("lead", "context", "low", "high", "data"))
    blocks = again(own.mapInArrow(block_codes, kind)).groupBy("lead", "context").agg(F.collect_set("place").alias("blocks"))
    offsets = again(own.join(blocks, ["lead", "context"]).select(*own.columns, "blocks").mapInArrow(passage_codes, kind))
    return offsets.groupBy("lead", "context").agg(F.collect_set("place").alias("offsets")).mapInArrow(offset_runs, "lead long, context long, runs array<int>")


def repeats(texts: DataFrame) -> DataFrame:
    """(t1, t2, spans): for each text with repeated passages the flat pairs (begin, end) of bytes that some of them cover."""
    spark = texts.sparkSession
    found = stored(anchors(texts))
    again = stored(found.groupBy("lead").agg(F.count("*").alias("rows")).filter("rows > 1").select("lead"))  # apart, so that a hot lead's rows are split in the join
    found = stored(found.join(again, "lead", "left_semi"))
    one = F.min(F.struct("t1", "t2", "at")).alias("one")
    counted = stored(found.groupBy("lead", "context").agg(F.count("*").alias("rows"), F.first("low").alias("low"), F.first("high").alias("high"), one))
    several = stored(counted.groupBy("lead").agg(F.count("*").alias("contexts")).filter("contexts > 1").select("lead", (F.col("contexts") > CROWD).alias("crowded")))
    settled = counted.filter("rows > 1").join(several, "lead", "left_anti").select("lead", "context", F.array("low", "high").alias("runs"))

    spots = stored(counted.join(several, "lead").select("lead", "context", "rows", "low", "high", "one.*", "crowded"))
    needed = small(written(spots.select("t1", "t2").distinct()), 40)
    bodies = texts.join(needed, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])

    def fetched(spots: DataFrame) -> DataFrame:  # contexts with their bytes
        by_text = spots.groupBy("t1", "t2").agg(F.collect_list(F.struct("lead", "context", "rows", "low", "high", "at")).alias("spots"))
        cut = bodies.join(by_text, ["t1", "t2"]).select(F.col("text").cast("binary").alias("text"), F.explode("spots").alias("s"))
        data = F.substring("text", (F.col("s.at") - F.col("s.high") + 1).cast("int"), F.col("s.high") - F.col("s.low") + SPAN)
        return cut.select("s.lead", "s.context", "s.rows", "s.low", "s.high", data.alias("data"))

    crowded = spots.filter("crowded")
    if not crowded.isEmpty():
        whole = crowded.filter("rows > 1").select("lead", "context", F.array("low", "high").alias("runs"))
        settled = settled.unionByName(whole).unionByName(counted_runs(fetched(crowded)).join(whole.select("lead", "context"), ["lead", "context"], "left_anti"))
    contexts = fetched(spots.filter("not crowded"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    leading = F.substring("data", F.col("high") + 1, F.lit(KEY))
    dealt = contexts.withColumn("leading", leading).repartitionByRange(parts, "leading", "lead").drop("leading")
    compared = dealt.mapInArrow(sorted_buckets, "lead long, context long, runs array<int>")

    runs = stored(settled.unionByName(compared))
    places = found.join(runs, ["lead", "context"]).select("t1", "t2", "at", "runs").distinct()
    spans = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda i: F.struct((F.col("at") - F.get("runs", (2 * i + 1).cast("int"))).alias("begin"), (F.col("at") - F.get("runs", (2 * i).cast("int")) + SPAN).alias("end")))
    return places.select("t1", "t2", F.explode(spans).alias("s")).groupBy("t1", "t2").agg(F.array_sort(F.collect_list("s")).alias("spans"))


def kept_parts(data: bytes, spans: list[dict] | None) -> tuple[list[bytes], int, int]:
    """What is left, bytes removed, runs removed; spans are in order and may overlap."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for span in spans or ():
        if span["begin"] > end:
            kept.append(data[at : span["begin"]])
            at, runs = span["begin"], runs + 1
        end = max(end, span["end"])
        removed += max(0, end - at)
        at = max(at, end)
    kept.append(data[at:])
    return kept, removed, runs


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's bytes without those that repeated passages cover."""
    texts = keyed(docs, text)
    spans = repeats(texts)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("t1", F.xxhash64(F.lit("a"), "text")).withColumn("t2", F.xxhash64(F.lit("b"), "text"))
    joined = own.join(spans, ["t1", "t2"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    kind = dict(own.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                rows = []
                for data, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    kept, removed, runs = kept_parts(data, found)
                    rows.append((len(data), removed, runs, b"".join(kept)))
                made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made, pa.array([r[3] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
