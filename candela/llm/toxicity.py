"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams that occur in it, whatever their count.
Feature f is worth r_f, the log of its share among toxic texts over its share
among the others, both shares smoothed by PRIOR texts of the average mix, so
that rare features are worth little and unknown ones nothing; each text's vector
is divided by its length, and logistic regression learns weights over these
values. The fit uses at most TRAIN_ROWS
labelled rows, chosen by a hash of their id, one text for each id, and all
features that occur in them; every text is scored.

N-grams are counted by Spark over the sample's PARTS partitions. The steps of
the fit (limited-memory BFGS) are taken in one task, which holds the sample's
features once, two bytes each, as Spark sent them (in batches of ROWS rows): some
120 MB for 10,000 texts of 3,400 characters. The driver gets counts, ratios and
weights, vectors of SPACE numbers whatever the input, and no rows.

Defined results: null text counts as empty; an empty text has no feature and
its score is that of the intercept; rows without a label (or id) are scored but
not learned from; a doc with several labels counts by the largest; of several
texts with one id the one of least hash is learned from; n-grams that the sample
lacks count for nothing; without labels of both kinds every score is the share
of toxic rows (0 if there are none); other columns pass through score().
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import appended, held, short_batches, written

#: Labelled rows that are learned from at most, in PARTS partitions.
TRAIN_ROWS, PARTS = 10_000, 4
#: Rows of the sample that Spark and a task pass between them at once; a row is some 12 KB.
ROWS = 256
#: n-gram lengths; places that n-grams are hashed to.
LENGTHS, SPACE = (4, 5, 6), 1 << 20
#: Texts that smooth a feature's shares; weight of the penalty.
PRIOR, RIDGE = 60, 1e-5
#: Steps of the fit at most, former steps that one looks at, the gradient's length that ends it.
STEPS, FORMER, ENOUGH = 20, 5, 1e-4


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, divisible by 5 (a null id: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of the lower-cased text, with repeats."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    found, h = [], points
    for n in range(2, max(LENGTHS) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        if n in LENGTHS:
            found.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SPACE.bit_length() + 1))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def distinct(features: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Each feature once, in no order; scratch has a place for every feature."""
    scratch[features] = np.arange(len(features))
    return features[scratch[features] == np.arange(len(features))]


def places() -> np.ndarray:
    """The scratch that a worker keeps; each of this operator's tasks asks for it first, so that other operators' tables go."""
    return held("toxicity", lambda: np.zeros(SPACE, np.int64))


class Model(NamedTuple):
    ratios: np.ndarray  # r of each feature
    weights: np.ndarray
    intercept: float


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, toxic) of at most `rows` labelled ids outside the held-out fold."""
    known = labels.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("its_id"), "toxic"))
    own = docs.select(F.col(doc_id).alias("its_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = own.join(F.broadcast(chosen), "its_id")  # chosen: `rows` ids at most
    return joined.groupBy("its_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")


def packed(features: np.ndarray) -> bytes:
    """Distinct features in order, as gaps of two bytes each; of four where a gap needs them."""
    gaps = np.diff(features, prepend=0)
    return gaps.astype("<u4" if len(gaps) and gaps.max() >> 16 else "<u2").tobytes()


def unpacked(data, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{memoryview(data).nbytes // n}"), dtype=np.int32) if n else np.empty(0, np.int32)


def vectors(texts: DataFrame) -> DataFrame:
    """(toxic, n, features): the n features of each text once, packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = places()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.sort(distinct(grams(t.as_py()), scratch)) for t in part.column(0)]
                columns = [part.column(1).cast(pa.int32()), pa.array(map(len, found), pa.int32()), pa.array(map(packed, found), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "n", "features"])

    return texts.mapInArrow(run, "toxic int, n int, features binary")


def in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Buffer, int, int]]:
    """(features, still packed and in their batch's memory, their number, toxic) of rows of vectors()."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found = batch.column(2)
        _, ends, data = found.buffers()
        data = data or pa.py_buffer(b"")  # no text has features
        at = np.frombuffer(ends, "<i8" if pa.types.is_large_binary(found.type) else "<i4")[found.offset :].tolist()
        for k, (toxic, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            yield data[at[k] : at[k + 1]], n, toxic


def counts(rows: DataFrame) -> np.ndarray:
    """Two rows, clean and toxic: in how many texts each feature occurs; last column: how many texts there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places()
        out = np.zeros((2, SPACE + 1), np.int32)
        for data, n, toxic in in_order(batches):
            out[toxic][unpacked(data, n)] += 1
            out[toxic][-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["vector"])

    out = np.zeros((2, SPACE + 1), np.int32)
    for row in rows.mapInArrow(run, "vector binary").toLocalIterator():  # one partition's at a time
        out += np.frombuffer(row["vector"], np.int32).reshape(2, SPACE + 1)
    return out


def log_ratios(clean: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> np.ndarray:
    mix = n1 / (n0 + n1)
    return (np.log((toxic + PRIOR * mix) / n1) - np.log((clean + PRIOR * (1 - mix)) / n0)).astype(np.float32)


def loss_and_slope(rows: Iterable[tuple[np.ndarray, int]], ratios: np.ndarray, weights: np.ndarray, share: tuple[float, float]) -> tuple[float, np.ndarray]:
    """Logistic loss over the sample with its penalty, and its gradient; the last weight is the intercept."""
    slope, loss = RIDGE * weights, RIDGE / 2 * float(weights[:-1] @ weights[:-1])
    slope[-1] = 0
    for features, toxic in rows:
        x = ratios[features]
        x = x / (np.sqrt(x @ x) or 1.0)
        logit = float(x @ weights[features] + weights[-1])
        off = share[toxic] * (sigmoid(logit) - toxic)
        slope[features] += off * x
        slope[-1] += off
        loss += share[toxic] * float(np.logaddexp(0.0, -logit if toxic else logit))
    return loss, slope


def minimised(slope_at: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray) -> np.ndarray:
    """Limited-memory BFGS; the first step is the one that the loss's largest curvature, 1/2, allows."""
    here, (loss, slope) = start, slope_at(start)
    former: list[tuple[np.ndarray, np.ndarray, float]] = []  # moves, how the slope turned, product of both
    for _ in range(STEPS):
        if np.sqrt(slope @ slope) < ENOUGH:
            break
        way, back = -slope, []
        for move, turn, bend in reversed(former):
            back.append((move @ way) / bend)
            way -= back[-1] * turn
        way *= former[-1][2] / (former[-1][1] @ former[-1][1]) if former else 2.0
        for (move, turn, bend), a in zip(former, reversed(back)):
            way += (a - (turn @ way) / bend) * move
        length = 1.0
        while True:
            there = here + np.float32(length) * way
            new_loss, new_slope = slope_at(there)
            if new_loss <= loss + 1e-4 * length * float(slope @ way) or length < 1e-3:
                break
            length /= 4
        if new_loss >= loss:
            break
        move, turn = there - here, new_slope - slope
        if (bend := float(move @ turn)) > 0:
            former = [*former[1 - FORMER :], (move, turn, bend)]
        here, loss, slope = there, new_loss, new_slope
    return here


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    with short_batches(docs.sparkSession, ROWS):
        return _fit(docs, labels, rows, doc_id, text)


def _fit(docs: DataFrame, labels: DataFrame, rows: int, doc_id: str, text: str) -> Model:
    learned = written(vectors(sample(docs, labels, rows, doc_id, text).repartition(PARTS)))
    clean, toxic = counts(learned)
    n0, n1 = int(clean[-1]), int(toxic[-1])
    if not n0 or not n1:
        share = min(max(n1 / max(1, n0 + n1), 1e-9), 1 - 1e-9)
        return Model(np.zeros(SPACE, np.float32), np.zeros(SPACE, np.float32), float(np.log(share / (1 - share))))
    ratios = log_ratios(clean[:-1], toxic[:-1], n0, n1)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    share = 0.5 / n0, 0.5 / n1  # both kinds count alike

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places()
        own = list(in_order(batches))
        weights = minimised(lambda w: loss_and_slope(((unpacked(data, n), toxic) for data, n, toxic in own), shared.value, w, share), np.zeros(SPACE + 1, np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    weights = np.frombuffer(learned.coalesce(1).mapInArrow(run, "weights binary").first()["weights"], np.float32)
    return Model(ratios, weights[:-1], float(weights[-1]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with each text's probability to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB
    at = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> list[float]:
        ratios, weights, intercept = shared.value
        scratch = places()
        out = []
        for value in batch.column(at):
            features = distinct(grams(value.as_py()), scratch)
            x = ratios[features]
            out.append(float(sigmoid(float(x @ weights[features]) / (float(np.sqrt(x @ x)) or 1.0) + intercept)))
        return out

    return appended(docs, make, name, T.DoubleType(), pa.float64())
