"""Language-model scores by logistic context mixing: bit predictors over hashed contexts, combined by gated weights that go on learning in each text.

A text is its lower-cased (A-Z) words and one end. There are two models of one
kind. In the first a symbol is one of the WORDS most frequent words of the
training texts, the mark of any other word, or the end; in the second, which
spells such other words, it is a byte or the stop after the last one. A Huffman
code over a model's symbols turns its sequences into bits, each a step down the
code's tree. For every bit there are ORDERS + 1 predictors:
  the node of the tree alone (its symbols' counts in all training texts),
  the node with the hash of one, two or three symbols before (the second model:
  two, three or five), in tables of 2^BITS places of bit counts; for a context the
  nodes of NEAR levels lie side by side.
A predictor gives ln((n1 + A) / (n0 + A)) of its place. The inputs are added up
with weights chosen by a gate (how deep in the tree the bit is) and squashed to a
probability; the middle between it and what bits of its gate and its size came to
in the fit is the result. In every sequence the weights go on learning, after
each STEP symbols of it, from that sequence alone; what comes later never counts.
The bits of a text, and those of the words that it spells, add up to its log10
probability.

Spark's part: texts are dealt to blocks that hold their tokens as places in the
block's list of words; words are counted in all blocks by a shuffle. What
spelling a word costs depends on the word alone, so it is found once for each
distinct word, next to its count; then each block gets the counts and costs of
its own words back. Tasks add up bit counts (of blocks of training texts; of
distinct words, as often as they occur) and send their tables in slices, which
are added up by slice: every training text counts. The driver gets the code's
words (WORDS of at most WORD_BYTES bytes) and the tables as two bytes a place,
all of fixed size. Weights and refinement, some hundred numbers a model, are learned
from all training texts, and from all distinct words in them: each task learns
from its own, where every bit is taken out of the counts before it is predicted,
and Spark takes the means of the tasks' weights by the bits that each has seen,
and adds up their cells.

Defined results: null text counts as empty; an empty text is its end alone; a
null id isn't held out; equal rows are scored alike and count each; without
training texts every count is zero and the base score is the sum of
log10(0.1/0.1) = 0; columns other than the id and the text don't matter; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import held, stored

#: Words that are symbols; bytes that such a word has at most.
WORDS, WORD_BYTES = 1 << 14, 64
#: Predictors with a hashed context; places of each of their tables, as a power of two; what is added to both counts.
ORDERS, BITS, A = 3, 21, 0.4
#: Places of a slice in which tables are added up.
SLICE = 1 << 14
#: Rates of learning from training texts and in a text.
RATE, OWN_RATE = 0.05, 0.05
#: Symbols after which a text's weights learn; tokens of a block; symbols that are counted, about as many bits that are learned from, and texts that are scored at once.
STEP, BLOCK, SYMBOLS, CHUNK, TEXTS = 64, 2_000_000, 1 << 15, 4096, 512
#: Gates; logits are cut at LIMIT on both sides, the refinement has a cell for each whole number between.
GATES, LIMIT = 16, 12
CELLS = 2 * LIMIT
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: A byte that UTF-8 never has.
END = 255
#: Bytes of texts that are split into words at once.
SPLIT = 1 << 20
U = np.uint32
#: Odd multipliers of the hashes, fixed values.
MIX = [U(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]
#: Levels of a code's tree whose nodes, seven at most, share eight places in a row for each context: one line of a cache.
NEAR = 3
#: Symbols before a bit that its hashed contexts take in.
AFTER_WORDS, AFTER_BYTES = (1, 2, 3), (2, 3, 5)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, divisible by 10 (a null id: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words, split at space and \\t to \\r, and an empty one for the end of each text: bytes of all, length of each, how many each text has."""
    data = np.frombuffer(b" ".join([part for text in texts for part in ((text or "").encode().translate(LOWER), bytes([END]))]), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    lengths, ends = edges[1::2] - edges[::2], data[edges[::2]] == END
    lengths[ends] = 0
    return data[inside & (data != END)], lengths, np.diff(np.flatnonzero(ends), prepend=-1)


# The code


class Sequences(NamedTuple):
    flat: np.ndarray  # the symbols of all, one sequence after the other
    lengths: np.ndarray

    def padded(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All symbols, the five of start before each sequence, and which of them are the sequences' own."""
        s, own = np.empty(len(self.flat) + 5 * len(self.lengths), U), np.ones(len(self.flat) + 5 * len(self.lengths), bool)
        heads = np.cumsum(self.lengths + 5) - self.lengths - 5
        for k in range(5):
            s[heads + k], own[heads + k] = start[k], False
        s[own] = self.flat
        return s, own


def joined(sequences: Sequences | list[np.ndarray]) -> Sequences:
    if isinstance(sequences, Sequences):
        return sequences
    return Sequences(np.concatenate([np.zeros(0, U), *sequences]), np.array([len(x) for x in sequences], np.int64))


class Code:
    """A Huffman code over symbols, by their counts; the last symbol ends a sequence and stands before its first."""

    def __init__(self, counts: np.ndarray, contexts: tuple[int, ...]):
        n = len(counts)
        self.end, self.contexts = n - 1, contexts
        heap = [(max(int(c), 1), k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        weight, above, turn = [0] * (2 * n - 1), [0] * (2 * n - 1), [0] * (2 * n - 1)
        for c, k in heap:
            weight[k] = c
        for node in range(n, 2 * n - 1):
            (low, i), (high, j) = heapq.heappop(heap), heapq.heappop(heap)
            above[i], above[j], turn[j], weight[node] = node, node, 1, low + high
            heapq.heappush(heap, (low + high, node))
        ones = np.zeros(2 * n - 1)
        for k in range(2 * n - 2):
            if turn[k]:
                ones[above[k]] = weight[k]
        total = np.array(weight, float)[n:]
        alone = np.log((ones[n:] + A) / (total - ones[n:] + A)).astype(np.float32)
        paths = []
        for k in range(n):
            path, at = [], k
            while at != 2 * n - 2:
                path.append((above[at] - n, turn[at]))
                at = above[at]
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], np.int32)
        order = np.argsort(-self.length, kind="stable")  # the longest codes first
        self.rank = np.empty(n, np.uint16 if n <= 1 << 16 else np.int64)
        self.rank[order] = np.arange(n)
        # for each level of the tree, of the symbols by rank that have one: the bit, what the node alone tells; for each
        # NEAR levels of those that have the first: where a node is among the eight places, the first node's part of the hashes
        self.steps, self.groups = [], []
        for depth in range(int(self.length.max())):
            node, bit = (np.array([paths[k][depth][i] for k in order[: (self.length > depth).sum()]]) for i in range(2))
            if depth % NEAR == 0:
                self.groups.append((np.zeros((NEAR, len(node)), np.int64), node.astype(U) * MIX[3]))
            near = self.groups[-1][0]
            near[depth % NEAR, : len(node)] = 2 * near[depth % NEAR - 1, : len(node)] + last[: len(node)] if depth % NEAR else 1
            self.steps.append((bit.astype(np.float32), alone[node]))
            last = bit

    def places(self, before: np.ndarray, s: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[Iterator[np.ndarray]]]:
        """The symbols s (or the wanted ones), which follow the five symbols before, level by level of the tree, so that a symbol's contexts and weights need no copy for each bit.

        Gives the order in which the symbols are taken, longest code first; their ranks; how many have a bit on each level;
        and for each NEAR levels the places in each table, a row for each symbol that has the first of them.
        """
        whole = np.concatenate([before[-5:], s]).astype(U)
        h, contexts = np.zeros(len(s), U), []
        for k in range(1, 6):
            h = (h ^ (whole[5 - k : len(whole) - k] + U(k))) * MIX[k % 3]
            if k in self.contexts:
                contexts.append(h)
        if wanted is not None:
            s, contexts = s[wanted], [c[wanted] for c in contexts]
        rank = self.rank[s]
        order = np.argsort(rank, kind="stable")
        many = len(s) - np.cumsum(np.bincount(self.length[s]))[:-1]
        rank, contexts = rank[order].astype(np.int64), [c[order] for c in contexts]

        def each(n: int, near: np.ndarray, node: np.ndarray) -> Iterator[np.ndarray]:
            salt, nears = node.take(rank[:n]), [x.take(rank[:n]) for x in near]
            for c in contexts:
                first, out = (((c[:n] ^ salt) * MIX[4]) >> U(32 - BITS)).astype(np.int64), np.empty((n, NEAR), np.int64)
                for k, x in enumerate(nears):
                    np.bitwise_xor(first, x, out=out[:, k])
                yield out

        return order, rank, many, (each(n, *group) for n, group in zip(many[::NEAR].tolist(), self.groups))

    def levels(self, before: np.ndarray, s: np.ndarray, wanted: np.ndarray | None = None, tables: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]]:
        """Order and number of the symbols, see places(); for each level what the nodes alone tell, what is in each table (without tables: the places), bits (0.0 or 1.0)."""
        order, rank, many, groups = self.places(before, s, wanted)

        def each() -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
            for depth, (n, (bit, alone)) in enumerate(zip(many.tolist(), self.steps)):
                if depth % NEAR == 0:  # a symbol's places side by side are looked up one after the other, while they are in the cache
                    found = [np.ascontiguousarray((p if tables is None else tables[k].take(p)).T) for k, p in enumerate(next(groups))]
                yield alone.take(rank[:n]), [f[depth % NEAR, :n] for f in found], bit.take(rank[:n])

        return order, many, each()

    def bits(self, before: np.ndarray, s: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """All levels one after the other: how many bits each has, what the nodes alone tell, places in each table, bits, gates."""
        _, many, each = self.levels(before, s, wanted)
        alone, places, bit = zip(*each)
        return many, np.concatenate(alone), [np.concatenate(p) for p in zip(*places)], np.concatenate(bit), np.repeat(np.minimum(np.arange(len(many)), GATES - 1), many)

    def start(self) -> np.ndarray:
        return np.full(5, self.end, U)


# Weights


class Weights(NamedTuple):
    weights: np.ndarray  # predictor x gate; the last predictor is always 1
    cells: np.ndarray  # gate x cell: the probability that the refinement gives


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def cell(logit: np.ndarray) -> np.ndarray:
    """Each logit's cell: its whole part, from -LIMIT on."""
    return np.minimum((logit + LIMIT).astype(np.int64), 2 * LIMIT - 1)


def neutral() -> np.ndarray:
    weights = np.full((ORDERS + 2, GATES), 1 / (ORDERS + 1), np.float32)
    weights[-1] = 0
    return weights


class Learner:
    """Weights and refinement of a task. tables: (logits in 16ths, levels) of each order."""

    def __init__(self, code: Code, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.code = code
        self.tables = [(levels.astype(np.uint16) << 8) + (logits.astype(np.int16) + 128).astype(np.uint16) for logits, levels in tables]  # one look-up for both
        self.weights, self.sums = neutral(), np.full((ORDERS + 2, GATES), 1e-4, np.float32)
        self.ones, self.zeros = np.zeros(GATES * CELLS), np.zeros(GATES * CELLS)

    def add(self, sequences: Sequences | list[np.ndarray], times: list[int] | None = None) -> None:
        """Learns from the sequences one after the other; times: how often each is in the counts."""
        for before, symbols, wanted, often in chunks(self.code, sequences, times):
            order, many, each = self.code.levels(before, symbols, wanted, self.tables)
            often = None if often is None else often[order]
            turns = max(1, round(int(many.sum()) / CHUNK))  # each learns from every turns-th bit of every level
            room = many // turns + 1
            ends = np.cumsum(room * turns)
            x = np.empty((ORDERS + 2, int(ends[-1])), np.float32)  # inputs, then the bits themselves; by level, by turn
            for end, width, (alone, inputs, bit) in zip(ends.tolist(), room.tolist(), each):
                n, side = len(bit), bit.astype(np.int64) << 16
                repeated = None if often is None else np.flatnonzero(often[:n] > 1)
                found = [without_own(x_in, side, bit, None if often is None else often[:n], repeated) for x_in in inputs]
                even = n - n % turns
                for row, values in zip(x[:, end - width * turns : end], (alone, *found, bit)):
                    by_turn = row.reshape(turns, width).T
                    by_turn[:-1] = values[:even].reshape(-1, turns)
                    by_turn[-1, : n - even] = values[even:]
            begins = ends - room * turns
            for turn in range(turns):
                sizes = room - (turn >= many % turns)
                self._learn(np.concatenate([x[:, a : a + n] for a, n in zip((begins + turn * room).tolist(), sizes.tolist())], axis=1), sizes[sizes > 0])

    def _learn(self, x: np.ndarray, sizes: np.ndarray) -> None:
        """One step of every weight, by the mean of what its input tells of its gate's bits, divided by the length of its gradients so far. sizes: bits of each level."""
        if len(sizes) > GATES:
            sizes = np.append(sizes[: GATES - 1], sizes[GATES - 1 :].sum())
        inputs, bit, n = x[:-1], x[-1], len(sizes)
        weights, sums = self.weights[:, :n], self.sums[:, :n]
        w = np.repeat(weights, sizes, axis=1)
        w[:-1] *= inputs
        logit = w.sum(axis=0)
        np.clip(logit, -LIMIT, LIMIT, out=logit)
        off = bit - squash(logit)
        starts = np.cumsum(sizes) - sizes
        slope = np.concatenate([np.add.reduceat(inputs * off, starts, axis=1), np.add.reduceat(off, starts)[None]]) / np.maximum(sizes, 16).astype(np.float32)
        sums += slope * slope
        weights += RATE * slope / np.sqrt(sums)
        where = np.repeat(np.arange(n) * CELLS, sizes) + cell(logit)
        where += bit.astype(np.int64) * (GATES * CELLS)
        both = np.bincount(where, minlength=2 * GATES * CELLS)
        self.zeros += both[: GATES * CELLS]
        self.ones += both[GATES * CELLS :]

    def parts(self) -> pa.RecordBatch:
        """(part, x): what means and sums over tasks are made of; weights count by their gate's bits."""
        seen = (self.ones + self.zeros).reshape(GATES, CELLS).sum(axis=1)
        x = np.concatenate([(self.weights * seen).ravel(), seen, self.ones, self.zeros])
        return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(x), pa.int32()), pa.array(x[np.flatnonzero(x)])], names=["part", "x"])


def learned(parts: dict[int, float]) -> Weights:
    """From the sums of all tasks' parts."""
    x = np.zeros((ORDERS + 3) * GATES + 2 * GATES * CELLS)
    x[list(parts)] = list(parts.values())
    sums, seen, cells = x[: (ORDERS + 2) * GATES].reshape(-1, GATES), x[(ORDERS + 2) * GATES :][:GATES], x[(ORDERS + 3) * GATES :].reshape(2, GATES, CELLS)
    weights = np.where(seen > 0, sums / np.maximum(seen, 1), neutral()).round(5)  # so that the order of the sums doesn't matter
    few = 50 * unrefined()  # a cell of few bits keeps to its own probability
    return Weights(weights.astype(np.float32), ((cells[0] + few) / (cells.sum(axis=0) + 50)).astype(np.float32))


def unrefined() -> np.ndarray:
    return np.tile(squash(np.arange(CELLS) + 0.5 - LIMIT), (GATES, 1)).astype(np.float32)


def less(logits: np.ndarray, levels: np.ndarray, bit: np.ndarray, times: np.ndarray | int) -> np.ndarray:
    """Logits after `times` such bits are taken out of the counts."""
    n = np.exp2(levels / np.float32(8)) - 1
    ones = (n + 2 * A) * squash(logits / np.float32(16)) - A
    return np.log((np.maximum(ones - bit * times, 0) + A) / (np.maximum(n - ones - (1 - bit) * times, 0) + A)).astype(np.float32)


#: less() of one bit, for each bit, level and logit.
LESS_ONE = less(np.arange(-128, 128, dtype=np.float32), np.arange(256, dtype=np.float32)[:, None], np.arange(2, dtype=np.float32)[:, None, None], 1).ravel()


def without_own(found: np.ndarray, side: np.ndarray, bit: np.ndarray, times: np.ndarray | None, again: np.ndarray | None) -> np.ndarray:
    """Logits of places (level * 256 + logit + 128) after each bit (side: bit * 65536) is taken out of the counts; those at `again` `times` times."""
    out = LESS_ONE.take(side + found)
    if again is not None and len(again):
        few = found[again]
        out[again] = less((few & 255).astype(np.float32) - 128, (few >> 8).astype(np.float32), bit[again], times[again])
    return out


def scored(code: Code, tables: list[np.ndarray], fit: Weights, texts: Sequences | list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of symbols. tables: logits in 16ths of each order."""
    texts = joined(texts)
    whole, lengths = texts.padded(code.start())[0], texts.lengths
    begin, longest = np.cumsum(lengths + 5) - lengths - 5, int(lengths.max(initial=0))
    total = np.zeros(len(lengths))
    own = np.zeros((ORDERS + 2, len(lengths)), np.float32)  # what each text has learned, added to the weights of all gates
    sums = np.full_like(own, 1e-4)
    sixteenths = np.array([1, *[1 / 16] * ORDERS, 1], np.float32)[:, None]  # weights and slopes are for logits as the tables hold them
    shared = fit.weights * sixteenths
    for at in range(0, longest, STEP):
        there = np.flatnonzero(lengths > at)
        sizes = np.minimum(lengths[there] - at, STEP) + 5
        heads = np.cumsum(sizes) - sizes
        symbols = whole.take(np.repeat(begin[there] + at - heads, sizes) + np.arange(int(sizes.sum())))
        wanted = np.ones(len(symbols), bool)
        for k in range(5):  # these five only are the context of the first
            wanted[heads + k] = False
        order, many, each = code.levels(code.start(), symbols, wanted, tables)
        mine = (own[:, there] * sixteenths).take(np.repeat(np.arange(len(there)), sizes - 5)[order], axis=1) if at else None
        goes_on = longest > at + STEP  # else nothing is scored with what would be learned
        tells, slopes = np.zeros(len(order), np.float32), np.zeros((ORDERS + 2, len(order) if goes_on else 0), np.float32)
        for depth, (alone, found, bit) in enumerate(each):
            gate, m = min(depth, GATES - 1), len(bit)
            inputs = [alone, *(x.astype(np.float32) for x in found)]
            weights = shared[:, gate] if mine is None else (row[:m] + w for row, w in zip(mine, shared[:, gate]))
            logit = np.zeros(m, np.float32)
            for w, x in zip(weights, (*inputs, np.float32(1))):
                logit += w * x
            np.clip(logit, -LIMIT, LIMIT, out=logit)
            chance = squash(logit)
            final = fit.cells[gate].take(cell(logit))
            final += chance
            final *= np.float32(0.5)
            final -= 1 - bit
            tells[:m] += np.log(np.abs(final, out=final), out=final)
            if goes_on:
                off = bit - chance
                for row, x in zip(slopes, (*inputs, np.float32(1))):
                    row[:m] += off * x
        starts, back = heads - 5 * np.arange(len(heads)), np.empty_like(order)
        back[order] = np.arange(len(order))
        total[there] += np.add.reduceat(tells[back], starts, dtype=np.float64)
        if goes_on:
            slope = sixteenths * np.add.reduceat(slopes.take(back, axis=1), starts, axis=1) / np.add.reduceat(code.length[symbols[wanted]], starts)
            sums[:, there] += slope * slope
            own[:, there] += OWN_RATE * slope / np.sqrt(sums[:, there])
    return total / math.log(10)


# Spark


def packed(places: np.ndarray) -> bytes:
    """Numbers below 2^24, their low halves before their (mostly zero) high bytes."""
    return places.astype("<u2").tobytes() + (places >> 16).astype(np.uint8).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 3
    return np.frombuffer(data, "<u2", n).astype(U) | np.frombuffer(data, np.uint8, n, 2 * n).astype(U) << U(16)


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, ids, apart, lengths, sizes, places, words, times): texts as places in their block's list of words, and each word's number in training texts (apart: held out; sizes: bytes of the words, with one after each)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", held_out(F.col("doc_id")).alias("apart"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language_model", dict)  # other operators' tables may go
        block = TaskContext.get().partitionId() << 32
        ids, apart, parts, size = [], [], [], 0

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            data, length, lengths = (np.concatenate(x) for x in zip(*parts))
            offsets = np.append(0, np.cumsum(length))
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            flat, words = found.indices.to_numpy(), found.dictionary.cast(pa.binary())
            times = np.bincount(flat[np.repeat(~np.array(apart), lengths)], minlength=len(words))
            sizes = np.add.reduceat(length + 1, np.cumsum(lengths) - lengths)
            columns = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([apart], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int64()))]
            columns += [pa.array([packed(flat)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([times], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "apart", "lengths", "sizes", "places", "words", "times"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < len(ends):  # about SPLIT bytes, one text at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPLIT, "right")))
                parts.append(tokens(batch.column(1)[at:to].to_pylist()))
                ids += batch.column(0)[at:to].to_pylist()
                apart += batch.column(2)[at:to].to_pylist()
                size += max(len(parts[-1][1]), len(parts[-1][0]) // 32)  # long words fill a block sooner
                at = to
                if size >= BLOCK:
                    yield out(batch.schema.types[0])
                    block, ids, apart, parts, size = block + 1, [], [], [], 0
        if ids:
            yield out(batch.schema.types[0])

    return stored(own.mapInArrow(run, f"block long, ids array<{kind}>, apart array<boolean>, lengths array<int>, sizes array<bigint>, places binary, words array<binary>, times array<long>"))


class Codes(NamedTuple):
    """What both codes follow from."""

    key: str  # another one for each pair
    words: list[bytes]
    word_counts: np.ndarray  # of the words, of the mark of other words, of the end
    byte_counts: np.ndarray  # of each byte in other words, of the stop


class Pair:
    """Both codes, and the symbol of each word."""

    def __init__(self, made: Codes):
        self.symbol = {w: k for k, w in enumerate(made.words)} | {b"": len(made.words) + 1}
        self.other = len(made.words)
        self.words, self.bytes = Code(made.word_counts, AFTER_WORDS), Code(made.byte_counts, AFTER_BYTES)

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.symbol.get(w, self.other) for w in words], U)

    def is_other(self, word: bytes) -> bool:
        return word not in self.symbol

    def spelled(self, word: bytes) -> np.ndarray:
        return self.spellings([word]).flat

    def spellings(self, words: list[bytes]) -> Sequences:
        """Of each word its bytes and the stop."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        flat = np.full(int(lengths.sum()), 256, U)
        letters = np.ones(len(flat), bool)
        letters[np.cumsum(lengths) - 1] = False
        flat[letters] = np.frombuffer(b"".join(words), np.uint8)
        return Sequences(flat, lengths)


def codes_of(counts: DataFrame, words: int) -> Codes:
    """From (word, c), written already."""
    short = counts.filter((F.col("c") > 1) & (F.length("word") > 0) & (F.length("word") <= WORD_BYTES))
    top = [(bytes(r["word"]), r["c"]) for r in short.orderBy(F.col("c").desc(), "word").limit(words).collect()]
    known = counts.sparkSession.sparkContext.broadcast(frozenset(w for w, _ in top))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not word:
                    n[257] += c
                elif word not in known.value:
                    n[256] += c
                    for b in word:
                        n[b] += c
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.int32()), pa.array(n.values(), pa.int64())], names=["symbol", "n"])

    rest = np.zeros(258, np.int64)
    for r in counts.filter("c > 0").select("word", "c").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        rest[r["symbol"]] = r["n"]
    return Codes(uuid.uuid4().hex, [w for w, _ in top], np.array([*(c for _, c in top), rest[256], rest[257]], np.int64), rest[:257])


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def chunks(code: Code, sequences: Sequences | list[np.ndarray], times: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """What Code.levels() takes of the sequences, SYMBOLS at once, and how often each wanted symbol's sequence occurs."""
    sequences, start, done = joined(sequences), code.start(), 0
    s, wanted = sequences.padded(start)
    often = None if times is None else np.repeat(np.array(times, U), sequences.lengths)
    for at in range(0, len(s), SYMBOLS):
        here = wanted[at : at + SYMBOLS]
        if n := int(here.sum()):
            yield s[at - 5 : at] if at else start, s[at : at + SYMBOLS], here, None if often is None else often[done : done + n]
        done += n


class Tables:
    """Bit counts of a task."""

    def __init__(self, code: Code):
        self.code, self.counts = code, np.zeros((ORDERS, 2 << BITS), U)

    def add(self, sequences: Sequences | list[np.ndarray], times: list[int] | None = None) -> None:
        for before, symbols, wanted, often in chunks(self.code, sequences, times):
            order, rank, many, groups = self.code.places(before, symbols, wanted)
            often = None if often is None else often[order]
            for depth, places in zip(range(0, len(many), NEAR), groups):
                here = many[depth : depth + NEAR].tolist()
                side = np.zeros((here[0], NEAR), np.int64)
                for k, n in enumerate(here):
                    side[:n, k] = self.code.steps[depth + k][0].take(rank[:n])
                for table, p in zip(self.counts, places):
                    p += p
                    p += side
                    for k, (n, more) in enumerate(zip(here, [*here[1:], 0]), 1):  # the symbols that have k of these levels
                        if n > more:
                            np.add.at(table, p[more:n, :k].ravel(), U(1) if often is None else np.repeat(often[more:n], k))

    def slices(self) -> Iterator[pa.RecordBatch]:
        """Those that hold anything, in as few bytes a count as they need, compressed: most counts are small."""
        for k, part in enumerate(self.counts.reshape(-1, 2 * SLICE)):
            if most := int(part.max()):
                width = next(w for w in (1, 2, 4) if most < 1 << 8 * w)
                data = pa.compress(part.astype(f"<u{width}").tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([width], pa.int32()), pa.array([data], pa.binary())], names=["slice", "width", "counts"])


def held_pair(shared) -> Pair:
    return held(("language_model", shared.value.key), lambda: Pair(shared.value))


def training_texts(pair: Pair, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Sequences, None]]:
    """Of each block the texts that aren't held out."""
    for batch in batches:
        for row in rows_of(batch):
            lengths, training = row["lengths"].values.to_numpy().astype(np.int64), ~np.array(row["apart"].as_py(), bool)
            own = unpacked(row["places"].as_py())[np.repeat(training, lengths)]
            yield Sequences(pair.places(row["words"].as_py())[own], lengths[training]), None


def spelled_words(pair: Pair, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Sequences, list[int]]]:
    """Of each batch the distinct words that are spelled, and how often they occur in training texts."""
    for batch in batches:
        rows = [(w, c) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if pair.is_other(w)]
        yield pair.spellings([w for w, _ in rows]), [c for _, c in rows]


def word_bits(rows: DataFrame, shared) -> DataFrame:
    """(slice, width, counts) of each task's training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held_pair(shared)
        tables = Tables(pair.words)
        for texts, _ in training_texts(pair, batches):
            tables.add(texts)
        yield from tables.slices()

    return rows.select("apart", "lengths", "places", "words").mapInArrow(run, "slice int, width int, counts binary")


def byte_bits(counts: DataFrame, shared) -> DataFrame:
    """(slice, width, counts) of each task's distinct words that are spelled, as often as they occur in training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held_pair(shared)
        tables = Tables(pair.bytes)
        for words, times in spelled_words(pair, batches):
            tables.add(words, times)
        yield from tables.slices()

    return in_training(counts).mapInArrow(run, "slice int, width int, counts binary")


def in_training(counts: DataFrame) -> DataFrame:
    """Words of training texts, in few parts: each task sends whole tables, or weights that it has learned from its own words."""
    return counts.filter("c > 0").select("word", "c").coalesce(counts.sparkSession.sparkContext.defaultParallelism)


def added_up(found: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(logits in 16ths, levels) of each order; slices are added up by Spark and fetched one partition after the other, two bytes a place."""

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SLICE, np.int64)
        for batch in parts:
            width, counts = (batch.column(batch.schema.get_field_index(name)) for name in ("width", "counts"))
            for w, x in zip(width.to_pylist(), counts):
                total += np.frombuffer(pa.decompress(x.as_buffer(), 2 * SLICE * w, "zstd"), f"<u{w}")
        zeros, ones = total[::2], total[1::2]
        logits = np.clip(np.rint(16 * np.log((ones + A) / (zeros + A))), -127, 127).astype(np.int8)
        levels = np.minimum(np.rint(8 * np.log2(1 + zeros + ones)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([logits.tobytes()], pa.binary()), pa.array([levels.tobytes()], pa.binary())], names=["slice", "logits", "levels"])

    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}  # Spark reads them: batch by batch
    logits, levels = np.zeros(ORDERS << BITS, np.int8), np.zeros(ORDERS << BITS, np.uint8)
    for row in found.groupBy("slice").applyInArrow(add, "slice int, logits binary, levels binary").toLocalIterator():
        part = slice(row["slice"] * SLICE, (row["slice"] + 1) * SLICE)
        logits[part], levels[part] = np.frombuffer(row["logits"], np.int8), np.frombuffer(row["levels"], np.uint8)
    return list(zip(logits.reshape(ORDERS, -1), levels.reshape(ORDERS, -1)))


def fit(rows: DataFrame, shared, tables: list[tuple[np.ndarray, np.ndarray]], spelling: bool) -> Weights:
    """From all blocks, or (spelling) all words of training texts."""
    sent = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held_pair(shared)
        learner = Learner(pair.bytes if spelling else pair.words, sent.value)
        for sequences, times in (spelled_words if spelling else training_texts)(pair, batches):
            learner.add(sequences, times)
        yield learner.parts()

    source = in_training(rows) if spelling else rows.select("apart", "lengths", "places", "words")
    found = source.mapInArrow(run, "part int, x double").groupBy("part").agg(F.sum("x").alias("x")).collect()  # some hundred rows
    sent.unpersist()
    return learned({r["part"]: r["x"] for r in found})


def with_costs(counts: DataFrame, shared, tables: list[tuple[np.ndarray, np.ndarray]], weights: Weights) -> DataFrame:
    """(word, c, tells): of a word that is a symbol its number, of another the log10 probability of its spelling, which is below zero."""
    model = counts.sparkSession.sparkContext.broadcast([logits for logits, _ in tables])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held_pair(shared)
        for batch in batches:
            words = batch.column(0).to_pylist()
            others = sorted((k for k, w in enumerate(words) if pair.is_other(w)), key=lambda k: len(words[k]))
            tells = pair.places(words).astype(np.float32)
            for at in range(0, len(others), 4096):
                some_words = others[at : at + 4096]
                tells[some_words] = scored(pair.bytes, model.value, weights, pair.spellings([words[k] for k in some_words]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tells)], names=["word", "c", "tells"])

    return counts.select("word", "c").mapInArrow(run, "word binary, c long, tells float")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document, and bits_per_byte of its words with a byte after each."""
    spark = docs.sparkSession
    rows = blocks(docs, doc_id, text)
    kind = rows.schema["ids"].dataType.elementType.simpleString()
    listed = rows.select("block", F.posexplode(F.arrays_zip("words", "times")).alias("place", "w")).select("block", "place", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    counts = stored(listed.groupBy("word").agg(F.sum("times").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    shared = spark.sparkContext.broadcast(codes_of(counts, words))
    byte_tables = added_up(byte_bits(counts, shared))
    byte_weights = fit(counts, shared, byte_tables, True)
    costs = with_costs(counts, shared, byte_tables, byte_weights)
    word_tables = added_up(word_bits(rows, shared))
    word_weights = fit(rows, shared, word_tables, False)
    model = spark.sparkContext.broadcast([logits for logits, _ in word_tables])
    known = listed.select("block", "place", "word").join(costs, "word").groupBy("block").agg(F.collect_list(F.struct("place", "c", "tells")).alias("known")).withColumnRenamed("block", "its_block")
    whole = rows.drop("times", "words").join(known, F.col("block") == F.col("its_block")).drop("its_block")  # a row for each block on both sides
    floor = math.log10(n + 0.1 * (v + 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held_pair(shared)
        for batch in batches:
            for row in rows_of(batch):
                flat, places = row["known"].values, unpacked(row["places"].as_py())
                order = np.argsort(flat.field("place").to_numpy())
                c, tells = (flat.field(x).to_numpy()[order] for x in ("c", "tells"))
                symbols, lengths = np.where(tells < 0, pair.other, tells).astype(U)[places], row["lengths"].values.to_numpy().astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = lambda x: np.add.reduceat(x[places], starts)
                total, order = sums(np.minimum(tells, 0).astype(float)), np.argsort(lengths, kind="stable")  # texts of like length go together
                for k in range(0, len(order), TEXTS):
                    part = order[k : k + TEXTS]
                    total[part] += scored(pair.words, model.value, word_weights, [symbols[starts[i] : ends[i]] for i in part])
                n_bytes = row["sizes"].values.to_numpy()
                columns = [row["ids"].values, row["apart"].values, pa.array(lengths), pa.array(sums((c > 0).astype(np.int64))), pa.array([n] * len(lengths), pa.int64()), pa.array(sums(np.log10(c + 0.1) - floor)), pa.array(total), pa.array(-total * math.log2(10) / n_bytes)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return whole.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
