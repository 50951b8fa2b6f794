"""Token counts that follow edits.

A document is cut into pre-tokens; their characters and token counts are the
leaves of a segment tree whose inner nodes hold subtree sums. An edit replaces
a character range. It touches the leaves that overlap the range, and those
before it whose match could have looked into it: the pattern looks at most
LOOK characters past a pre-token. From the first touched leaf on the new text
is cut again until a cut falls on an old one beyond the edit; the pattern never
looks back, so all later pre-tokens are as they were. Touched leaves get their
new pre-tokens (the first takes them all, others become empty), and only the
sums above them change.

Defined results: null text counts as empty; an edit beyond the end is one at
the end; an empty list of edits leaves the counts; edits apply one after the
other, each to the text that the former left; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from operator import add
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from candela.llm import bpe

#: Characters past its end that a match of the pattern may depend on.
LOOK = 3


class Edit(NamedTuple):
    start: int
    stop: int
    text: str


class CountTree:
    """One document's text, pre-tokens and sums."""

    def __init__(self, text: str, codec: bpe.Codec):
        self.codec, self.encoded = codec, 0
        pieces = codec.pieces(text)
        self.leaves: list[list[str]] = [[p] for p in pieces] or [[]]
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = self._sums(map(len, pieces)), self._sums(codec.counts(pieces))

    def _sums(self, leaves: Iterable[int]) -> list[int]:
        """The nodes' sums, level by level from the leaves up."""
        level = list(leaves)
        level += [0] * (self.width - len(level))
        levels = [level]
        while len(level) > 1:
            level = list(map(add, level[::2], level[1::2]))
            levels.append(level)
        return [0, *chain.from_iterable(reversed(levels))]

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, or the last that holds any, and its first character."""
        at, node, before = max(0, min(at, self.length - 1)), 1, 0
        while node < self.width:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def _set(self, leaf: int, pieces: list[str]) -> None:
        self.leaves[leaf] = pieces
        self.encoded += len(pieces)
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), sum(map(self.codec.count, pieces))

    def apply(self, edit: Edit) -> None:
        start = min(max(edit.start, 0), self.length)
        stop = min(max(edit.stop, start), self.length)
        final = len(self.leaves) - 1
        first, begin = self.find(start - LOOK)
        first = min(first, final)
        shift = len(edit.text) - (stop - start)
        last, end, cuts, region = first - 1, begin, {}, []
        ahead = 4
        while True:
            while last < final and (ahead or end < stop):  # some leaves beyond the edit, more each time
                last += 1
                region += self.leaves[last]
                end += self.chars[self.width + last]
                cuts[end] = last
                ahead -= end >= stop and ahead > 0
            old = "".join(region)
            text = old[: start - begin] + edit.text + old[stop - begin :]
            pieces, at, settled = [], 0, None
            for piece in self.codec.pieces(text):
                if begin + at - shift >= stop and (settled := cuts.get(begin + at - shift)) is not None:
                    break
                if last < final and at + len(piece) + LOOK > len(text):
                    break  # may go on beyond what was read
                pieces.append(piece)
                at += len(piece)
            else:
                settled = last if last == final else None
            if settled is not None:
                break
            ahead = 2 * (last - first + 1)
        self._set(first, pieces)
        for leaf in range(first + 1, settled + 1):
            if self.leaves[leaf]:
                self._set(leaf, [])
        low, high = (self.width + first) >> 1, (self.width + settled) >> 1
        while low:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low >> 1, high >> 1

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


def count(docs: DataFrame, ranks: bytes, pattern: str, edits: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_tokens; with edits, an array of structs (start, stop, text), also n_tokens_edited and recounted.

    recounted is how many pre-tokens the edits made the tree encode again.
    """
    names = ["n_tokens"] + (["n_tokens_edited", "recounted"] if edits else [])
    if clash := {c.lower() for c in docs.columns} & set(names):
        raise ValueError(f"columns already: {sorted(clash)}")
    file = docs.sparkSession.sparkContext.broadcast(ranks)
    at, at_edits = docs.columns.index(text), docs.columns.index(edits) if edits else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(file.value, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows = []
                for i, body in enumerate(part.column(at).to_pylist()):
                    tree = CountTree(body or "", codec)
                    row = [tree.count]
                    if at_edits is not None:
                        for e in part.column(at_edits)[i].as_py() or []:
                            tree.apply(Edit(e["start"] or 0, e["stop"] or 0, e["text"] or ""))
                        row += [tree.count, tree.encoded]
                    rows.append(row)
                made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))
