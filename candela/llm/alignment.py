"""Alignment of two tokenizers: which tokens of one end where tokens of the other end, and how often which pairs do.

The tokens of B are a static index of intervals over the text's bytes, sorted by
start and by end. For each token of A two bisections give the run of B tokens
that it overlaps; it spans the gaps between them. A gap that no A token spans is
the end of a group. All tokens of a slice of documents are bisected at once, as
tokens never cross the end of a text. The last A and the last B token of a group
end together and are linked.

How often each pair of ids is linked in all documents is counted in blocks of
documents, each with a list of its distinct pairs; blocks add up their counts by
pair, and get back the counts of their own pairs only. So what is shuffled is a
row for each pair and block, and each link once, as its place in the block's
list. Nothing is broadcast but the two vocabularies.

Defined results: texts that are null or empty, or that either tokenizer doesn't
give back byte for byte (a normaliser, for instance), have no tokens: zeros and
an empty digest; ids of any type, null and repeated ones too, have a row each;
columns other than the id and the text don't matter; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import held, stored, written

#: Links of a block at least, but for a task's last block; code points of the texts that are aligned at once, at least.
BLOCK, SLICE = 2_000_000, 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """The byte-level BPE tokenizer of a JSON file, without its special tokens: merges in order of their ids."""

    def __init__(self, raw: bytes, pattern: str):
        read, letters = json.loads(raw), byte_alphabet()
        special = {t["content"] for t in read.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in read["model"]["vocab"].items() if token not in special}
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in read["model"]["merges"]]
        if [read["model"]["vocab"][m] for m in made] != list(range(256, 256 + len(made))):
            raise ValueError("merges must be in the order of their ids")
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.own = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.own.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]


class Pieces:
    """The tokenizer of a sentencepiece model; it adds the space before the text itself."""

    def __init__(self, raw: bytes):
        self.own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.pieces = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers, with the length of each token and its id's digits."""

    def __init__(self, a: bytes, b: bytes, pattern: str):
        self.sides = ByteLevel(a, pattern), Pieces(b)
        self.lengths = [np.array([len(p) for p in side.pieces], np.int32) for side in self.sides]
        n = max(map(len, self.lengths))
        if n > 10**7:
            raise ValueError("ids of more than seven digits")
        texts = [str(i).encode() for i in range(n)]
        self.n_digits = np.array([len(t) for t in texts], np.int32)
        self.digits = np.frombuffer(b"".join(t.ljust(8, b"\x00") for t in texts), "<u8")  # the last byte is free for a mark

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of A and of B for each text; none if one of them doesn't give the text back."""
        none = np.empty(0, np.uint32), np.empty(0, np.uint32)
        out = [none] * len(texts)
        there = [i for i, t in enumerate(texts) if t]
        a, b = (side.encode([texts[i] for i in there]) for side in self.sides)
        for i, ids_a, ids_b in zip(there, a, b):
            whole = b" " + texts[i].encode()
            # A merges the text's own bytes, so their number tells; B may have changed characters
            if self.lengths[0][ids_a].sum() == len(whole) and b"".join(map(self.sides[1].pieces.__getitem__, ids_b)) == whole:
                out[i] = ids_a, np.array(ids_b, np.uint32)
        return out

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the last A and of the last B token of each group, for tokens of one or several texts."""
        len_a, len_b = self.lengths[0][a], self.lengths[1][b]
        end_a, end_b = np.cumsum(len_a, dtype=np.int32), np.cumsum(len_b, dtype=np.int32)  # of a slice, so within 32 bits
        first = np.searchsorted(end_b, end_a - len_a, "right")  # the first B token that ends after A's start
        last = np.searchsorted(end_b - len_b, end_a, "left") - 1  # the last one that starts before A's end
        spans = np.bincount(first, minlength=len(b)) - np.bincount(last, minlength=len(b))
        last_b = np.flatnonzero(np.cumsum(spans) == 0)  # no A token spans the gap after it
        return np.searchsorted(end_a, end_b[last_b]), last_b

    def written_out(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text of all groups, as `a1,a2|b1;`, and where each group ends in it."""
        group_a = np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=-1))
        group_b = np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=-1))
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b[:-1] + 1])[group_a]
        place_b = np.arange(len(b)) + (last_a + 1)[group_b]
        ids, mark = np.empty(len(a) + len(b), np.uint32), np.full(len(a) + len(b), ord(",") << 56, np.uint64)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|") << 56, ord(";") << 56
        text = (self.digits[ids] | mark).astype("<u8", copy=False).view(np.uint8)
        return text[text != 0], np.cumsum(self.n_digits[ids] + 1)[place_b[last_b]]

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray]]:
        """For each text: counts of A and B tokens, digest of the groups, and the linked ids of A and of B."""
        found = self.tokens(texts)
        a, b = (np.concatenate([x[side] for x in found]) if found else np.empty(0, np.uint32) for side in (0, 1))
        last_a, last_b = self.groups(a, b)
        text, ends = self.written_out(a, b, last_a, last_b) if len(a) else (np.empty(0, np.uint8), np.empty(0, np.int64))
        upto = np.searchsorted(last_b, np.cumsum([len(x[1]) for x in found]), "left")  # groups up to each text's end
        low = 0
        for (ids_a, ids_b), high in zip(found, upto.tolist()):
            start = int(ends[low - 1]) if low else 0
            digest = hashlib.sha256(text[start : int(ends[high - 1]) - 1].tobytes()).hexdigest() if high > low else ""
            yield len(ids_a), len(ids_b), digest, a[last_a[low:high]], b[last_b[low:high]]
            low = high


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of at least SLICE code points together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


ROW = "block long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, a: bytes, b: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document, its links as places in its block's list; and for each block a row with that list (pairs: A's id times 2^32 plus B's)."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b, pattern))  # two vocabularies
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"]
    names = ["doc_id", *(field.split()[0] for field in ROW.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held(("alignment", hashlib.sha256(shared.value[0] + shared.value[1]).digest(), shared.value[2]), lambda: Pair(*shared.value))
        block, rows, keys, n = TaskContext.get().partitionId() << 32, [], [], 0

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            codes, pairs = pd.factorize(np.concatenate(keys))
            places = codes.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
            ends = np.cumsum([len(k) for k in keys]).tolist()
            links = [places[e - len(k) : e].tobytes() for e, k in zip(ends, keys)]
            none = [None]
            columns = [pa.array([r[0] for r in rows] + none, id_type), pa.array([block] * (len(rows) + 1), pa.int64()), *(pa.array([r[i] for r in rows] + none, t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.string())))]
            columns += [pa.array(links + none, pa.binary()), *(pa.array([None] * len(rows) + [x], pa.list_(pa.int64())) for x in (pairs, np.bincount(codes, minlength=len(pairs))))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in slices(texts):
                for i, (n_a, n_b, digest, left, right) in enumerate(pair.align(texts[start:stop]), start):
                    rows.append((ids[i].as_py(), n_a, n_b, len(left), digest))
                    keys.append((left.astype(np.int64) << 32) | right)
                    n += len(left)
                if n >= BLOCK:
                    yield out(ids.type)
                    block, rows, keys, n = block + 1, [], [], 0
        if rows:
            yield out(batch.column(0).type)

    return stored(own.mapInArrow(run, f"doc_id {kind.dataType.simpleString()}, {ROW}"))


def links(docs: DataFrame, a: bytes, b: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pair counts, documents).

    pair counts: pair, a_id, b_id, count, best (whether no other pair of its B
    id has a higher count). documents: doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256.
    """
    rows = aligned(docs, a, b, pattern, doc_id, text)
    own = rows.filter("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    totals = written(own.groupBy("pair").agg(F.sum("times").alias("count")))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id")
    highest = totals.groupBy(b_id).agg(F.max("count").alias("most"))
    counts = totals.select("pair", "count", b_id).join(highest, "b_id").select("pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "count", (F.col("count") == F.col("most")).alias("best"))
    known = own.select("block", "place", "pair").join(counts.select("pair", "count", "best"), "pair").select(F.col("block").alias("its_block"), "place", "count", "best")
    texts = rows.filter("pairs is null").drop("pairs", "times")
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(docs_of, pairs_of):
        place = pairs_of.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = pairs_of.column("count").to_numpy(), pairs_of.column("best").to_numpy()
        width = "<u2" if len(place) <= 1 << 16 else "<u4"
        found = [np.frombuffer(x.as_py(), width) for x in docs_of.column("links")]
        sums = {"n_best": [int(best[x].sum()) for x in found], "count_sum": [int(count[x].sum()) for x in found]}
        kept = docs_of.select(["doc_id", "n_a", "n_b", "n_groups"]).append_column("n_links", pa.array([len(x) for x in found], pa.int64()))
        for name, column in sums.items():
            kept = kept.append_column(name, pa.array(column, pa.int64()))
        return kept.append_column("groups_sha256", docs_of.column("groups_sha256"))

    done = texts.groupBy("block").cogroup(known.groupBy("its_block")).applyInArrow(run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return counts, done
