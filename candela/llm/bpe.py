"""Byte-level BPE encoding and decoding.

Merges become a finite-state transducer over bytes that is determinised while
it runs. A hypothesis is (bytes of the unfinished token, token before it, tokens
not yet emitted); a state is the set of hypotheses that are alive after a
prefix. Two tokens may stand side by side exactly if BPE on their joined bytes
gives the same two tokens, and for each prefix exactly one chain of such tokens
spells it out; so a state holds one finished hypothesis and those that may
still overtake it. Tokens on which all hypotheses agree are emitted at once:
the lookahead is bounded by the longest token. States and arcs are built when
first met and kept in bounded tables.

Decoding joins the tokens' bytes chunk by chunk and passes them through an
incremental UTF-8 state machine, whose state is all that a chunk leaves behind.

Defined results: null or empty text has no tokens; an unknown id raises
ValueError; bytes that aren't UTF-8 decode to U+FFFD in text, unchanged in
bytes. Other columns pass through; clashing names raise ValueError.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import appended, held

#: Bounds of the lazily filled tables, in entries.
STATES, PAIRS, PATHS, LONGEST_PATH = 1 << 15, 1 << 18, 1 << 18, 48


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver and shipped to the executors (a vocabulary is about 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


class Merges:
    """Which tokens exist, how each came to be, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, piece: bytes, whole: bool = True) -> list[bytes]:
        """BPE by definition: join the leftmost pair of lowest rank until none is left; whole=False never joins all."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and (whole or len(parts) > 2)), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for single bytes and for tokens that merging never makes."""
        if token not in self.halves:
            parts = self.merged(self.tokens[token], whole=False)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.made_of(token) is not None

    def adjacent(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two as they are.

        Undo merges from the latest back to the first. While the pieces at the
        border are a and b, a merge of a+b would have come before the merge
        that next swallows one of them (left merges win ties), if its rank is
        lower: then the two tokens never come to be. left is -1 at the start.
        """
        key = left << 20 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.reachable(right) if left < 0 else self._adjacent(left, right)
        return known

    def _adjacent(self, a: int, b: int) -> bool:
        ranks, tokens, until = self.ranks, self.tokens, len(self.ranks) + 1
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < until:
                return False
            from_a, from_b = self.made_of(a), self.made_of(b)
            if from_a is None and from_b is None:
                return True
            if from_b is None or (from_a is not None and a > b):
                until, a = a, from_a[1]
            else:
                until, b = b + 1, from_b[0]


class State:
    __slots__ = ("arcs", "hypotheses", "rest")

    def __init__(self, hypotheses, rest):
        self.hypotheses, self.rest, self.arcs = hypotheses, rest, {}


class Transducer:
    """The determinised transducer; start() and step() for streams, piece() for whole pre-tokens.

    Once the table of states is full, further sets of hypotheses are stepped
    as they are, so memory stays bounded and results are the same.
    """

    def __init__(self, merges: Merges):
        self.merges, self.states = merges, {}
        self.go: dict[int, int] = {}
        self.ends, self.inner = [-1], bytearray(1)
        for token, i in merges.ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                node = self.go.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(0)
            self.ends[node] = i
        self.first = self._state(((0, -1, ()),))

    def start(self) -> State:
        return self.first

    def step(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        """Tokens that are certain after this byte, and the next state."""
        arc = state.arcs.get(byte)
        if arc is None:
            sure, alive = self.agreed(self.advanced(state.hypotheses, byte))
            arc = sure, self._state(tuple(alive))
            if len(self.states) < STATES:
                state.arcs[byte] = arc
        return arc

    def _state(self, hypotheses) -> State:
        known = self.states.get(hypotheses)
        if known is None:
            known = State(hypotheses, next((tokens for node, _, tokens in hypotheses if not node), ()))
            if len(self.states) < STATES:
                self.states[hypotheses] = known
        return known

    def advanced(self, hypotheses, byte: int) -> list:
        go, ends, inner, adjacent = self.go, self.ends, self.inner, self.merges.adjacent
        alive, done = [], False
        for node, last, tokens in hypotheses:
            child = go.get(node << 8 | byte)
            if child is not None:
                if not done and (token := ends[child]) >= 0 and adjacent(last, token):
                    alive.append((0, token, (*tokens, token)))
                    done = True
                if inner[child]:
                    alive.append((child, last, tokens))
        if not done:
            raise ValueError("the vocabulary lacks a single byte")
        return alive

    @staticmethod
    def agreed(alive: list) -> tuple[tuple[int, ...], list]:
        """The tokens that all hypotheses begin with, and the hypotheses without them."""
        rest = [x[2] for x in alive]
        low, high = min(rest), max(rest)
        n = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        return low[:n], [(node, last, tokens[n:]) for node, last, tokens in alive] if n else alive

    def piece(self, data: bytes) -> list[int]:
        if (whole := self.merges.ranks.get(data)) is not None:
            return [whole]
        out: list[int] = []
        state, at, n = self.first, 0, len(data)
        while at < n:
            arc = state.arcs.get(data[at])
            if arc is None:
                if len(self.states) >= STATES:
                    break
                arc = self.step(state, data[at])
            if arc[0]:
                out += arc[0]
            state = arc[1]
            at += 1
        else:
            out += state.rest
            return out
        alive = state.hypotheses
        for byte in data[at:]:
            alive = self.advanced(alive, byte)
            if len(alive[-1][2]) > 8:
                sure, alive = self.agreed(alive)
                out += sure
        out += next(tokens for node, _, tokens in alive if not node)
        return out


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class Paths(dict):
    """Short pre-tokens' whole paths through the transducer, as packed ids; emptied when full."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        packed = pack(self.transducer.piece(piece.encode()))
        if len(piece) <= LONGEST_PATH:
            if len(self) >= PATHS:
                self.clear()
            self[piece] = packed
        return packed


class Numbers(dict):
    """How many tokens pre-tokens have, without the tokens; emptied when full.

    Most short pre-tokens that weren't met before lead to states that weren't
    either, so their pairs are merged in turn; long ones go through the
    transducer.
    """

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> int:
        data = piece.encode()
        if len(data) > LONGEST_PATH:
            return len(self.transducer.piece(data))
        n = 1 if data in self.transducer.merges.ranks else self.merged(data)
        if len(self) >= PATHS:
            self.clear()
        self[piece] = n
        return n

    def merged(self, data: bytes) -> int:
        """The number of parts left when the leftmost pair of lowest rank was joined until there was none."""
        rank, none = self.transducer.merges.ranks.get, 1 << 32
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return len(parts)


def utf8_table() -> list[list[int]]:
    """States by byte class of the UTF-8 machine: 0 between characters, then what must follow.

    1-3: so many more bytes, any continuation; 4-7: the next byte from a
    narrower range, after E0, ED, F0 and F4. -1: the byte can't stand here.
    """
    table = [[-1] * 256 for _ in range(8)]
    table[0][:0x80] = [0] * 0x80
    for lead in range(0xC2, 0xF5):
        table[0][lead] = 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3
    for lead, state in ((0xE0, 4), (0xED, 5), (0xF0, 6), (0xF4, 7)):
        table[0][lead] = state
    for state, low, high, after in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state][low : high + 1] = [after] * (high - low + 1)
    return table


UTF8 = utf8_table()
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


class Utf8Machine:
    """Bytes in, text out, in any chunks.

    The state says what may follow; the only other memory is the value of the
    character that has begun. A byte that can't follow ends what has begun with
    one replacement character and is looked at again between characters. The
    machine steps through the edges of a chunk; what lies between is taken over
    whole if it is sound, else stepped through too.
    """

    def __init__(self):
        self.state = self.value = 0

    def step(self, data: bytes, out: list[str]) -> None:
        state, value, table = self.state, self.value, UTF8
        for byte in data:
            after = table[state][byte]
            if after < 0:
                out.append(REPLACEMENT)
                if state == 0:
                    continue
                state = 0
                if (after := table[0][byte]) < 0:
                    out.append(REPLACEMENT)
                    continue
            if state == 0:
                value = byte if after == 0 else byte & (0x1F if byte < 0xE0 else 0x0F if byte < 0xF0 else 0x07)
            else:
                value = value << 6 | byte & 0x3F
            state = after
            if state == 0:
                out.append(chr(value))
        self.state, self.value = state, value

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        begin, end = 0, len(data)
        while self.state and begin < end:
            self.step(data[begin : begin + 1], out)
            begin += 1
        back = next((k for k in range(1, min(3, end - begin) + 1) if data[end - k] & 0xC0 == 0xC0), 0)  # a character that may go on in the next chunk
        middle = data[begin : end - back]
        try:
            out.append(middle.decode())
        except UnicodeDecodeError:
            self.step(middle, out)
        self.step(data[end - back :] if back else b"", out)
        return "".join(out)

    def close(self) -> str:
        begun, self.state = self.state, 0
        return REPLACEMENT if begun else ""


class Codec:
    def __init__(self, rank_file: bytes, pattern: str):
        self.merges = Merges({base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)})
        self.split = regex.compile(pattern).findall
        self.paths = Paths(Transducer(self.merges))
        self.numbers = Numbers(self.paths.transducer)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.paths.__getitem__, self.split(text))) if text else b""

    def pieces(self, text: str) -> list[str]:
        return self.split(text)

    def count(self, piece: str) -> int:
        return self.numbers[piece]

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.numbers.__getitem__, pieces))

    def decode_bytes(self, packed: bytes | None, chunk: int = 1 << 14) -> Iterator[bytes]:
        """The tokens' bytes, chunk by chunk."""
        tokens, ids = self.merges.tokens, memoryview(packed or b"").cast("I")
        for at in range(0, len(ids), chunk):
            try:
                yield b"".join(map(tokens.__getitem__, ids[at : at + chunk]))
            except KeyError as e:
                raise ValueError(f"no token has the id {e}") from None

    def decode(self, packed: bytes | None, chunk: int = 1 << 14) -> Iterator[str]:
        """Text, chunk by chunk."""
        machine = Utf8Machine()
        for data in self.decode_bytes(packed, chunk):
            yield machine.feed(data)
        yield machine.close()


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    return held(("bpe", hash(rank_file), pattern), lambda: Codec(rank_file, pattern))


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds each text's token ids, packed as little-endian unsigned 32-bit integers (ids_array unpacks them)."""
    file = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(text)

    def make(batch: pa.RecordBatch) -> list[bytes]:
        return list(map(codec(file.value, pattern).encode, batch.column(at).to_pylist()))

    return appended(df, make, ids, T.BinaryType(), pa.binary())


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that packed ids stand for."""
    file = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(ids)

    def make(batch: pa.RecordBatch) -> list[str]:
        own = codec(file.value, pattern)
        return ["".join(own.decode(x)) for x in batch.column(at).to_pylist()]

    return appended(df, make, text, T.StringType(), pa.string())


def decode_bytes(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for, be they UTF-8 or not."""
    file = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(ids)

    def make(batch: pa.RecordBatch) -> list[bytes]:
        own = codec(file.value, pattern)
        return [b"".join(own.decode_bytes(x)) for x in batch.column(at).to_pylist()]

    return appended(df, make, data, T.BinaryType(), pa.binary())


def decode_chunks(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", chunk: int = 1 << 14) -> DataFrame:
    """A row (columns but ids, part, decoded) for each `chunk` tokens, in order of part: no text is whole in memory, however long."""
    file = df.sparkSession.sparkContext.broadcast(ranks)
    at, others = df.columns.index(ids), [c for c in df.columns if c != ids]
    if clash := {c.lower() for c in others} & {"part", "decoded"}:
        raise ValueError(f"columns already: {sorted(clash)}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                for part, text in enumerate(own.decode(row.column(at)[0].as_py(), chunk)):
                    yield pa.RecordBatch.from_arrays([*(row.column(c) for c in others), pa.array([part], pa.int32()), pa.array([text], pa.string())], names=[*others, "part", "decoded"])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in others), T.StructField("part", T.IntegerType()), T.StructField("decoded", T.StringType())]))


def ids_array(ids: Column) -> Column:
    """Packed ids as array<int>."""
    def word(i: Column) -> Column:
        return F.conv(F.concat(*(F.substring(F.hex(ids), i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4))), 16, 10).cast("int")

    return F.when(F.length(ids) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1), word))
