"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie with one character skipped or replaced.

Words are counted over all documents and dealt by range, so that a part holds
neighbours of the sorted list, PART words on average. In every node of the trie
the child with most words is heavy, the others (the end of a word counts as one)
are light. Two words one edit apart leave each other at one node, and at most
one of them goes on by the heavy child there; so it is enough that each word
under a light child of a node v is merged into v's subtree
  with its character at v replaced: by the heavy child's, or by any (light words
  of v with the same rest are one character apart),
  with its character at v skipped, if the next one is different,
  with the heavy child's character put before it,
and every terminal that coincides with a word gives one pair, each pair once. A
word has at most log2 of all words light nodes above it (small to large), so
that many errata are made of it, whatever its length.

Nodes whose subtree spans several parts are prefixes of a part's first or last
word; the sizes of their children are added up over the parts first, so that all
parts agree on the heavy child. Errata within a part's range are looked up there,
the others are joined with the words by Spark. A group of light words with the
same rest is no larger than the alphabet.

Defined results: null and empty texts have no words; a null id counts as empty
text before the colon; equal rows count each; without words that are frequent
enough the result is empty; other columns don't matter. Ties between near words
of equal count go to the smaller in code-point order.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import held, stored, written

#: Code points and occurrences that a word has at least; how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One of so many (document, word) loses a code point.
ERRATUM = 31
#: Words of a part on average; words that a task counts before it passes them on.
PART, HELD = 100_000, 400_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Between a word's start and its rest where any character may stand; no word has it.
ANY = "\x00"


def runs(text: str | None, least: int = LEAST_LENGTH) -> list[str]:
    """Maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of at least that length, A-Z lower-cased."""
    return re.findall(f"[a-zÀ-ÿ]{{{least},}}", (text or "").encode().translate(LOWER).decode())


def altered(run: str, seed: int) -> str:
    """The run, or without one code point; seed: crc32 of what comes before the run."""
    h = zlib.crc32(run.encode(), seed)
    if h % ERRATUM:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, often: int = LEAST_COUNT) -> DataFrame:
    """(word, n): how often each word occurs in all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("spelling", dict)  # it has no tables, but other operators' may go
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                seed = zlib.crc32(f"{key.as_py() if key.is_valid else ''}:".encode())
                for word, n in Counter(runs(value.as_py(), least)).items():
                    word = altered(word, seed)
                    if len(word) >= least:
                        total[word] += n
                if len(total) >= HELD:
                    yield out()
        yield out()

    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def in_parts(words: DataFrame, n_words: int) -> DataFrame:
    """words with part: each part is a range of the sorted words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32())], names=["word", "n", "part"])

    return stored(words.repartitionByRange(max(1, n_words // PART), "word").mapInArrow(run, "word string, n long, part int"))


def child(word: str, depth: int) -> str:
    """The character by which the word leaves its node of that depth; none at its end."""
    return word[depth] if len(word) > depth else ""


def children(words: list[str], low: int, high: int, depth: int) -> Iterator[tuple[str, int, int]]:
    """(character, from, to): the children of the node of that depth over words[low:high], in order."""
    while low < high:
        c = child(words[low], depth)
        end = bisect_right(words, c, low, high, key=lambda w: child(w, depth))
        yield c, low, end
        low = end


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def prefixes(word: str) -> list[bytes]:
    """A digest for each prefix, the empty one first."""
    made, out = xxhash.xxh3_128(), []
    for c in word:
        out.append(made.digest())
        made.update(c.encode())
    return [*out, made.digest()]


def edges(parts: DataFrame) -> DataFrame:
    """(part, depth, node, heavy): for each part the nodes above its first and last word that another part shares, and their heavy child."""

    def run(table):
        words = sorted(table.column("word").to_pylist())
        part, rows = table.column("part")[0].as_py(), []
        for at, word in {0: words[0], len(words) - 1: words[-1]}.items():
            low, high = 0, len(words)
            for depth, node in enumerate(prefixes(word)):
                found = list(children(words, low, high, depth))
                rows += [(part, depth, node, c, b - a) for c, a, b in found]
                low, high = next((a, b) for _, a, b in found if a <= at < b)
        rows = list(dict.fromkeys(rows))  # the first and the last word have some nodes in common
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("part", pa.int32()), ("depth", pa.int32()), ("node", pa.binary()), ("c", pa.string()), ("size", pa.int64())))})

    rows = written(parts.groupBy("part").applyInArrow(run, "part int, depth int, node binary, c string, size long"))
    sizes = rows.groupBy("depth", "node", "c").agg(F.sum("size").alias("size"), F.min("part").alias("least"), F.max("part").alias("most"))
    heavy = sizes.groupBy("depth", "node").agg(F.max(F.struct("size", "c"))["c"].alias("heavy"), F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most").drop("least", "most")
    return rows.select("part", "depth", "node").distinct().join(heavy, ["depth", "node"])


class Near:
    """What is known of the near words of each of a part's words: how many, and the best of them (most frequent, then first)."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.n, self.best = [0] * len(words), [-1] * len(words)

    def see(self, i: int, j: int) -> None:
        b = self.best[i]
        if b < 0 or (-self.counts[j], j) < (-self.counts[b], b):
            self.best[i] = j

    def pair(self, i: int, j: int) -> None:
        for x, y in ((i, j), (j, i)):
            self.n[x] += 1
            self.see(x, y)

    def all_of(self, group: list[int]) -> None:
        """All of them are near each other."""
        first, second = sorted(group, key=lambda k: (-self.counts[k], k))[:2]
        for i in group:
            self.n[i] += len(group) - 1
            self.see(i, second if i == first else first)


NEAR, LOOK, GROUP = 0, 1, 2  # kinds of rows that a part gives: near words found, errata to look up, light words with the same rest
FOUND = "kind int, key string, word string, n long, n_near long, best string, best_n long"


def merged(words: list[str], counts: list[int], shared: dict[tuple[int, bytes], str]) -> Iterator[tuple]:
    """Rows of FOUND for a part. shared: heavy children of the nodes that other parts share, by (depth, digest)."""
    near, place = Near(words, counts), {w: i for i, w in enumerate(words)}
    first, last = words[0], words[-1]
    ends = [[shared.get((d, node)) for d, node in enumerate(prefixes(w))] if shared else [] for w in (first, last)]
    opened: list[tuple] = []

    def look(i: int, target: str) -> None:
        if first <= target <= last:
            if (j := place.get(target)) is not None:
                near.pair(i, j)
        elif len(target) >= LEAST_LENGTH:
            opened.append((LOOK, target, words[i], counts[i], None, None, None))

    def light(low: int, high: int, depth: int, heavy: str | None, alike: dict[str, list[int]] | None) -> None:
        for i in range(low, high):
            w = words[i]
            start, c, rest = w[:depth], child(w, depth), w[depth + 1 :]
            if c:
                if alike is None:
                    opened.append((GROUP, start + ANY + rest, w, counts[i], None, None, None))
                else:
                    alike.setdefault(rest, []).append(i)
                if c != rest[:1]:
                    look(i, start + rest)
            if heavy:
                if c:
                    look(i, start + heavy + rest)
                look(i, start + heavy + w[depth:])

    def visit(low: int, high: int, depth: int, heavy: str | None, outside: bool) -> list[tuple[int, int]]:
        """Merges the light children of one node; gives the children's ranges."""
        found = list(children(words, low, high, depth))
        if not outside:
            heavy = max(found, key=lambda x: (x[2] - x[1], x[0]))[0]
        alike: dict[str, list[int]] | None = None if outside else {}
        for c, a, b in found:
            if c != heavy:
                light(a, b, depth, heavy, alike)
        for group in (alike or {}).values():
            if len(group) > 1:
                near.all_of(group)
        return [(a, b) for c, a, b in found if c]

    todo = [(0, len(words), 0)]
    while todo:
        low, high, depth = todo.pop()
        own = ends[0] if low == 0 else ends[1] if high == len(words) else []
        branch = common(words[low], words[high - 1])
        while depth < min(branch, len(own)) and own[depth] is None:
            depth += 1
        if depth >= len(own):
            depth = branch
        outside = depth < len(own) and own[depth] is not None
        if outside or high - low > 1:
            todo += [(a, b, depth + 1) for a, b in visit(low, high, depth, own[depth] if outside else None, outside)]
    for i, n in enumerate(near.n):
        if n:
            yield NEAR, None, words[i], counts[i], n, words[near.best[i]], counts[near.best[i]]
    yield from opened


def near_words(words: DataFrame) -> DataFrame:
    """(word, n), written already -> (word, n_near, best, best_n) for every word that has a near word, one edit apart."""
    parts = in_parts(words, words.count())
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    names = [field.split()[0] for field in FOUND.split(", ")]

    def run(own, shared):
        if not own.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, kinds)})
        rows = sorted(zip(own.column("word").to_pylist(), own.column("n").to_pylist()))
        known = {(d, node): h for d, node, h in zip(*(shared.column(c).to_pylist() for c in ("depth", "node", "heavy")))}
        found = list(merged([w for w, _ in rows], [n for _, n in rows], known))
        return pa.table({k: pa.array(column, t) for k, t, column in zip(names, kinds, zip(*found) if found else [[]] * len(names))})

    found = stored(parts.groupBy("part").cogroup(edges(parts).groupBy("part")).applyInArrow(run, FOUND))
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("top")
    here = found.filter(F.col("kind") == NEAR).select("word", "n_near", "best", "best_n")
    hit = found.filter(F.col("kind") == LOOK).select("key", F.col("word").alias("origin"), F.col("n").alias("m")).join(words, F.col("key") == words["word"])
    both = F.explode(F.array(F.struct(F.col("origin").alias("word"), F.lit(1).cast("long").alias("n_near"), F.col("word").alias("best"), F.col("n").alias("best_n")), F.struct("word", F.lit(1).cast("long").alias("n_near"), F.col("origin").alias("best"), F.col("m").alias("best_n"))))
    there = hit.select(both.alias("x")).select("x.*")
    group = found.filter(F.col("kind") == GROUP).groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "word"))).alias("all")).filter(F.size("all") > 1)  # no larger than the alphabet
    other = F.when(F.col("x.word") == F.col("all")[0]["word"], F.col("all")[1]).otherwise(F.col("all")[0])
    alike = group.select("all", F.explode("all").alias("x")).select(F.col("x.word").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), other.alias("o")).select("word", "n_near", F.col("o.word").alias("best"), (-F.col("o.minus")).alias("best_n"))
    rows = here.unionByName(there).unionByName(alike)
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.minus")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, twice as far in each round.

    A form is RATIO times as frequent as its word, so no chain is longer than
    the digits of the largest count.
    """
    found = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(found.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        found = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return found


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word, its form if it has one, and the last form that this leads to."""
    words = written(counted(docs, doc_id, text))
    rows = written(words.join(near_words(words), "word", "left"))
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = rows.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"))
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_BYTES = "[('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::int for i in range(octet_length(encode(s)))]"
_STEP = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"


def oracle(ratio: int = RATIO) -> str:
    """The same rows in SQL: crc32 by its table, near words by their common deletions, forms by recursion."""
    return f"""with recursive bits(i, x, k) as (select i, i, 0 from (select unnest(range(256)) as i) union all select i, {_STEP}, k + 1 from bits where k < 8),
crc as (select list(x order by i) as t from bits where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
each as (select doc_id, run, count(*) as n, coalesce(doc_id::varchar, '') || ':' || run as s from runs where length(run) >= {LEAST_LENGTH} group by all),
hashed as (select run, n, xor(list_reduce({_BYTES}, lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), 4294967295::bigint), 4294967295) as h from each, crc),
words as (select word, sum(n)::bigint as n from (select n, case when h % {ERRATUM} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed)
  where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}),
cut as (select word, n, unnest(range(length(word))) as i from words),
short as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from cut),
pairs as (select a.word as x, b.word as y from short a join short b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word from short a join words b on a.rest = b.word union select b.word, a.word from short a join words b on a.rest = b.word),
near as (select x as word, count(*) as n_near, arg_min(y, (-n, y)) as best, max(n) as best_n from pairs join words on y = words.word group by x),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= {ratio} * w.n then best end as form, case when best_n >= {ratio} * w.n then best_n end as form_n from words w left join near using (word)),
way(word, so_far, k) as (select word, word, 0 from forms union all select way.word, forms.form, k + 1 from way join forms on way.so_far = forms.word where forms.form is not null)
select word, form, (select arg_max(so_far, k) from way where way.word = forms.word) as root, n, n_near, form_n from forms"""
