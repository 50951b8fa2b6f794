"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's expression a Boolean query of trigrams is derived: a
disjunction of sets, all of whose trigrams any match must contain. The index
has a posting (trigram, id) for each trigram that some query names and each
text that contains it; postings of a set are intersected by counting them for
each id. Candidates are verified by the expression itself. A rule without
mandatory trigrams (such as a long run of hexadecimal digits) scans every text.

Spans come from splitting a text at its matches: the lengths of gaps and
matches, accumulated, give leftmost non-overlapping matches in code points.

Defined results: a null text counts as empty and has no spans; rows with equal
or null ids are candidates together and verified each by its own text; other
columns don't matter in scan() and pass through redact().
"""

from __future__ import annotations

from itertools import product
from re import _constants as kinds
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import fresh, small, written

#: An exact set of strings or a disjunction with more members than this is given up (the query only gets weaker).
WIDEST = 64


class Rule(NamedTuple):
    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The base kinds, in order. Matches whose group is shorter than `least` are dropped.
BASE = [
    Rule("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),
]
#: Further kinds that this scan knows.
FURTHER = [
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    # up to the END line if only header lines and the body come before it, else the BEGIN line
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[\\x20\\x09-\\x0D]+[A-Za-z-]+:[^\\n]*){0,4}[A-Za-z0-9+/=\\x20\\x09-\\x0D]*-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}(?:\\.[A-Za-z0-9_-]+)?"),
]

Query = frozenset  # of frozensets of trigrams; the empty set of trigrams holds for any text
ALWAYS: Query = frozenset([frozenset()])


def both(a: Query, b: Query) -> Query:
    out = frozenset(x | y for x, y in product(a, b))
    return out if len(out) <= WIDEST else min(a, b, key=len)


def either(queries: list[Query]) -> Query:
    out = frozenset().union(*queries)
    out = frozenset(x for x in out if not any(y < x for y in out))  # a set that holds another adds nothing
    return ALWAYS if frozenset() in out or len(out) > WIDEST else out


def of_strings(strings: set[str]) -> Query:
    return either([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def derive(items) -> tuple[set[str] | None, Query]:
    """(all strings that the parsed items match, if few; the query), in lower case."""
    exact: set[str] | None = {""}
    run, query = {""}, ALWAYS  # run: what the part since the last unbounded item matches
    for op, arg in items:
        strings, inner = None, ALWAYS
        if op is kinds.LITERAL:
            strings = {chr(arg).lower()}
        elif op is kinds.IN and all(k is kinds.LITERAL for k, _ in arg) and len(arg) <= 8:
            strings = {chr(c).lower() for _, c in arg}
        elif op is kinds.SUBPATTERN:
            strings, inner = derive(arg[-1])
        elif op is kinds.BRANCH:
            parts = [derive(x) for x in arg[1]]
            inner = either([q if s is None else of_strings(s) for s, q in parts])
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, what = arg
            strings, inner = derive(what)
            if strings is not None and high <= 8 and len(strings) ** high <= WIDEST:
                strings = {"".join(x) for n in range(low, high + 1) for x in product(strings, repeat=n)}
            elif low:
                strings, inner = None, inner if strings is None else of_strings(strings)
            else:
                strings, inner = None, ALWAYS
        longer = {a + b for a, b in product(run, strings)} if strings is not None else set()
        if strings is not None and len(longer) <= WIDEST:
            run = longer
        else:
            query, run, exact = both(query, both(of_strings(run), inner if strings is None else of_strings(strings))), {""}, None
    return (run if exact is not None else None), both(query, of_strings(run))


def trigram_query(regex: str) -> Query:
    """Sets of trigrams, one of which any match (in lower case) contains whole; ALWAYS if there is no such condition."""
    return derive(parser.parse(regex))[1]


def any_of(trigrams: list[str]) -> str:
    """An expression whose group 1 is, at each position in turn, the trigram that starts there if it is one of these."""
    of = lambda chars: "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(chars))) + "]"
    tree: dict[str, dict[str, set[str]]] = {}
    for a, b, c in trigrams:
        tree.setdefault(a, {}).setdefault(b, set()).add(c)
    branches = (of(a) + "(?:" + "|".join(of(b) + of(c) for b, c in sorted(after.items())) + ")" for a, after in sorted(tree.items()))
    return f"(?={''.join(of(t[i] for t in trigrams) for i in range(3))})(?=({'|'.join(branches)}))"  # the classes alone turn most positions away


def postings(docs: DataFrame, trigrams: list[str], doc_id: str, text: str) -> DataFrame:
    """(trigram, id): which texts contain which of the trigrams, letters A-Z in either case; one pass over each text."""
    low = F.lower(text)  # more than A-Z only adds candidates
    return docs.select(F.col(doc_id).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(any_of(trigrams)), F.lit(1)))).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule], doc_id: str, text: str) -> DataFrame:
    """(id, kinds): the rules whose query holds for a text of that id; rules that must scan fully aren't among them."""
    wanted = [(r.kind, f"{r.kind}/{i}", t, len(s)) for r in rules for i, s in enumerate(sorted(trigram_query(r.regex), key=sorted)) for t in sorted(s)]
    trigrams = sorted({x[2] for x in wanted})
    if not trigrams:
        return docs.select(F.col(doc_id).alias("id"), F.array(F.lit("")).alias("kinds")).limit(0)
    queries = docs.sparkSession.createDataFrame(wanted, "kind string, part string, trigram string, needed int")  # a few rows for each rule
    return (
        postings(docs, trigrams, doc_id, text)
        .join(F.broadcast(queries), "trigram")
        .groupBy("id", "kind", "part", "needed")
        .agg(F.collect_set("trigram").alias("found"))
        .filter(F.size("found") == F.col("needed"))
        .groupBy("id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as structs (start, order, end, kind)."""
    whole, part = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    gaps = F.split(text, rule.regex, -1)
    steps = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))), part, lambda x, p: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), F.length(p).alias("part")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["len"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(steps, start, add, lambda s: s["spans"])


def with_spans(docs: DataFrame, rules: list[Rule], spans: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a column of all matches, by start, then kind in the order of rules."""
    found = small(written(candidates(docs, rules, doc_id, text)), 64)
    key, fits, body = (fresh(docs, x) for x in ("its_id", "its_kinds", "its_text"))
    found = found.select(F.col("id").alias(key), F.col("kinds").alias(fits))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    joined = docs.join(found, F.col(doc_id).eqNullSafe(F.col(key)), "left").withColumn(body, F.coalesce(F.col(text), F.lit("")))
    each = []
    for i, rule in enumerate(rules):
        hit = F.col(body).rlike(rule.regex)
        if trigram_query(rule.regex) != ALWAYS:
            hit = F.coalesce(F.array_contains(fits, rule.kind), F.lit(False)) & hit
        each.append(F.when(hit, spans_of(F.col(body), rule, i)).otherwise(none))
    return joined.withColumn(spans, F.array_sort(F.concat(*each))).drop(key, fits, body)


def as_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, found: every match of the base and further kinds as array of structs (start, order, end, kind)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_spans(own, BASE + FURTHER, "found").select("doc_id", "found")


def redact(docs: DataFrame, mark: str = "[SECRET]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every found secret replaced by mark; overlapping spans are one."""
    spans = fresh(docs, "found")
    marked = with_spans(docs, BASE + FURTHER, spans, doc_id, text)
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))

    def cut(state: Column, x: Column) -> Column:
        gap = F.concat(state["kept"], F.substring(F.col(text), state["at"] + 1, x["start"] - state["at"]), F.lit(mark))
        return F.when(x["start"] < state["at"], F.struct(state["kept"].alias("kept"), F.greatest(state["at"], x["end"]).alias("at"))).otherwise(F.struct(gap.alias("kept"), x["end"].alias("at")))

    def close(state: Column) -> Column:
        return F.concat(state["kept"], F.substring(F.col(text), state["at"] + 1, F.length(text)))

    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, cut, close)).otherwise(F.col(text))
    return marked.withColumn(text, clean).drop(spans)


def _duck_spans(rule: Rule, order: int) -> str:
    regex = rule.regex.replace("'", "''")
    return f"""
select k, {order} as kind_order, '{rule.kind}' as kind, s.start, s.start + s.len as end_ from (
  select k, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    'start': (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint,
    'len': length(m[i]), 'part': length(p[i])}})) as s
  from (select k, regexp_extract_all(text, '{regex}') as m, regexp_extract_all(text, '{regex}', {rule.group}) as p, string_split_regex(text, '{regex}') as g
        from docs where regexp_matches(text, '{regex}'))) where s.part >= {rule.least}"""


ORACLE = f"""
with docs as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
spans as ({" union all ".join(_duck_spans(r, i) for i, r in enumerate(BASE + FURTHER))}),
lists as (
  select k, count(*) filter (kind_order = 0) as n_assign, count(*) filter (kind_order = 1) as n_access, count(*) filter (kind_order = 2) as n_hex,
         string_agg(kind || ':' || start || ':' || end_, ',' order by start, kind_order) filter (kind_order < 3) as base,
         string_agg(kind || ':' || start || ':' || end_, ',' order by start, kind_order) as spans
  from spans group by k)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join lists using (k)
"""
