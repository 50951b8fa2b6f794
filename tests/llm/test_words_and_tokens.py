"""Spelling variants, token alignment and language-model scores against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candela.llm import alignment, language_model, queries, spelling
from candela.llm.common import written

DOCS = "doc_id long, text string"
ODD = [(None, None), (1, ""), (1, ""), (2, "Kleine Wörterbücher Wörterbücher"), (2, "Kleine Wörterbücher Wörterbücher"), (None, "wörterbücher"), (3, "x" * 100_000), (4, " \t\n"), (10, "the end of the end")]


@pytest.fixture
def folder(spark, tmp_path):
    """Writes rows as the table of documents of a folder."""

    def write(rows):
        path = f"{tmp_path}/{random.random()}"
        spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).withColumn("word", F.lit(1)).coalesce(2).write.parquet(f"{path}/documents.parquet")
        return path

    return write


def prose(rng, n):
    words = ["".join(rng.choice(["the", "ti", "on", "er", "é", "x"]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    return [(k, " ".join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(n)]


# Spelling


def near_by_force(words):
    letters, out = set("".join(words)), {}
    for w in words:
        cuts = range(len(w))
        made = {w[:i] + w[i + 1 :] for i in cuts} | {w[:i] + c + w[i + 1 :] for i in cuts for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        if near := [x for x in made if x in words and x != w]:
            best = min(near, key=lambda x: (-words[x], x))
            out[w] = len(near), best, words[best]
    return out


@pytest.mark.parametrize("part, n, letters, longest", [(100_000, 800, "ab", 12), (40, 700, "abc", 11), (5, 120, "aé", 14), (1, 40, "a", 60)])
def test_near_words_equal_brute_force(spark, monkeypatch, part, n, letters, longest):
    monkeypatch.setattr(spelling, "PART", part)
    rng = random.Random(part)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, longest))): rng.randint(2, 50) for _ in range(n)}
    found = spelling.near_words(written(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in found.collect()} == near_by_force(words)


def variants_by_force(rows):
    n = collections.Counter()
    for key, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near, form = near_by_force(words), {}
    for w, (_, best, best_n) in near.items():
        if best_n >= 10 * words[w]:
            form[w] = best
    root = lambda w: root(form[w]) if w in form else w
    return sorted((w, form.get(w, ""), root(w), k, near.get(w, (0,))[0], words[form[w]] if w in form else -1) for w, k in words.items())


def variant_rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_op12_equals_brute_force(spark, folder):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["therefore", "Therefore", "mistaken", "mistake", "différent", "x"]) for _ in range(40))) for k in range(150)] + ODD
    rows += [(900, "mistakem mistakem mistakems mistakems")]
    got = variant_rows(queries.op12_spelling_variants(spark, folder(rows)))
    assert got == variants_by_force(rows) and any(r[1] for r in got)
    assert variant_rows(queries.op12_spelling_variants(spark, folder([(1, None)]))) == [] == variant_rows(spelling.grouped(spark.createDataFrame([], DOCS)))


def test_op12_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted((w, f or "", r, n, m, -1 if k is None else k) for w, f, r, n, m, k in con.execute(f"select word, form, root, n, n_near, form_n from ({spelling.oracle()})").fetchall())
    assert variant_rows(queries.op12_spelling_variants(spark, "/root/testdata/sf0.001")) == want


def test_chains_of_forms_end_at_their_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(19)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w19"}


# Alignment


@pytest.fixture(scope="module")
def files():
    return tuple(open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries(files):
    a = Tokenizer.from_str(files[0].decode())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=files[1])


def aligned_by_force(texts, a, b):
    letters, found, n = alignment.byte_alphabet(), [], collections.Counter()
    for text in texts:
        whole = b" " + (text or "").encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        pieces_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        names = [b.id_to_piece(i) for i in ids_b]
        pieces_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in names]
        if not text or b"".join(pieces_a) != whole or b"".join(pieces_b) != whole:
            found.append((0, 0, [], []))
            continue
        groups, links, i, j, at_a, at_b, own = [], [], 0, 0, 0, 0, ([], [])
        while i < len(ids_a) or j < len(ids_b):  # whichever side is behind takes its next token
            if at_a <= at_b and i < len(ids_a):
                at_a, i = at_a + len(pieces_a[i]), i + 1
                own[0].append(ids_a[i - 1])
            else:
                at_b, j = at_b + len(pieces_b[j]), j + 1
                own[1].append(ids_b[j - 1])
            if at_a == at_b:
                groups.append("|".join(",".join(map(str, x)) for x in own))
                links.append((own[0][-1], own[1][-1]))
                own = ([], [])
        n.update(links)
        found.append((len(ids_a), len(ids_b), groups, links))
    most = {}
    for (_, y), k in n.items():
        most[y] = max(k, most.get(y, 0))
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(x, y, len(g), len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), digest(g)) for x, y, g, links in found]


def odd_texts(rng, a):
    fixed = ["▁ a", "a▁b", "<s>hello</s><unk>", "<|endoftext|> x", "\x00\x01 nul\x00", "é é ﬁ", "x" * 20_000, " " * 500, "\n\n \n\t  a  ", "中文 \U0001f600"]
    return fixed + [a.decode([rng.randrange(50256) for _ in range(8)]) for _ in range(200)] + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD000)])) for _ in range(9)) for _ in range(200)]


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op11_equals_the_libraries(spark, monkeypatch, folder, libraries):
    monkeypatch.setattr(alignment, "BLOCK", 2000)
    monkeypatch.setattr(alignment, "SLICE", 3000)
    rng = random.Random(7)
    rows = [*ODD, *enumerate(odd_texts(rng, libraries[0]), 100), *prose(rng, 60)]
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), *(r[c] for c in ALIGNED)) for r in queries.op11_token_alignment(spark, folder(rows)).collect())
    want = aligned_by_force([t for _, t in rows], *libraries)
    assert got == sorted((-1 if k is None else k, *w) for (k, _), w in zip(rows, want))


def test_pair_counts_and_empty_table(spark, files):
    docs = spark.createDataFrame([("a", "the end"), ("b", "the end"), ("c", "an end")], "name string, body string")
    counts, done = alignment.links(docs, *files, public_tokenizers.PATTERN, "name", "body")
    rows = counts.collect()
    assert sum(r["count"] for r in rows) == sum(r["n_links"] for r in done.collect()) and all(r["pair"] == (r["a_id"] << 32) + r["b_id"] for r in rows)
    assert alignment.links(docs.limit(0), *files, public_tokenizers.PATTERN, "name", "body")[1].count() == 0


# Language model


def small_codes():
    rng = np.random.default_rng(3)
    code = language_model.Code(np.array([50, 20, 9, 4, 4, 1, 12]), (1, 2, 3))
    tables = [rng.integers(-60, 60, 1 << language_model.BITS).astype(np.int8) for _ in range(3)]
    fit = language_model.Weights(rng.uniform(-0.2, 0.7, (5, language_model.GATES)).astype(np.float32), rng.uniform(0.05, 0.95, (language_model.GATES, language_model.CELLS)).astype(np.float32))
    return code, tables, fit


def scored_by_force(code, tables, fit, s):
    own, sums, total, seen = [0.0] * 5, [1e-4] * 5, 0.0, [code.end] * 5 + list(s)
    for at in range(0, len(s), language_model.STEP):
        slopes, bits = [0.0] * 5, 0
        for k in range(at, min(at + language_model.STEP, len(s))):
            _, alone, places, bit, _ = code.bits(np.array(seen[k : k + 5], np.uint32), np.array([s[k]], np.uint32))
            for depth in range(len(bit)):
                x = [float(alone[depth]), *(t[p[depth]] / 16 for t, p in zip(tables, places)), 1.0]
                gate = min(depth, language_model.GATES - 1)
                logit = min(max(sum((float(fit.weights[i][gate]) + own[i]) * x[i] for i in range(5)), -language_model.LIMIT), language_model.LIMIT)
                chance = 1 / (1 + math.exp(-logit))
                final = (chance + float(fit.cells[gate][min(int(logit + language_model.LIMIT), language_model.CELLS - 1)])) / 2
                total += math.log10(final if bit[depth] else 1 - final)
                bits += 1
                for i in range(5):
                    slopes[i] += (bit[depth] - chance) * x[i]
        for i in range(5):
            sums[i] += (slopes[i] / bits) ** 2
            own[i] += language_model.OWN_RATE * slopes[i] / bits / math.sqrt(sums[i])
    return total


def test_scores_equal_a_loop_over_bits():
    code, tables, fit = small_codes()
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(0, 6, n), code.end).astype(np.uint32) for n in (0, 1, 63, 64, 200, 5)]
    got = language_model.scored(code, tables, fit, texts)
    assert np.allclose(got, [scored_by_force(code, tables, fit, t.tolist()) for t in texts], rtol=1e-4)
    alone = [float(language_model.scored(code, tables, fit, [t])[0]) for t in texts]
    assert np.array_equal(got, alone)  # other texts of the batch don't matter


def test_next_symbols_share_one():
    code, tables, fit = small_codes()
    before = np.array([0, 3, 1, 2] * 40, np.uint32)
    all_next = [np.append(before, x).astype(np.uint32) for x in range(7)]
    ratio = language_model.scored(code, tables, fit, all_next) - language_model.scored(code, tables, fit, [before])
    assert abs(np.power(10, ratio).sum() - 1) < 1e-3


def test_tables_hold_every_bit():
    code = small_codes()[0]
    sequences, times = [np.array([0, 1, 6]), np.array([5, 6]), np.array([6])], [2, 1, 3]
    tables = language_model.Tables(code)
    tables.add([np.array(s, np.uint32) for s in sequences], times)
    want = sum(k * int(code.length[np.array(s)].sum()) for s, k in zip(sequences, times))
    assert [int(t.sum()) for t in tables.counts] == [want] * 3


def base_by_force(rows):
    tokens = [[*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "), "\0end"] for _, t in rows]
    tokens = [[w for w in ws if w] for ws in tokens]
    apart = [k is not None and zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows]
    c = collections.Counter(w for ws, x in zip(tokens, apart) if not x for w in ws)
    n, v = sum(c.values()), len(c)
    return [(k, x, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (k, _), ws, x in zip(rows, tokens, apart)]


def test_op13_counts_and_scores(spark, monkeypatch, folder):
    monkeypatch.setattr(language_model, "BLOCK", 700)
    rng = random.Random(8)
    phrases = [" ".join(rng.choice(["north", "wind", "and", "sun", "cloak", "traveller"]) for _ in range(6)) for _ in range(8)]
    rows = [*prose(rng, 60), *((100 + k, " ".join(rng.choice(phrases) for _ in range(6))) for k in range(300)), *ODD]
    got = queries.op13_lm_score(spark, folder(rows)).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(base_by_force(rows), key=key)
    assert len(got) == len(want) and all(g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want))
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)
    long_enough = [g for g in got if g[1] and g[2] > 20]
    assert long_enough and sum(g[6] for g in long_enough) > 0.9 * sum(g[5] for g in long_enough)  # held out, and yet likelier: words follow from the words before
    same = collections.defaultdict(set)
    for g in got:
        same[g[0], g[2], round(g[5], 9)].add(g[6])
    assert all(len(x) == 1 for x in same.values()) and len(same) < len(got)  # repeated rows score alike


def test_op13_weights_come_from_all_training_texts(spark, monkeypatch, folder):
    made, sums = [], []
    codes_of, learned = language_model.codes_of, language_model.learned
    monkeypatch.setattr(language_model, "codes_of", lambda *a: made.append(codes_of(*a)) or made[-1])
    monkeypatch.setattr(language_model, "learned", lambda parts: sums.append(parts) or learned(parts))
    rng = random.Random(6)
    rows = [(k, f"north wind {rng.choice('abc')} word{k}") for k in range(1500)]  # word{k}: spelled
    queries.op13_lm_score(spark, folder(rows)).collect()
    pair, seen = language_model.Pair(made[0]), (language_model.ORDERS + 2) * language_model.GATES
    bits = [sum(x for k, x in parts.items() if seen <= k < seen + language_model.GATES) for parts in sums]
    training = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 10]
    assert len(training) > 1300 and bits[1] == int((made[0].word_counts * pair.words.length)[made[0].word_counts > 0].sum())
    assert bits[0] == sum(int(pair.bytes.length[pair.spelled(f"word{k}".encode())].sum()) for k in training)


def test_op13_without_anything_to_learn_from(spark, folder):
    held = next(k for k in range(1, 100) if zlib.crc32(str(k).encode()) % 10 == 0)
    r = queries.op13_lm_score(spark, folder([(held, "some words here")])).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 4, 0, 0, 0.0) and math.isfinite(r["score"])
    assert language_model.score(spark.createDataFrame([], DOCS)).count() == 0


def test_one_look_up_takes_own_bits_out():
    rng = np.random.default_rng(7)
    logits, levels = rng.integers(-127, 128, 500).astype(np.int8), rng.integers(8, 200, 500).astype(np.uint8)
    table = language_model.Learner(small_codes()[0], [(logits, levels)]).tables[0]
    bit, times = rng.integers(0, 2, 500).astype(np.float32), rng.integers(1, 4, 500).astype(np.uint32)
    side = bit.astype(np.int64) << 16
    for many in (None, times):
        got = language_model.without_own(table, side, bit, many, None if many is None else np.flatnonzero(many > 1))
        want = language_model.less(logits.astype(np.float32), levels.astype(np.float32), bit, 1 if many is None else many)
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_near_nodes_share_eight_places():
    code = small_codes()[0]
    symbol = np.array([int(code.length.argmax())], np.uint32)
    _, _, places, bit, _ = code.bits(code.start(), symbol)
    near = language_model.NEAR
    assert len(bit) == code.length[symbol[0]] > near
    for p in places:
        assert len({int(x) >> 3 for x in p[:near]}) == 1 and len({int(x) for x in p[:near]}) == near
        assert p[near] >> 3 != p[0] >> 3


def test_learning_sees_every_bit_once(monkeypatch):
    monkeypatch.setattr(language_model, "SYMBOLS", 50)
    monkeypatch.setattr(language_model, "CHUNK", 40)  # several turns for each lot of symbols
    code, rng = small_codes()[0], np.random.default_rng(9)
    learner = language_model.Learner(code, [(rng.integers(-60, 60, 1 << language_model.BITS).astype(np.int8), np.full(1 << language_model.BITS, 40, np.uint8)) for _ in range(3)])
    sequences = [np.append(rng.integers(0, 6, n), code.end).astype(np.uint32) for n in (0, 1, 49, 130)]
    learner.add(sequences, [1, 2, 1, 3])
    gates = [code.bits(code.start(), np.array([k], np.uint32))[4] for k in range(7)]
    bits = [code.bits(code.start(), np.array([k], np.uint32))[3] for k in range(7)]
    flat = np.concatenate(sequences)
    want = np.bincount(np.concatenate([gates[k] for k in flat]), minlength=language_model.GATES)
    assert np.array_equal((learner.ones + learner.zeros).reshape(language_model.GATES, -1).sum(axis=1), want)
    assert learner.ones.sum() == sum(bits[k].sum() for k in flat)


def test_words_of_many_texts_at_once():
    texts = ["Two  words\x0b", None, "", " \t", "\x00AÄ b\x1cc ", "x"]
    data, lengths, many = language_model.tokens(texts)
    ends = np.cumsum(lengths)
    got = [data.tobytes()[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
    want = [[*(re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode())), b""] for t in texts]
    assert got == [w for ws in want for w in ws] and many.tolist() == [len(ws) for ws in want]
