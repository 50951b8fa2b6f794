import base64
import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from candela.llm import bpe, fingerprints, mixing, secret_scan, simhash, suffix_dedup, token_counts, topk, toxicity, urls
from candela.llm import near_copies as near
from candela.llm.queries import RANKS, URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RAW = bpe.read_ranks(RANKS)


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls everywhere, an empty text, repeated rows, a clashing column."""
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "one two three four five", "en", None, 23), (2, "one two three four five", "en", None, 23), (None, "one two three four five", "en", "a", 23), (3, "x" * 200_000, "en", "a", 200_000)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(7)).withColumn("size", F.lit("clash"))


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RAW, public_tokenizers.PATTERN)


def random_text(rng, encoding):
    if rng.random() < 0.3:
        return encoding.decode([rng.randrange(50256) for _ in range(6)])
    letters = rng.choice(["ab", "abcdefgh etaoin", " \n\t'srelmd", "é中\U0001f600a ", "thein gsro1!"])
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))


def test_encoding_equals_the_library(encoding, codec):
    rng = random.Random(1)
    for text in [random_text(rng, encoding) for _ in range(3000)] + ["a" * 5000, "\n" * 700, "".join(rng.choice("abcdefg") for _ in range(20000))]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text)
        assert "".join(codec.decode(ids, chunk=3)) == text


def test_encoding_beyond_the_table_of_states(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 3)
    small = bpe.Codec(RAW, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for text in [random_text(rng, encoding) for _ in range(300)]:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == encoding.encode_ordinary(text)


def test_stream_emits_before_the_end(codec):
    machine = codec.paths.transducer
    out, state = [], machine.start()
    for byte in b" international internationalization":
        sure, state = machine.step(state, byte)
        out += sure
    assert out and out + list(state.rest) != out


def test_utf8_machine_equals_the_codec():
    import codecs

    rng = random.Random(3)
    for _ in range(500):
        data = "".join(rng.choice("aé中\U0001f600") for _ in range(10)).encode()
        if rng.random() < 0.5:
            data = bytes(b ^ (rng.random() < 0.1) * rng.randrange(256) for b in data)
        machine, own, i = bpe.Utf8Machine(), "", 0
        while i < len(data):
            n = rng.randint(1, 4)
            own, i = own + machine.feed(data[i : i + n]), i + n
        assert own + machine.close() == codecs.decode(data, "utf-8", "replace")


def test_bpe_in_spark(spark, encoding):
    ids = bpe.encode(odd(spark), RAW, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RAW, public_tokenizers.PATTERN)
    got = back.select("text", "decoded", bpe.ids_array(F.col("ids")).alias("list")).collect()
    assert len(got) == 7 and all(r["decoded"] == (r["text"] or "") and r["list"] == encoding.encode_ordinary(r["text"] or "") for r in got)
    with pytest.raises(ValueError):
        bpe.encode(ids, RAW, public_tokenizers.PATTERN)
    parts = bpe.decode_chunks(ids.select("text", "ids"), RAW, public_tokenizers.PATTERN, chunk=100).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("part", "decoded"))).alias("p")).collect()
    assert all(len(set(x["part"] for x in r["p"])) >= 1 and "".join(dict(x).get("decoded") for x in [y.asDict() for y in {z["part"]: z for z in r["p"]}.values()]) == (r["text"] or "") for r in parts)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in bpe.decode_bytes(ids, RAW, public_tokenizers.PATTERN).collect())


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups_by_force(prints):
    parent = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and parent[i] != parent[j]:
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    return parent


def near_copies(rng, n=120):
    words = [f"w{i}" for i in range(50)]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 120))] for _ in range(6)]
    out = []
    for _ in range(n):
        copy = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return [*out, "", " ", "UPPER Case\tOne two", "short"]


def test_masks_cover_every_pair():
    rng = random.Random(4)
    masks = simhash.family(list(range(64)))
    assert len(masks) == 31
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not m & flips for m in masks)


def test_three_families_leave_ten_bits_at_most():
    assert sorted(simhash.VECTORS) == list(range(1, 32))
    fixed = {0}
    for _ in range(3):
        fixed = {f | m for f in fixed for m in simhash.family(simhash.free(f & ((1 << 64) - 1)))}
    assert max(len(simhash.free(f & ((1 << 64) - 1))) for f in fixed) <= 10


@pytest.mark.parametrize("bucket", [256, 2])
def test_simhash_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)  # 2: the second and third family of masks
    texts = near_copies(random.Random(5))
    prints = [slow_fingerprint(t) for t in texts]
    got = {r["doc_id"]: r for r in simhash.groups(docs(spark, texts)).collect()}
    assert [got[i]["bits"] % (1 << 64) for i in range(len(texts))] == prints
    assert [got[i]["component_id"] for i in range(len(texts))] == groups_by_force(prints)


def test_simhash_of_odd_rows(spark):
    got = [(r["doc_id"], r["text"]) for r in simhash.deduplicate(odd(spark)).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, "one two three four five"), (3, "x" * 200_000)], key=str)
    assert simhash.groups(odd(spark)).count() == 7
    assert simhash.groups(docs(spark, []).limit(0)).count() == 0


def groups_by_jaccard(texts, width=5, similarity=0.8):
    sets = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and parent[i] != parent[j]:
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    return parent


@pytest.mark.parametrize("strip", [256, 3])
def test_near_duplicates_stage(spark, monkeypatch, strip):
    monkeypatch.setattr(near, "STRIP", strip)  # 3: tiles of two strips
    texts = [*near_copies(random.Random(12)), None, "one two three"]
    want = groups_by_jaccard(texts)
    assert len(set(want)) < len(set(groups_by_force([slow_fingerprint(t) for t in texts])))  # SimHash at radius 4 leaves some
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), "").collect()) == sorted(set(want))
    got = {r["doc_id"]: r["component_id"] for r in near.groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_of_odd_rows(spark):
    got = [(r["doc_id"], r["text"]) for r in near.deduplicate(odd(spark)).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, "one two three four five"), (3, "x" * 200_000)], key=str)
    assert near.groups(docs(spark, []).limit(0)).count() == 0


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(6)
    syllables = ["ta", "lo", "mi", "ner", "sub", "ka", "ro"]
    texts, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(40)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(40)] = rng.choice(["grumbolt", "snarkwad"])
        texts.append(" ".join(words))
        labels.append((i, toxic))
    table = docs(spark, texts)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, known)
    rows = toxicity.score(table, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    fold = [(r["score"] >= 0.5) == bool(labels[r["doc_id"]][1]) for r in rows if r["held_out"]]
    assert len(fold) > 40 and np.mean(fold) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(table, flipped)  # held-out labels don't matter
    assert np.allclose(again.weights, model.weights)


def test_toxicity_counts_ratios_and_slope_by_plain_loops():
    rng = random.Random(15)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))) for _ in range(20)]
    marks = [int(rng.random() < 0.4) for _ in texts]
    scratch = np.zeros(toxicity.SPACE, np.int64)
    rows = [(np.sort(toxicity.distinct(toxicity.grams(t), scratch)).astype("<i4"), m) for t, m in zip(texts, marks)]
    assert all(set(f.tolist()) == set(toxicity.grams(t).tolist()) and len(f) == len(set(f.tolist())) for (f, _), t in zip(rows, texts))
    seen = sorted({f for r, _ in rows for f in r.tolist()})
    n1, n0 = sum(marks), len(marks) - sum(marks)
    count = {f: [sum(f in r for r, m in rows if m == kind) for kind in (0, 1)] for f in seen}
    clean, toxic = np.zeros((2, toxicity.SPACE), np.int32)
    for f, (a, b) in count.items():
        clean[f], toxic[f] = a, b
    ratios = toxicity.log_ratios(clean, toxic, n0, n1)
    p = n1 / (n0 + n1)
    for f, (a, b) in count.items():
        assert ratios[f] == pytest.approx(np.log((b + toxicity.PRIOR * p) / n1 / ((a + toxicity.PRIOR * (1 - p)) / n0)), abs=1e-5)
    assert abs(ratios[next(i for i in range(toxicity.SPACE) if i not in count)]) < 1e-5
    weights = np.zeros(toxicity.SPACE + 1, np.float32)
    weights[seen], weights[-1] = [rng.uniform(-1, 1) for _ in seen], 0.3

    def loss(w):
        out = toxicity.RIDGE / 2 * sum(float(w[f]) ** 2 for f in seen)
        for r, m in rows:
            norm = sum(float(ratios[f]) ** 2 for f in r.tolist()) ** 0.5 or 1.0
            z = sum(float(ratios[f]) / norm * float(w[f]) for f in r.tolist()) + float(w[-1])
            out += (0.5 / n0, 0.5 / n1)[m] * np.log1p(np.exp(-z if m else z))
        return out

    got, slope = toxicity.loss_and_slope(rows, ratios, weights, (0.5 / n0, 0.5 / n1))
    assert got == pytest.approx(loss(weights), rel=1e-5)
    for f in (seen[0], seen[len(seen) // 2], -1):
        up, down = weights.astype(np.float64), weights.astype(np.float64)
        up[f], down[f] = up[f] + 1e-4, down[f] - 1e-4
        assert slope[f] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=1e-4)


def test_toxicity_of_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd(spark), empty)
    assert all(r["s"] < 1e-6 for r in toxicity.score(odd(spark), model, name="s").collect())
    with pytest.raises(ValueError):
        toxicity.score(odd(spark), model)


def removed_by_force(texts, span=400):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - span + 1):
            seen[d[i : i + span]] = seen.get(d[i : i + span], 0) + 1
    out = []
    for d in data:
        cover = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                cover[i : i + span] = True
        edges = np.diff(np.concatenate([[0], cover.astype(int)]))
        out.append((len(d), int(cover.sum()), int((edges == 1).sum()), bytes(np.frombuffer(d, np.uint8)[~cover])))
    return out


@pytest.mark.parametrize("crowd", [512, 2])
def test_repeated_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)  # 2: counts for most groups
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh éè") for _ in range(n))
    shared = [noise(n) for n in (399, 400, 401, 520, 900)]
    texts = [None, "", noise(399), "z" * 1500, "ab" * 900]
    for _ in range(14):
        parts = [noise(rng.randint(0, 500))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            i = rng.choice([0, 0, rng.randrange(60)])
            parts += [p[i:], noise(rng.randint(0, 60))]
        texts.append("".join(parts))
    texts += [texts[-1], texts[-1]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove(docs(spark, texts)).collect()}
    want = removed_by_force(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(w[1] for w in want) > 2000


def test_crowded_leads_meet_in_no_task(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 8, raising=False)
    buckets, lead = suffix_dedup.sorted_buckets, suffix_dedup.LEAD

    def guarded(batches):
        batches, seen = list(batches), {}
        for batch in batches:
            for high, data in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                key = data[high : high + lead]
                seen[key] = seen.get(key, 0) + 1
        assert max(seen.values(), default=0) <= 8
        yield from buckets(iter(batches))

    monkeypatch.setattr(suffix_dedup, "sorted_buckets", guarded)
    rng = random.Random(13)
    noise = lambda n: "".join(rng.choice("abcdefgh éè") for _ in range(n))
    licence, more = noise(330), [noise(90) for _ in range(3)]
    texts = [noise(rng.randint(200, 400)) + rng.choice(["", *more]) + licence + rng.choice(["", *more]) + noise(rng.randint(200, 400)) for _ in range(60)]
    texts += [texts[0], noise(500) + texts[1][100:700] + noise(30)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove(docs(spark, texts)).collect()}
    want = removed_by_force(texts)
    assert [got[i] for i in range(len(texts))] == want and 2000 < sum(w[1] for w in want) < 40_000


def test_large_groups_are_compared_by_bytes():
    rng = random.Random(14)
    lead = bytes(rng.choice(b"xyz") for _ in range(suffix_dedup.LEAD))
    contexts = []
    for _ in range(90):
        low, high = sorted((rng.randint(0, 60), rng.randint(0, suffix_dedup.REACH)))
        left = bytes(rng.choice(b"a" * 60 + b"b") for _ in range(high))
        right = bytes(rng.choice(b"c" * 200 + b"d") for _ in range(suffix_dedup.SPAN - low - len(lead)))
        contexts.append((low, high, left + lead + right))
    group = sorted((suffix_dedup.Member(i, 1, *c) for i, c in enumerate(contexts)), key=lambda m: m.right)
    suffix_dedup.compare(group)
    window = lambda c, offset: c[2][c[1] - offset : c[1] - offset + suffix_dedup.SPAN]
    for m in group:
        own = contexts[m.key]
        for offset in range(own[0], own[1] + 1):
            again = any(i != m.key and c[0] <= offset <= c[1] and window(c, offset) == window(own, offset) for i, c in enumerate(contexts))
            assert m.flags[offset - own[0]] == again
    assert any(m.flags.any() for m in group) and not all(m.flags.all() for m in group)


def test_multikey_sort():
    rng = random.Random(8)
    for _ in range(30):
        words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 200))]
        assert [words[i] for i in suffix_dedup.multikey_sort(words)] == sorted(words)


def test_suffixes_of_odd_rows(spark):
    assert suffix_dedup.remove(odd(spark)).count() == 7
    assert suffix_dedup.remove(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("collide", [False, True])
def test_fingerprints(spark, monkeypatch, collide):
    if collide:  # every text in one bucket: bytes decide
        monkeypatch.setattr(fingerprints, "wide_hash", lambda form: F.lit("0" * 32))
    texts = ["Straße  Ünter", "STRASSE\tU\u0308NTER", "ﬁne Å", "fine \u0041\u030a", "", None, " \u3000 ", "abcd", "x"]
    rows = fingerprints.fingerprints(docs(spark, texts)).orderBy("doc_id").collect()
    canon = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    whole = [t or "" for t in texts]
    names = {}
    for i, r in enumerate(rows):
        after = whole[(i + 1) % len(whole)]
        quarter = len(whole[i]) // 4
        changed = whole[i][: len(whole[i]) - quarter] + after[:quarter]
        assert r["n_chars"] == len(whole[i]) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == (canon(whole[i]) == canon(changed)) and r["near_next"] == (canon(whole[i]) == canon(after))
        for form, name in ((canon(whole[i]), r["fingerprint"]), (canon(changed), r["edited_fingerprint"])):
            assert names.setdefault(form, name) == name
    assert len(set(names.values())) == len(names)


def test_fingerprints_of_odd_rows(spark):
    assert fingerprints.fingerprints(odd(spark)).count() == 7
    lone = fingerprints.fingerprints(docs(spark, ["abcdefgh"])).first()
    assert lone["near_next"] == 1.0 and lone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints.fingerprints(docs(spark, ["a"]).limit(0)).count() == 0
    named = fingerprints.fingerprints(docs(spark, ["abcd", "efgh"]).withColumn("doc_id", F.concat(F.lit("x-"), "doc_id"))).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["edited_sha256"]) for r in named] == [("x-0", hashlib.sha256(b"abce").hexdigest()), ("x-1", hashlib.sha256(b"efga").hexdigest())]


def test_edits_are_counted_as_if_anew(codec):
    rng = random.Random(9)
    bits = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "1", "23", "!", "...", " the", "É", "\t", " \n "]
    make = lambda n: "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))
    for _ in range(2000):
        text = make(rng.choice([3, 20, 80]))
        tree = token_counts.CountTree(text, codec)
        for _ in range(3):
            start = rng.randint(0, len(text) + 2)
            stop, new = start + rng.choice([0, 0, 1, 2, 10]), make(rng.choice([0, 1, 4, 15]))
            tree.apply(token_counts.Edit(start, stop, new))
            text = text[:start] + new + text[max(start, stop) :]
            assert tree.text() == text and tree.count == len(codec.encode(text)) // 4
    tree = token_counts.CountTree("The quick brown fox. " * 1000, codec)
    tree.apply(token_counts.Edit(9000, 9004, "XY z"))
    assert tree.encoded < 12


def test_counts_without_the_tokens():
    codec = bpe.Codec(RAW, public_tokenizers.PATTERN)
    rng = random.Random(21)
    junk = ["".join(rng.choice("abcdeh0123456789 \u00e9\u4e16") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    pieces = [p for text in [*junk, " the quick brown fox " * 9, "x" * 300] for p in codec.pieces(text)]
    assert codec.counts(pieces) == [len(codec.encode(p)) // 4 for p in pieces]
    states = len(codec.paths.transducer.states)
    assert codec.count("zq9#vk2") == len(codec.merges.merged(b"zq9#vk2")) and len(codec.paths.transducer.states) == states  # no state for what is only counted


def test_token_counts_in_spark(spark, encoding):
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("stop"), F.lit("Zz ").alias("text")))
    got = token_counts.count(odd(spark).withColumn("edits", edits), RAW, public_tokenizers.PATTERN, "edits").collect()
    for r in got:
        text = r["text"] or ""
        assert r["n_tokens"] == len(encoding.encode_ordinary(text)) and r["n_tokens_edited"] == len(encoding.encode_ordinary("Zz " + text[2:]))


def test_trigram_queries():
    of = secret_scan.trigram_query
    assert of("[0-9a-f]{24,}") == secret_scan.ALWAYS and of("ab?") == secret_scan.ALWAYS
    assert of("AKIA[A-Z0-9]+") == frozenset([frozenset(["aki", "kia"])])
    assert of("(?:cat|dogs)x*") == frozenset([frozenset(["cat"]), frozenset(["dog", "ogs"])])


def test_postings_equal_containment(spark):
    trigrams = ["aa-", "a-a", "-a.", "key", "eye", "\u00e9]x", "^\\[", "\U0001f511ab"]
    texts = ["aa-a-a.", "KEYEye", "\u00e9]X ^\\[", "\U0001f511\U0001f511AB", "ke y\nk\ney", None, "", "k" * 50_000 + "ey"]
    got = {(r["id"], r["trigram"]) for r in secret_scan.postings(docs(spark, texts), trigrams, "doc_id", "text").collect()}
    assert got == {(i, t) for i, text in enumerate(texts) for t in trigrams if t in (text or "").lower()}


def test_secrets(spark):
    import re

    texts = ["token=abc secret=abcdefgh", "token=token:abcdef", "é PASSWORD\" : 'hunter2hunter2' AKIA" + "X" * 16, "0123456789abcdef01234567 and api_key=0123456789abcdef01234567", None, "", "AKIAX AKIA" + "Y" * 20, "ghp_" + "a1" * 20, "plain"]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs(spark, texts)).select("doc_id", secret_scan.as_text(F.col("found")).alias("spans")).collect()}
    for i, text in enumerate(texts):
        want = []
        for order, rule in enumerate(secret_scan.BASE + secret_scan.FURTHER):
            want += [(m.start(), order, rule.kind, m.end()) for m in re.finditer(rule.regex, text or "") if len(m.group(rule.group)) >= rule.least]
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(want))
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(spark, texts)).collect()}
    assert clean[0] == "token=abc [SECRET]" and clean[3] == "[SECRET] and [SECRET]" and clean[4] is None and clean[8] == "plain"
    assert secret_scan.scan(odd(spark)).count() == 7 and secret_scan.redact(odd(spark)).columns == odd(spark).columns


def test_whole_keys_and_signatures_are_masked(spark):
    body = "\n".join(["MIIEvQ+/aZ09" * 5] * 400)
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,00FF\r\n\r\n"
    texts = [f"a {begin}\n{body}\n{end} b", f"a {begin}\r\n{head}{body}=\r\n{end} b", f"a {begin} then prose. {end} b", f"{begin}{begin}\nAB\n{end}", "x eyJhbGciOiJI.eyJzdWIiOiIx.SflK-_w y", "x eyJhbGciOiJI.eyJzdWIiOiIx y"]
    got = [r["text"] for r in secret_scan.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["a [SECRET] b", "a [SECRET] b", f"a [SECRET] then prose. {end} b", "[SECRET][SECRET]", "x [SECRET] y", "x [SECRET] y"]
    assert secret_scan.trigram_query(secret_scan.FURTHER[2].regex) >= frozenset() and "beg" in set().union(*secret_scan.trigram_query(secret_scan.FURTHER[2].regex))


def test_urls(spark):
    pages = [(1, "HTTP://A.Example.NET/en/x?q"), (2, "http://b.net"), (3, "http://b.net/"), (4, None), (5, "nothing"), (6, "https://www.example.com/de/1#x"), (6, "https://www.example.com/de/1#x"), (7, "http://x.org/fr"), (8, "http://x.org/fr/1"), (9, "http://spam-farm.example.org/en/1"), (10, "http://notnet/"), (11, "a://b://c/d"), (12, "http://a\n.b.net/x")]
    rows = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = sorted(tuple(r) for r in urls.judge(rows, URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "b.net", "", None, "allow"), (3, "b.net", "/", "net/", "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "www.example.com", "/de/1", "example.com/de/", "block"), (6, "www.example.com", "/de/1", "example.com/de/", "block"), (7, "x.org", "/fr", None, "allow"), (8, "x.org", "/fr/1", "org/fr/", "allow"),
        (9, "spam-farm.example.org", "/en/1", None, "block"), (10, "notnet", "/", None, "allow"), (11, "b:", "//c/d", None, "allow"),
        (12, "a\n.b.net", "/x", "net/", "block"),
    ]
    assert urls.judge(rows.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize("block", [32_768, 16])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)] + [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (220, [1.0, 2.0]), (240, [0.5, 0.5]), (0, [3.0, 3.0, 3.0, 3.0])]
    got = {}
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = [(i, np.floor(64 * np.array(v))) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    for i, q in good:
        if i % 20 == 0 and i:
            others = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:5]
            assert got[i] == [(j, -s) for s, j in others]
    assert len(got[0]) == 10  # two vectors with the id 0


def test_large_products_are_exact():
    q, m = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**20 + 1, 0.0]])
    assert topk.product(q, m).tolist() == [[2**60 + 3, 2**60 + 2**40]]


def test_any_finite_component_has_a_result(spark):
    big = [[1e18, -3.0], [1e307, 1.0], [-1e200, 5.0], [2.0**40, 3.0], [0.5, 2.0**50]]
    rows = spark.createDataFrame([(20 * i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.search(rows, F.col("vec_id") % 20 == 0).collect()}
    whole = {20 * i: [int(np.floor(64 * x)) for x in v] for i, v in enumerate(big) if np.isfinite(64 * np.array(v)).all()}
    want = {(a, b): max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[a], whole[b])))) for a in whole for b in whole if a != b}
    assert got == want and len(whole) == 4
    assert topk.search(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    twice = rows.unionByName(rows)
    assert topk.search(twice, F.col("vec_id") == 60).filter("vec_id = 60").count() == 1  # a repeated row is a candidate once


def test_mix(spark):
    rng = random.Random(10)
    sources = [rng.choice(["a", "b", "c", "d"]) for _ in range(3000)]
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in sources]
    table = docs(spark, texts, sources).union(docs(spark, ["p q r"] * 200, [None] * 200).withColumn("doc_id", F.col("doc_id") + 5000))
    rows = mixing.mix(table).collect()
    assert len(rows) == 3200
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        s[0], s[1] = s[0] + r["taken"], s[1] + r["size"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    total, weight = sum(s[1] for s in by.values()), {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    assert by[None][3] == 3 * by[None][2]  # capped
    share = (total - by[None][3]) / (sum(weight.values()) - 2)
    for name, (taken, size, source_size, target) in by.items():
        assert size == source_size and abs(taken - target) <= 60
        assert name is None or target == pytest.approx(min(3 * size, weight[name] * share))
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(table.repartition(3)).collect()), key=str)


def test_mix_of_odd_rows(spark):
    assert mixing.mix(odd(spark).drop("score")).count() == 7
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    assert mixing.resampled(odd(spark)).columns == odd(spark).columns


def test_near_copies_have_candidates_by_simhash(spark):
    texts = [*near_copies(random.Random(17)), None, "one two three"]
    prints = {near.set_key(s): simhash.majority(s) for s in map(near.shingle_set, texts)}
    marked = near.with_keys(docs(spark, texts), near.WIDTH, "doc_id", "text").drop("doc_id").dropDuplicates(["bits"])
    got = {k: k for k in prints} | {r["a"]: r["b"] for r in near.simhash_candidates(marked).collect()}
    want = {k: k for k in prints}
    for x in prints:
        for y in prints:
            if (prints[x] ^ prints[y]).bit_count() <= simhash.RADIUS and want[x] != want[y]:
                low, high = sorted((want[x], want[y]))
                want = {k: low if r == high else r for k, r in want.items()}
    assert got == want and len(set(want.values())) < len(want)


def test_a_bucket_of_unlike_texts_gives_no_pairs():
    rng = random.Random(18)
    common = [f"c{k}" for k in range(60)]
    sets = [near.shingle_set(" ".join(common + [f"w{rng.random()}" for _ in range(40)])) for _ in range(60)]
    sets.append(near.shingle_set(" ".join(common + [f"x{k}" for k in range(8)])))
    sets.append(near.shingle_set(" ".join(common + [f"y{k}" for k in range(2)])))
    members = [{"bits": near.set_key(s), "root": k, "n": len(s), "strip": 0, "odd": near.parities(s)} for k, s in enumerate(sets)]
    kind = pa.list_(pa.struct([("bits", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("strip", pa.int32()), ("odd", pa.binary())]))
    out = list(near.pairs_across(0.8)([pa.RecordBatch.from_arrays([pa.array([members], kind)], names=["members"])]))
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    want = {frozenset((near.set_key(a), near.set_key(b))) for k, a in enumerate(sets) for b in sets[:k] if alike(a, b)}
    assert {frozenset((x["a"], x["b"])) for batch in out for x in batch.to_pylist()} == want and len(want) == 1


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    texts = near_copies(rng, 150) + [f"unique {rng.random()} text number {i} with token = \"{rng.getrandbits(160):040x}\" inside it" for i in range(30)] + ["a vile grumbolt speaks here"] * 40 + [None, ""]
    table = docs(spark, texts, [f"s{i % 5}" for i in range(len(texts))])
    table.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("grumbolt" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    done = {}
    rows = table
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path)).cache()
        done[name] = rows
    kept = {r["doc_id"] for r in done["toxicity"].collect()}
    assert not any("grumbolt" in (texts[i] or "") for i in kept) and len(kept) > 170
    order = sorted(kept)
    parents = groups_by_jaccard([texts[i] for i in order])
    assert sorted(r["doc_id"] for r in done["simhash_near_dedup"].collect()) == sorted({order[p] for p in parents})
    assert not done["secret_scan"].filter("text rlike '[0-9a-f]{40}'").count()
    assert done["source_mix"].columns == table.columns
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.columns == [*table.columns, "ids", "n_tokens"] and last.count() == done["byte_bpe"].count() > 0


def test_the_fit_holds_its_features_once(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0], pa.int32()), pa.array([3, 2], pa.int32()), pa.array([toxicity.packed(np.array(x)) for x in ([1, 5, 9], [4, 70_000])], pa.binary())], names=["toxic", "n", "features"])
    data = batch.column(2).buffers()[2]
    found = list(toxicity.in_order([batch]))
    assert [(toxicity.unpacked(x, n).tolist(), toxic) for x, n, toxic in found] == [([1, 5, 9], 1), ([4, 70_000], 0)]
    assert all(data.address <= x.address < data.address + data.size for x, _, _ in found)  # no copies


def test_long_rows_go_in_short_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, written = spark.conf.get(key), toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df: seen.append(int(spark.conf.get(key))) or written(df))
    toxicity.fit(docs(spark, ["some text", "other text"]), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    assert seen and max(seen) <= 256 and spark.conf.get(key) == before
    try:
        corpus_pipeline.encode(spark, docs(spark, ["some text"]), "")
        assert int(spark.conf.get(key)) <= 1000  # its table isn't computed yet
    finally:
        spark.conf.set(key, before)
