"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import alignment, bpe, fingerprints, language_model, mixing, secret_scan, simhash, spelling, suffix_dedup, token_counts, topk, toxicity, urls
from candela.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and the text they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.read_ranks(RANKS)
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    back = bpe.decode(ids, ranks, public_tokenizers.PATTERN)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate group."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 400 bytes that occur again anywhere, as counts and a digest."""
    left = suffix_dedup.remove(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how alike they and the next document's are."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


#: What op6 does to every text, one after the other: a new heading, other words in the middle, the end cut off.
def sample_edits(n: Column) -> Column:
    edit = lambda start, stop, text: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(text).alias("text"))
    return F.array(edit(F.lit(0), F.lit(0), "Revised: "), edit(n / 2, n / 2 + 24, " an edited passage,\n"), edit(n - 8, n + 40, "."))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, before and after three edits, and how many pre-tokens these made it encode again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", sample_edits(F.coalesce(F.length("text"), F.lit(0))))
    counted = token_counts.count(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN, "edits")
    return counted.select("doc_id", "n_tokens", "n_tokens_edited", "recounted")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts of the base kinds, and all spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["order"] < len(secret_scan.BASE))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.as_text(base).cast("binary"), 256).alias("base_sha256"), secret_scan.as_text(F.col("found")).alias("spans"))


#: The rules that pages are judged by.
URL_RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every vector whose id is divisible by 20."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and how many of its words the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups of byte-level BPE and sentencepiece tokens, and how common its links are in all documents."""
    a, b = (open(public_tokenizers.path(name), "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.links(table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)[1]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its spelling form and root."""
    return spelling.grouped(table(spark, sf_dir, "documents"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's unigram score and its score by the mixed models."""
    return language_model.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_fingerprint": op5_fingerprint,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_url_filter": op8_url_filter,
    "op9_top_k": op9_top_k,
    "op10_mix": op10_mix,
    "op11_token_alignment": op11_token_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lm_score": op13_lm_score,
}

ORACLES: dict[str, str] = {
    "op7_secret_scan": secret_scan.ORACLE,
    "op8_url_filter": urls.oracle(URL_RULES),
    "op9_top_k": topk.ORACLE,
    "op10_mix": mixing.ORACLE,
    "op12_spelling_variants": spelling.oracle(),
}
