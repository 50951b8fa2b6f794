"""A pipeline over documents: toxic documents go, near-duplicates go, secrets are masked, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame, which run() writes as Parquet and reads again. All stages but the
last return the columns of docs.

Defined results: null and empty texts are scored like any other and stay if
they aren't near-duplicates of an earlier document; they have no words, so the
mix leaves them out; a document that the mix takes twice has two rows.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import bpe, mixing, near_copies, secret_scan, toxicity
from candela.llm.common import BATCH_ROWS, fresh, shared_dir, short_batches, table
from candela.llm.queries import RANKS
from candela.storage import removed, stored_within

#: A document whose toxicity score reaches this is rejected.
TOXIC = 0.5
#: Documents of which so much of the distinct shingles of NEAR_WIDTH words is the same (Jaccard) are near-duplicates.
NEAR_WIDTH, NEAR = 5, 0.8
#: Rows that Spark passes to a Python worker at once: with its default of 10,000, texts of some KB take up to a hundred MB on both sides of each task.
ROWS = 1_000


def in_short_batches(stage: Callable) -> Callable:
    """Sets the session's batches, as a stage's table is computed only when its caller writes it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_ROWS, ROWS)
        return stage(spark, docs, sf_dir)

    return run


@in_short_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "toxicity")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), name=name)
    return scored.filter(F.col(name) < TOXIC).drop(name)


@in_short_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs, NEAR_WIDTH, NEAR)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resampled(docs)


@in_short_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.encode(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    return ids.withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: A trained classifier and SimHash can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; a stage's folder goes once the next one is written, and so do the tables that it stored."""
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with stored_within(spark), short_batches(spark, ROWS):  # afterwards the session's batches are as before
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before is not None:
            removed(spark, f"{base}/{before}")
        docs, before = spark.read.parquet(f"{base}/{name}"), name
    return docs
