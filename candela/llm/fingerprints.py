"""Exact document fingerprints, in DataFrame functions only.

A text's canonical form is its compatibility composition (NFKC), full case
folding, composition again, and white space runs folded to single spaces, ends
trimmed. Two xxhash64 digests with different prefixes, 128 bits together, put it
in a bucket. Inside buckets with more than one row the canonical bytes are
compared: where the least and the greatest differ, every distinct form gets its
own number, which ends the fingerprint. So fingerprints are equal exactly if
canonical forms are.

Only rows of buckets with several rows move their texts for this comparison.

Defined results: null text counts as empty; the last document by id is followed
by the first, a lone one by itself; null ids come last; rows with the same id
share one place, and the one before them is continued by the least of their
texts; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import small, written

#: Code points that fold to a space.
SPACES = "[\\s\\x1C-\\x1F\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def _normalised(text: Column) -> Column:
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return compose(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True)))


def canonical(text: Column) -> Column:
    folded = F.when(text.rlike("^\\p{ASCII}*$"), F.lower(text)).otherwise(_normalised(text))
    return F.trim(F.regexp_replace(folded, SPACES, " "))


def wide_hash(form: Column) -> Column:
    """128 bits of a canonical form, as hexadecimal digits."""
    digits = lambda prefix: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(prefix), form))), 16, "0")
    return F.concat(digits("first"), digits("second"))


def with_hash(texts: DataFrame) -> DataFrame:
    """Adds hash to (..., text) and turns text into its canonical form."""
    return texts.withColumn("text", canonical(F.coalesce("text", F.lit("")))).withColumn("hash", wide_hash(F.col("text")))


def compared(members: DataFrame) -> DataFrame:
    """(key columns, hash, text) of shared buckets -> hash, form, number for buckets whose texts differ (none, as good as always)."""
    mixed = members.groupBy("hash").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter(F.col("least") != F.col("most")).select("hash")
    forms = members.join(small(written(mixed), 64), "hash", "left_semi").groupBy("hash", "text").agg(F.count("*").alias("rows"))
    return forms.withColumn("number", F.dense_rank().over(Window.partitionBy("hash").orderBy("text"))).select("hash", "text", "number")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, text): key is never null and orders null ids last."""
    key = F.struct(F.col(doc_id).isNull().alias("absent"), F.col(doc_id).alias("id"))
    return docs.select(key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def successors(keys: DataFrame) -> DataFrame:
    """(key, quarter) -> each key once with its next key; the last one's is the first.

    Keys are dealt by range; within a part the next key is one row away, and
    the first keys of the parts, one row for each, link the parts.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(keys.groupBy("key").agg(F.max("quarter").alias("quarter")).repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    firsts = dealt.groupBy("part").agg(F.min("key").alias("first"))
    everything = Window.orderBy("part")
    firsts = firsts.withColumn("after", F.coalesce(F.lead("first").over(everything), F.first("first").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    within = Window.partitionBy("part").orderBy("key")
    return dealt.withColumn("near", F.lead("key").over(within)).join(F.broadcast(firsts.select("part", "after")), "part").select("key", "quarter", F.coalesce("near", "after").alias("next"))


def edited(rows: DataFrame, follow: DataFrame) -> DataFrame:
    """rows (key, text) with edited: the last quarter of the text gives way to the start of the next key's text.

    Texts are dealt by key once: both joins read the same exchange, so both
    sides take the same columns and filter only after it.
    """
    earlier = F.lag(F.lit(1)).over(Window.partitionBy("key").orderBy("text"))
    starts = (
        rows.withColumn("earlier", earlier)
        .filter("earlier is null")
        .join(follow.select(F.col("next").alias("key"), F.col("key").alias("before"), "quarter"), "key")
        .select(F.col("before").alias("key"), F.substring("text", F.lit(1), F.col("quarter")).alias("start"))
    )
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    return rows.join(starts, "key").withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("start", F.lit(1), quarter)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = keyed(docs, doc_id, text)
    follow = written(successors(rows.select("key", F.floor(F.length("text") / 4).cast("int").alias("quarter"))))
    both = edited(rows, follow).withColumn("form", canonical(F.col("text"))).withColumn("edited_form", canonical(F.col("edited")))
    hashed = written(
        both.select(
            "key", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            wide_hash(F.col("form")).alias("hash"), wide_hash(F.col("edited_form")).alias("edited_hash"),
        )
    )
    each = hashed.select(F.explode(F.array("hash", "edited_hash")).alias("hash"))
    shared = small(written(each.groupBy("hash").agg(F.count("*").alias("rows")).filter("rows > 1").select("hash")), 64)

    own = with_hash(rows.select("text")).join(shared, "hash", "left_semi")
    needed = hashed.select("key", F.col("edited_hash").alias("hash")).join(shared, "hash", "left_semi").select("key").distinct().join(follow, "key")
    needed = written(needed)
    touched = small(written(needed.select("key").union(needed.select("next")).distinct()), 32)
    again = edited(rows.join(touched, "key", "left_semi"), needed)
    changed = with_hash(again.select(F.col("edited").alias("text"))).join(shared, "hash", "left_semi")
    numbers = written(compared(own.select("hash", "text").unionByName(changed.select("hash", "text"))))
    if numbers.isEmpty():
        named = hashed.withColumnsRenamed({"hash": "fingerprint", "edited_hash": "edited_fingerprint"})
    else:
        forms = edited(rows, follow).select("key", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"), F.length("text").cast("long").alias("n_chars"))
        forms = forms.withColumn("hash", wide_hash(F.col("form"))).withColumn("edited_hash", wide_hash(F.col("edited_form")))
        name = lambda number, hash_: F.when(F.col(number).isNull(), F.col(hash_)).otherwise(F.concat_ws("-", hash_, number))
        a = numbers.select(F.col("hash"), F.col("text").alias("form"), F.col("number").alias("n1"))
        b = numbers.select(F.col("hash").alias("edited_hash"), F.col("text").alias("edited_form"), F.col("number").alias("n2"))
        named = forms.join(a, ["hash", "form"], "left").join(b, ["edited_hash", "edited_form"], "left").select("key", "n_chars", "edited_sha256", name("n1", "hash").alias("fingerprint"), name("n2", "edited_hash").alias("edited_fingerprint"))

    place = Window.partitionBy("key").orderBy("fingerprint")
    heads = named.withColumn("place", F.row_number().over(place)).filter("place = 1").select(F.col("key").alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    following = follow.select("key", "next").join(heads, "next").select("key", "next_fingerprint")
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")  # noqa: E731  an exact digest knows only equal and unequal
    return named.join(following, "key").select(
        F.when(~F.col("key.absent"), F.col("key.id")).cast(dict(docs.dtypes)[doc_id]).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next")
    )
