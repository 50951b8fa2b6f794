"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, passed through up
to ``repeats`` times. An entry's virtual finish time is the source's words up to
it, divided by the source's target; a document counts as finished when half of
it is served, so that a source ends within half a document of its target. All
entries are sorted by that time over range partitions and cut where their words
reach the budget, the size of the whole corpus; so at any time sources are
served in proportion to their targets.

Cumulative sums never gather a source: words are summed by (source, slice of
the shuffled order), the short list of slice sums is accumulated, and only
within a slice, of a few hundred rows, are rows accumulated one by one. The
global order is treated the same way: by range partition, then within the one
partition that holds the cut.

Defined results: null or empty text has size 0 and is never taken; a null source
is a source, last in order; rows that agree in id, source and size count as one
entry, taken or left together, and each comes back; a table without words takes
nothing; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import fresh, n_words, written

#: Rows in a slice of the shuffled order, on average over all sources.
SLICE_ROWS = 256
SALT = "mix"


def source_targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """Adds target to (source, source_size, weight): shares of the whole by weight, none above cap times its size.

    Sources are filled in the order in which they reach their cap; the level
    of the first that doesn't reach it holds for it and all after it.
    """
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = (
        sources.withColumn("ceiling", F.lit(cap) * F.col("source_size"))
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full")).cast("double") / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("ceiling") >= F.col("weight") * F.col("level"), F.struct(F.col("full").alias("full"), F.col("level").alias("level")))).over(everything)["level"])
    )
    return filled.select("source", "source_size", "weight", "budget", F.when(F.col("budget") > 0, F.least(F.col("ceiling").cast("double"), F.col("weight") * F.col("level"))).otherwise(0.0).alias("target"))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds weight: 1, 2, ... cycle, repeating, by source in code point order, null last (one row for each source)."""
    return sources.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weigh=cyclic_weights, repeats: int = 3) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    ticket = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{SALT}"))), 1, 8), 16, 10).cast("long")
    entries = written(own.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("ticket", ticket))
    slices = min(1 << 24, max(1, entries.count() // SLICE_ROWS))
    entries = entries.withColumn("slice", F.floor(F.col("ticket") * F.lit(slices) / F.lit(float(1 << 32))).cast("int")).withColumn("words", F.col("size") * F.col("copies"))

    by_slice = entries.groupBy("source", "slice").agg(F.sum("words").alias("slice_words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("before", F.coalesce(F.sum("slice_words").over(before), F.lit(0)))
    targets = source_targets(weigh(entries.groupBy("source").agg(F.sum("words").alias("source_size"))), repeats)
    by_slice = by_slice.withColumnRenamed("source", "its_source").join(targets, F.col("source").eqNullSafe(F.col("its_source"))).drop("source").withColumnRenamed("slice", "its_slice")

    within = Window.partitionBy("source", "slice").orderBy("ticket", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = (
        entries.withColumn("done", F.sum("words").over(within))
        .join(by_slice, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("slice") == F.col("its_slice")))
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("finish", F.when(F.col("target") > 0, ((F.col("round") * F.col("source_size") + F.col("before") + F.col("done")).cast("double") - F.col("words") / 2.0) / F.col("target")).otherwise(0.0))
        .select("doc_id", "source", "size", "copies", "words", "ticket", "round", "finish", "source_size", "target", "budget")
    )
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("ticket"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("round")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = written(queue.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))

    sums = line.groupBy("part").agg(F.sum("words").alias("part_words"))
    sums = sums.withColumn("ahead", F.coalesce(F.sum("part_words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    line = line.join(F.broadcast(sums), "part")  # a row for each range partition
    whole = line.filter((F.col("ahead") + F.col("part_words") <= F.col("budget")) | (F.col("ahead") >= F.col("budget")))
    whole = whole.withColumn("in_mix", F.col("ahead") < F.col("budget"))
    cut = line.filter((F.col("ahead") + F.col("part_words") > F.col("budget")) & (F.col("ahead") < F.col("budget")))
    reached = F.col("ahead") + F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("in_mix", reached <= F.col("budget"))
    return (
        whole.unionByName(cut)
        .groupBy("doc_id", "source", "size", "copies", "source_size", "target")
        .agg(F.sum(F.when(F.col("in_mix"), F.col("size")).otherwise(0)).alias("taken"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def resampled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as mixed: each row as often as the mix takes it, those that it doesn't take left out."""
    id_, source_, size, times = (fresh(docs, x) for x in ("its_id", "its_source", "its_size", "times"))
    taken = mix(docs, doc_id, text, source).filter("taken > 0").groupBy("doc_id", "source", "size").agg((F.max("taken") / F.col("size")).cast("int").alias(times))
    taken = taken.withColumnsRenamed({"doc_id": id_, "source": source_, "size": size})
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & F.col(source).eqNullSafe(F.col(source_)) & (n_words(F.col(text)) == F.col(size))
    mixed = docs.join(taken, same).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return mixed.select(*docs.columns)


ORACLE = f"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':{SALT}'), 1, 8))::bigint as ticket
  from documents),
rows_ as (select doc_id, source, size, ticket, count(*) as copies from docs group by doc_id, source, size, ticket),
entries as (select *, (size * copies)::bigint as words from rows_),
totals as (select source, sum(words)::bigint as source_size from entries group by source),
sources as (select source, source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight from totals),
levels as (
  select *, 3 * source_size as ceiling, (sum(source_size) over ())::bigint as budget,
         coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as full_,
         (sum(weight) over (order by 3 * source_size / weight, source nulls last rows between current row and unbounded following))::bigint as open_
  from sources),
level as (
  select arg_min((budget - full_)::double / open_, full_) as level from levels where ceiling >= weight * ((budget - full_)::double / open_)),
targets as (
  select source, source_size, budget, case when budget > 0 then least(ceiling::double, weight * level) else 0.0 end as target from levels, level),
queue as (
  select e.*, t.source_size, t.target, t.budget, r.round,
         case when target > 0 then ((r.round * source_size + (sum(words) over (partition by e.source, r.round order by ticket, doc_id nulls first, size rows unbounded preceding))::bigint)::double - words / 2.0) / target else 0.0 end as finish
  from entries e join targets t on e.source is not distinct from t.source, (select unnest([0, 1, 2]) as round) r),
line as (
  select *, sum(words) over (order by finish, source nulls last, ticket, doc_id nulls first, size, round rows unbounded preceding) as reached from queue),
taken as (
  select doc_id, source, size, copies, source_size, target, sum(case when reached <= budget then size else 0 end)::bigint as taken
  from line group by doc_id, source, size, copies, source_size, target)
select doc_id, size, source_size, target, taken from taken, range(copies)
"""
