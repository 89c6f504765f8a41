"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue whose documents stand in a hash-shuffled order; it may be gone through up to `max_repeats` times.
The virtual finish time of a document (of one pass) is the number of words its source has sent up to and including it,
divided by the source's target. All documents of all passes, sorted by finish time (then source and place in the queue)
and cut where the total budget is used up, are the mix.

The order is cut without sorting all of it. What finishes by time 1 is in: by then no source has sent more than its
target, and the targets are the budget. What finishes later is summed by slices of finish time, so that one slice is found in
which the budget runs out, and only that slice (a few of TIME_SLICES) is sorted; the last document of it that fits is the
cut, and everything up to the cut is taken. Running sums per source are taken in two levels: documents fall into buckets
by the leading digits of their shuffle hash; a window over the bucket totals of a source (at most 16**digits rows) gives
each bucket's start, a window inside the bucket gives the rest. So a source that holds a third of all rows, or rows
without doc_id, are still spread over thousands of groups.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in order;
rows with equal doc_id are separate rows; an empty table gives an empty result; columns of the input other than doc_id,
text and source pass through `mix` untouched and don't reach `mix_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearbox.llm.common import fresh, words
from nearbox.session import written

DEC = "decimal(38,0)"
#: Slices of a unit of virtual time; what finishes after LAST_TIME is one slice.
TIME_SLICES, LAST_TIME = 4096, 5


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """src, source_size, target, for (src, source_size) with one row per source.

    The weights go round over the sources in order. No target exceeds max_repeats times its source; what is above is
    shared again by weight (water filling: in order of cap per weight, the saturated sources are a prefix).
    """
    # One row per source: these windows see the list of sources, never documents.
    everything = Window.partitionBy()
    ordered = Window.orderBy("src")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy(F.col("cap").cast("double") / F.col("w"), "src")
    return (
        sizes.withColumn("w", w)
        .withColumn("cap", (F.col("source_size") * max_repeats).cast(DEC))
        .withColumn("budget", F.sum("source_size").over(everything).cast(DEC))
        .withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(DEC))
        .withColumn("w_rest", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)).cast(DEC))
        .withColumn("full", F.col("cap").cast("double") * F.col("w_rest").cast("double") <= F.col("w") * (F.col("budget") - F.col("before")).cast("double"))
        .withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything))
        .select("src", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("left").cast("double") / F.col("w_open")).alias("target"))
    )


def queued(docs: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: str, bucket_digits: int) -> DataFrame:
    """doc_id, src, size, source_size, target, start (words its source sends before it in a pass), row for each row of docs.

    src is a null source's '1' or '0' before the name, so nulls are last; row tells rows apart, as far as any column does.
    """
    src = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    sized = written(docs.select("doc_id", src.alias("src"), F.size(words(F.col("text"))).cast("long").alias("size"), order.alias("h"), row_key(docs).alias("row")), "mix-sizes")
    sized = sized.withColumn("bucket", F.substring("h", 1, bucket_digits))
    buckets = sized.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = buckets.select("src", "bucket", (F.sum("bucket_size").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bucket_size")).alias("bucket_start"))
    targets = source_targets(buckets.groupBy("src").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats)
    inside = Window.partitionBy("src", "bucket").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.join(starts, ["src", "bucket"]).withColumn("start", F.col("bucket_start") + F.sum("size").over(inside) - F.col("size")).join(targets, "src")
    return written(placed.select("doc_id", "src", "size", "source_size", "target", "start", "row"), "mix-queue")


def row_key(docs: DataFrame) -> Column:
    """A hash of the whole row: rows with the same one are alike in every column. Nulls count, as the hash itself skips them."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix", bucket_digits: int = 3) -> DataFrame:
    """doc_id, row, src, size, source_size, target, start, passes, taken for each row of docs."""
    queue = queued(docs, weights, max_repeats, seed, bucket_digits)
    ends = [(F.col("start") + e * F.col("source_size") + F.col("size")) / F.col("target") for e in range(max_repeats)]
    entry = lambda e: F.struct(ends[e].alias("finish"), F.col("src"), (F.col("start") + e * F.col("source_size")).alias("pos"))
    # A row for the totals, and the entries that finish after time 1.
    sent = sum((F.when(ends[e] <= 1, F.col("size")).otherwise(0) for e in range(max_repeats)), F.lit(0))
    room = queue.filter("size > 0").agg(F.coalesce(F.sum(F.col("size").cast(DEC)), F.lit(0)).alias("budget"), F.coalesce(F.sum(sent.cast(DEC)), F.lit(0)).alias("sent")).select((F.col("budget") - F.col("sent")).alias("room"))
    late = queue.filter("size > 0").select("size", F.explode(F.filter(F.array(*map(entry, range(max_repeats))), lambda x: x.finish > 1)).alias("entry"))
    late = late.withColumn("slice", F.least(F.floor((F.col("entry.finish") - 1) * TIME_SLICES), F.lit((LAST_TIME - 1) * TIME_SLICES)).cast("int"))
    slices = late.groupBy("slice").agg(F.sum(F.col("size").cast(DEC)).alias("words"))
    # One row per slice of time, of which the number is fixed.
    upto = F.sum("words").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    full = slices.withColumn("upto", upto).crossJoin(F.broadcast(room)).filter("upto > room").agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"), "room")).alias("x")).select("x.*")
    inside = late.join(F.broadcast(full), "slice")
    running = F.sum(F.col("size").cast(DEC)).over(Window.partitionBy("slice").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0))
    fits = inside.withColumn("used", F.col("before") + running).filter("used <= room").agg(F.max("entry").alias("last"))
    # One row: the slice in which the budget runs out (null: never), and the last entry of it that is in (null: none).
    cut = F.broadcast(full.agg(F.max("slice").alias("cut_slice")).crossJoin(fits))
    early = lambda e: F.floor((ends[e] - 1) * TIME_SLICES) < F.col("cut_slice")
    passes = sum(((ends[e] <= 1) | F.col("cut_slice").isNull() | early(e) | F.coalesce(entry(e) <= F.col("last"), F.lit(False))).cast("int") for e in range(max_repeats))
    planned = queue.crossJoin(cut).withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0))
    return planned.select("doc_id", "row", "src", "size", "source_size", "target", "start", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with their pass (mix_pass) and virtual start time (mix_time).

    A row meets its plan by a hash of all its columns; rows that are alike in all of them are read once and stand for each.
    Where docs has columns of these names, the new ones have underscores more.
    """
    names = [f"`{c}`" for c in docs.columns]
    own, row, passes, start, size, target, nth, time = fresh(docs, "own", "row", "passes", "start", "source_size", "target", "mix_pass", "mix_time")
    whole = mix_plan(docs, **options)
    plan = whole.filter(F.col("passes") > 0).select(F.col("row").alias(row), F.col("passes").alias(passes), F.col("start").alias(start), F.col("source_size").alias(size), F.col("target").alias(target))
    plan = written(plan, "mix-plan")
    alike = whole.groupBy(F.col("row").alias(row)).count().filter("count > 1").select(row)
    keyed = docs.withColumn(own, row_key(docs))
    same = F.col(own) == F.col(row)
    single = keyed.join(plan.join(alike, row, "left_anti"), same)
    several = keyed.join(alike, same, "left_semi").dropDuplicates([own]).join(plan.join(alike, row, "left_semi"), same)
    out = single.unionByName(several).withColumn(nth, F.explode(F.sequence(F.lit(0), F.col(passes) - 1)))
    return out.select(*names, nth, ((F.col(start) + F.col(nth) * F.col(size)) / F.col(target)).alias(time))


def mix_result(docs: DataFrame) -> DataFrame:
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY src),
s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS BIGINT) AS w, source_size * 3 AS cap, sum(source_size) OVER () AS budget FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(w) OVER (ORDER BY cap::DOUBLE / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM s1),
s3 AS (SELECT *, cap::DOUBLE * w_rest::DOUBLE <= w * (budget - before)::DOUBLE AS is_full FROM s2),
s4 AS (SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS rest, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS w_open FROM s3),
targets AS (SELECT src, source_size, budget, CASE WHEN is_full THEN cap::DOUBLE ELSE w::DOUBLE * rest::DOUBLE / w_open::DOUBLE END AS target FROM s4),
q AS (SELECT s.*, t.source_size, t.target, t.budget,
             sum(s.size) OVER (PARTITION BY s.src ORDER BY s.h, s.r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
      FROM sized s JOIN targets t USING (src)),
p AS (SELECT q.*, start + e * source_size AS pos FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
sorted AS (SELECT r, size, budget, sum(size) OVER (ORDER BY (pos + size)::DOUBLE / target, src, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM p),
t AS (SELECT r, sum(size) AS taken FROM sorted WHERE used <= budget GROUP BY r)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN t USING (r)
"""
