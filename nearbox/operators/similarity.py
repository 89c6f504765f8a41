"""Text similarity: exact and estimated Jaccard, LSH candidates, top-n, and the hybrid with a numeric box."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearbox.functions import minhash, text, vectors
from nearbox.session import bounded, discard, written

NUM_PERM, THRESHOLD = 128, 0.5


def with_tokens(df: DataFrame, column: str, use_shingles: bool, k: int = 3) -> DataFrame:
    return df.withColumn("tokens", text.tokens(F.col(column), use_shingles, k))


def with_shingles(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """df and the distinct k-character shingles (column tokens) of plain texts, as text.shingles gives them.

    Computed in Arrow batches: on long texts this takes a small part of the time of nested lambdas, which Spark interprets.
    """
    at = df.columns.index(column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [text.shingles_of(t, k) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.list_(pa.string()))], names=[*b.schema.names, "tokens"])

    return df.mapInArrow(cut, T.StructType([*df.schema.fields, T.StructField("tokens", T.ArrayType(T.StringType()))]))


def with_signatures(df: DataFrame, num_perm: int = NUM_PERM) -> DataFrame:
    return minhash.with_signature(df, "tokens", num_perm)


def banded(df: DataFrame, key: str, num_perm: int = NUM_PERM, threshold: float = THRESHOLD) -> DataFrame:
    """key, band, band_key: the index, a row for each band."""
    b, r = minhash.best_bands(threshold, num_perm)
    return df.select(key, F.inline(minhash.bands(F.col("signature"), b, r)))


def candidates(df: DataFrame, queries: DataFrame, key: str, num_perm: int = NUM_PERM, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, key of rows that share a band with a query; queries and df have signatures. A bucket is only ever met
    from the query side, and the query's bands are few."""
    index = banded(df, key, num_perm, threshold)
    probe = banded(queries.select(F.col(key).alias("query_id"), "signature"), "query_id", num_perm, threshold)
    return index.join(probe, ["band", "band_key"]).select("query_id", key).distinct()


def ranked(df: DataFrame, queries: DataFrame, key: str, top_n: int, keep_self: bool, min_similarity: float | None = None, **options) -> DataFrame:
    """query_id, key, similarity, rank of the top candidates of each query by estimated Jaccard, ties by key."""
    found = candidates(df, queries, key, **options)
    if not keep_self:
        found = found.filter(F.col(key) != F.col("query_id"))
    q = queries.select(F.col(key).alias("query_id"), F.col("signature").alias("query_signature"))
    scored = found.join(df.select(key, "signature"), key).join(bounded(q), "query_id").withColumn("similarity", minhash.estimated_jaccard(F.col("signature"), F.col("query_signature")))
    if min_similarity is not None:
        scored = scored.filter(F.col("similarity") >= min_similarity)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n).select("query_id", key, "similarity", "rank")


def jaccard_pairs(df: DataFrame, key: str, threshold: float, dense: float = 1 / 400, block: int = 8192) -> DataFrame:
    """a, b (a < b), jaccard of all pairs at or above a threshold over 0, exactly.

    An inverted index over distinct token sets with prefix filtering: a pair that reaches the threshold shares a token
    among the rarest few of either set, so only those are indexed and common tokens never meet. Rows with equal sets are
    one set; pairs of rows come from joins with the sets' rows, so no set's rows are gathered.

    At low thresholds nearly all tokens are such prefixes. Where the index would meet over a share `dense` of all pairs of
    sets (it is counted first), shared tokens are counted in arrays instead, block of rows against block (`overlaps`).
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    rows = df.select(key, F.sort_array(F.array_distinct("tokens")).alias("tokens")).withColumn("sid", F.xxhash64("tokens"))
    sets = rows.groupBy("sid").agg(F.first("tokens").alias("tokens")).withColumn("n", F.size("tokens"))
    exploded = sets.select("sid", "n", F.explode("tokens").alias("token"))
    frequency = exploded.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("sid").orderBy("df", "token")
    prefix = exploded.join(frequency, "token").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("sid", "n", "token")
    prefix = written(prefix, "jaccard-prefix")
    listed = prefix.groupBy("token").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    if listed > dense * sets.count() ** 2 / 2:
        discard(prefix)
        return overlaps(df.select(key, "tokens"), key, threshold, block)
    a, b = prefix.alias("a"), prefix.alias("b")
    met = (
        a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.sid") < F.col("b.sid")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * (threshold - 1e-9)))
        .select(F.col("a.sid").alias("s1"), F.col("b.sid").alias("s2")).distinct()
    )
    one, two = sets.select(F.col("sid").alias("s1"), F.col("tokens").alias("t1")), sets.select(F.col("sid").alias("s2"), F.col("tokens").alias("t2"))
    near = met.join(one, "s1").join(two, "s2").withColumn("jaccard", text.jaccard(F.col("t1"), F.col("t2"))).filter(F.col("jaccard") >= threshold).select("s1", "s2", "jaccard")
    x, y = rows.select(F.col("sid").alias("s1"), F.col(key).alias("x")), rows.select(F.col("sid").alias("s2"), F.col(key).alias("y"))
    across = near.join(x, "s1").join(y, "s2").filter(F.col("x") != F.col("y")).select("jaccard", "x", "y")
    within = x.join(y, F.col("s1") == F.col("s2")).filter(F.col("x") < F.col("y")).select(F.lit(1.0).alias("jaccard"), "x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def overlaps(df: DataFrame, key: str, threshold: float, block: int) -> DataFrame:
    """a, b, jaccard as jaccard_pairs gives them, by counting the tokens that all pairs of rows share.

    Rows (key, tokens) are dealt to blocks of about `block`; each two blocks meet in one group, where the tokens of one
    block are an inverted index of row numbers and a row of the other counts how often each number is listed by its own
    tokens. A group holds two blocks and one row's counts, and hands its pairs on in batches.
    """
    rows = written(df.select(F.col(key).alias("x"), F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")).alias("tokens")).filter("x is not null").withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    exploded = rows.select("row", F.explode("tokens").alias("token"))
    numbers = written(exploded.select("token").distinct().withColumn("number", F.monotonically_increasing_id()), "jaccard-tokens")
    coded = exploded.join(numbers, "token").groupBy("row").agg(F.collect_list("number").alias("numbers"))
    parts = max(1, -(-rows.count() // block))
    own = rows.select("x", "row").join(coded, "row", "left").select("x", F.coalesce("numbers", F.array().cast("array<long>")).alias("numbers"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("own"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = met.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "x", "numbers")
    of = dict(df.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        keys, lists = t["x"].combine_chunks(), t["numbers"].combine_chunks()
        inside, second = t["i"][0].as_py() == t["j"][0].as_py(), t["second"].to_numpy()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        _, tokens = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(sizes)
        first = np.arange(len(t)) if inside else np.flatnonzero(~second)
        facing = first if inside else np.flatnonzero(second)
        if not len(first) or not len(facing):
            return
        place = np.full(len(t), -1)
        place[facing] = np.arange(len(facing))
        faced = np.repeat(place, sizes)
        listed, faced = tokens[faced >= 0], faced[faced >= 0]
        postings = faced[np.argsort(listed, kind="stable")]
        stops = np.cumsum(np.bincount(listed, minlength=len(tokens) and int(tokens.max()) + 1))
        starts = np.concatenate([[0], stops[:-1]]).tolist()
        stops, against = stops.tolist(), sizes[facing]
        least = against * (threshold / (1 + threshold)) - 1e-6
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            p, q, near = (np.concatenate(c) for c in zip(*found, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([keys.take(pa.array(p)), keys.take(pa.array(q)), pa.array(near)], names=["x", "y", "jaccard"])

        waiting = 0
        for p in first.tolist():
            n, its = int(sizes[p]), tokens[ends[p] - sizes[p] : ends[p]].tolist()
            shared = np.bincount(np.concatenate([postings[starts[k] : stops[k]] for k in its]), minlength=len(facing)) if n else np.zeros(len(facing), np.int64)
            if inside:
                shared[: place[p] + 1] = -1  # each pair once
            q = np.flatnonzero(shared >= least + n * (threshold / (1 + threshold)))
            both, union = shared[q], n + against[q] - shared[q]
            near = np.where(union > 0, both / np.maximum(union, 1), 1.0)
            near, q = near[near >= threshold], q[near >= threshold]
            if len(q):
                found.append((np.full(len(q), p), facing[q], near))
                waiting += len(q)
            if waiting >= 500_000:
                yield batch()
                waiting = 0
        if found:
            yield batch()

    pairs = met.groupBy("i", "j").applyInArrow(count, f"x {of}, y {of}, jaccard double").filter("x != y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def stride_pick(df: DataFrame, key: str, num_queries: int) -> DataFrame:
    """Rows in order of token count (most first), every step-th, at most num_queries.

    The order is made by range partitions, each sorted by itself; a row's place is its place in its partition after the
    rows of the partitions before it, of which there are as many numbers as partitions.
    """
    counted = df.select(key, F.size("tokens").alias("n_tokens"))
    placed = written(counted.orderBy(F.desc("n_tokens"), key).withColumn("__at", F.monotonically_increasing_id()), "stride")
    # The upper bits of the number are the partition, the lower ones the place in it.
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    n = sum(sizes.values())
    step = max(1, n // num_queries) if num_queries else 1
    before, rows = {}, 0
    for k in sorted(sizes):
        before[k] = rows
        rows += sizes[k]
    starts = df.sparkSession.createDataFrame(list(before.items()), "__part long, __before long")
    picked = placed.join(F.broadcast(starts), part == F.col("__part")).withColumn("nth", F.col("__before") + place)
    return picked.filter((F.col("nth") % step == 0) & (F.col("nth") < step * num_queries)).select(key, "n_tokens", "nth")


def choose_queries(df: DataFrame, inside: DataFrame, key: str, num_queries: int) -> DataFrame:
    """stride_pick among the rows inside the box, or among all rows where the box holds none."""
    return stride_pick(df if inside.isEmpty() else inside, key, num_queries)


def similar_to(df: DataFrame, key: str, query=None, top_n: int = 10, **options) -> DataFrame:
    """The top_n rows most like one row, itself left out; the row of least key if none is named. df has signatures."""
    if top_n <= 0:
        raise ValueError("top_n must be positive")
    if query is None and (query := df.agg(F.min(key)).first()[0]) is None:
        raise ValueError("there are no rows to choose a query from")
    asked = df.filter(F.col(key) == query)
    if asked.isEmpty():
        raise ValueError(f"no row has the {key} {query}")
    return ranked(df, asked, key, top_n, keep_self=False, **options)


def hybrid(df: DataFrame, key: str, dims: Sequence[str], lo: Sequence[float], hi: Sequence[float], queries: DataFrame, top_n: int = 10, **options) -> DataFrame:
    """Rows inside the box that share a band with a query, ranked by estimated Jaccard; the query itself may be among
    them. The box is applied first, on scalar columns, so it reaches the scan; only rows inside are signed."""
    vectors.check_box(dims, lo, hi)
    inside = df.filter(vectors.finite(dims) & vectors.in_box(dims, list(lo), list(hi)))
    return ranked(with_signatures(inside), queries, key, top_n, keep_self=True, **options)


def accuracy(found: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """Macro and micro precision, recall and F1 of (query_id, id) found against truth; 0/0 is 0."""
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    f1 = lambda p, r: F.when(F.col(p) + F.col(r) == 0, F.lit(0.0)).otherwise(2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r)))
    marked = found.select("query_id", "id", F.lit(1).alias("f"), F.lit(0).alias("t")).unionByName(truth.select("query_id", "id", F.lit(0).alias("f"), F.lit(1).alias("t")))
    each = marked.groupBy("query_id", "id").agg(F.max("f").alias("f"), F.max("t").alias("t")).groupBy("query_id").agg(F.sum(F.col("f") * F.col("t")).alias("tp"), F.sum("f").alias("found"), F.sum("t").alias("true"))
    each = queries.select("query_id").join(each, "query_id", "left").na.fill(0, ["tp", "found", "true"])
    each = each.withColumn("p", ratio("tp", "found")).withColumn("r", ratio("tp", "true")).withColumn("f1", f1("p", "r"))
    total = each.agg(
        *[F.avg(c).alias(f"macro_{n}") for c, n in (("p", "precision"), ("r", "recall"), ("f1", "f1"))], F.sum("tp").alias("total_tp"), F.sum(F.col("found") - F.col("tp")).alias("total_fp"), F.sum(F.col("true") - F.col("tp")).alias("total_fn"),
        F.avg("found").alias("avg_lsh_candidates"), F.avg("true").alias("avg_ground_truth_similar"), F.count("*").alias("num_queries"), F.sum("found").alias("__f"), F.sum("true").alias("__t"),
    )
    total = total.withColumn("micro_precision", ratio("total_tp", "__f")).withColumn("micro_recall", ratio("total_tp", "__t")).withColumn("micro_f1", f1("micro_precision", "micro_recall"))
    rounded = ["macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall", "micro_f1", "avg_lsh_candidates", "avg_ground_truth_similar"]
    return total.select(*[F.round(c, 6).alias(c) for c in rounded], "total_tp", "total_fp", "total_fn", "num_queries")
