"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts become lower-case runs of letters and digits. A mask such as 1101111 picks the tokens at its ones from a window of
its length; the hash of the picked tokens is a seed. Token positions at a mask's zeros are ignored, so a seed survives
substitutions there. Training seeds are joined to benchmark seeds; each hit fixes an alignment of the document with the
item, around which the tokens are compared one by one. An overlap is an aligned run of `window` to `window + 2 * flank`
tokens of which at least `min_match` agree; the one of most agreeing tokens is reported, of these the longest.

The masks are chosen so that every such run, wherever its substitutions lie, holds a hit (`missed` enumerates those that
don't), and with 12 to 20 tokens every longer run at 80 % holds a shorter one at 80 %: from 24 tokens it can be cut into
parts of 12 to 20, or of 21 to 23 with at most four substitutions, of which 20 in a row hold at most four. So
nothing at the accepted agreement is missed, at any length.

Items shorter than `window` are looked for whole and exactly, by a mask of ones of their own length. An item without
tokens is never found.

What is broadcast is counted in bytes first: seeds (item, place, hash) and items (token hashes) are two tables, so an item is
held once whatever its length. Up to `broadcast_bytes` they go to every task whole. A larger benchmark is taken in blocks
of items, up to `most_blocks`, each a pass over the documents that shuffles nothing; beyond that, seeds of documents and
items are joined by shuffling, and the documents are read again for the comparison, matched by row.

Rows are told apart by doc_id and text. Defined cases: null texts have no tokens; items with the same tokens are found
each; `overlaps` reports rows that share a doc_id as one, `clean` judges each row by its own text, whatever its doc_id;
empty tables give no overlaps; other columns are ignored by `overlaps` and kept by `clean`.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearbox.llm.common import fresh
from nearbox.session import bounded, written

MASKS = ("1101111", "111010011", "11100100011")


def missed(masks: tuple[str, ...], length: int, substitutions: int) -> int:
    """The placements of substitutions in a run of tokens that leave no mask a hit inside it."""
    ones = [(len(m), sum(1 << k for k, c in enumerate(m) if c == "1")) for m in masks]
    placed = (((1 << length) - 1) & ~sum(1 << k for k in gone) for gone in itertools.combinations(range(length), substitutions))
    return sum(not any(same >> at & m == m for n, m in ones for at in range(length - n + 1)) for same in placed)


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed(text: Column) -> Column:
    """The tokens' 64-bit hashes."""
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seed_at(h: str, i: str, mask: str) -> Column:
    """The seed of the window of h that begins at i (from 0); null where the window is longer than what is left."""
    picked = [F.expr(f"{h}[{i} + {k}]") for k, c in enumerate(mask) if c == "1"]
    return F.when(F.expr(f"{i} + {len(mask)} <= size({h})"), F.xxhash64(F.lit(mask), *picked))


def seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """df (with an array h) and a row for each window and mask: i, mask, seed."""
    at = df.withColumn("i", F.explode(F.expr("sequence(0, greatest(size(h) - 1, 0))")))
    found = at.select("*", F.posexplode(F.array(*[seed_at("h", "i", m) for m in masks])).alias("mask", "seed"))
    return found.filter(F.col("seed").isNotNull())


def matches(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, flank: int = 4, min_match: float = 0.8, broadcast_bytes: int = 64 << 20, most_blocks: int = 16, window: int = 12
) -> DataFrame:
    """doc_id, text_hash, item_id, matched, compared: per row (by doc_id and text) and item the overlap of most agreeing tokens."""
    longest, narrowest = window + 2 * flank, min(map(len, masks))
    if 2 * longest - narrowest > 62 or max(map(len, masks)) > window:
        raise ValueError("runs around a hit must fit 62 tokens, and masks the window")
    items = benchmark.select("item_id", hashed(F.col("text")).alias("b")).withColumn("m", F.size("b")).filter("m > 0")
    # At most window - 1 numbers: the lengths of items that are looked for whole.
    short = sorted(r[0] for r in items.filter(F.col("m") < window).select("m").distinct().collect())
    every = (*masks, *("1" * n for n in short))
    fits = F.when(F.col("m") >= window, F.col("mask") < len(masks)).otherwise(F.element_at(F.array(*[F.lit(len(m)) for m in every]), F.col("mask") + 1) == F.col("m"))
    # Equal items share a name here and are told apart at the end; an item's tokens are held once.
    bodies = items.groupBy(F.xxhash64("b").alias("item")).agg(F.first("b").alias("b"), F.first("m").alias("m"))
    named = items.select("item_id", F.xxhash64("b").alias("item"))

    def probe(some: DataFrame) -> DataFrame:
        return seeds(some.withColumnRenamed("b", "h"), every).filter(fits).select("seed", "mask", "item", F.col("i").alias("j"))

    # The runs around a hit: where they begin, their length, how many tokens must agree.
    runs = ", ".join(f"named_struct('a', {a}, 'n', {n}, 'least', {math.ceil(min_match * n - 1e-9)})" for n in range(window, longest + 1) for a in range(narrowest - n, 1))

    def compared(hits: DataFrame) -> DataFrame:
        """hits: doc_id, text_hash, h, item, b, i, j, mask."""
        whole = F.col("mask") >= len(masks)
        lo = F.when(whole, 0).otherwise(F.greatest(F.lit(narrowest - longest), -F.col("i"), -F.col("j")))
        hi = F.when(whole, F.size("b")).otherwise(F.least(F.lit(longest), F.size("h") - F.col("i"), F.size("b") - F.col("j")))
        hits = hits.withColumn("whole", whole).withColumn("lo", lo).withColumn("hi", hi)
        # Not a filter before the aggregate: it would go into the join's condition, and the join out of generated code.
        same = F.expr("aggregate(sequence(0, hi - lo - 1), 0L, (n, k) -> n | if(h[i + lo + k] = b[j + lo + k], shiftleft(1L, k), 0L))")
        agree = "bit_count(shiftright(same, r.a - lo) & (shiftleft(1L, r.n) - 1))"
        best = f"array_max(transform(array({runs}), r -> if(r.a >= lo and r.a + r.n <= hi and {agree} >= r.least, shiftleft(cast({agree} as bigint), 32) + r.n, null)))"
        score = F.expr(f"if(whole, if(bit_count(same) = hi, shiftleft(cast(hi as bigint), 32) + hi, null), {best})")
        return hits.withColumn("same", same).groupBy("doc_id", "text_hash", "item").agg(F.max(score).alias("best")).filter("best is not null")

    known = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), hashed(F.col("text")).alias("h"))
    # Bytes of both tables in memory, from the items' lengths: a seed is about 64 bytes, a token 8.
    per_item = F.lit(64.0) * F.when(F.col("m") >= window, F.col("m") * len(masks)).otherwise(1) + 8.0 * F.col("m") + 64
    size = bodies.agg(F.coalesce(F.sum(per_item), F.lit(0.0)).alias("all"), F.coalesce(F.max(per_item), F.lit(0.0)).alias("largest")).first()
    blocks = max(1, math.ceil(2 * size["all"] / max(1, broadcast_bytes))) if size["all"] > broadcast_bytes else 1
    if blocks <= most_blocks and size["largest"] <= broadcast_bytes:
        found = None
        for k in range(blocks):
            some = bodies.filter(F.pmod(F.col("item"), F.lit(blocks)) == k) if blocks > 1 else bodies
            part = compared(seeds(known, every).join(F.broadcast(probe(some)), ["seed", "mask"]).join(F.broadcast(some.select("item", "b")), "item"))
            found = part if found is None else found.unionByName(part)
    else:
        narrow = seeds(known, every).select("doc_id", "text_hash", "seed", "mask", "i").join(probe(bodies), ["seed", "mask"])
        narrow = narrow.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "item", "mask", "i", "j").distinct()
        texts = known.dropDuplicates(["doc_id", "text_hash"])
        own = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
        found = compared(texts.join(narrow, own).join(bodies.select("item", "b"), "item"))
    # A name for each equal item: the found rows are few, the names as many as the benchmark.
    return found.join(named, "item").select("doc_id", "text_hash", "item_id", F.shiftright("best", 32).alias("matched"), F.col("best").bitwiseAND(0xFFFFFFFF).alias("compared"))


def overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, matched, compared: per document and item the overlap of most agreeing tokens."""
    best = matches(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "compared")).alias("best"))
    return best.select("doc_id", "item_id", "best.matched", "best.compared")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without overlaps, all columns; each row is judged by its own text."""
    doc, text = fresh(docs, "doc", "hash")
    # Written, so that counting them for a broadcast doesn't find them twice; few as they are, no document is shuffled.
    bad = written(matches(docs, benchmark, **options).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text))
    return docs.join(bounded(bad), same, "left_anti")


# By definition, not by masks: a run of 12 to 20 tokens that agrees to 80 % has three in a row that agree, so alignments
# come from equal triples of tokens; every run of each alignment is judged.
ORACLE = r"""
WITH dt AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h FROM documents),
bt AS (SELECT row_number() OVER () AS q, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS b FROM benchmark),
dw AS (SELECT r, h, unnest(range(len(h))) AS i FROM dt),
bw AS (SELECT q, b, unnest(range(len(b) - 2)) AS j FROM bt WHERE len(b) >= 12),
aligned AS (SELECT DISTINCT r, q, i - j AS d FROM (SELECT r, i, h[i + 1] AS x, h[i + 2] AS y, h[i + 3] AS z FROM dw WHERE i + 3 <= len(h)) JOIN (SELECT q, j, b[j + 1] AS x, b[j + 2] AS y, b[j + 3] AS z FROM bw) USING (x, y, z)),
pairs AS (SELECT r, q, d, doc_id, item_id, h, b, greatest(0, -d) AS lo, least(len(b), len(h) - d) AS hi FROM aligned JOIN dt USING (r) JOIN bt USING (q)),
same AS (SELECT r, q, d, doc_id, item_id, list_transform(range(lo, hi), lambda k: CASE WHEN h[k + d + 1] = b[k + 1] THEN 1 ELSE 0 END) AS eq FROM pairs WHERE hi - lo >= 12),
runs AS (SELECT doc_id, item_id, n, list_sum(list_slice(eq, s + 1, s + n)) AS matched
         FROM (SELECT doc_id, item_id, eq, n, unnest(range(len(eq) - n + 1)) AS s FROM same, (SELECT unnest(range(12, 21)) AS n) WHERE list_sum(eq) >= 10 AND len(eq) >= n)),
found AS (SELECT doc_id, item_id, matched, n AS compared FROM runs WHERE 5 * matched >= 4 * n
          UNION ALL
          SELECT doc_id, item_id, len(b), len(b) FROM (SELECT doc_id, h, unnest(range(len(h))) AS i FROM dt) JOIN bt ON len(b) BETWEEN 1 AND 11 AND i + len(b) <= len(h) AND h[i + 1] = b[1] AND list_slice(h, i + 1, i + len(b)) = b),
best AS (SELECT doc_id, item_id, matched, compared, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, compared DESC) AS n FROM found)
SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(compared AS BIGINT) AS compared FROM best WHERE n = 1
"""
