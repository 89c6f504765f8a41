"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A text's fingerprint has 64 bits; a bit is set if more than half of its word shingles' XXH64 values have it set.
Fingerprints link if they differ in at most two bits, so in at most two of their eight bytes: at least six bytes agree,
position by position. The inverted index holds positional bytes. A single byte's list would hold 1/256 of all
fingerprints, so bytes are listed four at a time: position sets are the 14 quadruples of the eight positions in which
any three positions occur together once (positions 0 to 7 whose XOR is 0). Then the count of lists that a pair shares
tells how many positional bytes it shares: eight agree in 14 lists, seven in 7, six in 3, five in 1, four in at most 1.
Pairs are tallied over the lists; those with fewer than 3, the guaranteed minimum of six shared bytes, are dropped, the
rest is verified bit by bit.

Lists longer than `list_limit` don't make pairs. Their fingerprints are linked exactly by the keys one bit away: two
fingerprints differ in at most two bits if and only if they share such a key (or are themselves that key), and each key
links its fingerprints to its least one. So a list of any length costs 65 rows a fingerprint. A pair that shares a long
list is found there whatever its tally; a pair that shares none is tallied over all its lists.

Up to three differing bits (`bits`) leave five agreeing bytes. The index then has a second system of 14 quadruples that
shares none with the first (MORE): five agreeing bytes are in 2 of the 28 lists, four in 1 at most, so the minimum is 2.
Fingerprints of long lists are listed again by their 56 quintuples of bytes, one of which such a pair shares; those of
quintuple lists that are still long are linked by keys: one is at most one bit from the key, the other at most two, and each
key links those within two bits to the least of those within one. That is 2,081 rows a fingerprint at worst, and exact.

Classes are the connected components. Equal texts, and equal fingerprints, count once until the end, where fingerprints
of very many rows are handed their class by a broadcast of a size that the number of rows bounds (see `by_fingerprint`).

Defined cases: a null text has no words and fingerprint zero, which links like any other; a fingerprint all of whose
rows have a null doc_id links others but names no class; repeated rows repeat; other columns are ignored by `groups` and
kept by `keep_one`. There, rows that share a doc_id are told apart by their texts, rows equal in both are kept once, and rows
without a doc_id come last in their class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbox.llm.common import rows_named
from nearbox.llm.components import connected_components
from nearbox.session import discard, written

BYTES, BITS, SEED = 8, 2, 42
#: The position sets of the index, and the lists that two fingerprints with BITS different bytes share at least.
QUADS = [q for q in combinations(range(BYTES), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
MINIMUM = min(sum(not set(q) & set(gone) for q in QUADS) for gone in combinations(range(BYTES), BITS))
#: For three bits: a system of the same kind, the first with positions exchanged, that has no quadruple in common with it.
MORE = [tuple(sorted((0, 1, 2, 4, 3, 6, 7, 5)[p] for p in q)) for q in QUADS]
SLICE = 1 << 16


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[i:j], SEED) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    h = shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), shingle)
    if not len(h):
        return 0
    raw = h.astype(">u8").view(np.uint8).reshape(-1, BYTES)
    ones = sum(np.unpackbits(raw[i : i + SLICE], axis=1).sum(0, dtype=np.int64) for i in range(0, len(raw), SLICE))
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, hash (of the text), fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, fp long")


def byte_of(fp: str, k: int):
    return F.shiftrightunsigned(F.col(fp), 56 - 8 * k).bitwiseAND(0xFF)


def position_sets(bits: int) -> tuple[list[tuple[int, ...]], int]:
    """The position sets of the index and the lists that fingerprints with so many differing bits share at least."""
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees no shared list beyond three differing bits")
    sets = QUADS if bits <= BITS else QUADS + MORE
    return sets, min(sum(not set(q) & set(gone) for q in sets) for gone in combinations(range(BYTES), bits))


def postings(distinct: DataFrame, sets: list[tuple[int, ...]] = QUADS) -> DataFrame:
    """k, key, fp, count: the lists (k, key) of two fingerprints and more, count their length."""
    keys = F.array(*[sum((F.shiftleft(byte_of("fp", p), 8 * n) for n, p in enumerate(q)), F.lit(0).cast("long")) for q in sets])
    index = distinct.select("fp", F.posexplode(keys).alias("k", "key"))
    lists = index.groupBy("k", "key").count().filter("count > 1")
    return index.join(lists, ["k", "key"])


def tallied(short: DataFrame) -> DataFrame:
    """a, b, shared: the pairs of fingerprints that meet in lists (k, key, fp), and how many they share."""
    met = short.select("k", "key", F.col("fp").alias("a")).join(short.select("k", "key", F.col("fp").alias("b")), ["k", "key"]).filter("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"))


def within(pairs: DataFrame, bits: int) -> DataFrame:
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")


def around(fps: DataFrame, bits: int) -> DataFrame:
    """fp, key: the keys at most so many bits away."""
    keys = fps.select("fp", F.col("fp").alias("key"), F.lit(-1).alias("last"))
    for _ in range(bits):  # each flips a later bit than the one before, or (64) none any more
        keys = keys.select("fp", "key", F.explode(F.sequence(F.least(F.col("last") + 1, F.lit(64)), F.lit(64))).alias("last"))
        keys = keys.withColumn("key", F.expr("IF(last < 64, key ^ shiftleft(1L, last), key)"))
    return keys.select("fp", "key")


def starred(fps: DataFrame, bits: int) -> DataFrame:
    """a, b: links by keys: those up to bits // 2 bits from a key name its hub, those up to the other bits from it are linked to it."""
    hubs = around(fps, bits // 2).groupBy("key").agg(F.min("fp").alias("hub"))
    met = around(fps, bits - bits // 2).join(hubs, "key").filter("fp != hub")
    return met.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(distinct: DataFrame, list_limit: int = 64, bits: int = BITS) -> DataFrame:
    """a, b: links among distinct fingerprints (fp) that have the same components as all links."""
    sets, minimum = position_sets(bits)
    read = [posted := written(postings(distinct, sets), "simhash-postings")]
    likely = tallied(posted.filter(F.col("count") <= list_limit)).filter(F.col("shared") >= minimum)
    near = within(likely, bits)
    crowded = posted.filter(F.col("count") > list_limit).select("fp").distinct()
    if bits > BITS:
        read.append(again := written(postings(crowded, list(combinations(range(BYTES), BYTES - bits))), "simhash-crowded"))
        near = near.unionByName(within(tallied(again.filter(F.col("count") <= list_limit)), bits))
        crowded = again.filter(F.col("count") > list_limit).select("fp").distinct()
    found = written(near.unionByName(starred(crowded, bits)), "simhash-links")
    discard(*read)
    return found


def by_fingerprint(rows: DataFrame, classes: DataFrame, total: int, most: int = 100_000) -> DataFrame:
    """rows (with fp) joined to classes (fp, n, component_id), n the number of rows of fp.

    Fingerprints of over total / most rows, of which there are fewer than `most`, are broadcast, so no task gets all rows
    of one; the others are joined by shuffling.
    """
    limit = max(1000, total // most)
    hot = F.broadcast(classes.filter(F.col("n") > limit).select("fp", F.lit(True).alias("hot"), F.col("component_id").alias("of_hot")))
    marked = rows.join(hot, "fp", "left")
    few = classes.filter(F.col("n") <= limit).select("fp", "component_id")
    return (
        marked.filter("hot").withColumn("component_id", F.col("of_hot")).drop("hot", "of_hot")
        .unionByName(marked.filter("hot is null").drop("hot", "of_hot").join(few, "fp"))
    )


def classes_of(first: DataFrame, list_limit: int, bits: int) -> DataFrame:
    """first (fp, first, n) with the least `first` of each fingerprint's class in place of its own."""
    labels = connected_components(links(first.select("fp"), list_limit, bits))
    linked = labels.join(first, F.col("node") == F.col("fp"))
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    moved = linked.join(least, "label").select("fp", "least")
    return first.join(moved, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("first"))


def groups(docs: DataFrame, shingle: int = 3, list_limit: int = 64, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id for each row of docs; component_id is the least doc_id of its class."""
    rows = written(fingerprints(docs, shingle).drop("hash"), "simhash-fingerprints")
    first = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    classes = classes_of(first, list_limit, bits).withColumnRenamed("first", "component_id")
    return by_fingerprint(rows, classes, rows.count()).select("doc_id", "fp", "component_id")


def simhash_result(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, list_limit: int = 64, bits: int = BITS) -> DataFrame:
    """The first document of each class (least doc_id, nulls last), all columns."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    first = written(fingerprints(docs, shingle).groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")), "simhash-distinct")
    return rows_named(docs, classes_of(first, list_limit, bits).select("first.doc_id", "first.hash"))
