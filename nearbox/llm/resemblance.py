"""Near-duplicates by verified resemblance, an operator beside SimHash: its byte-position index, with minwise bytes as fingerprint.

The pipeline does not use it: its stage is the SimHash operator (simhash.py).

Two texts are near-duplicates if the sets of their word shingles (five words, lower-cased A-Z) have a Jaccard similarity of
at least 0.8. A 64-bit SimHash can't decide that: such texts differ in about ten bits, as do many unrelated ones. So the
fingerprint here has UNITS * ROWS bytes, each of one minwise value: two texts of similarity s agree in a byte with
probability s (and 1/256 of the rest). The steps are the operator's: an inverted index of positional bytes, a tally of the
positional bytes that a pair shares, a minimum of matches that similar pairs reach, verification.

* The index lists ROWS positional bytes at a time (a unit), as a single byte's list would hold 1/256 of all texts. A pair
  of similarity 0.8 shares at least one of the units with probability 0.9998.
* The tally counts all positions at which a pair's bytes agree. A pair of similarity 0.8 agrees in 0.8 of them on average;
  the minimum is five standard deviations less, which one such pair in some millions misses. Pairs below it aren't verified.
* What is left is verified on the whole shingle sets, exactly up to collisions of 64-bit hashes.

Classes are the connected components of links. No list of any length makes all its pairs:

1. Texts of equal sets are one node from the start.
2. Each list's nodes are compared with one hub: of long lists the node that is in most company (in the most, and longest,
   long lists), of others the least. This is linear in the list.
3. Lists of up to `list_limit` nodes that still hold several components are compared pair by pair across components.
4. Longer such lists, those of one hub together, are taken apart by what their nodes have beside the group's consensus h (the
   shingles of more than half of a sample of them; the bound that follows holds for any h, the sample only decides how well
   it prunes). If two sets share nothing outside h, what they share is in h, and their similarity
   is bounded by what each shares with h: x can only be similar to sets of at most |x & h| * (1 + t) / t - |x| shingles. So
   a pair shares a shingle that h lacks, or its sizes pass that bound both ways. Pairs of the second kind are joined by
   size; for the first kind each shingle that h lacks makes a list, which goes through step 3, and again through this step
   where it is long (`LEVELS` times). What is left then is compared across components in blocks: exact, bounded in memory,
   quadratic in what is left.

Defined cases: a text of fewer words than a shingle is one shingle, one without words (or null) has the empty set, and all
such texts are one class; rows with a null doc_id belong to classes as others do but name none, and come last where one row
is kept; rows that share a doc_id are told apart by their texts; rows equal in both are kept once; other columns are kept
as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearbox.llm.common import rows_named
from nearbox.llm.components import connected_components
from nearbox.llm.perplexity import slices
from nearbox.llm.simhash import by_fingerprint, shingle_hashes
from nearbox.session import bounded, discard, written

UNITS, ROWS, SEED = 28, 6, 42
#: Shingles whose permuted values are held at a time.
SLICE = 4096
LEVELS = 6
#: Members of a group, about, that its consensus is taken from.
SAMPLE = 12
#: Bytes of text that a worker has in hand at a time.
BATCH = 2_000_000
#: Sets whose sizes differ by less than this factor are of one size class.
SIZE_CLASS = 1.01
#: Pairs that share one side's copy in a verification; more are dealt to further copies.
FAN = 32


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), shingle))


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), SEED)


@lru_cache(maxsize=2)
def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def units(s: np.ndarray) -> np.ndarray:
    """The fingerprint: UNITS numbers of ROWS bytes, a byte of each minwise value; the empty set has zeros."""
    if not len(s):
        return np.zeros(UNITS, np.int64)
    a, b = multipliers(UNITS * ROWS)
    least = np.full(UNITS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), SLICE):
        np.minimum(least, (a[:, None] * s[None, k : k + SLICE] + b[:, None]).min(1), out=least)
    byte = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    return (byte.reshape(UNITS, ROWS) << (np.uint64(8) * np.arange(ROWS, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64)


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, hash (of the text), node (of the shingle set), n (its size), units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, BATCH):
            nodes, sizes, found = [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), shingle)
                nodes.append(node_of(s))
                sizes.append(len(s))
                found.append(units(s))
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * UNITS), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists], names=["doc_id", "hash", "node", "n", "units"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, node long, n long, units array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, units, items: fingerprints and shingle sets of the wanted rows (doc_id, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, BATCH):
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(0)]
            nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            prints = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * UNITS), pa.array(np.concatenate([units(s) for s in sets]) if sets else np.zeros(0, np.int64)))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), prints, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "units", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").join(
        bounded(wanted.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left_semi"
    )
    return texts.select("text").mapInArrow(run, "node long, units array<long>, items array<long>").dropDuplicates(["node"])


def sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity - 1e-9)


def least_matches(similarity: float) -> int:
    """The positional bytes that a pair of this similarity shares, less five standard deviations."""
    n = UNITS * ROWS
    return int(n * similarity - 5 * (n * similarity * (1 - similarity)) ** 0.5)


def tally(x: str, y: str) -> Column:
    """The positions at which the fingerprints x and y have the same byte: those of x ^ y whose byte is zero."""
    low = sum(0x7F << 8 * k for k in range(ROWS))
    high = sum(0x80 << 8 * k for k in range(ROWS))
    same = f"{ROWS} - bit_count((((d & {low}L) + {low}L) | d) & {high}L)"
    return F.expr(f"aggregate(zip_with({x}, {y}, (u, v) -> u ^ v), 0, (n, d) -> n + {same})")


def dealt(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """pairs (a, b) joined to side (b, ...); a b of many pairs is copied once for each FAN of them."""
    many = pairs.groupBy("b").count().filter(F.col("count") > FAN).select("b", F.ceil(F.col("count") / FAN).cast("int").alias("copies"))
    left = pairs.join(many, "b", "left").withColumn("copy", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    right = side.join(many, "b", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return left.join(right, ["b", "copy"]).drop("copy")


def tallied(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their fingerprints (f, g) and sets (x, y), and the positional bytes they share."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("units").alias("f"), F.col("items").alias("x")), "a")
    both = dealt(left, sets.select(F.col("node").alias("b"), F.col("units").alias("g"), F.col("items").alias("y")))
    return both.withColumn("shared_bytes", tally("f", "g"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) that share the least number of positional bytes and whose sets are similar."""
    both = tallied(pairs, sets).filter(F.col("shared_bytes") >= least_matches(similarity))
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return both.filter(F.col("shared") >= (F.col("sizes") - F.col("shared")) * F.lit(similarity - 1e-9)).select("a", "b")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label: the least node of its component) when links (a, b) are added; only components are joined anew."""
    if links.isEmpty():
        return labels
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l_{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    joined = connected_components(ends).select(F.col("node").alias("label"), F.col("label").alias("new"))
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("label"))
    known = labels.unionByName(alone).groupBy("node").agg(F.min("label").alias("label"))
    return written(known.join(joined, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "resemblance-labels")


def apart(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists (k, key, node, n, size) whose nodes are in several components, with each node's label."""
    labelled = posted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("k", "key").agg(F.min("label").alias("__l"), F.max("label").alias("__m")).filter("__l != __m").select("k", "key")
    return labelled.join(mixed, ["k", "key"], "left_semi")


def to_hubs(posted: DataFrame, similarity: float, list_limit: int) -> DataFrame:
    """Pairs (a, b) of each list's nodes with its hub."""
    company = posted.filter(F.col("size") > list_limit).groupBy("node").agg(F.sum("size").alias("company"))
    known = posted.join(company, "node", "left").withColumn("company", F.coalesce("company", F.lit(0)))
    best = known.groupBy("k", "key").agg(F.max(F.struct("company", (-F.col("node")).alias("least"), "node", "n")).alias("hub"))
    met = posted.join(best, ["k", "key"]).filter((F.col("node") != F.col("hub.node")) & sizes_allow(F.col("n"), F.col("hub.n"), similarity))
    return met.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()


def across(mixed: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of each list across components."""
    x, y = (mixed.select("k", "key", F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("label").alias(f"l_{side}")) for side in "ab")
    met = x.join(y, ["k", "key"]).filter((F.col("a") > F.col("b")) & (F.col("l_a") != F.col("l_b")) & sizes_allow(F.col("n_a"), F.col("n_b"), similarity))
    return met.select("a", "b").distinct()


def groups_of(crowded: DataFrame) -> DataFrame:
    """hub, node, n for the nodes of all lists that have one hub."""
    company = crowded.groupBy("node").agg(F.sum("size").alias("company"))
    known = crowded.join(company, "node")
    best = known.groupBy("k", "key").agg(F.max(F.struct("company", (-F.col("node")).alias("least"), "node")).alias("hub"))
    return known.join(best, ["k", "key"]).select(F.col("hub.node").alias("hub"), "node", "n").distinct()


def beside_consensus(grouped: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For groups (hub, node, n): how many items each node shares with the consensus (hub, node, n, shared), and the lists
    (k, key, node, n, size) of the nodes that have one item which the consensus lacks."""
    size = grouped.groupBy("hub").agg(F.count("*").alias("members"))
    drawn = grouped.join(size, "hub").filter(F.pmod(F.xxhash64("hub", "node"), F.col("members")) < SAMPLE).select("hub", "node")
    items = drawn.join(sets.select("node", "items"), "node").select("hub", F.explode("items").alias("item"))
    counted = items.groupBy("hub", "item").agg(F.count("*").alias("size")).join(drawn.groupBy("hub").agg(F.count("*").alias("drawn")), "hub")
    consensus = written(counted.filter(2 * F.col("size") > F.col("drawn")).groupBy("hub").agg(F.collect_list("item").alias("y")), "resemblance-consensus")
    own = grouped.join(sets.select("node", F.col("items").alias("x")), "node").select(F.col("node").alias("a"), F.col("hub").alias("b"), "n", "x")
    every = size.select(F.col("hub").alias("b")).join(consensus.withColumnRenamed("hub", "b"), "b", "left").select("b", F.coalesce("y", F.array().cast("array<long>")).alias("y"))
    beside = written(dealt(own, every).select(F.col("b").alias("hub"), F.col("a").alias("node"), "n", F.array_except("x", "y").alias("beside")), "resemblance-beside")
    index = beside.select(F.lit(0).alias("k"), "node", "n", "hub", F.explode("beside").alias("item")).select("k", F.xxhash64("hub", "item").alias("key"), "node", "n")
    lists = index.groupBy("k", "key").agg(F.count("*").alias("size")).filter("size > 1")
    return beside.select("hub", "node", "n", (F.col("n") - F.size("beside")).alias("shared")), index.join(lists, ["k", "key"])


def by_size(shared: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) within a group, across components, that may be similar though they share nothing beside the consensus."""
    reach = F.floor(F.col("shared") * F.lit((1 + similarity) / similarity) - F.col("n") + 1e-6)
    sized = shared.join(labels, "node", "left").select("hub", "node", "n", F.coalesce("label", "node").alias("label"), reach.alias("reach"))
    # Of a pair across components one at least is outside the group's largest.
    counts = sized.groupBy("hub", "label").count().groupBy("hub").agg(F.max(F.struct("count", "label")).alias("most")).select("hub", F.col("most.label").alias("main"))
    of = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_CLASS))).cast("int")
    low, high = F.ceil(F.col("n") * F.lit(similarity - 1e-9)), F.least("reach", F.floor(F.col("n") / F.lit(similarity - 1e-9)))
    x = sized.join(counts, "hub").filter((F.col("label") != F.col("main")) & (high >= low) & (low >= 1)).withColumn("class", F.explode(F.sequence(of(low), of(high))))
    y = sized.select(F.col("hub"), of(F.col("n")).alias("class"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("reach").alias("back"))
    met = x.join(y, ["hub", "class"]).filter((F.col("label") != F.col("other")) & (F.col("m") <= F.col("reach")) & (F.col("n") <= F.col("back")) & sizes_allow(F.col("n"), F.col("m"), similarity))
    return met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def block_links(crowded: DataFrame, sets: DataFrame, block: int, similarity: float) -> DataFrame:
    """Links (a, b) across components within lists of any length, block against block, so memory is bounded."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = crowded.select("k", "key", "node", "label", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = met.select("k", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"), "node", "label").join(sets, "node")

    def compare(t: pa.Table) -> pa.Table:
        nodes, labels, second = t["node"].to_pylist(), t["label"].to_pylist(), t["second"].to_pylist()
        items = [np.asarray(s.values) for s in t["items"].combine_chunks()]
        inside = t["i"][0].as_py() == t["j"][0].as_py()
        out: list[tuple[int, int]] = []
        for p in range(len(nodes)):
            for q in range(p + 1, len(nodes)):
                if labels[p] == labels[q] or (not inside and second[p] == second[q]):
                    continue
                small, large = sorted((len(items[p]), len(items[q])))
                if small < large * (similarity - 1e-9):
                    continue
                shared = len(np.intersect1d(items[p], items[q], assume_unique=True))
                if shared >= (small + large - shared) * (similarity - 1e-9):
                    out.append((nodes[p], nodes[q]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return met.groupBy("k", "key", "i", "j").applyInArrow(compare, "a long, b long")


def components(first: DataFrame, docs: DataFrame, shingle: int, similarity: float, list_limit: int) -> DataFrame:
    """node, label for each node that has a link; first: node, doc_id, hash, n, units."""
    index = first.filter("n > 0").select("node", "n", F.posexplode("units").alias("k", "key"))
    lists = index.groupBy("k", "key").agg(F.count("*").alias("size")).filter("size > 1")
    posted = written(index.join(lists, ["k", "key"]), "resemblance-postings")
    wanted = written(first.join(posted.select("node").distinct(), "node", "left_semi").select("doc_id", "hash"), "resemblance-wanted")
    sets = written(sets_of(docs, wanted, shingle), "resemblance-sets")

    found = written(verified(to_hubs(posted, similarity, list_limit), sets, similarity), "resemblance-links")
    labels = connected_components(found)
    mixed = written(apart(posted, labels), "resemblance-mixed")
    discard(posted)
    more = None
    for level in range(LEVELS + 1):
        pairs = across(mixed.filter(F.col("size") <= list_limit), similarity)
        pairs = pairs if more is None else pairs.unionByName(more).distinct()
        labels = relabelled(labels, written(verified(pairs, sets, similarity), "resemblance-links"))
        left = written(apart(mixed.filter(F.col("size") > list_limit).drop("label"), labels), "resemblance-mixed")
        discard(mixed)
        if left.isEmpty():
            return labels
        if level == LEVELS:
            break
        grouped = written(groups_of(left), "resemblance-groups")
        if level:  # at first, hubs have been met in step 2
            direct = grouped.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
            labels = relabelled(labels, written(verified(direct, sets, similarity), "resemblance-links"))
        shared, lists = beside_consensus(grouped, sets)
        more = written(by_size(shared, labels, similarity), "resemblance-pairs")
        mixed = written(apart(lists, labels), "resemblance-mixed")
    return relabelled(labels, written(block_links(left, sets, list_limit, similarity), "resemblance-links"))


def nodes_of(docs: DataFrame, shingle: int, similarity: float, list_limit: int) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, hash, node), and for each node its number of rows and its class's first row (doc_id, hash)."""
    rows = written(signed(docs, shingle), "resemblance-units")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    first = written(
        rows.groupBy("node").agg(F.min(order).alias("first"), F.min("n").alias("n"), F.min("units").alias("units"), F.count("*").alias("rows")).select("node", "first.*", "n", "units", "rows"),
        "resemblance-nodes",
    )
    labels = components(first, docs, shingle, similarity, list_limit)
    named = first.select("node", "rows", F.struct("unnamed", "doc_id", "hash").alias("first"))
    linked = labels.join(named, "node")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    moved = linked.join(least, "label").select("node", "least")
    return rows.select("doc_id", "hash", "node"), named.join(moved, "node", "left").select("node", "rows", F.coalesce("least", "first").alias("first"))


def classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, list_limit: int = 32) -> DataFrame:
    """doc_id, node, component_id for each row of docs; component_id is the least doc_id of its class."""
    rows, found = nodes_of(docs, shingle, similarity, list_limit)
    found = found.select(F.col("node").alias("fp"), F.col("rows").alias("n"), F.col("first.doc_id").alias("component_id"))
    return by_fingerprint(rows.select("doc_id", F.col("node").alias("fp")), found, rows.count()).select("doc_id", F.col("fp").alias("node"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, list_limit: int = 32) -> DataFrame:
    """The first document of each class (least doc_id, nulls last), all columns."""
    _, found = nodes_of(docs, shingle, similarity, list_limit)
    return rows_named(docs, found.select("first.doc_id", "first.hash"))
