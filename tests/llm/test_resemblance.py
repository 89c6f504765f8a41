"""The pipeline's near-duplicate stage against all pairs."""

import collections
import itertools
import random

import numpy as np
import pytest

from nearbox.llm import resemblance

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", 0, "clash") for i, t in rows], SCHEMA)


def prose(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def changed(words, share, seed):
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def brute(rows, similarity=0.8):
    """doc_id to the least doc_id of its class, and the pairs in between that are too near the threshold to miss."""
    sets = {i: frozenset(resemblance.shingle_set(t, 5).tolist()) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if (not x and not y) or (x | y and len(x & y) >= similarity * len(x | y)):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {i: new if v == old else v for i, v in label.items()}
    return label


BASES = [prose(n, 50 + n) for n in (12, 60, 200, 900)]
ROWS = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One\ttwo "), (6, "one three"), (7, " ".join(prose(30000, 3))), (8, changed(prose(30000, 3), 0.01, 4)), (9, " ".join(prose(300, 5)))]
ROWS += [(100 * (g + 1) + k, changed(base, share, k)) for g, base in enumerate(BASES) for k, share in enumerate([0, 0, 0.004, 0.01, 0.01, 0.02, 0.02, 0.03, 0.03, 0.2])]


@pytest.mark.parametrize("limit", [64, 2])
def test_classes(spark, limit):
    got = {r["doc_id"]: r["component_id"] for r in resemblance.classes(docs(spark, ROWS), list_limit=limit).collect()}
    assert got == brute(ROWS)
    assert got[8] == 7 and got[101] == 100 and len(set(got.values())) < len(got)


def test_keep_one(spark):
    rows = [*ROWS, ROWS[5], (None, "a b c d e f"), (None, "a b c d e f"), (None, None), (4, "a text of its own under an id that repeats"), (None, ROWS[10][1])]
    kept = resemblance.keep_one(docs(spark, rows))
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter([*set(brute(ROWS).values()), 4, None])
    assert resemblance.keep_one(docs(spark, [])).count() == 0


def test_tally(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (50, resemblance.UNITS, resemblance.ROWS))
    y = np.where(rng.random(x.shape) < 0.5, x, rng.integers(0, 256, x.shape))
    packed = lambda v: (v << (8 * np.arange(resemblance.ROWS))).sum(2).tolist()
    df = spark.createDataFrame(list(zip(range(50), packed(x), packed(y))), "i int, x array<long>, y array<long>")
    assert {r["i"]: r["t"] for r in df.select("i", resemblance.tally("x", "y").alias("t")).collect()} == {i: int((x[i] == y[i]).sum()) for i in range(50)}


def test_tally_rejects_and_keeps(spark):
    """Of pairs that meet in lists, far ones fall to the tally and similar ones don't."""
    base = prose(400, 77)
    texts = [" ".join(base), changed(base, 0.01, 1), changed(base, 0.02, 2), changed(base, 0.15, 3)]
    sets = [resemblance.shingle_set(t, 5) for t in texts]
    table = spark.createDataFrame([(i, resemblance.units(s).tolist(), s.view(np.int64).tolist()) for i, s in enumerate(sets)], "node long, units array<long>, items array<long>")
    pairs = spark.createDataFrame(list(itertools.combinations(range(4), 2)), "a long, b long")
    kept = {(r["a"], r["b"]) for r in resemblance.tallied(pairs, table).collect() if r["shared_bytes"] >= resemblance.least_matches(0.8)}
    similar = {(i, j) for i, j in itertools.combinations(range(4), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert similar <= kept and not any(3 in p for p in kept) and similar


def crowd(n, seed, ways):
    """Variants of one text whose mutual similarities lie around the threshold."""
    base, rng, rows = prose(150, 9), random.Random(seed), []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            p, way = rng.randrange(len(w)), rng.choice(ways)
            w[p : p + (way != "insert")] = [] if way == "delete" else [f"v{rng.randrange(10**6)}" if rng.random() < 0.8 else "often"]
        if "cut" in ways and rng.random() < 0.2:
            w = w[: rng.randint(110, 150)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("ways,limit", [(["replace"], 64), (["replace"], 2), (["replace", "insert", "delete", "cut"], 8), (["replace", "insert", "delete", "cut"], 2)])
def test_crowd_near_the_threshold(spark, ways, limit):
    """Equal to all pairs, whether lists are short or are taken apart beside hubs, by size and in blocks."""
    rows = crowd(160, 2, ways)
    got = {r["doc_id"]: r["component_id"] for r in resemblance.classes(docs(spark, rows), list_limit=limit).collect()}
    assert got == brute(rows) and 1 < len(set(got.values())) < 150


def test_blocks_alone(spark, monkeypatch):
    """What no level takes apart is compared block by block, with the same result."""
    monkeypatch.setattr(resemblance, "LEVELS", 0)
    rows = crowd(90, 4, ["replace", "delete"])
    got = {r["doc_id"]: r["component_id"] for r in resemblance.classes(docs(spark, rows), list_limit=16).collect()}
    assert got == brute(rows)


def test_long_list_makes_few_pairs(spark):
    """A crowd's pairs beside the hub grow with the crowd, not with its square."""
    for n in (100, 200):
        rows = crowd(n, 5, ["replace"])
        sets = {i: resemblance.shingle_set(t, 5) for i, t in rows}
        table = spark.createDataFrame([(i, resemblance.units(s).tolist(), s.view(np.int64).tolist()) for i, s in sets.items()], "node long, units array<long>, items array<long>")
        lists = spark.createDataFrame([(0, 0, i, len(s), n) for i, s in sets.items()], "k int, key long, node long, n long, size long")
        shared, lists = resemblance.beside_consensus(resemblance.groups_of(lists), table)
        # Six words at most were changed, so thirty shingles: the lists hold what was changed alike.
        assert lists.count() <= 30 * n
        # With what is alike in one component, few pairs are left to be met by size.
        base = resemblance.shingle_set(" ".join(prose(150, 9)), 5)
        near = [(i, 0) for i, s in sets.items() if len(np.intersect1d(s, base)) >= 0.8 * len(np.union1d(s, base))]
        assert resemblance.by_size(shared, spark.createDataFrame(near, "node long, label long"), 0.8).count() <= n
