import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearbox.functions import minhash, text
from nearbox.operators import results, similarity, stats
from nearbox.operators.clean import business_filter, load_and_process, min_max_scale

T1 = [(1, ["amber", "basil", "cedar"]), (2, ["amber", "basil", "fennel"]), (3, ["fennel", "hazel", "sorrel"]), (4, ["amber", "basil", "cedar", "iris"])]


def test_tokens(spark):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "!!!"), (5, "banana"), (6, "['a'"), (7, "['Harbour Lights', 'Nine Mills Ltd.']"), (8, "['A', None]")]
    df = spark.createDataFrame(rows, "id long, t string").select("id", text.tokens(F.col("t"), True).alias("s"), text.tokens(F.col("t"), False).alias("w"), text.list_items(F.col("t")).alias("items"))
    got = {r["id"]: r for r in df.collect()}
    assert [got[i]["s"] for i in range(1, 6)] == [[], [], ["ab"], [""], ["ana", "ban", "nan"]]
    assert got[4]["w"] == [] and got[6]["items"] == ["['a'"] and got[8]["items"] == ["A"]
    assert [text.shingles_of(t) for _, t in rows[:5]] == [got[i]["s"] for i in range(1, 6)]
    assert got[7]["w"] == ["harbour", "lights", "ltd", "mills", "nine"]


def test_hash_and_signature(spark):
    df = spark.createDataFrame([(w,) for w in ("a", "harbour", "é ü")], "token string")
    assert all(r[1] == minhash.hashed(r[0]) for r in df.select("token", text.token_hash(F.col("token"))).collect())
    assert (minhash.signature_of([]) == text.MERSENNE).all()
    a, b = minhash.permutations(4)
    big = [((int(x) * minhash.hashed("q") + int(y) + 2**63) % 2**64 - 2**63) % text.MERSENNE for x, y in zip(a, b)]
    assert minhash.signature_of(["q"], 4).tolist() == big


def test_jaccard_pairs(spark):
    df = spark.createDataFrame(T1 + [(5, T1[0][1]), (6, [])], "id long, tokens array<string>")
    got = {(r["a"], r["b"]): r["jaccard"] for r in similarity.jaccard_pairs(df, "id", 0.2).collect()}
    assert got == {(1, 2): 0.5, (2, 3): 0.2, (1, 4): 0.75, (4, 5): 0.75, (2, 4): 0.4, (1, 5): 1.0, (2, 5): 0.5}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdefg"), max_size=5), min_size=1, max_size=9), st.sampled_from([0.3, 0.5, 1.0]))
def test_jaccard_pairs_equal_brute_force(spark, sets, threshold):
    rows = [(i, sorted(s)) for i, s in enumerate(sets)]
    got = {(r["a"], r["b"]) for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), "id", threshold).collect()}
    near = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
    assert got == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if near(sets[i], sets[j]) >= threshold}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdefgh"), max_size=6), min_size=1, max_size=30), st.sampled_from([0.1, 0.5, 1.0]))
def test_jaccard_pairs_either_way(spark, sets, threshold):
    """By the index and by counting in small blocks, with rows that repeat and share an id."""
    rows = [(i // 2 if i % 5 == 0 else i + 100, sorted(s)) for i, s in enumerate(sets)] + [(None, ["a"])]
    near = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
    expected = sorted((min(i, j), max(i, j), near(set(s), set(t))) for k, (i, s) in enumerate(rows) for j, t in rows[:k] if None not in (i, j) and i != j and near(set(s), set(t)) >= threshold)
    df = spark.createDataFrame(rows, "id long, tokens array<string>").filter("id is not null")
    for dense in (0, 1e9):
        assert sorted(map(tuple, similarity.jaccard_pairs(df, "id", threshold, dense, block=7).collect())) == expected


def test_low_thresholds_are_counted_in_blocks(spark):
    """Where prefixes prune little, no pair of rows is joined; where they do, the index is used."""
    rng = np.random.RandomState(1)
    rows = [(i, sorted({f"t{x}" for x in rng.zipf(1.3, 40) % 500})) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    plan = lambda t: similarity.jaccard_pairs(df, "id", t)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan(0.1) and "FlatMapGroupsInArrow" not in plan(1.0)


def test_candidates_and_ranks(spark):
    s = similarity.with_signatures(spark.createDataFrame(T1, "id long, tokens array<string>"))
    got = similarity.ranked(s, s.filter("id = 4"), "id", 10, keep_self=False).collect()
    assert got[0]["id"] == 1 and got[0]["rank"] == 1 and all(r["id"] != 4 for r in got)
    assert similarity.ranked(s, s.filter("id = 4"), "id", 10, keep_self=True).orderBy("rank").first()["similarity"] == 1.0


def test_documents(spark):
    rows = spark.createDataFrame([(70, 1, 31, 0.8547, ["amber"], "A Quiet Orchard"), (70, 2, 58, 4 / 128, [], "Unknown")], "query_id long, rank int, id long, similarity double, tokens array<string>, title string")
    got = results.single(rows, include_tokens=True).first()["document"]
    assert got == '{"query":{"movie_id":70},"results":[{"rank":1,"movie_id":31,"similarity":0.8547,"title":"A Quiet Orchard","tokens":["amber"]},{"rank":2,"movie_id":58,"similarity":0.0312,"title":"Unknown"}],"metadata":{"total_results":2,"include_titles":true,"include_tokens":true}}'


def test_cleaning(spark):
    rows = [(1, "1994-01-01", "['US']", None), (2, "not-a-date", "US", 2.0), (3, "", "['FR', 'GB']", 3.0), (4, "2024-12-31", "['FR']", 4.0), (5, None, None, 5.0)]
    df = spark.createDataFrame(rows, "id long, release_date string, origin_country string, popularity double")
    assert [r["id"] for r in load_and_process(df, normalize=False).orderBy("id").collect()] == [1, 4]
    assert [r["id"] for r in business_filter(df.drop("release_date", "popularity")).orderBy("id").collect()] == [1, 2, 3]
    scaled = min_max_scale(df.select("popularity", F.lit(3).alias("budget"))).collect()
    assert sorted(r["popularity"] for r in scaled if r["popularity"] is not None) == [0.0, 1 / 3, 2 / 3, 1.0] and all(r["budget"] == 0.0 for r in scaled)


def test_percentile_like_numpy(spark):
    x = np.random.RandomState(0).rand(101)
    got = stats.percentile_box(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"]).first()
    assert (got["lo_x"], got["hi_x"]) == (np.percentile(x, 25), np.percentile(x, 75))
