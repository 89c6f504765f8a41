"""Quantiles, picks and changes against plain computations, on awkward columns and beyond the sizes that are broadcast."""

import math
import random

import pytest
from pyspark.sql import functions as F

from nearbox.operators import clean, quantiles, similarity, spatial, stats
from nearbox.operators.spatial import PointTable
from nearbox.session import blocks, bounded


def plain(values, p):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    at = p * (len(v) - 1)
    a, b = v[math.floor(at)], v[math.ceil(at)]
    return a if a == b or math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b


@pytest.mark.parametrize("limit", [50_000, 0, 7])
def test_quantiles(spark, limit):
    rng = random.Random(1)
    inf, nan = float("inf"), float("nan")
    columns = {
        "few": [float(rng.randrange(3)) for _ in range(400)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(400)],
        "one": [5.0] * 400,
        "skewed": [0.1] * 390 + [1e9 + k for k in range(10)],
        "close": [1.0 + k * 2**-52 for k in range(400)],
        "ends": [-inf] * 50 + [inf] * 60 + [nan] * 150 + [float(k) for k in range(140)],
        "nulls": [None] * 300 + [float(k) for k in range(100)],
        "empty": [None] * 400,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = quantiles.quantiles(df, list(columns), probabilities, limit)
    for c, values in columns.items():
        for p, x in zip(probabilities, got[c], strict=True):
            want = plain(values, p)
            assert x == want or (want is not None and math.isnan(want) and math.isnan(x)), (c, p, x, want)
    assert quantiles.quantiles(df.filter("false"), ["few"], [0.5]) == {"few": [None]}


def test_quantile_box_of_no_rows(spark):
    df = spark.createDataFrame([], "x double")
    assert stats.percentile_box(df, ["x"]).first().asDict() == {"lo_x": None, "hi_x": None}
    assert stats.vector_stats(df, ["x"]).first()["median"] is None


@pytest.mark.parametrize("rows,wanted", [(0, 5), (3, 5), (100, 7), (101, 1), (50, 50), (40, 0)])
def test_stride_pick_over_partitions(spark, rows, wanted):
    rng = random.Random(rows)
    data = [(i, ["t"] * rng.randint(0, 4)) for i in range(rows)]
    df = spark.createDataFrame(data, "id long, tokens array<string>").repartition(7)
    ordered = sorted(((len(t), i) for i, t in data), key=lambda x: (-x[0], x[1]))
    step = max(1, rows // wanted) if wanted else 1
    want = [(i, n, k) for k, (n, i) in enumerate(ordered) if k % step == 0][:wanted]
    assert sorted(map(tuple, similarity.stride_pick(df, "id", wanted).collect()), key=lambda r: r[2]) == want


def test_similar_to_errors(spark):
    df = spark.createDataFrame([(1, [1, 2])], "id long, signature array<long>")
    for call in (lambda: similarity.similar_to(df, "id", 9), lambda: similarity.similar_to(df, "id", top_n=0), lambda: similarity.similar_to(df.filter("false"), "id")):
        with pytest.raises(ValueError):
            call()


def test_changes_report_what_they_find(spark):
    t = PointTable(spark.createDataFrame([(1, 1.0, None, "a"), (2, 1.0, None, "b"), (3, 2.0, 2.0, "c")], "id long, x double, y double, payload string"), ("id",), ("x", "y"))
    gone = spark.createDataFrame([(1.0, None), (1.0, None), (1.0, None), (2.0, 9.0)], "x double, y double")
    assert {(r["x"], r["y"]): (r["asked"], r["found"]) for r in t.matched(gone).collect()} == {(1.0, None): (3, 2), (2.0, 9.0): (1, 0)}
    assert [r["id"] for r in t.delete(gone).df.collect()] == [3]
    assert sorted(r["id"] for r in t.delete(spark.createDataFrame([(1.0, "b")], "x double, payload string")).df.collect()) == [1, 3]
    changes = spark.createDataFrame([(2.0, 2.0, 7.0, 8.0, "n"), (2.0, 2.0, 5.0, 9.0, "m"), (4.0, 4.0, 0.0, 0.0, "z")], "x double, y double, new_x double, new_y double, new_payload string")
    got = {r["id"]: (r["x"], r["y"], r["payload"]) for r in t.update(changes).df.collect()}
    assert got == {1: (1.0, None, "a"), 2: (1.0, None, "b"), 3: (5.0, 9.0, "m")}
    assert t.update(changes.filter("false")).df.count() == 3 and t.delete(gone.filter("false")).df.count() == 3


def test_untouched_rows_stay_in_place(spark):
    """Deleting few rows shuffles none of the others."""
    df = spark.range(1000).select("id", (F.col("id") % 10).cast("double").alias("x"))
    left = PointTable(df, ("id",), ("x",)).delete(spark.createDataFrame([(3.0,)], "x double"))
    plan = left.df._jdf.queryExecution().optimizedPlan().toString()
    assert left.df.count() == 999 and "LeftAnti" in plan and plan.count("Window") == 1


def test_blocks_and_bounds(spark):
    df = spark.range(1000).withColumnRenamed("id", "query_id")
    parts = blocks(df, "query_id", 300)
    assert len(parts) == 4 and sorted(r["query_id"] for p in parts for r in p.collect()) == list(range(1000))
    assert "broadcast" in bounded(df)._jdf.queryExecution().toString() and "broadcast" not in bounded(df, 999)._jdf.queryExecution().toString()


def test_nearest_in_blocks(spark):
    rng = random.Random(3)
    pts = [(i, rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    queries = spark.createDataFrame([(q, rng.random(), rng.random()) for q in range(30)], "query_id long, q_x double, q_y double")
    one = sorted(map(tuple, spatial.knn_join(df, queries, ["x", "y"], ["id"], 3, sample=10).select("query_id", "id", "distance", "rank").collect()))
    assert one == sorted(map(tuple, spatial.knn_join(df, queries, ["x", "y"], ["id"], 3, sample=10, block=7).select("query_id", "id", "distance", "rank").collect()))
    q = {r["query_id"]: (r["q_x"], r["q_y"]) for r in queries.collect()}
    for k, (a, b) in q.items():
        want = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), i) for i, x, y in pts)[:3]
        assert [(d, i) for _, i, d, _ in sorted((r for r in one if r[0] == k), key=lambda r: r[3])] == want


def test_grid_join_on_skewed_points(spark):
    rng = random.Random(5)
    pts = [(i, *rng.choice([(1.0, 1.0), (rng.random(), 1e6 * rng.random()), (rng.expovariate(1), -5.0)])) for i in range(400)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    boxes = [(q, lo, lo + rng.random(), y, y + 3e5) for q in range(25) for lo, y in [(rng.random() * 2 - 0.5, rng.choice([-10.0, 0.0, 4e5]))]]
    got = sorted((r["query_id"], r["id"]) for r in spatial.range_join_grid(df, spark.createDataFrame(boxes, "query_id long, lo_x double, hi_x double, lo_y double, hi_y double"), ["x", "y"]).collect())
    assert got == sorted((q, i) for q, a, b, c, d in boxes for i, x, y in pts if a <= x <= b and c <= y <= d) and got


def test_fill_nulls_by_class(spark):
    df = spark.createDataFrame([(1, None, True, "2020-01-02"), (None, "x", None, None)], "n long, s string, b boolean, d string").withColumn("d", F.col("d").cast("date"))
    assert [tuple(r) for r in clean.fill_nulls(df).collect()] == [(1, "Unknown", "true", "2020-01-02"), (0, "x", "Unknown", "Unknown")]
    assert dict(clean.fill_nulls(df.filter("n = 1")).dtypes)["b"] == "boolean"
