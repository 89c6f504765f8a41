import math

import pytest
from pyspark.sql import functions as F

from nearbox.operators import spatial
from nearbox.operators.spatial import PointTable

P2D6 = [("A", 2, 3), ("B", 5, 4), ("C", 9, 6), ("D", 4, 7), ("E", 8, 1), ("F", 7, 2)]


def points(spark, rows):
    return PointTable(spark.createDataFrame([(k, float(x), float(y)) for k, x, y in rows], "label string, x double, y double"), ("label",), ("x", "y"))


def labels(df):
    return sorted(r["label"] for r in df.collect())


def test_box_is_closed(spark):
    t = points(spark, P2D6)
    assert labels(t.range_query([0, 0], [6, 6])) == ["A", "B"]
    assert labels(t.range_query([2, 3], [5, 4])) == ["A", "B"]
    assert labels(points(spark, P2D6 + [("G", 1, 5), ("H", 6, 8)]).range_query([0, 0], [6, 6])) == ["A", "B", "G"]


def test_nearest_in_order(spark):
    rows = points(spark, P2D6).knn([9, 2], 3).collect()
    assert [r["label"] for r in rows] == ["E", "F", "C"]
    assert rows[0]["distance"] == math.sqrt(2)
    assert [r["label"] for r in points(spark, P2D6).knn_two_phase([9, 2], 3).collect()] == ["E", "F", "C"]
    assert points(spark, P2D6).knn([0, 0], 99).count() == 6


def test_bad_arguments(spark):
    t = points(spark, P2D6)
    for call in (lambda: t.range_query([1, 1], [0, 2]), lambda: t.range_query([1], [2]), lambda: t.knn([1, 1], 0), lambda: t.knn([1], 1), lambda: PointTable(t.df, t.key, t.dims, "btree")):
        with pytest.raises(ValueError):
            call()


def test_changes(spark):
    t = points(spark, P2D6).insert(points(spark, [("G", 3, 3)]).df)
    assert labels(t.range_query([0, 0], [6, 6])) == ["A", "B", "G"]
    t = t.delete(spark.createDataFrame([(5.0, 4.0)], "x double, y double"))
    assert labels(t.range_query([0, 0], [6, 6])) == ["A", "G"]
    t = t.update(spark.createDataFrame([(2.0, 3.0, 2.0, 4.0)], "x double, y double, new_x double, new_y double"))
    assert [(r["x"], r["y"]) for r in t.df.filter("label = 'A'").collect()] == [(2.0, 4.0)]


def test_delete_takes_one_of_equals(spark):
    t = points(spark, [("A", 1, 1), ("B", 1, 1), ("C", 2, 2)])
    assert labels(t.delete(spark.createDataFrame([(1.0, 1.0)], "x double, y double")).df) == ["B", "C"]
    assert labels(t.delete(spark.createDataFrame([(9.0, 9.0)], "x double, y double")).df) == ["A", "B", "C"]


def test_not_a_number_is_no_point(spark):
    t = points(spark, [("A", 1, 1), ("B", float("nan"), 1), ("C", float("inf"), 1)])
    assert labels(t.knn([0, 0], 5)) == ["A"]
    assert labels(t.range_query([0, 0], [1e308, 1e308])) == ["A"]


def test_grid_join_equals_plain_join(spark):
    pts = spark.range(500).select("id", (F.rand(1) * 10).alias("x"), (F.rand(2) * 10).alias("y"))
    boxes = spark.range(30).select(F.col("id").alias("query_id"), (F.col("id") / 3.0).alias("lo_x"), (F.col("id") / 3.0 + 1).alias("hi_x"), F.lit(2.0).alias("lo_y"), F.lit(6.0).alias("hi_y"))
    one = {(r["query_id"], r["id"]) for r in spatial.range_join(pts, boxes, ["x", "y"]).collect()}
    two = [(r["query_id"], r["id"]) for r in spatial.range_join_grid(pts, boxes, ["x", "y"]).collect()]
    assert one == set(two) and len(one) == len(two) > 0


def test_empty_table(spark):
    t = points(spark, P2D6)
    t = PointTable(t.df.filter("false"), t.key, t.dims)
    assert t.range_query([0, 0], [1, 1]).count() == 0 and t.knn([0, 0], 3).count() == 0 and t.knn_two_phase([0, 0], 3).count() == 0


def test_box_reaches_the_scan(spark, tmp_path):
    points(spark, P2D6).df.write.parquet(str(tmp_path / "p"))
    t = PointTable(spark.read.parquet(str(tmp_path / "p")), ("label",), ("x", "y"))
    plan = t.range_query([0, 0], [6, 6])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,0.0), LessThanOrEqual(x,6.0)" in plan
