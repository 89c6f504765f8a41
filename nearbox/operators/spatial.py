"""Points in k dimensions: range and nearest-neighbour queries, single and batched, and functional changes.

A PointTable is a DataFrame with a key and scalar dimension columns. Queries are lazy DataFrames; nothing is indexed in
memory. Clustered layout (see `clustered`) lets Parquet skip row groups for boxes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearbox.functions import vectors
from nearbox.session import blocks, bounded

INDEX_TYPES = ("kdtree", "quadtree", "rangetree", "rtree")


@dataclass(frozen=True)
class PointTable:
    df: DataFrame
    key: tuple[str, ...]
    dims: tuple[str, ...]
    layout: str | None = None  #: a hint only; all layouts give the same answers

    def __post_init__(self):
        if self.layout is not None and self.layout not in INDEX_TYPES:
            raise ValueError(f"unknown index type {self.layout}; one of {', '.join(INDEX_TYPES)}")

    def valid(self) -> DataFrame:
        return self.df.filter(vectors.finite(self.dims))

    def range_query(self, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
        vectors.check_box(self.dims, lo, hi)
        return self.valid().filter(vectors.in_box(self.dims, list(map(float, lo)), list(map(float, hi))))

    def at_point(self, point: Sequence[float], rtol: float = 0.0, atol: float = 0.0) -> DataFrame:
        if len(point) != len(self.dims):
            raise ValueError(f"a point has {len(self.dims)} dimensions")
        return self.valid().filter(vectors.near_point(self.dims, point, rtol, atol))

    def knn(self, point: Sequence[float], k: int) -> DataFrame:
        """The k nearest rows with their distance, ties by key."""
        if k <= 0 or len(point) != len(self.dims):
            raise ValueError(f"k must be positive and the point have {len(self.dims)} dimensions")
        return self.valid().withColumn("distance", vectors.euclidean(self.dims, list(map(float, point)))).orderBy("distance", *self.key).limit(k)

    def knn_two_phase(self, point: Sequence[float], k: int, sample: int = 64) -> DataFrame:
        """As knn: the k-th distance within a cheap subset bounds the box that the exact search reads."""
        radius = self.valid().limit(max(sample, k)).select(vectors.euclidean(self.dims, list(map(float, point))).alias("d")).orderBy("d").limit(k).agg(F.max("d")).first()[0]
        if radius is None:
            return self.knn(point, k)
        # A little wider, so that rounding in the box's bounds loses nothing.
        r = radius * (1 + 1e-9) + 1e-9
        near = self.df.filter(vectors.in_box(self.dims, [float(p) - r for p in point], [float(p) + r for p in point])) if self.df.limit(k + 1).count() > k else self.df
        return PointTable(near, self.key, self.dims).knn(point, k)

    def insert(self, rows: DataFrame) -> PointTable:
        return PointTable(self.df.unionByName(rows, allowMissingColumns=True), self.key, self.dims, self.layout)

    def _touched(self, match: Sequence[str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows that equal a row of keys (distinct in match) in all columns of match, joined to it, and the other rows.

        Only the touched rows are ever numbered; with few keys, which are counted, no other row leaves its place.
        """
        keys = bounded(keys.select(*[F.col(c).alias(f"__{c}") for c in match], *[c for c in keys.columns if c not in match]))
        on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in match])
        return self.df.join(keys, on).drop(*[f"__{c}" for c in match]), self.df.join(keys, on, "left_anti")

    def matched(self, points: DataFrame) -> DataFrame:
        """For each distinct row of points (dims, and any payload columns to match) how often it is asked for and found."""
        match = [c for c in points.columns if c in self.df.columns]
        asked = points.groupBy(*match).agg(F.count("*").alias("asked"))
        touched, _ = self._touched(match, asked)
        counted = touched.groupBy(*match).agg(F.count("*").alias("__n"))
        on = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in match])
        return asked.alias("a").join(counted.alias("c"), on, "left").select(*[f"a.{c}" for c in match], "asked", F.least("asked", F.coalesce("__n", F.lit(0))).alias("found"))

    def delete(self, points: DataFrame) -> PointTable:
        """For each row of points (dims, and any payload columns to match) one matching row goes; see matched for what is found."""
        match = [c for c in points.columns if c in self.df.columns]
        touched, rest = self._touched(match, points.groupBy(*match).agg(F.count("*").alias("__gone")))
        nth = F.row_number().over(Window.partitionBy(*match).orderBy(*self.key))
        left = touched.withColumn("__nth", nth).filter(F.col("__nth") > F.col("__gone"))
        return PointTable(rest.unionByName(left.select(*self.df.columns)), self.key, self.dims, self.layout)

    def update(self, changes: DataFrame) -> PointTable:
        """changes: the dims of old points, new_<dim> columns, and new_<column> for payload that changes with them.

        The first match of each moves; payload without a new column stays. Of several changes of one point the least counts.
        """
        new = [c for c in changes.columns if c.startswith("new_")]
        one = changes.groupBy(*self.dims).agg(F.min(F.struct(*new)).alias("__new"))
        touched, rest = self._touched(self.dims, one)
        first = F.row_number().over(Window.partitionBy(*self.dims).orderBy(*self.key)) == 1
        moved = touched.withColumn("__first", first)
        to = {c: F.when(F.col("__first"), F.coalesce(F.col(f"__new.new_{c}"), F.col(c)) if c in self.dims else F.col(f"__new.new_{c}")).otherwise(F.col(c)) for c in self.df.columns if f"new_{c}" in new}
        return PointTable(rest.unionByName(moved.select(*[to[c].alias(c) if c in to else F.col(c) for c in self.df.columns])), self.key, self.dims, self.layout)

    def describe(self) -> DataFrame:
        """One row: the layout hint, dimensions, rows, rows that are points, distinct points."""
        point = F.when(vectors.finite(self.dims), F.struct(*self.dims))
        return self.df.agg(F.count("*").alias("rows"), F.count(point).alias("points"), F.count_distinct(point).alias("distinct_points")).select(
            F.lit(self.layout or "none").alias("layout"), F.lit(len(self.dims)).alias("dimensions"), F.lit(",".join(self.dims)).alias("names"), "rows", "points", "distinct_points"
        )

    def bounds(self, margin: float = 0.01, above: float = 0.0) -> DataFrame:
        """dim, lo, hi: extremes, widened by a share of their range (by 1 where that is 0), and hi by `above`."""
        found = self.valid().agg(*[F.struct(F.min(d).alias("lo"), F.max(d).alias("hi")).alias(d) for d in self.dims])
        rows = found.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{d}.lo").alias("lo"), F.col(f"{d}.hi").alias("hi")) for d in self.dims])).alias("x")).select("x.*")
        wide = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) * margin) if margin else F.lit(0.0)
        return rows.select("dim", (F.col("lo") - wide).alias("lo"), (F.col("hi") + wide + above).alias("hi"))

    def cells(self, widths: Sequence[float]) -> DataFrame:
        """Layout by grid cell: rows and bounds of each."""
        at = [F.floor(F.col(d) / w).alias(f"cell_{d}") for d, w in zip(self.dims, widths, strict=False)]
        names = [f"cell_{d}" for d in self.dims[: len(widths)]]
        return self.valid().select("*", *at).groupBy(*names).agg(F.count("*").alias("rows"), *[f(d).alias(f"{n}_{d}") for d in self.dims for n, f in (("min", F.min), ("max", F.max))])

    def clustered(self, path: str, partitions: int = 32, bits: int = 10) -> None:
        """Write the table in Morton order of its dimensions, so that row groups are small boxes."""
        extremes = self.valid().agg(*[f(d).alias(f"{n}_{d}") for d in self.dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
        cells = []
        for d in self.dims:
            lo, hi = extremes[f"lo_{d}"], extremes[f"hi_{d}"]
            cells.append(F.least(F.lit((1 << bits) - 1), F.floor((F.col(d) - lo) / ((hi - lo) or 1.0) * (1 << bits))).cast("long") if lo is not None else F.lit(0))
        code = F.lit(0).cast("long")
        for bit in range(min(bits, 62 // len(self.dims))):
            for k, c in enumerate(cells):
                code = code.bitwiseOR(F.shiftleft(F.shiftright(c, bits - 1 - bit).bitwiseAND(1), (min(bits, 62 // len(self.dims)) - 1 - bit) * len(self.dims) + k))
        self.df.withColumn("__code", code).repartitionByRange(partitions, "__code").sortWithinPartitions("__code").drop("__code").write.parquet(path)


def range_join(points: DataFrame, boxes: DataFrame, dims: Sequence[str], broadcast_rows: int = 10_000) -> DataFrame:
    """boxes: query_id, lo_<dim>, hi_<dim>. Few boxes (counted first) are broadcast; more go through range_join_grid."""
    if boxes.limit(broadcast_rows + 1).count() > broadcast_rows:
        return range_join_grid(points, boxes, dims)
    on = reduce(and_, [F.col(d).between(F.col(f"lo_{d}"), F.col(f"hi_{d}")) for d in dims])
    return points.join(F.broadcast(boxes), on)


def range_join_grid(points: DataFrame, boxes: DataFrame, dims: Sequence[str], cells: int = 16) -> DataFrame:
    """As range_join by an equi-join on grid cells of the first two dimensions, with the exact test after it.

    Cells are cut at quantiles (approximate ones do, any cuts give the same result), so skewed points fill them evenly;
    a cell of very many equal points is split by adaptive execution.
    """
    gridded = dims[:2]
    cuts = points.stat.approxQuantile(list(gridded), [k / cells for k in range(1, cells)], 0.005)
    place = lambda c, at: sum(((c >= x).cast("int") for x in sorted(set(at))), F.lit(0))
    spread = boxes
    for d, at in zip(gridded, cuts, strict=True):
        spread = spread.withColumn(f"__{d}", F.explode(F.sequence(place(F.col(f"lo_{d}"), at), F.greatest(place(F.col(f"lo_{d}"), at), place(F.col(f"hi_{d}"), at)))))
    own = points
    for d, at in zip(gridded, cuts, strict=True):
        own = own.withColumn(f"__{d}", place(F.col(d), at))
    on = reduce(and_, [F.col(x).between(F.col(f"lo_{x}"), F.col(f"hi_{x}")) for x in dims])
    marks = [f"__{d}" for d in gridded]
    return own.join(spread, marks).filter(on).drop(*marks)


def nearest(points: DataFrame, queries: DataFrame, distance: Column, key: Sequence[str], k: int, sample: int = 4096, block: int = 10_000) -> DataFrame:
    """For each query (query_id and what distance needs) its k nearest points with distance and rank, exactly.

    The k-th distance among a few points bounds each query's own k-th distance. With that bound beside the broadcast
    query, almost all pairs end in the scan's own stage, and only what is left is ranked. Queries are counted and taken
    in blocks, so what is broadcast at once doesn't grow with them.
    """
    order = Window.partitionBy("query_id").orderBy("distance", *key)
    few = points.limit(max(sample, k))

    def one(some: DataFrame) -> DataFrame:
        met = few.crossJoin(F.broadcast(some)).select("query_id", *key, distance.alias("distance"))
        bound = met.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select("query_id", F.col("distance").alias("__bound"))
        bounds = some.join(F.broadcast(bound), "query_id", "left")
        return points.join(F.broadcast(bounds), F.col("__bound").isNull() | (distance <= F.col("__bound"))).withColumn("distance", distance).drop("__bound")

    near = reduce(DataFrame.unionByName, [one(some) for some in blocks(queries, "query_id", block)])
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_join(points: DataFrame, queries: DataFrame, dims: Sequence[str], key: Sequence[str], k: int, **options) -> DataFrame:
    """nearest for queries with q_<dim> columns, by Euclidean distance."""
    return nearest(points, queries, vectors.euclidean(dims, [F.col(f"q_{d}") for d in dims]), key, k, **options)


def envelopes(df: DataFrame, by: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Minimum bounding boxes of groups, with volume."""
    found = df.groupBy(*by).agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    return found.withColumn("volume", vectors.volume([F.col(f"lo_{d}") for d in dims], [F.col(f"hi_{d}") for d in dims]))


def enlarged(boxes: DataFrame, other: Sequence[tuple[float, float]], dims: Sequence[str]) -> DataFrame:
    """What each box's volume grows by to hold another box, and what the union wastes over both."""
    lo = [F.least(F.col(f"lo_{d}"), F.lit(float(a))) for d, (a, _) in zip(dims, other, strict=True)]
    hi = [F.greatest(F.col(f"hi_{d}"), F.lit(float(b))) for d, (_, b) in zip(dims, other, strict=True)]
    union = vectors.volume(lo, hi)
    own = reduce(lambda x, y: x * y, [float(b) - float(a) for a, b in other])
    return boxes.withColumn("enlargement", union - F.col("volume")).withColumn("waste", union - F.col("volume") - F.lit(own))
