"""Exact quantiles by rank selection: no task holds a column's values, and no sort of the table is needed.

A pass counts the values of each column in BINS equal bins between its extremes. The bins that hold the wanted ranks are
looked at again, each between its own extremes, until they hold `limit` rows at most; their values are counted and
brought to the driver. A pass divides a bin's width by BINS and tells its extremes apart, so a column of any shape takes
few passes (each reads the column once), and a bin of one value, however many rows, is done.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


def number(c: str) -> Column:
    """The column as a double; values that are no number are left to the counts at either end."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ends(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """Per column: values, of them -inf, of them numbers, least and greatest number."""
    x = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(
        *[
            F.struct(F.count(x[c]), F.count_if(x[c] == float("-inf")), F.count(number(c)), F.min(number(c)), F.max(number(c))).alias(f"e{k}")
            for k, c in enumerate(columns)
        ]
    ).first()
    return {c: tuple(row[k]) for k, c in enumerate(columns)}


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], limit: int = 50_000) -> dict[str, list[float | None]]:
    """For each column the values at the probabilities, by linear interpolation; nulls are left out, None without values.

    NaN counts as greater than all numbers, as it does in sorting.
    """
    found = ends(df, columns)
    wanted: dict[str, set[int]] = {}
    for c, (n, low, numbers, _, _) in found.items():
        places = {r for p in probabilities if n for at in (p * (n - 1),) for r in (floor(at), ceil(at))}
        wanted[c] = {r - low for r in places if low <= r < low + numbers}
    # What is still open, per column: (least, greatest, rank of the first value in it, ranks wanted from it).
    open_ = [(c, found[c][3], found[c][4], 0, ranks) for c, ranks in wanted.items() if ranks]
    known: dict[tuple[str, int], float] = {}
    rows = None
    while open_:
        ranges = [part[:3] for part in open_]
        counted = binned(df, ranges) if rows is None or rows > limit else values_in(df, ranges)
        following, rows = [], 0
        for c, lo, hi, before, ranks in open_:
            upto = before
            for a, b, n in counted[c, lo, hi]:
                inside = {r for r in ranks if upto <= r < upto + n}
                if inside and a == b:
                    known.update({(c, r): a for r in inside})
                elif inside:
                    following.append((c, a, b, upto, inside))
                    rows += n
                upto += n
        open_ = following

    def at(c: str, r: int) -> float:
        _, low, numbers, _, _ = found[c]
        if r < low:
            return float("-inf")
        if r >= low + numbers:
            # Beyond the numbers come +inf, then NaN.
            return float("inf") if r < low + numbers + above(df, c) else float("nan")
        return known[c, r - low]

    out: dict[str, list[float | None]] = {}
    for c in columns:
        n = found[c][0]
        out[c] = []
        for p in probabilities:
            if not n:
                out[c].append(None)
                continue
            place = p * (n - 1)
            lo, hi = floor(place), ceil(place)
            a, b = at(c, lo), at(c, hi)
            out[c].append(a if lo == hi or a == b else (hi - place) * a + (place - lo) * b)
    return out


def above(df: DataFrame, c: str) -> int:
    return df.agg(F.count_if(F.col(c).cast("double") == float("inf"))).first()[0]


def inside(df: DataFrame, ranges: Sequence[tuple[str, float, float]]) -> DataFrame:
    """k, v: the values in each range, by its number."""
    columns = list(dict.fromkeys(c for c, _, _ in ranges))
    numbers = df.select(*[number(c).alias(f"n{k}") for k, c in enumerate(columns)])
    at = {c: F.col(f"n{k}") for k, c in enumerate(columns)}
    # Only plain expressions, which are compiled: a value outside its range becomes null and goes.
    parts = [F.struct(F.lit(k).alias("k"), F.when(at[c].between(lo, hi), at[c]).alias("v")) for k, (c, lo, hi) in enumerate(ranges)]
    return numbers.select(F.explode(F.array(*parts)).alias("x")).select("x.k", "x.v").filter("v is not null")


def values_in(df: DataFrame, ranges: Sequence[tuple[str, float, float]]) -> dict[tuple, list[tuple[float, float, int]]]:
    """For each range its values in order, twice, and their rows; the ranges hold few rows."""
    some = df.filter(reduce(or_, [number(c).between(lo, hi) for c, lo, hi in ranges]))
    out: dict[tuple, list] = {r: [] for r in ranges}
    for r in sorted(inside(some, ranges).groupBy("k", "v").count().collect(), key=lambda r: (r["k"], r["v"])):
        out[ranges[r["k"]]].append((r["v"], r["v"], r["count"]))
    return out


def binned(df: DataFrame, ranges: Sequence[tuple[str, float, float]]) -> dict[tuple, list[tuple[float, float, int]]]:
    """For each range its bins in order: least and greatest value and rows."""
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
    low = of([lo / BINS for _, lo, _ in ranges])
    width = of([max((hi / BINS - lo / BINS) / BINS, 5e-324) for _, lo, hi in ranges])
    placed = inside(df, ranges).withColumn("bin", F.least(F.floor((F.col("v") / BINS - low) / width), F.lit(BINS - 1)).cast("int"))
    out: dict[tuple, list] = {r: [] for r in ranges}
    for r in sorted(placed.groupBy("k", "bin").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).collect(), key=lambda r: (r["k"], r["bin"])):
        out[ranges[r["k"]]].append((r["a"], r["b"], r["n"]))
    return out
