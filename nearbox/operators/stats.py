"""Descriptive statistics: exact, in one pass over the table where one is enough; quantiles by rank selection."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearbox.operators.quantiles import quantiles

PLACES = 6


def exact_mean(c: str) -> Column:
    """Mean through a decimal sum, so that it doesn't depend on the order of rows."""
    return (F.sum(F.col(c).cast("decimal(38,10)")).cast("double") / F.count(c)).cast("double")


def per_column(df: DataFrame, columns: Sequence[str], measures: dict[str, callable], ranks: dict[str, float]) -> DataFrame:
    """A row for each column with the named measures, from one aggregation, and the quantiles named in ranks."""
    at = quantiles(df, columns, list(ranks.values()))
    one = df.agg(*[F.struct(*[f(c).cast("double").alias(n) for n, f in measures.items()]).alias(c) for c in columns])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}.{n}").alias(n) for n in measures], *[F.lit(at[c][k]).cast("double").alias(n) for k, n in enumerate(ranks)])
        for c in columns
    ]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def vector_stats(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """min, max, mean, median and population deviation of each dimension."""
    return per_column(df, dims, {"min": F.min, "max": F.max, "mean": lambda c: F.round(exact_mean(c), PLACES), "std": lambda c: F.round(F.stddev_pop(c), PLACES)}, {"median": 0.5})


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, extremes and linear quartiles."""
    measures = {"count": F.count, "mean": lambda c: F.round(exact_mean(c), PLACES), "std": lambda c: F.round(F.stddev_samp(c), PLACES), "min": F.min, "max": F.max}
    return per_column(df, columns, measures, {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def percentile_box(df: DataFrame, dims: Sequence[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """One row lo_<dim>, hi_<dim>, by linear interpolation."""
    at = quantiles(df, dims, [low, high])
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(f"{n}_{d}") for d in dims for n, v in zip(("lo", "hi"), at[d], strict=True)])


def throughput(n: Column, seconds: Column) -> Column:
    """n a second, 0 where no time passed."""
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))


def first_rows(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The first n rows in the order of the given columns."""
    return df.orderBy(*by).limit(n)


def missing_profile(df: DataFrame) -> DataFrame:
    """column, missing, percent of the columns that miss values, most first."""
    counted = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = counted.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])).alias("x")).select("__n", "x.*")
    return rows.filter("missing > 0").select("column", "missing", F.round(100.0 * F.col("missing") / F.col("__n"), 4).alias("percent")).orderBy(F.desc("missing"), "column")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair over the rows that have all columns."""
    complete = df.dropna(subset=list(columns))
    pairs = list(combinations(columns, 2))
    one = complete.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{i}", PLACES).alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, rows: equal widths from least to greatest value, the last bin closed; empty bins are left out."""
    extremes = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    at = F.floor((F.col(column) - F.col("__lo")) * bins / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(1.0))
    return df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(extremes)).select(F.least(at, F.lit(bins - 1)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("rows"))


def log10_positive(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0).withColumn(f"log10_{column}", F.log10(column))


def best_group(df: DataFrame, by: str, value: str) -> DataFrame:
    """The group of least mean, values that mark a failure (not above 0) left out."""
    means = df.filter(F.col(value) > 0).groupBy(by).agg(exact_mean(value).alias("mean"))
    return means.agg(F.min_by(by, F.struct("mean", by)).alias(by), F.round(F.min("mean"), PLACES).alias("mean"))


def group_means(df: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.round(F.sum(F.when(F.col(v) > 0, F.col(v)).cast("decimal(38,10)")).cast("double") / F.count_if(F.col(v) > 0), PLACES).alias(f"avg_{v}") for v in values])


def top_k(df: DataFrame, by: str, key: str, k: int = 10) -> DataFrame:
    return df.filter(F.col(by).isNotNull()).orderBy(F.desc(by), key).limit(k)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of least hash of seed and key: the same rows every time and everywhere."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("__h", order).orderBy("__h", key).limit(n).drop("__h")
