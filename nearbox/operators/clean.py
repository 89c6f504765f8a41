"""Cleaning, filtering and scaling of a movie-like table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearbox.functions import vectors
from nearbox.functions.text import countries
from nearbox.sources.tables import write_csv

SCALED = ("budget", "revenue", "runtime", "vote_average", "vote_count", "popularity")
VECTOR = ("popularity", "vote_average", "runtime", "budget", "release_year")


def fill_nulls(df: DataFrame) -> DataFrame:
    """Numbers become 0; strings 'Unknown', and so do truth values, dates and times, which become strings if they miss any."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    other = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType)]
    missing = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in other]).first().asDict() if other else {}
    other = [c for c in other if missing[c]]
    return df.withColumns({c: F.col(c).cast("string") for c in other}).na.fill(0, numeric).na.fill("Unknown", text + other)


def parse_dates(df: DataFrame, column: str = "release_date", year: str = "release_year") -> DataFrame:
    """Rows whose date doesn't parse go; the year becomes a column."""
    parsed = df.withColumn(column, F.try_to_date(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column).cast("date"))
    return parsed.filter(F.col(column).isNotNull()).withColumn(year, F.year(column))


def business_filter(df: DataFrame, years=(1990, 2024), popularity=1.0, votes=(4, 10), runtime=(60, 240), origins=("US", "GB"), language="en") -> DataFrame:
    """Each condition applies if its column exists."""
    conditions = {
        "release_year": lambda c: c.between(*years),
        "popularity": lambda c: (c >= popularity) & ~F.isnan(c),
        "vote_average": lambda c: c.between(*votes),
        "runtime": lambda c: c.between(*runtime),
        "origin_country": lambda c: F.coalesce(F.arrays_overlap(countries(c), F.array(*map(F.lit, origins))), F.lit(False)),
        "original_language": lambda c: c == language,
    }
    for name, condition in conditions.items():
        if name in df.columns:
            df = df.filter(condition(F.col(name)))
    return df


def min_max_scale(df: DataFrame, columns: Sequence[str] = SCALED) -> DataFrame:
    """Columns that exist, scaled to [0, 1] over all rows; the one row of extremes is broadcast."""
    columns = [c for c in columns if c in df.columns]
    extremes = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    scaled = {c: vectors.min_max(c, F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(extremes)).select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def extract_vectors(df: DataFrame, dims: Sequence[str] = VECTOR, reference: Sequence[str] = ("id", "title")) -> DataFrame:
    """Reference columns and dimensions of the rows that have all dimensions."""
    if missing := [c for c in dims if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[c for c in reference if c in df.columns], *[F.col(c).cast("double").alias(c) for c in dims]).dropna(subset=list(dims))


def load_and_process(df: DataFrame, apply_filter: bool = False, normalize: bool = True) -> DataFrame:
    df = parse_dates(fill_nulls(df))
    df = business_filter(df) if apply_filter else df
    return min_max_scale(df) if normalize else df


def save_preprocessed(df: DataFrame, path: str) -> DataFrame:
    """Clean and filter df, write it as CSV, and return what was kept (see retention), counted while writing."""
    before, after = Observation(), Observation()
    seen = df.observe(before, F.count("*").alias("n"))
    write_csv(load_and_process(seen, apply_filter=True, normalize=False).observe(after, F.count("*").alias("n")), path)
    rows_in, rows_out = before.get["n"], after.get["n"]
    share = round(100.0 * rows_out / rows_in, 4) if rows_in else 0.0
    return df.sparkSession.createDataFrame([(rows_in, rows_out, share)], "rows_in long, rows_out long, retention_pct double")


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_in, rows_out, percent kept."""
    counted = before.agg(F.count("*").alias("rows_in")).crossJoin(after.agg(F.count("*").alias("rows_out")))
    return counted.withColumn("retention_pct", F.when(F.col("rows_in") == 0, 0.0).otherwise(F.round(100.0 * F.col("rows_out") / F.col("rows_in"), 4)))
