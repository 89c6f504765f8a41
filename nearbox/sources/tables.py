"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOVIES = (
    "id long, title string, adult boolean, original_language string, origin_country string, release_date string, genre_names string, production_company_names string, "
    "budget double, revenue double, runtime double, popularity double, vote_average double, vote_count long"
)


def movies_csv(spark: SparkSession, path: str, schema: str = MOVIES) -> DataFrame:
    """A movie CSV with header; quoted fields may hold quotes and line ends."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def points(spark: SparkSession, rows: Sequence[Sequence[float]], payload: Sequence | None = None) -> DataFrame:
    """id, x0.., payload from lists; numbers alone are points of one dimension."""
    rows = [[r] if isinstance(r, int | float) else list(r) for r in rows]
    if payload is not None and len(payload) != len(rows):
        raise ValueError("points and payload differ in length")
    dims = len(rows[0]) if rows else 0
    if any(len(r) != dims for r in rows):
        raise ValueError("points differ in dimension")
    schema = "id long, " + "".join(f"x{k} double, " for k in range(dims)) + "payload string"
    return spark.createDataFrame([(i, *map(float, r), None if payload is None else payload[i]) for i, r in enumerate(rows)], schema)


def uniform_points(spark: SparkSession, n: int, dims: int = 5, seed: int = 42) -> DataFrame:
    """n seeded points, uniform on [0, 1): 52 bits of a hash of seed, dimension and id, so equal whatever the partitions."""
    x = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.col("id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return spark.range(n).select("id", *[x(k).alias(f"x{k}") for k in range(dims)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Keys and dimensions as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_matrix(df: DataFrame, path: str, dims: Sequence[str], reference: Sequence[str] = ("id", "title")) -> None:
    """The matrix (key and dimensions, Parquet) and what its rows refer to (CSV), in two folders."""
    df.select(reference[0], *dims).write.mode("overwrite").parquet(f"{path}/matrix")
    write_csv(df.select(*reference), f"{path}/reference")


def write_documents(documents: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """JSON documents as text files, in folders by the given columns."""
    writer = documents.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def write_results(documents: DataFrame, summary: DataFrame, path: str, by: Sequence[str] = ("query_id", "scheme")) -> None:
    """A JSON document (column document) in a folder of its own for each query and scheme, and a summary document."""
    write_documents(documents.select(*by, "document"), f"{path}/results", by)
    write_documents(summary.select("document"), f"{path}/summary")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
