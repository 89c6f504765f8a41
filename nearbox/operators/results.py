"""Result documents as JSON: one query, plain lists, and batches. Optional fields are left out where null."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearbox.session import bounded


def rounded(similarity: Column) -> Column:
    """Four places, half to even."""
    return F.bround(similarity, 4)


def with_titles(results: DataFrame, titles: DataFrame, key: str = "id") -> DataFrame:
    """Adds title, 'Unknown' where there is none."""
    return results.join(titles.select(key, "title"), key, "left").withColumn("title", F.coalesce("title", F.lit("Unknown")))


def _entries(include_titles: bool, include_tokens: bool) -> Column:
    fields = [F.col("rank"), F.col("id").alias("movie_id"), rounded(F.col("similarity")).alias("similarity")]
    fields += [F.col("title")] if include_titles else []
    fields += [F.when(F.size("tokens") > 0, F.col("tokens")).alias("tokens")] if include_tokens else []
    return F.array_sort(F.collect_list(F.struct(*fields)))


def single(results: DataFrame, query: DataFrame | None = None, include_titles: bool = True, include_tokens: bool = False) -> DataFrame:
    """query_id, document for each query_id of results (query_id, rank, id, similarity[, title][, tokens]).

    query: query_id, title of the queries whose own title is known.
    """
    grouped = results.groupBy("query_id").agg(_entries(include_titles, include_tokens).alias("results"), F.count("*").alias("total_results"))
    if query is not None and include_titles:
        grouped = grouped.join(bounded(query.select("query_id", F.col("title").alias("__title"))), "query_id", "left")
    else:
        grouped = grouped.withColumn("__title", F.lit(None).cast("string"))
    document = F.struct(
        F.struct(F.col("query_id").alias("movie_id"), F.col("__title").alias("title")).alias("query"), F.col("results"),
        F.struct("total_results", F.lit(include_titles).alias("include_titles"), F.lit(include_tokens).alias("include_tokens")).alias("metadata"),
    )
    return grouped.select("query_id", F.to_json(document).alias("document"))


def simple(results: DataFrame, has_titles: bool) -> DataFrame:
    """One document of ranked (rank, id, similarity[, title]) rows."""
    return results.agg(_entries(has_titles, False).alias("results"), F.count("*").alias("total_results")).select(
        F.to_json(F.struct("results", F.struct("total_results", F.lit(has_titles).alias("has_titles")).alias("metadata"))).alias("document")
    )


def simple_rows(spark, ids: list, similarities: list, titles: list | None = None) -> DataFrame:
    """Rows for simple() from lists of one length."""
    if len(ids) != len(similarities) or titles is not None and len(titles) != len(ids):
        raise ValueError("ids, similarities and titles differ in length")
    rows = [(n + 1, i, float(s), *([t] if titles is not None else [])) for n, (i, s, t) in enumerate(zip(ids, similarities, titles or ids, strict=True))]
    return spark.createDataFrame(rows, "rank int, id long, similarity double" + (", title string" if titles is not None else ""))


def batch(results: DataFrame, query: DataFrame | None = None, include_titles: bool = True, include_tokens: bool = False) -> DataFrame:
    """One document over all queries of a result of bounded size (queries by top-n)."""
    grouped = results.groupBy("query_id").agg(_entries(include_titles, include_tokens).alias("results"), F.count("*").alias("total_results"))
    if query is not None and include_titles:
        grouped = grouped.join(bounded(query.select("query_id", F.col("title").alias("query_title"))), "query_id", "left")
    else:
        grouped = grouped.withColumn("query_title", F.lit(None).cast("string"))
    entry = F.struct(F.col("query_id").alias("query_movie_id"), "results", "query_title", "total_results")
    return grouped.agg(F.array_sort(F.collect_list(entry)).alias("queries"), F.count("*").alias("total_queries")).select(
        F.to_json(F.struct("queries", F.struct("total_queries", F.lit(include_titles).alias("include_titles"), F.lit(include_tokens).alias("include_tokens")).alias("metadata"))).alias("document")
    )


def pretty(document: str) -> str:
    """A small document with indents, on the driver."""
    return json.dumps(json.loads(document), indent=2, ensure_ascii=False)
