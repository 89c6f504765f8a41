"""The test tables seen as points and as a movie table; each view also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
DIMS = ("quantity", "price", "discount", "tax", "year")
MOVIE_DIMS = ("popularity", "vote_average", "runtime", "budget", "release_year")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points; adding 0.0 turns a negative zero into a positive one."""
    return table(spark, sf_dir, "lineitem").select(
        *KEY[:4], F.col("l_extendedprice"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") + 0.0).alias("discount"), (F.col("l_tax") + 0.0).alias("tax"),
        F.year("l_shipdate").cast("double").alias("year"), "l_returnflag", "l_suppkey",
    ).select(*KEY, *DIMS, "l_returnflag")


POINTS = """points AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity AS quantity, l_extendedprice AS price, l_discount + 0.0::DOUBLE AS discount, l_tax + 0.0::DOUBLE AS tax,
  CAST(year(l_shipdate) AS DOUBLE) AS year, l_returnflag FROM lineitem)"""


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with figures of their line items, under a movie table's names."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min(F.year("l_shipdate")).alias("y"))
    part = table(spark, sf_dir, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    country = F.when(F.col("p_size") % 3 == 0, "US").when(F.col("p_size") % 3 == 1, "GB").otherwise("FR")
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.coalesce("n", F.lit(0)).cast("double").alias("popularity"), (F.col("p_size") % 11).cast("double").alias("vote_average"), (F.col("p_size") * 5).cast("double").alias("runtime"),
        F.col("p_retailprice").alias("budget"), F.coalesce("y", F.lit(1900)).cast("double").alias("release_year"), F.coalesce("n", F.lit(0)).cast("long").alias("vote_count"), F.concat(F.lit("['"), country, F.lit("', 'DE']")).alias("origin_country"),
        F.when(F.col("p_size") % 2 == 0, "en").otherwise("fr").alias("original_language"), F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_brand", F.lit("', '"), "p_type", F.lit("']")).alias("companies"),
    )


MOVIES = """movies AS (SELECT p_partkey AS id, p_name AS title, CAST(coalesce(n, 0) AS DOUBLE) AS popularity, CAST(p_size % 11 AS DOUBLE) AS vote_average, CAST(p_size * 5 AS DOUBLE) AS runtime, p_retailprice AS budget,
  CAST(coalesce(y, 1900) AS DOUBLE) AS release_year, CAST(coalesce(n, 0) AS BIGINT) AS vote_count, '[''' || CASE p_size % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' ELSE 'FR' END || ''', ''DE'']' AS origin_country,
  CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'fr' END AS original_language, '[''' || p_name || ''', ''' || p_brand || ''', ''' || p_type || ''']' AS companies, [p_name, p_brand, p_type] AS items
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, min(year(l_shipdate)) AS y FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey)"""


def boxes(spark: SparkSession) -> DataFrame:
    """A hundred boxes over quantity and price, every one at another place."""
    q = spark.range(100).withColumnRenamed("id", "query_id")
    return q.select("query_id", (F.col("query_id") % 10 * 5.0).alias("lo_quantity"), (F.col("query_id") % 10 * 5.0 + 10.0).alias("hi_quantity"), (F.floor(F.col("query_id") / 10) * 9000.0).alias("lo_price"), (F.floor(F.col("query_id") / 10) * 9000.0 + 12000.0).alias("hi_price"))


BOXES = """boxes AS (SELECT i AS query_id, i % 10 * 5.0::DOUBLE AS lo_quantity, i % 10 * 5.0::DOUBLE + 10 AS hi_quantity, i // 10 * 9000.0::DOUBLE AS lo_price, i // 10 * 9000.0::DOUBLE + 12000 AS hi_price FROM range(100) r(i))"""


def knn_queries(spark: SparkSession) -> DataFrame:
    q = spark.range(20).withColumnRenamed("id", "query_id")
    return q.select("query_id", (F.col("query_id") * 2.5).alias("q_quantity"), (F.col("query_id") * 4000.0).alias("q_price"), (F.col("query_id") % 10 * 0.01).alias("q_discount"), (F.col("query_id") % 8 * 0.01).alias("q_tax"), (F.col("query_id") % 7 + 1992.0).alias("q_year"))


KNN_QUERIES = """queries AS (SELECT i AS query_id, i * 2.5::DOUBLE AS q_quantity, i * 4000.0::DOUBLE AS q_price, (i % 10) * 0.01::DOUBLE AS q_discount, (i % 8) * 0.01::DOUBLE AS q_tax, i % 7 + 1992.0::DOUBLE AS q_year FROM range(20) r(i))"""

#: Words and 3-shingles of a column x of items, as SQL.
def words_sql(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda w: w <> '')))"


def shingles_sql(x: str, k: int = 3) -> str:
    s = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    return f"CASE WHEN coalesce({x}, '') = '' THEN []::VARCHAR[] WHEN length({s}) < {k} THEN [{s}] ELSE list_sort(list_distinct(list_transform(range(1, length({s}) - {k} + 2), lambda i: substring({s}, i, {k})))) END"


def tokens_sql(shingled: bool) -> str:
    """Distinct tokens of the column `items`."""
    each = shingles_sql("x") if shingled else words_sql("x")
    return f"list_sort(list_distinct(flatten(list_transform(items, lambda x: {each}))))"


HASH_SQL = (
    "CAST(((('0x' || substr(sha1(token), 1, 10))::BIGINT::HUGEINT * 576460752303423488) % 2305843009213693951"
    " + (('0x' || substr(sha1(token), 11, 15))::BIGINT::HUGEINT * 1152921504606846976) % 2305843009213693951 + ('0x' || substr(sha1(token), 26, 15))::BIGINT::HUGEINT) % 2305843009213693951 AS BIGINT)"
)


def signatures_sql(num_perm: int = 128) -> str:
    """CTEs sig(id, signature), from t(id, tokens): products and sums wrap in 64 bits, remainders are floored."""
    from nearbox.functions.minhash import permutations

    a, b = permutations(num_perm)
    rows = ", ".join(f"({i}, {x}::HUGEINT, {y}::HUGEINT)" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)))
    return f"""perms(i, a, b) AS (SELECT * FROM (VALUES {rows}) v(i, a, b)),
vocab AS (SELECT token, {HASH_SQL}::HUGEINT AS h FROM (SELECT DISTINCT unnest(tokens) AS token FROM t)),
raw AS (SELECT token, i, (a * h) % 18446744073709551616 + b AS w FROM vocab, perms),
wrapped AS (SELECT token, i, CASE WHEN w % 18446744073709551616 >= 9223372036854775808 THEN w % 18446744073709551616 - 18446744073709551616 ELSE w % 18446744073709551616 END AS w FROM raw),
valued AS (SELECT token, i, ((w % 2305843009213693951) + 2305843009213693951) % 2305843009213693951 AS v FROM wrapped),
least_of AS (SELECT id, i, CAST(min(v) AS BIGINT) AS v FROM (SELECT id, unnest(tokens) AS token FROM t) JOIN valued USING (token) GROUP BY id, i),
sig AS (SELECT id, list(v ORDER BY i) AS signature FROM least_of GROUP BY id)"""


BANDS_SQL = "bands AS (SELECT id, band, signature[band * 4 + 1 : band * 4 + 4] AS band_key FROM sig, (SELECT unnest(range(32)) AS band))"
SIMILARITY_SQL = "len(list_filter(range(1, 129), lambda i: s.signature[i] = q.signature[i])) / 128.0::DOUBLE"
