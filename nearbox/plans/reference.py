"""The queries of the engine and the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearbox.functions import minhash, text, vectors
from nearbox.operators import clean, results, similarity, spatial, stats
from nearbox.operators.spatial import PointTable
from nearbox.plans import views
from nearbox.plans.views import BANDS_SQL, BOXES, DIMS, KEY, KNN_QUERIES, MOVIE_DIMS, MOVIES, POINTS, SIMILARITY_SQL, signatures_sql, table, tokens_sql
from nearbox.sources import tables
from nearbox.session import new_shared_path, written

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def point_table(spark: SparkSession, d: str) -> PointTable:
    return PointTable(views.points(spark, d), KEY, DIMS)


K = ", ".join(KEY)
P = ", ".join(DIMS)
LO, HI = [10, 20000, 0.02, 0.01, 1993], [30, 60000, 0.07, 0.06, 1997]
BOX = " AND ".join(f"{d} BETWEEN {a} AND {b}" for d, a, b in zip(DIMS, LO, HI, strict=True))
AT = [25, 40000, 0.05, 0.04, 1995]


def distance_sql(point, prefix: str = "") -> str:
    return "sqrt(" + " + ".join(f"({prefix}{d} - {p}) * ({prefix}{d} - {p})" for d, p in zip(DIMS, point, strict=True)) + ")"


NEAREST = distance_sql([f"{p}::DOUBLE" for p in AT])


# Scans, cleaning, vectors


@query(f"WITH {POINTS} SELECT {K}, {P} FROM points")
def scan_project_vectors(spark, d):
    return clean.extract_vectors(views.points(spark, d), DIMS, KEY)


@query("SELECT c_custkey, coalesce(o_totalprice, 0) AS o_totalprice, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def fill_nulls(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return clean.fill_nulls(joined.select("c_custkey", "o_totalprice", "o_orderpriority"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS release_date, CAST(year(o_orderdate) AS INTEGER) AS release_year FROM orders WHERE o_orderstatus <> 'P'")
def parse_dates_year(spark, d):
    raw = F.when(F.col("o_orderstatus") == "P", "Unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    parsed = clean.parse_dates(table(spark, d, "orders").select("o_orderkey", raw.alias("release_date")))
    return parsed.withColumn("release_date", F.col("release_date").cast("string"))


@query(f"""WITH {MOVIES}, e AS (SELECT min(budget) lb, max(budget) hb, min(runtime) lr, max(runtime) hr, min(vote_average) lv, max(vote_average) hv, min(popularity) lp, max(popularity) hp FROM movies)
SELECT id, 0.0::DOUBLE AS revenue, CASE WHEN hb = lb THEN 0 ELSE (budget - lb) / (hb - lb) END AS budget, CASE WHEN hr = lr THEN 0 ELSE (runtime - lr) / (hr - lr) END AS runtime,
CASE WHEN hv = lv THEN 0 ELSE (vote_average - lv) / (hv - lv) END AS vote_average, CASE WHEN hp = lp THEN 0 ELSE (popularity - lp) / (hp - lp) END AS popularity FROM movies, e""")
def minmax_scale(spark, d):
    m = views.movies(spark, d).select("id", F.lit(7.0).alias("revenue"), "budget", "runtime", "vote_average", "popularity")
    return clean.min_max_scale(m)


BUSINESS = "release_year BETWEEN 1990 AND 2024 AND popularity >= 1 AND vote_average BETWEEN 4 AND 10 AND runtime BETWEEN 60 AND 240 AND (origin_country LIKE '%''US''%' OR origin_country LIKE '%''GB''%') AND original_language = 'en'"


@query(f"WITH {MOVIES} SELECT id, title, release_year, popularity, vote_average, runtime FROM movies WHERE {BUSINESS}")
def business_filter(spark, d):
    return clean.business_filter(views.movies(spark, d)).select("id", "title", "release_year", "popularity", "vote_average", "runtime")


@query(f"WITH {MOVIES} SELECT id, origin_country FROM movies WHERE origin_country LIKE '%''US''%' OR origin_country LIKE '%''GB''%'")
def country_overlap(spark, d):
    return clean.business_filter(views.movies(spark, d).select("id", "origin_country"))


@query(f"WITH {MOVIES} SELECT (SELECT count(*) FROM movies) AS rows_in, count(*) AS rows_out, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM movies), 4) AS retention_pct FROM movies WHERE {BUSINESS}")
def retention(spark, d):
    m = views.movies(spark, d)
    return clean.retention(m, clean.business_filter(m))


@query(f"WITH {MOVIES} SELECT id, log10(popularity) AS log10_popularity FROM movies WHERE popularity > 0".replace("log10(popularity)", "round(log10(popularity), 9)"))
def log10_positive(spark, d):
    return stats.log10_positive(views.movies(spark, d), "popularity").select("id", F.round("log10_popularity", 9).alias("log10_popularity"))


def bounds_sql(margin: float) -> str:
    each = " UNION ALL ".join(f"SELECT '{x}' AS dim, min({x}) AS l, max({x}) AS h FROM points" for x in DIMS)
    wide = f"CASE WHEN h = l THEN 1 ELSE (h - l) * {margin} END" if margin else "0"
    return f"WITH {POINTS}, e AS ({each}) SELECT dim, l - {wide} AS lo, h + {wide} AS hi FROM e"


@query(bounds_sql(0.01))
def bounds_margin(spark, d):
    return point_table(spark, d).bounds(0.01)


@query(bounds_sql(0))
def bounds_exact(spark, d):
    return point_table(spark, d).bounds(0)


@query("SELECT i AS id, " + ", ".join(f"('0x' || substr(md5('42:{k}:' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS x{k}" for k in range(5)) + " FROM range(10000) r(i)")
def uniform_source(spark, d):
    return tables.uniform_points(spark, 10_000)


@query(f"WITH {MOVIES} SELECT id, title, companies, budget FROM movies")
def csv_round_trip(spark, d):
    path = new_shared_path(spark, "csv")
    tables.write_csv(views.movies(spark, d).select("id", "title", "companies", "budget"), path)
    return tables.movies_csv(spark, path, "id long, title string, companies string, budget double")


# Range queries


@query(f"WITH {POINTS} SELECT {K}, {P}, l_returnflag FROM points WHERE {BOX}")
def range_query_5d(spark, d):
    return point_table(spark, d).range_query(LO, HI)


@query(f"WITH {POINTS}, p AS (SELECT {P} FROM points ORDER BY {K} LIMIT 1) SELECT {K}, points.quantity, points.price FROM points JOIN p USING ({P})")
def range_query_exact_point(spark, d):
    t = point_table(spark, d)
    return t.at_point(list(t.df.orderBy(*KEY).select(*DIMS).first())).select(*KEY, "quantity", "price")


MBR = f"""m AS (SELECT l_suppkey, {', '.join(f'min({x}) AS lo_{x}, max({x}) AS hi_{x}' for x in DIMS[:3])} FROM points GROUP BY l_suppkey)"""


@query(f"WITH {POINTS}, {MBR} SELECT l_suppkey FROM m WHERE lo_quantity <= 3 AND hi_quantity >= 1 AND lo_price <= 1500 AND hi_price >= 900 AND lo_discount <= 0.01 AND hi_discount >= 0")
def box_intersects_mbr(spark, d):
    m = spatial.envelopes(views.points(spark, d), ["l_suppkey"], DIMS[:3])
    c = [F.col(f"{n}_{x}") for n in ("lo", "hi") for x in DIMS[:3]]
    return m.filter(vectors.boxes_touch(c[:3], c[3:], [F.lit(x) for x in (1.0, 900.0, 0.0)], [F.lit(x) for x in (3.0, 1500.0, 0.01)])).select("l_suppkey")


@query(f"WITH {POINTS}, {MBR}, v AS (SELECT *, (hi_quantity - lo_quantity) * (hi_price - lo_price) * (hi_discount - lo_discount) AS volume, (greatest(hi_quantity, 60) - least(lo_quantity, 0)) * (greatest(hi_price, 1e5) - least(lo_price, 500)) * (greatest(hi_discount, 0.2) - least(lo_discount, 0)) AS u FROM m) SELECT l_suppkey, round(volume, 3) AS volume, round(u - volume, 3) AS enlargement, round(u - volume - (60.0::DOUBLE - 0) * (1e5 - 500) * 0.2::DOUBLE, 3) AS waste FROM v")
def mbr_measures(spark, d):
    m = spatial.enlarged(spatial.envelopes(views.points(spark, d), ["l_suppkey"], DIMS[:3]), [(0, 60), (500, 1e5), (0, 0.2)], DIMS[:3])
    return m.select("l_suppkey", *[F.round(c, 3).alias(c) for c in ("volume", "enlargement", "waste")])


RANGE_JOIN = f"WITH {POINTS}, {BOXES} SELECT query_id, count(*) AS n, min(l_orderkey) AS first_order, max(price) AS max_price FROM points JOIN boxes ON quantity BETWEEN lo_quantity AND hi_quantity AND price BETWEEN lo_price AND hi_price GROUP BY query_id"


def by_box(joined: DataFrame) -> DataFrame:
    return joined.groupBy("query_id").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"), F.max("price").alias("max_price"))


@query(RANGE_JOIN)
def range_join_batch(spark, d):
    return by_box(spatial.range_join(views.points(spark, d), views.boxes(spark), ["quantity", "price"]))


@query(RANGE_JOIN)
def range_join_grid(spark, d):
    return by_box(spatial.range_join_grid(views.points(spark, d), views.boxes(spark), ["price", "quantity"]))


# Nearest neighbours

KNN_ONE = f"WITH {POINTS} SELECT {K}, {NEAREST} AS distance FROM points ORDER BY distance, {K} LIMIT 10"


@query(KNN_ONE)
def knn_single(spark, d):
    return point_table(spark, d).knn(AT, 10).select(*KEY, "distance")


@query(KNN_ONE)
def knn_two_phase(spark, d):
    return point_table(spark, d).knn_two_phase(AT, 10).select(*KEY, "distance")


KNN_BATCH = f"WITH {POINTS}, {KNN_QUERIES}, r AS (SELECT query_id, {K}, {distance_sql([f'q_{x}' for x in DIMS])} AS distance FROM points, queries) SELECT query_id, {K}, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, {K}) AS INTEGER) AS rank FROM r QUALIFY rank <= 10"


@query(KNN_BATCH)
def knn_batch(spark, d):
    found = spatial.knn_join(views.points(spark, d), views.knn_queries(spark), DIMS, KEY, 10)
    return found.select("query_id", *KEY, "distance", "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, round(sqrt(list_reduce(list_transform(range(1, 65), lambda i: (q.e[i]::DOUBLE - x.embedding[i]::DOUBLE) * (q.e[i]::DOUBLE - x.embedding[i]::DOUBLE)), lambda a, b: a + b)), 9) AS distance FROM embeddings x, q)
SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10""")
def knn_embedding(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("e"))
    distance = F.round(vectors.array_distance(F.col("e"), F.col("embedding")), 9)
    return spatial.nearest(e, q, distance, ["vec_id"], 10, sample=256).select("query_id", "vec_id", "distance", "rank")


# Statistics


def measures_sql(source: str, columns, measures: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {measures.replace('$', c)} FROM {source}" for c in columns)


MEAN = "round(CAST(sum(CAST($ AS DECIMAL(38,10))) AS DOUBLE) / count($), 6) AS mean"


@query(f"WITH {POINTS} " + measures_sql("points", DIMS, f"min($) AS min, max($) AS max, {MEAN}, quantile_cont($, 0.5) AS median, round(stddev_pop($), 6) AS std"))
def vector_stats(spark, d):
    return stats.vector_stats(views.points(spark, d), DIMS)


@query(f"WITH {MOVIES} " + measures_sql("movies", MOVIE_DIMS, f"CAST(count($) AS DOUBLE) AS count, {MEAN}, round(stddev_samp($), 6) AS std, min($) AS min, quantile_cont($, 0.25) AS p25, quantile_cont($, 0.5) AS p50, quantile_cont($, 0.75) AS p75, max($) AS max"))
def describe_stats(spark, d):
    return stats.describe(views.movies(spark, d), MOVIE_DIMS)


@query(f"WITH {POINTS} SELECT {', '.join(f'quantile_cont({x}, 0.25) AS lo_{x}, quantile_cont({x}, 0.75) AS hi_{x}' for x in DIMS)} FROM points")
def percentile_box(spark, d):
    return stats.percentile_box(views.points(spark, d), DIMS)


@query("""WITH j AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice <= 100000 THEN o_totalprice END AS price FROM orders), u AS (SELECT 'status' AS "column", count(*) FILTER (status IS NULL) AS missing, count(*) AS n FROM j UNION ALL SELECT 'price', count(*) FILTER (price IS NULL), count(*) FROM j UNION ALL SELECT 'o_orderkey', count(*) FILTER (o_orderkey IS NULL), count(*) FROM j)
SELECT "column", missing, round(100.0::DOUBLE * missing / n, 4) AS percent FROM u WHERE missing > 0""")
def missing_profile(spark, d):
    o = table(spark, d, "orders")
    return stats.missing_profile(o.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_totalprice") <= 100000, F.col("o_totalprice")).alias("price")))


CORR = ("popularity", "vote_average", "runtime", "budget", "release_year")


@query(f"WITH {MOVIES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM movies" for i, a in enumerate(CORR) for b in CORR[i + 1 :]))
def corr_matrix(spark, d):
    return stats.correlations(views.movies(spark, d), CORR)


@query(f"WITH {POINTS}, e AS (SELECT min(price) AS l, max(price) AS h FROM points) SELECT CAST(least(floor((price - l) * 50 / (h - l)), 49) AS BIGINT) AS bin, count(*) AS rows FROM points, e GROUP BY ALL")
def histogram_50(spark, d):
    return stats.histogram(views.points(spark, d), "price")


@query(f"WITH {POINTS}, g AS (SELECT l_returnflag, CAST(sum(CAST(price AS DECIMAL(38,10))) AS DOUBLE) / count(price) AS m FROM points WHERE price > 0 GROUP BY l_returnflag) SELECT l_returnflag, round(m, 6) AS mean FROM g ORDER BY m, l_returnflag LIMIT 1")
def group_mean_argmin(spark, d):
    return stats.best_group(views.points(spark, d), "l_returnflag", "price")


@query(f"WITH {POINTS} SELECT l_returnflag, round(CAST(sum(CASE WHEN price > 0 THEN CAST(price AS DECIMAL(38,10)) END) AS DOUBLE) / count(*) FILTER (price > 0), 6) AS avg_price, round(CAST(sum(CASE WHEN tax > 0 THEN CAST(tax AS DECIMAL(38,10)) END) AS DOUBLE) / count(*) FILTER (tax > 0), 6) AS avg_tax FROM points GROUP BY l_returnflag")
def group_means(spark, d):
    return stats.group_means(views.points(spark, d), "l_returnflag", ["price", "tax"])


@query("SELECT DISTINCT event_type FROM events")
def distinct_values(spark, d):
    return table(spark, d, "events").select("event_type").distinct()


@query(f"WITH {MOVIES} SELECT id, title, popularity FROM movies ORDER BY popularity DESC, id LIMIT 10")
def topk_popular(spark, d):
    return stats.top_k(views.movies(spark, d).select("id", "title", "popularity"), "popularity", "id")


@query(f"WITH {MOVIES} SELECT id, title, vote_average, vote_count FROM movies WHERE vote_count >= 20 ORDER BY vote_average DESC, id LIMIT 10")
def topk_min_votes(spark, d):
    return stats.top_k(views.movies(spark, d).filter("vote_count >= 20").select("id", "title", "vote_average", "vote_count"), "vote_average", "id")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 50")
def hash_sample(spark, d):
    return stats.hash_sample(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 50)


# Sets


def order_sets(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("id"))


SETS = "a AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000), b AS (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 200000)"


@query(f"WITH {SETS} SELECT id FROM a WHERE id IN (SELECT id FROM b)")
def set_intersect(spark, d):
    a, b = order_sets(spark, d)
    return a.join(b, "id", "left_semi")


@query(f"WITH {SETS} SELECT id FROM a UNION SELECT id FROM b")
def set_union(spark, d):
    a, b = order_sets(spark, d)
    return a.unionByName(b).distinct()


@query(f"WITH {SETS} SELECT id FROM a WHERE id NOT IN (SELECT id FROM b)")
def set_difference(spark, d):
    a, b = order_sets(spark, d)
    return a.join(b, "id", "left_anti")


@query(f"WITH {SETS} SELECT id FROM a UNION ALL SELECT id FROM b")
def union_rows(spark, d):
    a, b = order_sets(spark, d)
    return a.unionByName(b)


# Tokens and hashes


@query(f"SELECT doc_id, {views.words_sql('text')} AS tokens FROM documents".replace("lower(text)", "lower(coalesce(text, ''))"))
def tokens_words(spark, d):
    return table(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("tokens"))


SHINGLED = r"""WITH n AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', '', 'g') AS s FROM documents),
w AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN length(s) < 3 THEN [s] ELSE list_sort(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3)))) END AS tokens FROM n)
SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, '|')) AS digest FROM w"""


@query(SHINGLED)
def tokens_shingles(spark, d):
    s = similarity.with_shingles(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")
    return s.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", "|").cast("binary")).alias("digest"))


@query(f"WITH {MOVIES} SELECT id, {tokens_sql(False)} AS tokens FROM movies")
def list_literal_tokens(spark, d):
    return similarity.with_tokens(views.movies(spark, d), "companies", False).select("id", "tokens")


@query(f"WITH {MOVIES}, v AS (SELECT DISTINCT unnest({tokens_sql(True)}) AS token FROM movies) SELECT token, {views.HASH_SQL} AS hash FROM v")
def token_hash(spark, d):
    v = similarity.with_tokens(views.movies(spark, d), "companies", True).select(F.explode("tokens").alias("token")).distinct()
    return v.select("token", text.token_hash(F.col("token")).alias("hash"))


SIGNED = f"WITH {MOVIES}, t AS (SELECT id, title, items, {tokens_sql(True)} AS tokens FROM movies), {signatures_sql()}"


def signed(spark, d) -> DataFrame:
    return similarity.with_signatures(similarity.with_tokens(views.movies(spark, d), "companies", True))


@query(f"{SIGNED} SELECT id, signature FROM sig")
def minhash_signature(spark, d):
    return signed(spark, d).select("id", "signature")


@query(f"{SIGNED}, q AS (SELECT signature FROM sig ORDER BY id LIMIT 1) SELECT s.id, {SIMILARITY_SQL} AS similarity FROM sig s, q")
def est_jaccard(spark, d):
    s = signed(spark, d)
    first = s.orderBy("id").select("signature").limit(1).withColumnRenamed("signature", "other")
    return s.crossJoin(F.broadcast(first)).select("id", minhash.estimated_jaccard(F.col("signature"), F.col("other")).alias("similarity"))


JACCARD_SQL = "len(list_intersect(x.tokens, y.tokens)) / (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens)))::DOUBLE"


@query(f"""WITH t AS (SELECT item_id AS id, {views.words_sql('text')} AS tokens FROM benchmark UNION ALL SELECT -(conv_id * 1000 + turn) - 1, {views.words_sql('text')} FROM conversations)
SELECT x.id AS a, y.id AS b, round({JACCARD_SQL}, 9) AS jaccard FROM t x JOIN t y ON x.id < y.id WHERE {JACCARD_SQL} >= 0.1""")
def exact_jaccard_pairs(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.words(F.col("text")).alias("tokens"))
    c = table(spark, d, "conversations").select((-(F.col("conv_id") * 1000 + F.col("turn")) - 1).alias("id"), text.words(F.col("text")).alias("tokens"))
    return similarity.jaccard_pairs(b.unionByName(c), "id", 0.1).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("""SELECT t AS threshold, CAST(b AS INTEGER) AS bands, CAST(128 // b AS INTEGER) AS rows FROM (SELECT unnest([0.5::DOUBLE, 0.8, 0.9]) AS t), (SELECT unnest(range(1, 129)) AS b) WHERE 128 % b = 0
QUALIFY row_number() OVER (PARTITION BY t ORDER BY abs(pow(1.0::DOUBLE / b, b / 128.0::DOUBLE) - t), b) = 1""")
def optimal_bands(spark, d):
    return spark.createDataFrame([(t, *minhash.best_bands(t, 128)) for t in (0.5, 0.8, 0.9)], "threshold double, bands int, rows int")


@query(f"{SIGNED}, {BANDS_SQL} SELECT id, CAST(band AS INTEGER) AS band, band_key FROM bands")
def lsh_bands(spark, d):
    return similarity.banded(signed(spark, d), "id")


#: The query rows: the five of most tokens at a stride among those inside the middle box.
MIDDLE = f"middle AS (SELECT {', '.join(f'quantile_cont({x}, 0.25) AS lo_{x}, quantile_cont({x}, 0.75) AS hi_{x}' for x in MOVIE_DIMS)} FROM movies)"
INSIDE = f"inside AS (SELECT movies.* FROM movies, middle WHERE {' AND '.join(f'{x} BETWEEN lo_{x} AND hi_{x}' for x in MOVIE_DIMS)})"
PICKED = "picked AS (SELECT id, n_tokens, nth FROM (SELECT id, len(tokens) AS n_tokens, row_number() OVER (ORDER BY len(tokens) DESC, id) - 1 AS nth, count(*) OVER () AS n FROM t JOIN inside USING (id)) WHERE nth % greatest(1, n // 5) = 0 ORDER BY nth LIMIT 5)"
FLAGSHIP = f"WITH {MOVIES}, {MIDDLE}, {INSIDE}, t AS (SELECT id, title, items, {tokens_sql(True)} AS tokens FROM movies), {PICKED}, {signatures_sql()}, {BANDS_SQL}"
CANDIDATES = "found AS (SELECT DISTINCT p.id AS query_id, b.id FROM bands p JOIN picked USING (id) JOIN bands b ON b.band = p.band AND b.band_key = p.band_key)"
SCORED = f"scored AS (SELECT query_id, f.id, {SIMILARITY_SQL} AS similarity FROM found f JOIN sig s ON s.id = f.id JOIN sig q ON q.id = f.query_id)"


class Flagship:
    """The movie table, its middle box and its query rows. The table is a join and is read several times, so it is written once."""

    def __init__(self, spark: SparkSession, d: str):
        self.movies = written(similarity.with_tokens(views.movies(spark, d), "companies", True), "movies")
        box = stats.percentile_box(self.movies, MOVIE_DIMS).first()
        self.lo, self.hi = [box[f"lo_{x}"] for x in MOVIE_DIMS], [box[f"hi_{x}"] for x in MOVIE_DIMS]
        self.inside = self.movies.filter(vectors.in_box(MOVIE_DIMS, self.lo, self.hi))
        self.picked = written(similarity.choose_queries(self.movies, self.inside, "id", 5), "picked")
        self.queries = similarity.with_signatures(self.movies.join(F.broadcast(self.picked.select("id")), "id", "left_semi"))

    def signed(self) -> DataFrame:
        """Keys and signatures of all rows, signed once."""
        return written(similarity.with_signatures(self.movies).select("id", "signature"), "signatures")


@query(f"{FLAGSHIP} SELECT id, CAST(n_tokens AS INTEGER) AS n_tokens, nth FROM picked")
def stride_pick(spark, d):
    return Flagship(spark, d).picked.withColumn("nth", F.col("nth").cast("long"))


@query(f"{FLAGSHIP}, {CANDIDATES} SELECT query_id, id FROM found")
def lsh_candidates(spark, d):
    f = Flagship(spark, d)
    return similarity.candidates(f.signed(), f.queries, "id")


@query(f"{FLAGSHIP}, {CANDIDATES}, {SCORED} SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM scored WHERE id <> query_id QUALIFY rank <= 10")
def similar_top_n(spark, d):
    f = Flagship(spark, d)
    return similarity.ranked(f.signed(), f.queries, "id", 10, keep_self=False)


def hybrid_sql(where: str = "") -> str:
    return f"{FLAGSHIP}, {CANDIDATES}, {SCORED}, ranked AS (SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM scored JOIN ({where or 'SELECT id FROM inside'}) USING (id) QUALIFY rank <= 10)"


SHOWN = "SELECT query_id, id, round_even(similarity, 4) AS similarity, rank FROM ranked"


def flagship_rows(spark, d) -> tuple[Flagship, DataFrame]:
    f = Flagship(spark, d)
    return f, similarity.hybrid(f.movies, "id", MOVIE_DIMS, f.lo, f.hi, f.queries)


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "id", results.rounded(F.col("similarity")).alias("similarity"), "rank")


@query(f"{hybrid_sql()} {SHOWN}")
def hybrid_box_lsh(spark, d):
    return shown(flagship_rows(spark, d)[1])


WIDE = f"SELECT movies.id FROM movies, middle WHERE {' AND '.join(f'{x} BETWEEN lo_{x} AND hi_{x}' for x in MOVIE_DIMS if x != 'budget')}"


@query(f"{hybrid_sql(WIDE)} {SHOWN}")
def hybrid_widened_dim(spark, d):
    f = Flagship(spark, d)
    dims = [x for x in MOVIE_DIMS if x != "budget"]
    keep = [i for i, x in enumerate(MOVIE_DIMS) if x != "budget"]
    return shown(similarity.hybrid(f.movies, "id", dims, [f.lo[i] for i in keep], [f.hi[i] for i in keep], f.queries))


@query(f"""{hybrid_sql()}, n AS (SELECT query_id, count(*) AS final_count FROM ranked GROUP BY query_id), w AS ({hybrid_sql(WIDE).split('ranked AS (', 1)[1].rsplit(')', 1)[0]}), nw AS (SELECT query_id, count(*) AS final_count FROM w GROUP BY query_id)
SELECT 'default' AS scheme, (SELECT count(*) FROM inside) AS tree_count, round(avg(final_count), 6) AS avg_final_count FROM n UNION ALL SELECT 'widened', (SELECT count(*) FROM ({WIDE})), round(avg(final_count), 6) FROM nw""")
def scheme_summary(spark, d):
    f = Flagship(spark, d)
    keep = [i for i, x in enumerate(MOVIE_DIMS) if x != "budget"]
    out = None
    for name, at in (("default", range(len(MOVIE_DIMS))), ("widened", keep)):
        dims, lo, hi = [MOVIE_DIMS[i] for i in at], [f.lo[i] for i in at], [f.hi[i] for i in at]
        inside = f.movies.filter(vectors.in_box(dims, lo, hi)).agg(F.count("*").alias("tree_count"))
        final = similarity.hybrid(f.movies, "id", dims, lo, hi, f.queries).groupBy("query_id").count().agg(F.round(F.avg("count"), 6).alias("avg_final_count"))
        row = inside.crossJoin(final).select(F.lit(name).alias("scheme"), "tree_count", "avg_final_count")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {MOVIES}, t AS (SELECT id, title, items, {tokens_sql(False)} AS tokens FROM movies), {signatures_sql()}, {BANDS_SQL},
picked AS (SELECT id FROM t ORDER BY md5('42:' || id), id LIMIT 10), {CANDIDATES},
truth AS (SELECT x.id AS query_id, y.id FROM t x JOIN picked p ON p.id = x.id JOIN t y ON y.id <> x.id WHERE {JACCARD_SQL} >= 0.3),
f AS (SELECT * FROM found WHERE id <> query_id),
e AS (SELECT picked.id AS query_id, (SELECT count(*) FROM f WHERE f.query_id = picked.id) AS nf, (SELECT count(*) FROM truth WHERE truth.query_id = picked.id) AS nt, (SELECT count(*) FROM f JOIN truth USING (query_id, id) WHERE f.query_id = picked.id) AS tp FROM picked),
r AS (SELECT *, CASE WHEN nf = 0 THEN 0 ELSE tp / nf::DOUBLE END AS p, CASE WHEN nt = 0 THEN 0 ELSE tp / nt::DOUBLE END AS r FROM e),
g AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM r),
m AS (SELECT avg(p) AS mp, avg(r) AS mr, avg(f1) AS mf, sum(tp) AS tp, sum(nf) AS nf, sum(nt) AS nt, avg(nf) AS af, avg(nt) AS an, count(*) AS n FROM g),
o AS (SELECT *, CASE WHEN nf = 0 THEN 0 ELSE tp / nf::DOUBLE END AS up, CASE WHEN nt = 0 THEN 0 ELSE tp / nt::DOUBLE END AS ur FROM m)
SELECT round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(up, 6) AS micro_precision, round(ur, 6) AS micro_recall, round(CASE WHEN up + ur = 0 THEN 0 ELSE 2 * up * ur / (up + ur) END, 6) AS micro_f1,
round(af, 6) AS avg_lsh_candidates, round(an, 6) AS avg_ground_truth_similar, CAST(tp AS BIGINT) AS total_tp, CAST(nf - tp AS BIGINT) AS total_fp, CAST(nt - tp AS BIGINT) AS total_fn, n AS num_queries FROM o""")
def lsh_accuracy(spark, d):
    t = similarity.with_tokens(views.movies(spark, d), "companies", False)
    picked = stats.hash_sample(t.select("id"), "id", 10)
    s = similarity.with_signatures(t)
    q = s.join(F.broadcast(picked), "id", "left_semi")
    found = similarity.candidates(s, q, "id").filter("id <> query_id")
    asked = F.broadcast(q.select(F.col("id").alias("query_id"), F.col("tokens").alias("asked")))
    truth = t.join(asked, F.col("id") != F.col("query_id")).filter(text.jaccard(F.col("tokens"), F.col("asked")) >= 0.3).select("query_id", "id")
    return similarity.accuracy(found, truth, q.select(F.col("id").alias("query_id")))


# Results


@query("SELECT o_orderkey AS id, coalesce(c_name, 'Unknown') AS title FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def title_lookup(spark, d):
    names = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"))
    return results.with_titles(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key")), names, "key").select("id", "title")


def quoted(x: str) -> str:
    return f"to_json({x})"


ENTRY = "'{\"rank\":' || rank || ',\"movie_id\":' || id || ',\"similarity\":' || CAST(round_even(similarity, 4) AS VARCHAR) || ',\"title\":' || to_json(title) || '}'"
LISTED = f"titled AS (SELECT ranked.*, title FROM ranked JOIN movies USING (id)), listed AS (SELECT query_id, '[' || string_agg({ENTRY}, ',' ORDER BY rank) || ']' AS results, count(*) AS n FROM titled GROUP BY query_id), named AS (SELECT listed.*, title FROM listed JOIN movies ON movies.id = query_id)"


def result_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    f, rows = flagship_rows(spark, d)
    titles = f.movies.select("id", "title")
    return results.with_titles(rows, titles), titles.join(F.broadcast(f.picked.select("id")), "id", "left_semi").withColumnRenamed("id", "query_id")


@query(f"""{hybrid_sql()}, {LISTED} SELECT query_id, '{{"query":{{"movie_id":' || query_id || ',"title":' || to_json(title) || '}},"results":' || results || ',"metadata":{{"total_results":' || n || ',"include_titles":true,"include_tokens":false}}}}' AS document FROM named""")
def result_json_single(spark, d):
    rows, asked = result_rows(spark, d)
    return results.single(rows, asked)


@query(f"""{hybrid_sql()}, {LISTED} SELECT '{{"queries":[' || string_agg('{{"query_movie_id":' || query_id || ',"results":' || results || ',"query_title":' || to_json(title) || ',"total_results":' || n || '}}', ',' ORDER BY query_id) || '],"metadata":{{"total_queries":' || count(*) || ',"include_titles":true,"include_tokens":false}}}}' AS document FROM named""")
def result_json_batch(spark, d):
    rows, asked = result_rows(spark, d)
    return results.batch(rows, asked)


@query(f"""WITH {MOVIES}, r AS (SELECT id, title, popularity / 1000 AS similarity, row_number() OVER (ORDER BY popularity DESC, id) AS rank FROM movies QUALIFY rank <= 12)
SELECT '{{"results":[' || string_agg({ENTRY}, ',' ORDER BY rank) || '],"metadata":{{"total_results":' || count(*) || ',"has_titles":true}}}}' AS document FROM r""")
def result_json_simple(spark, d):
    """The dozen most popular rows, given as plain lists."""
    top = stats.top_k(views.movies(spark, d).select("id", "title", "popularity"), "popularity", "id", 12).collect()
    return results.simple(results.simple_rows(spark, [r["id"] for r in top], [r["popularity"] / 1000 for r in top], [r["title"] for r in top]), True)


@query(f"""{hybrid_sql()}, {LISTED} SELECT query_id, 'default' AS scheme, '{{"query":{{"movie_id":' || query_id || ',"title":' || to_json(title) || '}},"results":' || results || ',"metadata":{{"total_results":' || n || ',"include_titles":true,"include_tokens":false}}}}' AS document FROM named
UNION ALL SELECT -1, 'summary', '{{"queries":' || count(*) || ',"results":' || sum(n) || '}}' FROM listed""")
def result_files(spark, d):
    """Documents written by query and scheme and a summary, read back from their folders."""
    rows, asked = result_rows(spark, d)
    documents = results.single(rows, asked).withColumn("scheme", F.lit("default"))
    summary = rows.agg(F.to_json(F.struct(F.count_distinct("query_id").alias("queries"), F.count("*").alias("results"))).alias("document"))
    path = new_shared_path(spark, "results")
    tables.write_results(documents, summary, path)
    back = spark.read.text(f"{path}/results").select(F.col("query_id").cast("long").alias("query_id"), "scheme", F.col("value").alias("document"))
    return back.unionByName(spark.read.text(f"{path}/summary").select(F.lit(-1).cast("long").alias("query_id"), F.lit("summary").alias("scheme"), F.col("value").alias("document")))


# More of the surface


RAW = f"""{MOVIES}, raw AS (SELECT id, title, CASE WHEN id % 7 = 0 THEN 'n/a' WHEN id % 11 = 0 THEN NULL ELSE CAST(release_year AS INTEGER) || '-06-15' END AS release_date, CASE WHEN id % 5 = 0 THEN NULL ELSE budget END AS budget,
CASE WHEN id % 13 = 0 THEN NULL ELSE runtime END AS runtime, vote_average, vote_count, popularity, origin_country, CASE WHEN id % 17 = 0 THEN NULL ELSE original_language END AS original_language, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 = 0 END AS adult FROM movies),
cleaned AS (SELECT id, coalesce(title, 'Unknown') AS title, try_cast(release_date AS DATE) AS release_date, CAST(year(try_cast(release_date AS DATE)) AS INTEGER) AS release_year, coalesce(budget, 0) AS budget, coalesce(runtime, 0) AS runtime, vote_average, vote_count, popularity,
origin_country, coalesce(original_language, 'Unknown') AS original_language, coalesce(CAST(adult AS VARCHAR), 'Unknown') AS adult FROM raw WHERE try_cast(release_date AS DATE) IS NOT NULL),
kept AS (SELECT * FROM cleaned WHERE {BUSINESS})"""


def raw_movies(spark, d) -> DataFrame:
    m = views.movies(spark, d)
    missing = lambda c, n: F.when(F.col("id") % n != 0, F.col(c)).alias(c)
    date = F.when(F.col("id") % 7 == 0, "n/a").when(F.col("id") % 11 != 0, F.concat(F.col("release_year").cast("int").cast("string"), F.lit("-06-15")))
    return m.select("id", "title", date.alias("release_date"), missing("budget", 5), missing("runtime", 13), "vote_average", "vote_count", "popularity", "origin_country", missing("original_language", 17), F.when(F.col("id") % 3 != 0, F.col("id") % 2 == 0).alias("adult"))


SCALED_SQL = ", ".join(f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0::DOUBLE ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE END AS {c}" for c in ("budget", "runtime", "vote_average", "vote_count", "popularity"))


@query(f"WITH {RAW} SELECT id, title, strftime(release_date, '%Y-%m-%d') AS release_date, release_year, adult, {SCALED_SQL} FROM kept")
def load_and_process(spark, d):
    done = clean.load_and_process(raw_movies(spark, d), apply_filter=True)
    return done.select("id", "title", F.col("release_date").cast("string").alias("release_date"), "release_year", "adult", "budget", "runtime", "vote_average", "vote_count", "popularity")


@query(f"WITH {RAW} SELECT id, adult, coalesce(release_date, 'Unknown') AS release_date, budget IS NULL AS was_null FROM (SELECT id, coalesce(CAST(adult AS VARCHAR), 'Unknown') AS adult, release_date, budget FROM raw)")
def fill_by_class(spark, d):
    raw = raw_movies(spark, d).withColumn("was_null", F.col("budget").isNull())
    return clean.fill_nulls(raw).select("id", "adult", "release_date", "was_null")


@query(f"WITH {RAW} SELECT (SELECT count(*) FROM raw) AS rows_in, (SELECT count(*) FROM kept) AS rows_out, round(100.0::DOUBLE * (SELECT count(*) FROM kept) / (SELECT count(*) FROM raw), 4) AS retention_pct, (SELECT count(*) FROM kept) AS rows_written")
def save_preprocessed(spark, d):
    path = new_shared_path(spark, "preprocessed")
    kept = clean.save_preprocessed(raw_movies(spark, d), path)
    return kept.crossJoin(spark.read.option("header", True).option("escape", '"').csv(path).agg(F.count("*").alias("rows_written")))


@query(f"WITH {MOVIES} SELECT id, title, popularity, budget FROM movies")
def matrix_reference_round_trip(spark, d):
    path = new_shared_path(spark, "matrix")
    tables.write_matrix(views.movies(spark, d), path, ["popularity", "budget"])
    return spark.read.parquet(f"{path}/matrix").join(spark.read.schema("id long, title string").option("header", True).option("escape", '"').csv(f"{path}/reference"), "id")


@query(bounds_sql(0).replace("h + 0 AS hi", "h + 0 + 0.001::DOUBLE AS hi"))
def bounds_above(spark, d):
    return point_table(spark, d).bounds(0, above=0.001)


@query("WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'Unknown' ELSE text END AS text FROM documents) SELECT doc_id FROM t WHERE text IS NOT NULL AND text <> '' AND text <> 'Unknown'")
def nonempty_text(spark, d):
    shown = F.when(F.col("doc_id") % 5 != 0, F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 == 0, "Unknown").otherwise(F.col("text")))
    return table(spark, d, "documents").select("doc_id", shown.alias("text")).filter(text.has_text(F.col("text"))).select("doc_id")


TOLERANT = " AND ".join(f"abs({x} - {p}::DOUBLE) <= 0.01::DOUBLE + 0.3::DOUBLE * abs({p}::DOUBLE)" for x, p in zip(DIMS, AT, strict=True))


@query(f"WITH {POINTS} SELECT {K}, {P} FROM points WHERE {TOLERANT}")
def near_point_tolerance(spark, d):
    return point_table(spark, d).at_point(AT, rtol=0.3, atol=0.01).select(*KEY, *DIMS)


@query(f"WITH {MOVIES}, t AS (SELECT id, {tokens_sql(True)} AS tokens FROM movies) SELECT id, CAST(len(tokens) AS INTEGER) AS n_tokens, row_number() OVER (ORDER BY len(tokens) DESC, id) - 1 AS nth FROM t QUALIFY nth % greatest(1, (SELECT count(*) FROM t) // 7) = 0 ORDER BY nth LIMIT 7")
def queries_of_empty_box(spark, d):
    """A box that holds no row: the queries are chosen among all."""
    movies = similarity.with_tokens(views.movies(spark, d), "companies", True)
    return similarity.choose_queries(movies, movies.filter(vectors.in_box(["budget"], [-2.0], [-1.0])), "id", 7)


@query(f"{SIGNED}, picked AS (SELECT min(id) AS id FROM sig), {BANDS_SQL}, {CANDIDATES}, {SCORED} SELECT query_id, id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM scored WHERE id <> query_id QUALIFY rank <= 5")
def similar_to_default(spark, d):
    """No query named: the row of least key is asked for."""
    return similarity.similar_to(written(signed(spark, d).select("id", "signature"), "signatures"), "id", top_n=5)


@query(f"WITH {MOVIES}, t AS (SELECT id, title, items, {tokens_sql(True)} AS tokens FROM movies), {signatures_sql(256)} SELECT id, signature FROM sig")
def minhash_signature_256(spark, d):
    return similarity.with_signatures(similarity.with_tokens(views.movies(spark, d), "companies", True), 256).select("id", "signature")


@query(f"WITH {POINTS} SELECT 'kdtree' AS layout, 5 AS dimensions, '{','.join(DIMS)}' AS names, count(*) AS rows, count(*) AS points, count(DISTINCT ({P})) AS distinct_points FROM points")
def describe_layout(spark, d):
    return PointTable(views.points(spark, d), KEY, DIMS, "kdtree").describe()


@query(f"WITH {MOVIES} SELECT id, title FROM movies ORDER BY id LIMIT 100")
def prefix_slice(spark, d):
    return stats.first_rows(views.movies(spark, d).select("id", "title"), ["id"], 100)


@query("WITH g AS (SELECT event_type, count(*) AS n, CAST(sum(user_id % 2) AS BIGINT) AS seconds FROM events GROUP BY event_type) SELECT event_type, n, CASE WHEN seconds > 0 THEN n / seconds::DOUBLE ELSE 0 END AS rate FROM g UNION ALL SELECT event_type, n, 0 FROM g")
def throughput_rates(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("user_id") % 2).alias("seconds"))
    g = g.unionByName(g.withColumn("seconds", F.lit(0).cast("long")))
    return g.select("event_type", "n", stats.throughput(F.col("n"), F.col("seconds").cast("double")).alias("rate"))


# Changes

CUSTOMER_POINTS = "pts AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)"


def customer_points(spark, d) -> PointTable:
    return PointTable(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y")), ("id",), ("x", "y"))


@query(f"WITH {CUSTOMER_POINTS} SELECT id, x, y FROM pts UNION ALL SELECT -s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) FROM supplier")
def points_insert(spark, d):
    return customer_points(spark, d).insert(table(spark, d, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))).df


@query(f"WITH {CUSTOMER_POINTS} SELECT id, x, y FROM pts QUALIFY NOT (row_number() OVER (PARTITION BY y ORDER BY id) <= 2 AND y < 10)")
def points_delete(spark, d):
    gone = spark.range(20).select((F.col("id") % 10).cast("double").alias("y"))
    return customer_points(spark, d).delete(gone).df


@query(f"WITH {CUSTOMER_POINTS} SELECT y, 2 AS asked, least(2, count(id)) AS found FROM (SELECT unnest(range(0, 40, 4))::DOUBLE AS y) a LEFT JOIN pts USING (y) GROUP BY y")
def points_delete_found(spark, d):
    """How many of the rows that a deletion asks for are there."""
    gone = spark.range(20).select((F.col("id") % 10 * 4).cast("double").alias("y"))
    return customer_points(spark, d).matched(gone)


@query(f"WITH {CUSTOMER_POINTS} SELECT id, x, y FROM pts QUALIFY y >= 3 OR row_number() OVER (PARTITION BY x, y ORDER BY id) > 1 UNION ALL SELECT -id, x, y + 50 FROM (SELECT * FROM pts WHERE y < 3 QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY id) = 1)")
def points_update_payload(spark, d):
    """A change that brings a new key along; one that matches nothing changes nothing."""
    t = customer_points(spark, d)
    own = t.df.filter("y < 3").groupBy("x", "y").agg(F.min("id").alias("id")).select("x", "y", F.col("x").alias("new_x"), (F.col("y") + 50).alias("new_y"), (-F.col("id")).alias("new_id"))
    return t.update(own.unionByName(spark.createDataFrame([(-1e9, -1.0, 0.0, 0.0, 0)], "x double, y double, new_x double, new_y double, new_id long"))).df


@query(f"WITH {CUSTOMER_POINTS}, o AS (SELECT x, y FROM pts WHERE y < 3) SELECT id, CASE WHEN y < 3 AND row_number() OVER (PARTITION BY x, y ORDER BY id) = 1 THEN x + 1 ELSE x END AS x, CASE WHEN y < 3 AND row_number() OVER (PARTITION BY x, y ORDER BY id) = 1 THEN y + 100 ELSE y END AS y FROM pts")
def points_update(spark, d):
    t = customer_points(spark, d)
    changes = t.df.filter("y < 3").select("x", "y", (F.col("x") + 1).alias("new_x"), (F.col("y") + 100).alias("new_y"))
    return t.update(changes).df


@query(f"WITH {POINTS} SELECT CAST(floor(quantity / 10.0) AS BIGINT) AS cell_quantity, CAST(floor(price / 20000.0) AS BIGINT) AS cell_price, count(*) AS rows, " + ", ".join(f"min({x}) AS min_{x}, max({x}) AS max_{x}" for x in DIMS) + " FROM points GROUP BY 1, 2")
def layout_stats(spark, d):
    return point_table(spark, d).cells([10.0, 20000.0])


@query(f"WITH {POINTS} SELECT {K}, {P}, l_returnflag FROM points WHERE {BOX}")
def clustered_range_query(spark, d):
    """The box on a table written in Morton order."""
    path = new_shared_path(spark, "clustered")
    point_table(spark, d).clustered(path, partitions=8)
    return PointTable(spark.read.parquet(path), KEY, DIMS).range_query(LO, HI)


# Streams


@query(RANGE_JOIN)
def stream_box_filter(spark, d):
    """The boxes on line items read as a stream, each batch appended to a table."""
    from nearbox.streaming.index import box_filter

    schema = table(spark, d, "lineitem").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    stream = raw.select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    path = new_shared_path(spark, "stream")
    found = box_filter(stream, views.boxes(spark), ["quantity", "price"])
    found.select("query_id", "l_orderkey", "price").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return by_box(spark.read.schema("query_id long, l_orderkey long, price double").parquet(f"{path}/out"))


@query(f"{SIGNED}, {BANDS_SQL} SELECT id, CAST(band AS INTEGER) AS band, band_key FROM bands")
def stream_lsh_index(spark, d):
    """The LSH index, appended from a stream of texts."""
    from nearbox.streaming.index import append_bands

    path = new_shared_path(spark, "stream-index")
    tables.write_vectors(views.movies(spark, d).select("id", "companies"), f"{path}/in")
    stream = spark.readStream.schema("id long, companies string").parquet(f"{path}/in")
    append_bands(stream, "id", "companies", f"{path}/index", f"{path}/state").awaitTermination()
    return spark.read.schema("id long, band int, band_key array<bigint>").parquet(f"{path}/index").select("id", "band", "band_key")
