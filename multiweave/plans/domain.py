"""Queries of the domain operators, each built by its operator, with the SQL that checks it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, scalar
from ..operators import documents, fulltext, geosearch, graph, joins, knn, policy, series, stats, temporal
from ..schema import TableSchema
from ..session import read
from ..sources import foreign, transfer
from ..streaming import changes, views, windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


# ------------------------------------------------------------------ time series: a series for each kind of event

_MS = "(epoch_us(ts) // 1000)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("series"), scalar.epoch_ms(F.col("ts")).alias("timestamp_millis"), "value", "event_id")


@query(f"SELECT event_type AS series, {_MS} // 3600000 * 3600000 AS bucket, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def ts_time_bucket(spark, d):
    return series.downsample(_points(spark, d), 3_600_000).select("series", "bucket", "n", "low", "high")


@query("SELECT -1 - ((-1 % 1000) + 1000) % 1000 AS before, 1000 AS after, 0 AS at")
def ts_bucket_negative(spark, d):
    return spark.range(1).select(scalar.time_bucket(1000, F.lit(-1).cast("long")).cast("int").alias("before"), scalar.time_bucket(1000, F.lit(1500).cast("long")).cast("int").alias("after"), scalar.time_bucket(1000, F.lit(0).cast("long")).cast("int").alias("at"))


@query(f"SELECT event_type AS series, {_MS} AS timestamp_millis, value, event_id FROM events WHERE event_type = 'click' AND {_MS} >= 1704412800000 AND {_MS} < 1705017600000")
def ts_range(spark, d):
    return series.ts_range(_points(spark, d), "click", 1_704_412_800_000, 1_705_017_600_000)


@query(f"SELECT event_type AS series, max({_MS}) AS timestamp_millis, arg_max(value, {_MS}) AS value FROM events GROUP BY 1")
def ts_latest(spark, d):
    return series.latest(_points(spark, d))


@query(f"WITH p AS (SELECT event_type AS series, {_MS} AS timestamp_millis, value, event_id FROM events), m AS (SELECT series, max(timestamp_millis) AS newest FROM p GROUP BY 1) SELECT p.* FROM p JOIN m USING (series) WHERE timestamp_millis // 86400000 >= (newest - 604800000) // 86400000")
def ts_retention(spark, d):
    return series.retain(_points(spark, d), 7 * 86_400_000, 86_400_000)


@query(f"SELECT event_type AS series, {_MS} // 60000 * 60000 AS timestamp_millis, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def ts_dedup_upsert(spark, d):
    return series.upsert(_points(spark, d).withColumn("timestamp_millis", scalar.time_bucket(60_000, F.col("timestamp_millis"))), order="event_id")


@query()
def ts_codec_stats(spark, d):
    return series.codec_stats(_points(spark, d), 86_400_000)


@query(f"WITH h AS (SELECT event_type AS series, {_MS} // 21600000 * 21600000 AS bucket, arg_max(value, {_MS}) AS value FROM events GROUP BY 1, 2), e AS (SELECT series, unnest(range(min(bucket), max(bucket) + 1, 21600000)) AS bucket FROM h GROUP BY series) SELECT series, bucket, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY bucket) AS value FROM e LEFT JOIN h USING (series, bucket)")
def ts_gap_fill(spark, d):
    return series.gap_fill(_points(spark, d), 21_600_000)


@query(f"WITH p AS (SELECT user_id, {_MS} AS t, value FROM events) SELECT user_id AS series, t AS timestamp_millis, value, round((value - lag(value) OVER w) * 1000 / (t - lag(t) OVER w), 6) + 0.0 AS rate FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def ts_rate(spark, d):
    points = read(spark, d, "events").select(F.col("user_id").alias("series"), scalar.epoch_ms(F.col("ts")).alias("timestamp_millis"), "value")
    return series.rate(points).withColumn("rate", F.round("rate", 6) + 0.0)


# ------------------------------------------------------------------ text

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(f"SELECT doc_id AS id, term, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)) GROUP BY 1, 2")
def text_tokenize(spark, d):
    return fulltext.postings(read(spark, d, "documents"), id_col="doc_id", text_col="text")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1")
def text_df(spark, d):
    return fulltext.postings(read(spark, d, "documents"), id_col="doc_id", text_col="text").groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH t AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1), n AS (SELECT count(*) AS n FROM documents) SELECT term, round(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)), 6) AS idf FROM t, n")
def text_idf(spark, d):
    docs = read(spark, d, "documents")
    df = fulltext.postings(docs, id_col="doc_id", text_col="text").groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(fulltext.corpus_stats(docs, id_col="doc_id", text_col="text"))).select("term", F.round(fulltext.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(f"SELECT count(*) AS n_docs, greatest(1.0, avg(len({_TOKENS}))) AS avg_len FROM documents WHERE trim(text) <> ''")
def text_index_stats(spark, d):
    return fulltext.corpus_stats(read(spark, d, "documents"), id_col="doc_id", text_col="text")


def _bm25(terms: list[str], k: int) -> str:
    asked = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE trim(text) <> ''), c AS (SELECT count(*) AS n, greatest(1.0, avg(len(w))) AS a FROM w),
q AS (SELECT term, count(*) AS times FROM (VALUES {asked}) AS v(term) GROUP BY 1), p AS (SELECT doc_id, len(w) AS l, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) GROUP BY ALL),
h AS (SELECT p.*, times FROM p JOIN q USING (term)), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id AS id, round(sum(times * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN f USING (term), c GROUP BY 1 ORDER BY score DESC, id LIMIT {k}"""


@query(_bm25(["license", "version", "idiot", "version"], 20))
def text_bm25_topk(spark, d):
    return fulltext.bm25(read(spark, d, "documents"), "license VERSION idiot version", id_col="doc_id", text_col="text", limit=20).select("id", F.round("score", 6).alias("score"))


@query(_bm25(["license", "general"], 15))
def text_index_search(spark, d):
    docs = read(spark, d, "documents")
    index, lengths = fulltext.postings(docs, id_col="doc_id", text_col="text"), fulltext.lengths(docs, id_col="doc_id", text_col="text")
    return fulltext.search(index, fulltext.stats_of(lengths), "License; general", limit=15).select("id", F.round("score", 6).alias("score"))


@query(_bm25(["license", "general"], 15).replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'the general license, and more' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"))
def text_index_incremental(spark, d):
    """An index of old texts, brought up to date by the changed documents alone: a third have new texts, a fifth are gone."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    old = fulltext.postings(docs, id_col="doc_id", text_col="text"), fulltext.lengths(docs, id_col="doc_id", text_col="text")
    changed = docs.filter("doc_id % 3 = 0 or doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.lit("the general license, and more")).alias("text"))
    index, lengths = fulltext.refresh(*old, changed, id_col="doc_id", text_col="text")
    return fulltext.search(index, fulltext.stats_of(lengths), "License; general", limit=15).select("id", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ vectors

_D = "list_transform(embedding, lambda x: x::DOUBLE)"


def _first(spark, d) -> list[float]:
    return list(read(spark, d, "embeddings").filter("vec_id = 7").first()["embedding"])


@query(f"WITH e AS (SELECT vec_id, {_D} AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 7) SELECT vec_id, round(1 - list_cosine_similarity(v, q), 6) AS distance FROM e, q ORDER BY 1 - list_cosine_similarity(v, q), vec_id LIMIT 10")
def vec_cosine_knn(spark, d):
    return knn.knn(read(spark, d, "embeddings"), _first(spark, d), 10, id_col="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH e AS (SELECT vec_id, {_D} AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 7) SELECT vec_id, round(list_distance(v, q), 6) AS distance FROM e, q ORDER BY list_distance(v, q), vec_id LIMIT 10")
def vec_l2_knn(spark, d):
    return knn.knn(read(spark, d, "embeddings"), _first(spark, d), 10, id_col="vec_id", metric="l2").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH e AS (SELECT vec_id, label, {_D} AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 7) SELECT vec_id, round(list_distance(v, q), 6) AS distance FROM e, q WHERE label = 3 ORDER BY list_distance(v, q), vec_id LIMIT 5")
def vec_filtered_knn(spark, d):
    return knn.knn(read(spark, d, "embeddings"), _first(spark, d), 5, id_col="vec_id", metric="l2", where=F.col("label") == 3).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH e AS (SELECT vec_id, {_D} AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(e.v, q.v) AS distance FROM e, e q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) SELECT query_id, id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5")
def vec_batch_knn(spark, d):
    e = read(spark, d, "embeddings")
    return knn.knn_join(e.filter("vec_id % 50 = 0"), e, 5, query_id="vec_id", id_col="vec_id", metric="l2").withColumn("distance", F.round("distance", 6))


_AWAY = "CASE WHEN {0} < 0 THEN -floor(-({0}) + 0.5) ELSE floor(({0}) + 0.5) END"


@query(f"SELECT vec_id, array_to_string(list_transform({_D}, lambda x: CAST({_AWAY.format('x / m * 127')} AS INT)), ',') AS q FROM (SELECT vec_id, embedding, list_max(list_transform({_D}, lambda x: abs(x))) AS m FROM embeddings)")
def vec_scalar_quantize(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.array_join(scalar.scalar_quantize(F.col("embedding")).cast("array<string>"), ",").alias("q"))


@query(f"SELECT vec_id, array_to_string(list_transform(range(16), lambda i: CAST({_AWAY.format(f'list_sum(list_slice({_D}, i * 4 + 1, i * 4 + 4)) / 4 * 16')} AS INT)), ',') AS q FROM embeddings")
def vec_product_quantize(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.array_join(scalar.product_quantize(F.col("embedding"), 16).cast("array<string>"), ",").alias("q"))


@query("SELECT vec_id, 4 * len(embedding) AS plain, len(embedding) AS scalar, CAST(16 AS BIGINT) AS product FROM embeddings")
def vec_quantized_length(spark, d):
    n = F.size("embedding")
    return read(spark, d, "embeddings").select("vec_id", scalar.quantized_length(n, "none").alias("plain"), scalar.quantized_length(n, "scalar").alias("scalar"), scalar.quantized_length(n, "product", 16).alias("product"))


@query("SELECT vec_id, CAST(4 * len(embedding) AS BIGINT) AS bytes, true AS same FROM embeddings")
def vec_bytes_codec(spark, d):
    coded = read(spark, d, "embeddings").withColumn("b", scalar.vector_to_bytes("embedding"))
    return coded.select("vec_id", F.octet_length("b").cast("long").alias("bytes"), (scalar.vector_from_bytes("b") == F.col("embedding")).alias("same"))


@query(ORACLE["vec_cosine_knn"])
def vec_knn_invalid_rows(spark, d):
    """Stored vectors that are null, zero, too short or not finite are no candidates, and raise nothing."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    bad = spark.createDataFrame([(-1, None), (-2, [0.0] * 64), (-3, [1.0] * 3), (-4, [float("nan")] + [1.0] * 63), (-5, [None] + [1.0] * 63), (-6, [float("inf")] * 64)], "vec_id long, embedding array<float>")
    return knn.knn(e.unionByName(bad), _first(spark, d), 10, id_col="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query()
def vec_lsh_knn(spark, d):
    return knn.lsh_knn(read(spark, d, "embeddings"), _first(spark, d), 10, id_col="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


# ------------------------------------------------------------------ places: made from customers' keys

_PLACE = "(SELECT c_custkey AS id, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 17 % 1700) / 10.0 - 85 AS lat FROM customer)"
_HAV = "2 * 6371000 * asin(sqrt(pow(sin(radians(lat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin(radians(lon - ({lon})) / 2), 2)))"


def _places(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 3600 / 10.0 - 180).alias("lon"), (F.col("c_custkey") * 17 % 1700 / 10.0 - 85).alias("lat"))


@query(f"SELECT id, round({_HAV.format(lon=21.0122, lat=52.2297)}, 3) AS m FROM {_PLACE}")
def geo_haversine(spark, d):
    return _places(spark, d).select("id", F.round(geo.haversine_m(F.lit(21.0122), F.lit(52.2297), F.col("lon"), F.col("lat")), 3).alias("m"))


@query(f"SELECT id, round({_HAV.format(lon=21.0122, lat=52.2297)}, 3) AS distance_meters FROM {_PLACE} WHERE {_HAV.format(lon=21.0122, lat=52.2297)} <= 5000000")
def geo_within_radius(spark, d):
    return geosearch.within_radius(_places(spark, d), 21.0122, 52.2297, 5_000_000).select("id", F.round("distance_meters", 3).alias("distance_meters"))


@query(f"SELECT id, round({_HAV.format(lon=0.0, lat=89.5)}, 3) AS distance_meters FROM {_PLACE} WHERE {_HAV.format(lon=0.0, lat=89.5)} <= 1500000")
def geo_radius_pole(spark, d):
    return geosearch.within_radius(_places(spark, d), 0.0, 89.5, 1_500_000).select("id", F.round("distance_meters", 3).alias("distance_meters"))


@query(f"SELECT id, round({_HAV.format(lon=15.0, lat=25.0)}, 3) AS distance_meters FROM {_PLACE} WHERE lon BETWEEN -10 AND 40 AND lat BETWEEN 5 AND 45")
def geo_within_bbox(spark, d):
    return geosearch.within_bbox(_places(spark, d), -10, 5, 40, 45).select("id", F.round("distance_meters", 3).alias("distance_meters"))


@query(f"SELECT id, round({_HAV.format(lon=180.0, lat=0.0)}, 3) AS distance_meters FROM {_PLACE} WHERE (lon >= 170 OR lon <= -170) AND lat BETWEEN -30 AND 30")
def geo_antimeridian(spark, d):
    return geosearch.within_bbox(_places(spark, d), 170, -30, -170, 30).select("id", F.round("distance_meters", 3).alias("distance_meters"))


@query(f"SELECT id, CAST(floor((lon + 180) * 100) AS BIGINT) || ':' || CAST(floor((lat + 90) * 100) AS BIGINT) AS cell FROM (SELECT id, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM {_PLACE})")
def geo_cell(spark, d):
    at = _places(spark, d).select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    return at.select("id", geo.cell(F.col("lon"), F.col("lat"), 2).alias("cell"))


# ------------------------------------------------------------------ graphs: customers' orders, and nations in regions

_EDGES = "(SELECT DISTINCT 'c' || o_custkey AS src, 'bought' AS label, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT DISTINCT 's' || l_suppkey, 'sold', 'c' || o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


#: Nodes that a search may reach here: all.
WHOLE = 1 << 62


def _edges(spark, d) -> DataFrame:
    pairs = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    c, s = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey")
    return pairs.select(c.alias("src"), F.lit("bought").alias("label"), s.alias("dst")).distinct().unionByName(pairs.select(s.alias("src"), F.lit("sold").alias("label"), c.alias("dst")).distinct())


@query(f"SELECT DISTINCT dst AS node FROM {_EDGES} WHERE src = 'c1' AND label = 'bought'")
def graph_neighbors(spark, d):
    return graph.neighbors(_edges(spark, d), "c1", "bought")


@query(f"WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES}), r(node, depth) AS (SELECT 'c1', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY node HAVING node <> 'c1'")
def graph_k_hop(spark, d):
    return graph.k_hop(_edges(spark, d), "c1", max_depth=2, max_expansion=WHOLE)


@query(f"WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES}), r(node, depth) AS (SELECT 'c2', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT CAST(min(depth) AS INT) AS steps FROM r WHERE node = 'c51'")
def graph_shortest_path_len(spark, d):
    path = graph.shortest_path(_edges(spark, d), "c2", "c51", max_expansion=WHOLE)
    return spark.createDataFrame([(None if path is None else len(path) - 1,)], "steps int")


@query(f"SELECT src, label, dst FROM {_EDGES} WHERE NOT (label = 'sold' AND src = 's1')")
def graph_delete_edges(spark, d):
    e = _edges(spark, d)
    return graph.delete_edges(e, e.filter("label = 'sold' and src = 's1'"))


# ------------------------------------------------------------------ documents: the JSON of events and conversations


def _docs(spark, d) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.struct("event_type", "value").alias("what"))).alias("doc"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, value AS v FROM events")
def doc_project(spark, d):
    f = documents.DocField
    return documents.project(_docs(spark, d), [f("id", None), f("k", "k", "int"), f("kind", "what.event_type", "str"), f("v", "what.value", "float")])


@query("SELECT event_id AS id FROM events WHERE event_type = 'error'")
def doc_eq(spark, d):
    return documents.find(_docs(spark, d), documents.eq(F.col("doc"), "what.event_type", "error")).select("id")


@query("SELECT event_id AS id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 19")
def doc_range(spark, d):
    return documents.find(_docs(spark, d), documents.between(F.col("doc"), "k", 10, 20)).select("id")


@query("SELECT event_id AS id, CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS DOUBLE) AS wrong FROM events")
def doc_missing_is_null(spark, d):
    f = documents.DocField
    return documents.project(_docs(spark, d), [f("id", None), f("missing", "what.nothing", "str"), f("wrong", "k", "float")])


@query("SELECT c.c_custkey, c.c_name, count(*) AS n FROM events e JOIN customer c ON CAST(json_extract_string(e.props, '$.k') AS BIGINT) = c.c_custkey GROUP BY ALL")
def doc_join_table(spark, d):
    own = documents.project(_docs(spark, d), [documents.DocField("k", "k", "int")])
    return own.join(read(spark, d, "customer"), F.col("k") == F.col("c_custkey")).groupBy("c_custkey", "c_name").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id FROM events ORDER BY event_id LIMIT 20 OFFSET 40")
def doc_scan_page(spark, d):
    return documents.page(_docs(spark, d), 40, 20).select("id")


# ------------------------------------------------------------------ history, change streams and views: events as a change log of users

_LOG = "(SELECT event_id AS lsn, epoch_us(ts) // 1000 AS \"at\", CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, user_id AS key, event_type AS kind, value FROM events)"


def _log(spark, d) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("lsn"), scalar.epoch_ms(F.col("ts")).alias("at"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "value")


_AS_OF = f"SELECT key, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM {_LOG} WHERE lsn <= {{}}) WHERE r = 1 AND op <> 'delete'"


@query(_AS_OF.format(600))
def hist_as_of(spark, d):
    return temporal.as_of(_log(spark, d), "key", 600)


@query(_AS_OF.format(f"(SELECT max(lsn) FROM {_LOG} WHERE \"at\" <= 1705000000000)"))
def hist_as_of_time(spark, d):
    log = _log(spark, d)
    return temporal.as_of(log, "key", temporal.lsn_at(log, 1_705_000_000_000))


@query(f"SELECT key, kind, value, valid_from_lsn, valid_to_lsn, valid_from, valid_to FROM (SELECT *, lsn AS valid_from_lsn, lead(lsn) OVER w AS valid_to_lsn, \"at\" AS valid_from, lead(\"at\") OVER w AS valid_to FROM {_LOG} WINDOW w AS (PARTITION BY key ORDER BY lsn)) WHERE op <> 'delete'")
def hist_versions(spark, d):
    return temporal.history(_log(spark, d), "key")


@query(f"WITH c AS (SELECT * FROM {_LOG} WHERE lsn > 100 ORDER BY lsn LIMIT 50) SELECT lsn, \"at\", 'users' AS target, op, CAST(key AS VARCHAR) AS key, op AS kind FROM c UNION ALL SELECT lsn, \"at\", NULL, 'begin', NULL, 'begin' FROM c UNION ALL SELECT lsn, \"at\", NULL, 'commit', NULL, 'commit' FROM c")
def cdc_page(spark, d):
    return changes.page(_log(spark, d).withColumn("target", F.lit("users")), 100, max_commits=50)[0]


@query(f"SELECT key, lsn, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM {_LOG}) WHERE r = 1")
def cdc_net_changes(spark, d):
    return changes.net_changes(_log(spark, d)).select("key", "lsn", "op")


_VIEW = views.View("by_kind", "users", "key", "kind", (("count", None), ("sum", "value"), ("avg", "value")))
_MV = "SELECT kind, count(*) AS count, round(sum(value), 4) AS sum_value, round(avg(value), 4) AS avg_value FROM ({}) GROUP BY kind"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("kind", "count", F.round("sum_value", 4).alias("sum_value"), F.round("avg_value", 4).alias("avg_value"))


@query(_MV.format(_AS_OF.format(500)))
def mv_count_sum_avg(spark, d):
    return _rounded(views.recompute(temporal.as_of(_log(spark, d), "key", 500), _VIEW))


@query(_MV.format(_AS_OF.format("(SELECT max(lsn) FROM " + _LOG + ")")))
def mv_after_updates(spark, d):
    """The view of half the log, kept up by the other half in two batches."""
    log = _log(spark, d)
    rows, groups = views.initial(temporal.as_of(log, "key", 400), _VIEW)
    for a, b in ((400, 700), (700, 1 << 60)):
        rows, groups = views.apply(rows, groups, log.filter((F.col("lsn") > a) & (F.col("lsn") <= b)), _VIEW)
    return _rounded(views.result(groups, _VIEW))


# ------------------------------------------------------------------ streams: events read as a stream, run to their end


def _streamed(spark, d, build, mode: str = "append") -> DataFrame:
    """What a streaming query has written once it has taken all files: into a table of files, in the shared folder where there is one."""
    import uuid

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"{named or tempfile.mkdtemp()}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")
    out = build(source)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    writer = out.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    writer.start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.schema(out.schema).parquet(f"{base}/out/*")


def _count_top() -> list:
    return [F.count("*").alias("n"), F.max("value").alias("top")]



@query("SELECT event_type, count(*) AS n, max(value) AS top, epoch_us(ts) // 3600000000 * 3600 AS start FROM events GROUP BY event_type, start")
def stream_tumbling(spark, d):
    out = _streamed(spark, d, lambda s: windows.tumbling(s, at="ts", size="1 hour", keys=["event_type"], aggregates=_count_top()), "complete")
    return out.select("event_type", "n", "top", F.unix_seconds("window_start").alias("start"))


@query("WITH s AS (SELECT user_id, epoch_us(ts) AS t, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS grp FROM s) SELECT user_id, count(*) AS n, max(value) AS top, min(t) AS start FROM g GROUP BY user_id, grp")
def stream_session(spark, d):
    out = _streamed(spark, d, lambda s: windows.sessions(s, at="ts", gap="6 hours", keys=["user_id"], aggregates=_count_top()), "complete")
    return out.select("user_id", "n", "top", F.unix_micros("window_start").alias("start"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return _streamed(spark, d, lambda s: s.dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_mv(spark, d):
    return _streamed(spark, d, lambda s: s.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), "complete")


@query("SELECT event_type, count(*) AS n, to_timestamp(0) + INTERVAL 1 MINUTE * (w * 30) AS ws FROM (SELECT event_type, unnest([epoch_us(ts) // 1800000000, epoch_us(ts) // 1800000000 - 1]) AS w FROM events) GROUP BY event_type, w".replace("to_timestamp(0) + INTERVAL 1 MINUTE * (w * 30) AS ws", "w * 1800 AS start"))
def window_sliding(spark, d):
    out = windows.sliding(read(spark, d, "events"), at="ts", size="1 hour", step="30 minutes", keys=["event_type"], aggregates=[F.count("*").alias("n")])
    return out.select("event_type", "n", F.unix_seconds("window_start").alias("start"))


# ------------------------------------------------------------------ joins that need help


@query("WITH r AS (SELECT p_partkey AS rid, p_retailprice AS low, p_retailprice + 0.5 AS high FROM part) SELECT o_orderkey, rid FROM orders JOIN r ON o_totalprice / 100 >= low AND o_totalprice / 100 < high")
def join_range_bins(spark, d):
    points = read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("at"))
    ranges = read(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 0.5).alias("high"))
    return joins.range_join(points, ranges, at="at", low="low", high="high", width=0.5).select("o_orderkey", "rid")


@query("WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, event_id AS click_id, value AS click_value FROM events WHERE event_type = 'click') SELECT p.user_id, p.event_id, p.value, c.click_id, c.click_value FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts")
def join_asof(spark, d):
    e = read(spark, d, "events")
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    c = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("cts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return joins.asof_join(p, c, key="user_id", left_at="ts", right_at="cts", value=["click_id", "click_value"]).drop("ts")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_salted(spark, d):
    big = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"))
    return joins.salted_join(big, read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_two_step(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", "l_suppkey")
    return joins.distinct_count(rows, ["l_returnflag"], "l_suppkey", "suppliers")


@query()
def agg_approximate(spark, d):
    """Approximate aggregates against exact ones. Its SQL is with the relational queries; in one aggregation, Spark would carry the sketches with each distinct key."""
    rows, flag = read(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity"), "l_returnflag"
    sketches = rows.groupBy(flag).agg(F.approx_count_distinct("l_orderkey", 0.01).alias("some"), F.percentile_approx("l_quantity", 0.5, 10000).alias("near"), F.count("*").alias("n"))
    distinct = joins.distinct_count(rows, [flag], "l_orderkey", "every").withColumnRenamed(flag, "__f")
    counts = rows.groupBy(flag, "l_quantity").agg(F.count("*").alias("times"))
    middle = counts.groupBy(F.col(flag).alias("__g")).agg(F.percentile("l_quantity", 0.5, F.col("times")).alias("median"))
    both = sketches.join(distinct, F.col(flag).eqNullSafe(F.col("__f"))).join(middle, F.col(flag).eqNullSafe(F.col("__g")))
    return both.select(flag, (F.abs(F.col("some") / F.col("every") - 1) < 0.05).alias("near_distinct"), (F.abs(F.col("near") - F.col("median")) <= 1).alias("near_median"), "n")


# ------------------------------------------------------------------ foreign tables and transfer


def _folder(spark, name: str) -> str:
    import uuid

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp()}/{name}-{uuid.uuid4().hex}"


_CUSTOMER = TableSchema.of("c_custkey", c_custkey="int!", c_name="str", c_acctbal="float", c_mktsegment="str")
_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


def _customers(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(*_CUSTOMER.names)


@query(f"{_CUSTOMER_SQL} WHERE c_acctbal > 5000")
def foreign_csv(spark, d):
    transfer.export_csv(_customers(spark, d), path := _folder(spark, "csv"))
    return foreign.read(spark, foreign.ForeignTable(_CUSTOMER, "csv", path, {"header": True})).filter("c_acctbal > 5000")


@query(f"{_CUSTOMER_SQL} WHERE c_mktsegment = 'BUILDING'")
def foreign_jsonl(spark, d):
    transfer.export_jsonl(_customers(spark, d), path := _folder(spark, "jsonl"))
    return foreign.read(spark, foreign.ForeignTable(_CUSTOMER, "jsonl", path)).filter("c_mktsegment = 'BUILDING'")


@query(f"{_CUSTOMER_SQL} WHERE c_custkey BETWEEN 10 AND 99")
def foreign_parquet(spark, d):
    return foreign.read(spark, foreign.ForeignTable(_CUSTOMER, "parquet", f"{d}/customer.parquet")).filter("c_custkey between 10 and 99")


@query(_CUSTOMER_SQL)
def import_csv(spark, d):
    transfer.export_csv(_customers(spark, d), path := _folder(spark, "csv"))
    return transfer.import_csv(spark, path, _CUSTOMER)[0]


@query(_CUSTOMER_SQL)
def import_jsonl(spark, d):
    transfer.export_jsonl(_customers(spark, d), path := _folder(spark, "jsonl"))
    return transfer.import_jsonl(spark, path, _CUSTOMER)[0]


@query(_CUSTOMER_SQL)
def import_copy_text(spark, d):
    lines = _customers(spark, d).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in _CUSTOMER.names]).alias("value"))
    return transfer.import_copy(lines, _CUSTOMER)[0]


# ------------------------------------------------------------------ policies and statistics


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY'")
def row_policy(spark, d):
    p = policy.Policies(rows=[policy.RowPolicy("customer", "c_mktsegment", "BUILDING"), policy.RowPolicy("customer", "c_mktsegment")])
    return p.secure(read(spark, d, "customer"), "customer", "MACHINERY").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, '***' AS c_name FROM customer")
def mask_column(spark, d):
    return policy.Policies(masks=[policy.Mask("customer", "c_name")]).secure(read(spark, d, "customer"), "customer", None).select("c_custkey", "c_name")


@query("SELECT 'l_quantity' AS column_name, count(*) AS n_rows, 0.0::DOUBLE AS null_fraction, CAST(min(l_quantity) AS VARCHAR) AS low, CAST(max(l_quantity) AS VARCHAR) AS high, count(DISTINCT l_quantity) AS ndv FROM lineitem")
def stats_columns(spark, d):
    return stats.column_stats(read(spark, d, "lineitem"), "l_quantity")


@query("WITH v AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1), u AS (SELECT *, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS total FROM v) SELECT CAST(least(9, floor((upto - 1) * 10 / total)) AS INT) AS bucket, min(value) AS low, max(value) AS high, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1")
def stats_histogram(spark, d):
    return stats.histogram(read(spark, d, "lineitem"), "l_quantity")


@query()
def win_rank_dense(spark, d):
    """Ranks from counts of values. Its SQL is with the relational queries; as a window, Spark would sort each flag's rows in one task."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return stats.ranks(rows, ["l_returnflag"], "l_quantity", rank="r", dense="d").select("l_orderkey", "l_linenumber", "r", "d")


@query("SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 32")
def stats_mcv(spark, d):
    return stats.common_values(read(spark, d, "lineitem"), "l_suppkey")


#: Rows that one task sorts for the copy, about.
ZONE_ROWS = 1_000_000


@query()
def zone_map_skip(spark, d):
    """Row groups of a sorted copy that a point lookup reads and skips, by the least and greatest values in the footers."""
    path, rows = _folder(spark, "zones"), read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    ranges = max(4, -(-rows.count() // ZONE_ROWS))
    rows.repartitionByRange(ranges, "l_orderkey").sortWithinPartitions("l_orderkey").write.option("parquet.block.size", 64 << 10).option("parquet.block.size.row.check.min", 100).parquet(path)
    return stats.segment_report(spark, path, "l_orderkey", 100)


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size) AS place FROM part")
def collation_natural(spark, d):
    """Names ending in numbers in natural order: f9 before f10."""
    named = read(spark, d, "part").select("p_partkey", scalar.natural_key(F.concat(F.lit("f"), F.col("p_size"))).alias("k"))
    counts = named.groupBy("k").agg(F.count("*").alias("n"))
    before = counts.select("k", (F.sum("n").over(Window.orderBy("k")) - F.col("n") + 1).alias("place"))  # as many rows as there are names
    return named.join(before, "k").select("p_partkey", "place")
