"""Queries of scans, sinks and streams: rows are written, read back and compared with the tables they came from."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.plans.lineage import scratch
from tidemark.plans.registry import query
from tidemark.sources import frames as S
from tidemark.sources import sinks
from tidemark.sources.keyed_table import KeyedTable
from tidemark.streaming import keyed, streams


def messages(spark, d):
    """Envelopes of articles and jobs from documents."""
    kind = F.when(F.col("doc_id") % 3 == 0, "job").otherwise("article")
    url = F.concat(F.lit("https://x.example/"), "doc_id")
    data = F.struct(F.col("source").alias("title"), F.col("text").alias("content"), url.alias("source_url"))
    return S.table(spark, d, "documents").select(kind.alias("message_type"), F.col("source").alias("source_platform"), F.lit("2026-06-01T00:00:00").alias("crawled_at"), data.alias("data"))


def envelope_stream(spark, d, name):
    """The envelopes as JSON files, read as a stream; and a folder for what comes of it."""
    folder = scratch(spark, name)
    messages(spark, d).write.json(f"{folder}/in")
    return streams.envelopes(spark, f"{folder}/in"), folder


@query("o001_raw_stream", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'job' ELSE 'article' END AS message_type, source AS source_platform, count(*) AS n FROM documents GROUP BY ALL")
def raw_stream(spark, d):
    raw, folder = envelope_stream(spark, d, "o001")
    return streams.collected(raw.select("message_type", "source_platform"), folder).groupBy("message_type", "source_platform").agg(F.count("*").alias("n"))


@query("o002_routed_stream", """SELECT 'article' AS kind, md5('https://x.example/' || doc_id) AS id, source AS title FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT 'job', md5('https://x.example/' || doc_id), source FROM documents WHERE doc_id % 3 = 0""")
def routed_stream(spark, d):
    raw, folder = envelope_stream(spark, d, "o002")
    articles = streams.collected(streams.articles(raw).select("id", "title"), f"{folder}/articles")
    postings = streams.collected(streams.postings(raw).select("id", F.col("job_title").alias("title")), f"{folder}/jobs")
    return articles.select(F.lit("article").alias("kind"), "id", "title").unionByName(postings.select(F.lit("job").alias("kind"), "id", "title"))


WORDS = {"the": "The", "of": "Of", "der": "Der", "les": "Les", "una": "Una"}


@query("o003_extraction_stage", r"""SELECT md5('https://x.example/' || doc_id) AS id,
  array_to_string(list_sort(list_filter(['Der', 'Les', 'Of', 'The', 'Una'], lambda w: list_contains(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lower(w)))), ',') AS techs FROM documents WHERE doc_id % 3 <> 0""")
def extraction_stage(spark, d):
    raw, folder = envelope_stream(spark, d, "o003")
    found = raw.filter("message_type = 'article'").select(C.url_id(F.col("data.source_url")).alias("id"), F.array_join(C.terms(F.col("data.content"), WORDS), ",").alias("techs"))
    return streams.collected(found, folder)


@query("o007_parquet_scan", "SELECT n_regionkey, n_name FROM nation WHERE n_regionkey = 2")
def parquet_scan(spark, d):
    folder = scratch(spark, "o007")
    S.table(spark, d, "nation").write.partitionBy("n_regionkey").parquet(folder)
    return spark.read.parquet(folder).filter("n_regionkey = 2").select(F.col("n_regionkey").cast("int").alias("n_regionkey"), "n_name")


@query("o008_json_scan", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal FROM customer")
def json_scan(spark, d):
    folder, rows = scratch(spark, "o008"), S.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal")
    rows.write.json(folder)
    return S.json_table(spark, folder, rows.schema)


@query("o009_csv_scan", """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, '"' || p_name || '", ' || p_brand AS label FROM part""")
def csv_scan(spark, d):
    folder = scratch(spark, "o009")
    rows = S.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.concat(F.lit('"'), "p_name", F.lit('", '), "p_brand").alias("label"))
    rows.write.csv(folder, header=True, quote='"', escape='"')
    return S.csv_table(spark, folder, T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("label", T.StringType())]))


@query("o011_raw_sink", """SELECT event_type AS content_type, 'p' || (user_id % 3) AS source, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, 1 AS day, count(*) AS n
FROM events GROUP BY ALL""")
def raw_sink(spark, d):
    """Messages as they were crawled on the first of each month, so that a folder has more than a few of them."""
    folder = scratch(spark, "o011")
    platform = F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))
    sinks.write_raw(S.table(spark, d, "events").select(F.col("event_type").alias("message_type"), platform.alias("source_platform"), F.date_trunc("month", F.col("ts").cast("timestamp")).cast("string").alias("crawled_at"), "props"), folder)
    parts = ("content_type", "source", "year", "month", "day")
    return spark.read.json(folder).groupBy(*parts).agg(F.count("*").alias("n"))


@query("o017_snapshot_sink", "SELECT 'part' AS name, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders")
def snapshot_sink(spark, d):
    root = scratch(spark, "o017")
    sinks.write_snapshot({n: S.table(spark, d, n) for n in ("part", "orders")}, root, "2026-05-13")
    read = sinks.read_snapshot(spark, root, "2026-05-13", ["part", "orders"])
    count = lambda n, key: read[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(key).cast("long").alias("keys")).select("name", "n", "keys")
    return count("part", "p_partkey").unionByName(count("orders", "o_orderkey"))


@query("o018_trend_export", """SELECT p_name || ', "x"' AS technology_name, count(*) AS job_count, round(avg(p_retailprice), 2) AS growth_rate FROM part GROUP BY 1""")
def trend_export(spark, d):
    folder = scratch(spark, "o018")
    series = S.table(spark, d, "part").groupBy(F.concat("p_name", F.lit(', "x"')).alias("technology_name")).agg(F.count("*").alias("job_count"), F.round(F.avg("p_retailprice"), 2).alias("growth_rate"))
    sinks.export_trends(series, folder)
    return S.csv_table(spark, folder, T.StructType([T.StructField("technology_name", T.StringType()), T.StructField("job_count", T.LongType()), T.StructField("growth_rate", T.DoubleType())]))


def event_stream(spark, d, name, columns=("event_id", "ts", "user_id", "event_type", "value"), files=4, per_batch=1):
    folder = scratch(spark, name)
    rows = S.table(spark, d, "events").select(*columns)
    return streams.file_stream(streams.event_time(rows) if "ts" in columns else rows, f"{folder}/in", files, per_batch), folder


def merged_events(spark, d, name, rows, schema, version, keep=()):
    """A keyed table that a stream of batches is merged into, each batch twice."""
    folder = scratch(spark, name)
    table = KeyedTable(spark, f"{folder}/table", schema, ["user_id"], version, keep)

    def write(batch, n):
        for _ in range(2):
            table.merge(batch, n)

    streams.run_available(streams.file_stream(rows, f"{folder}/in", 3, 1), write, f"{folder}/state")
    return table.read()


@query("o013_upsert_written", "SELECT user_id, max(event_id) AS version, max_by(value, event_id) AS value FROM events GROUP BY 1")
def upsert_written(spark, d):
    rows = S.table(spark, d, "events").select("user_id", F.col("event_id").alias("version"), "value")
    return merged_events(spark, d, "o013", rows, {"user_id": "bigint", "version": "bigint", "value": "double"}, "version")


@query(
    "o014_null_preserving_written",
    """WITH a AS (SELECT user_id, event_id AS version, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN NULL ELSE event_type END AS kind FROM events)
SELECT user_id, max(version) AS version, max_by(kind, version) FILTER (kind <> '') AS kind FROM a GROUP BY 1""",
)
def null_preserving_written(spark, d):
    kind = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "click", F.col("event_type"))
    rows = S.table(spark, d, "events").select("user_id", F.col("event_id").alias("version"), kind.alias("kind"))
    return merged_events(spark, d, "o014", rows, {"user_id": "bigint", "version": "bigint", "kind": "string"}, "version", ("kind",))


@query(
    "o016_tombstones_written",
    "SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2026-06-01' WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2026-07-01' END AS deleted_at FROM orders",
)
def tombstones_written(spark, d):
    """Orders in two batches, then two rounds of deletions, the second of which meets rows deleted before."""
    orders = S.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).cast("long").alias("version"))
    table = KeyedTable(spark, f"{scratch(spark, 'o016')}/table", {"o_orderkey": "bigint", "status": "string", "version": "bigint"}, ["o_orderkey"], "version")
    table.merge(orders.filter("o_orderkey % 2 = 0"), 0)
    table.merge(orders.filter("o_orderkey % 2 = 1"), 1)
    for number, rule, day in ((2, "status = 'F'", "2026-06-01"), (3, "o_orderkey % 5 = 0", "2026-07-01")):
        table.delete(orders.filter(rule), number, F.to_timestamp(F.lit(day)))
    return table.read(deleted=True).select("o_orderkey", "status", F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))


@query("o169_micro_batches", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def micro_batches(spark, d):
    rows, folder = event_stream(spark, d, "o169", ("event_type", "value"))
    return streams.appended(rows, folder).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("o170_stateful_dedup", "SELECT DISTINCT user_id || ':' || event_type AS key FROM events")
def stateful_dedup(spark, d):
    rows, folder = event_stream(spark, d, "o170", ("user_id", "event_type"))
    keyed = rows.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"))
    return streams.collected(streams.deduplicated(keyed, "key"), folder)


def marked_events(spark, d, name, key):
    """Events, marked by the first one of their key within the years that they cover."""
    folder = scratch(spark, name)
    rows = streams.event_time(S.table(spark, d, "events").select("event_id", "ts", key.alias("key")))
    return keyed.marked(streams.file_stream(rows, f"{folder}/in"), "event_id", "key", "ts", 10 * 366 * 86400, folder)


@query(
    "o170_duplicate_of",
    """WITH k AS (SELECT event_id AS id, user_id || ':' || event_type AS key, ts FROM events),
f AS (SELECT key, first(id ORDER BY ts, id) AS first FROM k GROUP BY key)
SELECT id, key, CASE WHEN id <> first THEN first END AS duplicate_of FROM k JOIN f USING (key)""",
)
def duplicate_of(spark, d):
    return marked_events(spark, d, "o170d", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))


@query("o171_is_new", "SELECT user_id, CAST(1 AS BIGINT) AS alerts FROM events GROUP BY 1")
def is_new(spark, d):
    """One alert a key: the rows that are no duplicates."""
    alerts = marked_events(spark, d, "o171", F.col("user_id").cast("string")).filter("duplicate_of IS NULL")
    return alerts.groupBy(F.col("key").cast("long").alias("user_id")).agg(F.count("*").alias("alerts"))


@query("o172_alias_refresh", "SELECT CASE lower(event_type) WHEN 'signup' THEN 'registration' WHEN 'error' THEN 'failure' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY 1")
def alias_refresh(spark, d):
    rows, folder = event_stream(spark, d, "o172", ("event_type",))
    spark.createDataFrame([("signup", "registration"), ("error", "failure")], "alias string, canonical string").write.parquet(f"{folder}/aliases")
    return streams.canonical_stream(rows, "event_type", lambda: spark.read.parquet(f"{folder}/aliases"), folder).groupBy("event_type").agg(F.count("*").alias("n"))


@query("o174_embed_stream", r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM conversations),
b AS (SELECT conv_id, turn, CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) % 8 AS b FROM w WHERE w <> ''), i AS (SELECT conv_id, turn, unnest(range(8)) AS i FROM conversations)
SELECT conv_id || '/' || turn AS key, string_agg(CAST((SELECT count(*) FROM b WHERE b.conv_id = i.conv_id AND b.turn = i.turn AND b.b = i.i) AS VARCHAR), ',' ORDER BY i.i) AS vector FROM i GROUP BY 1""")
def embed_stream(spark, d):
    folder = scratch(spark, "o174")
    rows = streams.file_stream(S.table(spark, d, "conversations").select("conv_id", "turn", "text"), f"{folder}/in")
    keyed = rows.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.array_join(C.hashed_words(F.col("text"), 8).cast("array<string>"), ",").alias("vector"))
    return streams.collected(keyed, folder)


@query("o175_snapshot_push", "SELECT user_id AS key, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, user_id) AS place FROM events GROUP BY 1 ORDER BY total DESC, key LIMIT 5")
def snapshot_push(spark, d):
    rows, folder = event_stream(spark, d, "o175", ("user_id",))
    return streams.pushed_top(rows, "user_id", 5, folder).withColumn("place", F.col("place").cast("long"))


@query("o176_sliding_windows", """WITH s AS (SELECT unnest([0, 1]) AS k), w AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS start, event_type, value FROM events, s)
SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_windows(spark, d):
    out = streams.tumbling(streams.event_time(S.table(spark, d, "events")), "ts", "event_type", "value", "1 hour", slide="30 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "total")


@query("o176_stream_join", """SELECT a.user_id, count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY
WHERE a.event_type = 'view' AND b.event_type = 'purchase' GROUP BY 1""")
def stream_join(spark, d):
    folder = scratch(spark, "o176")
    rows = streams.event_time(S.table(spark, d, "events").select("ts", "user_id", "event_type"))
    views, purchases = (streams.file_stream(rows.filter(F.col("event_type") == kind), f"{folder}/{kind}") for kind in ("view", "purchase"))
    return streams.collected(streams.met_within(views, purchases, "user_id", "ts", "1 DAY"), folder).groupBy("user_id").agg(F.count("*").alias("pairs"))
