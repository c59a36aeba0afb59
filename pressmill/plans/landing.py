"""Sources, sinks and streams over files landed from the tables: each query writes what a feed, a site or a job would, in the shared folder, reads it with the library's readers and gives what came of it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from pressmill.functions import dates, lexicon
from pressmill.functions.urls import canonical_url
from pressmill.plans.common import AS_OF
from pressmill.plans.dashboards import dashboard_by_source, dashboard_timeline
from pressmill.plans.texts import _CANON
from pressmill.session import hadoop_path, shared_dir, table
from pressmill.sources import readers, sinks
from pressmill.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def _folder(spark, name: str) -> str:
    """A new folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _land_items(a, link, path: str) -> None:
    """RSS files; the description of an item is the article's id."""
    mail = F.concat(F.date_format("inserted_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    items = a.select(F.trim("title").alias("title"), link.alias("link"), F.col("id").cast("string").alias("description"), F.trim("category").alias("category"), mail.alias("pubDate"))
    items.write.format("xml").option("rootTag", "rss").option("rowTag", "item").mode("overwrite").save(path)


@query("SELECT id::VARCHAR AS id, NULLIF(trim(url, ' '), '') AS url, epoch_us(inserted_at) // 1000000 AS seconds FROM articles")
def rss_items(spark, d):
    path = _folder(spark, "rss")
    _land_items(table(spark, d, "articles"), F.col("url"), path)
    return readers.rss(spark, path).select(F.col("description").alias("id"), F.nullif("url", F.lit("")).alias("url"), F.unix_seconds("published").alias("seconds"))


@query(f"SELECT id::VARCHAR AS id, {_CANON} AS url FROM articles WHERE url IS NOT NULL")
def aggregator_links(spark, d):
    """Links of an aggregator's feed, each leading to a story by a parameter."""
    path = _folder(spark, "aggregator")
    link = F.concat(F.lit("https://aggregator.example/open?from=feed&url="), F.url_encode("url"))
    _land_items(table(spark, d, "articles").where(F.col("url").isNotNull()), link, path)
    return readers.aggregator(spark, path).select(F.col("description").alias("id"), "url")


@query("SELECT url, COUNT(*) AS n FROM articles WHERE url IS NOT NULL GROUP BY url")
def sitemap_urls(spark, d):
    path = _folder(spark, "sitemap")
    a = table(spark, d, "articles").where(F.col("url").isNotNull())
    pages = a.select(F.col("url").alias("loc"), F.date_format("inserted_at", "yyyy-MM-dd").alias("lastmod"))
    pages.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").mode("overwrite").save(path)
    return readers.sitemap(spark, path).groupBy("url").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type, ROUND(value, 4) AS value FROM events")
def json_arrays(spark, d):
    """Arrays of records, one a line."""
    path = _folder(spark, "json")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))
    e.select(F.to_json(F.array(F.struct("*"))).alias("value")).write.mode("overwrite").text(path)
    return readers.json_array(spark, path, "event_id long, user_id long, event_type string, value double", per_line=True)


@query("SELECT category, lower(trim(term)) AS term, COUNT(*) AS n FROM lexicon WHERE category IS NOT NULL AND term IS NOT NULL GROUP BY 1, 2")
def lexicon_file(spark, d):
    """The lexicon as a file of terms and weights, read back."""
    path, doc = _folder(spark, "lexicon"), {"version": "1", "keywords": {}, "weights": {}}
    for c, t, w in table(spark, d, "lexicon").where(F.col("category").isNotNull() & F.col("term").isNotNull()).select("category", "term", "weight").collect():  # a table of fixed size
        doc["keywords"].setdefault(c, []).append(t)
        doc["weights"].setdefault(c, w)
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return lexicon.load_json(spark, path).groupBy("category", F.lower(F.trim("term")).alias("term")).agg(F.count("*").alias("n"))


@query("""SELECT run_id, id, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY completed_at DESC NULLS LAST, id DESC) AS rn FROM scraping_logs) q WHERE rn = 1""")
def upsert_twice(spark, d):
    """The run log merged into a table kept by key, in two halves and then once more: latest wins, and the last time changes nothing."""
    path = f"{_folder(spark, 'upsert')}/runs"
    r = table(spark, d, "scraping_logs").select("run_id", "id", "status", "completed_at").withColumn("seen", F.coalesce(F.unix_micros("completed_at"), F.lit(-1)))
    for part in (r.where("id % 2 = 0"), r.where("id % 2 = 1").unionByName(r.where("id % 2 = 0")), r):
        sinks.upsert(part, path, ["run_id"], ["seen", "id"])
    return sinks.merged(spark, path).select("run_id", "id", "status")


@query(f"SELECT u AS url, COUNT(*) OVER () AS n FROM (SELECT DISTINCT {_CANON} AS u FROM articles WHERE url IS NOT NULL) q")
def append_with_ids(spark, d):
    """Articles appended with stable ids, twice: a URL is there once, under one id."""
    path = f"{_folder(spark, 'append')}/articles"
    a = sinks.with_ids(table(spark, d, "articles").where(F.col("url").isNotNull()).select(canonical_url(F.col("url")).alias("url")), "url")
    for _ in range(2):
        sinks.append_new(a, path, "url")
    kept = spark.read.parquet(path)
    return kept.select("url", F.lit(kept.select("id").distinct().count()).alias("n"))


@query("SELECT source, COUNT(*) AS n FROM articles GROUP BY source")
def cached_counts(spark, d):
    """A result kept under its parameters: made once, read twice, dropped, made again."""
    folder = _folder(spark, "cache")
    make = lambda: table(spark, d, "articles").groupBy("source").agg(F.count("*").alias("n"))
    for _ in range(2):
        sinks.cached(spark, folder, "counts", make, by="source")
    if sinks.clear_cached(spark, folder, "counts") != 1:
        raise AssertionError("one result was to be kept")
    return sinks.cached(spark, folder, "counts", make, by="source")


@query("""SELECT run_id, 'success' AS status, n::INTEGER AS articles_scraped, 90000::BIGINT AS execution_time_ms FROM (SELECT 'run-' || source AS run_id, COUNT(*) AS n FROM articles GROUP BY source ORDER BY n DESC, source LIMIT 3) q""")
def run_log(spark, d):
    """The runs of the three largest outlets, opened and closed."""
    import datetime as dt

    path = f"{_folder(spark, 'log')}/runs"
    top = table(spark, d, "articles").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(3).collect()
    for r in top:
        sinks.start_run(spark, path, f"run-{r.source}", r.source, AS_OF)
        sinks.finish_run(spark, path, f"run-{r.source}", "success", r.n, AS_OF + dt.timedelta(seconds=90))
    return sinks.merged(spark, path).select("run_id", "status", "articles_scraped", "execution_time_ms")


@query()
def dashboard_files(spark, d):
    """(name, json) of the exported documents as read back: days, sources, summary."""
    path = f"{_folder(spark, 'export')}/dashboard"
    sinks.export_json(sinks.dashboard_documents(dashboard_timeline(spark, d), dashboard_by_source(spark, d)), path)
    return spark.read.schema("name string, json string").json(path)


@query("SELECT id, epoch_us(inserted_at) // 1000000 AS mail, epoch_us(inserted_at) // 60000000 * 60 AS line, epoch_us(date_trunc('day', make_timestamp(epoch_us(inserted_at)))) // 1000000 AS day, strftime(make_timestamp(epoch_us(inserted_at)) + INTERVAL 8 HOUR, '%Y-%m-%d') AS manila FROM articles")
def dates_read(spark, d):
    """One time in the forms of a mail header, of a printed line, of a bare date and of an ISO text, read back from each."""
    t = F.col("inserted_at")
    a = table(spark, d, "articles").select(
        "id", F.concat(F.date_format(t, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("mail"), F.concat(F.lit("Published "), F.date_format(t, "MMMM d, yyyy h:mma")).alias("line"), F.date_format(t, "MM/dd/yyyy").alias("day"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"))
    s = F.unix_seconds
    return a.select("id", s(dates.rfc2822(F.col("mail"))).alias("mail"), s(dates.published_line(F.col("line"), None)).alias("line"), s(dates.coalesce_formats(F.col("day"), ["yyyy-MM-dd", "MM/dd/yyyy"])).alias("day"), dates.iso_date(F.col("iso")).alias("manila"))


@query("SELECT id, CASE WHEN regexp_matches(published_at, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN published_at ELSE '2025-12-15T04:00:00Z' END AS published FROM articles")
def dates_kept(spark, d):
    """Publication texts that hold an ISO day, the time of reference in the place of others."""
    return table(spark, d, "articles").select("id", dates.kept_or(F.col("published_at"), AS_OF).alias("published"))


_BUCKET = "(epoch_us(ts) - 57600000000) // 86400000000 * 86400 + 57600"


@query(f"SELECT {_BUCKET} AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Counts by Manila day from a stream over the landed events, merged batch by batch."""
    src = table(spark, d, "events").select("event_id", "ts", "event_type")
    landed, out = f"{_folder(spark, 'events')}/in", f"{_folder(spark, 'windows')}/out"
    src.write.parquet(landed)
    stream = ingest.tumbling(spark.readStream.schema(src.schema).parquet(landed), "ts", ["event_type"])

    def merge(batch, k):
        sinks.upsert(batch.withColumn("batch", F.lit(k).cast("long")), out, ["start", "event_type"], ["batch"])

    q = stream.writeStream.outputMode("update").option("checkpointLocation", _folder(spark, "state")).foreachBatch(merge).trigger(availableNow=True).start()
    q.awaitTermination()
    return sinks.merged(spark, out).select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL),
  s AS (SELECT user_id, t, SUM(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, MIN(t) AS start, MAX(t) + 1800000000 AS "end", COUNT(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    s = ingest.sessions(table(spark, d, "events").where(F.col("user_id").isNotNull()), "ts", "user_id")
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("SELECT event_type, COUNT(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) q GROUP BY event_type")
def stream_once(spark, d):
    """The first event of each user and type, of a stream with late and repeated rows."""
    src = table(spark, d, "events").select("ts", F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("url"), "event_type")
    landed, out = f"{_folder(spark, 'repeated')}/in", f"{_folder(spark, 'once')}/out"
    src.unionByName(src).write.parquet(landed)
    once = ingest.deduplicated(spark.readStream.schema(src.schema).parquet(landed), "url", "ts", "400 days")
    q = once.writeStream.format("parquet").option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT {_CANON} AS url FROM articles WHERE url IS NOT NULL AND trim(title, ' ') <> ''")
def stream_ingest(spark, d):
    """Articles landed as JSON, ingested by a stream, then landed once more: what the table of articles holds."""
    landed, out = _folder(spark, "landing"), _folder(spark, "ingested")
    a = table(spark, d, "articles").where(F.col("url").isNotNull()).select("source", "category", "raw_category", "title", "url", "content", F.col("inserted_at").alias("published_at"))
    for state in (_folder(spark, "state"), _folder(spark, "state")):
        a.write.mode("append").json(landed)
        ingest.start_ingest(spark, landed, out, state, AS_OF).awaitTermination()
    return spark.read.parquet(f"{out}/articles").select("url")
