"""Incremental ingestion and streaming aggregates.

A file stream of landed pages is parsed and normalized in one projection; each
micro-batch appends the articles whose URL is new, and merges their analysis rows.
Both writes are idempotent, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions.text import blank_to_null, normalize_source, threshold_label
from pressmill.functions.urls import canonical_url
from pressmill.models import funds, sentiment
from pressmill.sources.sinks import append_new, upsert, with_ids

ARTICLE = "source string, category string, raw_category string, title string, url string, content string, published_at timestamp"


def normalized(df: DataFrame, as_of) -> DataFrame:
    """Landed rows as articles: names normalized, URL canonical, blank content NULL, a missing time filled with `as_of` (a parameter, never the clock)."""
    return df.select(
        normalize_source(F.col("source")).alias("source"), "category", "raw_category", F.trim("title").alias("title"), canonical_url(F.col("url")).alias("url"), blank_to_null(F.col("content")).alias("content"),
        F.coalesce(F.col("published_at"), F.lit(as_of).cast("timestamp")).alias("published_at"), funds.by_rule(F.col("title"), F.col("content")).alias("is_funds"),
    )


def analysis_rows(articles: DataFrame) -> DataFrame:
    """One sentiment row per article."""
    text = F.trim(F.concat_ws(" ", "title", "content"))
    s = articles.select(F.col("id").alias("article_id"), sentiment.score(text).alias("sentiment_score"), F.col("published_at").alias("created_at"))
    return s.select("article_id", F.lit(sentiment.VERSION).alias("model_version"), F.lit("sentiment").alias("model_type"), "sentiment_score", threshold_label(F.col("sentiment_score")).alias("sentiment_label"), "created_at")


def ingest_batch(batch: DataFrame, folder: str, as_of) -> None:
    """Appends what is new, analyses it, merges the analysis."""
    rows = with_ids(normalized(batch, as_of).where(F.col("title") != ""), "url")
    fresh = append_new(rows, f"{folder}/articles", "url")
    upsert(analysis_rows(fresh), f"{folder}/analysis", ["article_id", "model_version", "model_type"], ["created_at"])


def start_ingest(spark: SparkSession, landing: str, folder: str, checkpoint: str, as_of, trigger: dict | None = None):
    """A stream over JSON files in `landing`; all that is there and then stops, unless another trigger is given."""
    stream = spark.readStream.schema(ARTICLE).json(landing)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest_batch(df, folder, as_of)).trigger(**(trigger or {"availableNow": True})).start()


def deduplicated(stream: DataFrame, key: str = "url", time: str = "published_at", late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", offset: str = "16 hours", late: str = "1 day") -> DataFrame:
    """Counts per window; the offset puts the day's border at midnight in Manila. Works on a batch as on a stream."""
    w = F.window(time, width, width, offset)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key, closed by a gap."""
    s = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
