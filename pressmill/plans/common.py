"""What the queries share: logical tables, the reference time, and the SQL of both."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions.dates import local_date
from pressmill.operators import instants
from pressmill.operators.instants import utc_instants
from pressmill.session import staged, table, version_of

#: The time that "today" is reckoned from; a parameter, never the clock.
AS_OF = dt.datetime(2025, 12, 15, 4, 0, tzinfo=dt.timezone.utc)


_dated: dict[tuple, DataFrame] = {}


def articles(spark: SparkSession, d: str) -> DataFrame:
    """articles without content, with `at`, the instant a row counts for (published_at as a UTC instant, else the time of ingestion), and `day`, its Manila date.

    The instants are read from their texts once an application and state of the table, and written by month of `at`, in its order:
    filters by `month` and `at` (`between`) leave out folders and row groups.
    """
    key = (spark.sparkContext.applicationId, d, version_of(spark, f"{d}/articles.parquet"), version_of(spark, f"{d}/outlets.parquet"))
    if key not in _dated:
        a = table(spark, d, "articles")
        keep = ("source", "category", "raw_category", "title", "url", "is_funds", "tags", "inserted_at", "updated_at")
        u = utc_instants(a, table(spark, d, "outlets"), keep=keep)
        at = F.coalesce(F.timestamp_micros("utc_us"), F.col("inserted_at"))
        u = u.select(F.col("article_id").alias("id"), *keep, "published_at", at.alias("at")).withColumns({"day": local_date(F.col("at")), "month": F.date_format("at", "yyyy-MM")})
        # a month may hold any share of the rows: its partitions are split by size
        _dated[key] = staged(u.hint("rebalance", "month").sortWithinPartitions("month", "at"), "dated", "month")
    return _dated[key]


def between(a: DataFrame, lo: dt.datetime, hi: dt.datetime) -> DataFrame:
    """Rows of `articles` with lo <= at < hi; only the months concerned are read."""
    at, month = F.col("at"), F.col("month")
    return a.where((month >= f"{lo:%Y-%m}") & (month <= f"{hi:%Y-%m}") & (at >= F.lit(lo)) & (at < F.lit(hi)))


def analyses(spark: SparkSession, d: str) -> DataFrame:
    """bias_analysis with the fields of its metadata that queries use, and without the map, which no key may hold."""
    b = table(spark, d, "bias_analysis")
    return b.select("id", "article_id", "model_version", "model_type", "sentiment_score", "sentiment_label", "political_bias_score", "toxicity_score", "confidence_score", "created_at", F.col("model_metadata.direction").alias("direction"))


_SCORES = ("sentiment_score", "political_bias_score", "confidence_score")
_LABELS, _DIRECTIONS = ("positive", "negative", "neutral"), ("pro_government", "pro_opposition", "mixed", "neutral")


def by_article(b: DataFrame) -> DataFrame:
    """One row per article with the sums that means and counts are made of, so that an article with many analyses is one row before it is joined.

    k rows; l_<label> counts; d_<direction> counts, d_none for a missing one; s_<score> sums and c_<score> counts.
    """
    label, direction = F.col("sentiment_label"), F.col("direction")
    return b.where(F.col("article_id").isNotNull()).groupBy("article_id").agg(
        F.count("*").alias("k"), *[F.count_if(label == x).alias("l_" + x) for x in _LABELS], *[F.count_if(direction == x).alias("d_" + x) for x in _DIRECTIONS], F.count_if(direction.isNull()).alias("d_none"),
        *[F.sum(c).alias("s_" + c) for c in _SCORES], *[F.count(c).alias("c_" + c) for c in _SCORES])


def mean_of(score: str):
    """The mean over all rows behind rows of by_article; NULL for none."""
    return F.try_divide(F.sum("s_" + score), F.sum("c_" + score))


def rounded(c, digits: int = 6):
    """Rounded so that a tie comes out alike in whatever order its sum was made."""
    return F.round(c + 1e-9, digits)


def _sql_text(pattern: str) -> str:
    return "'" + re.sub(r"\$(\d)", r"\\\1", pattern).replace("'", "''") + "'"


def _sql_instants() -> str:
    """CTEs up to `utc`(id, utc_us): published_at as a UTC instant, by the same fixed patterns as in `instants`, with other means."""
    layouts = [instants._EPOCH, *instants._LAYOUTS.values()]
    pattern = lambda x: "'" + x.replace("'", "''") + "'"
    laid = " ".join(f"WHEN regexp_matches(c, {pattern(p)}) THEN regexp_replace(c, {pattern(p)}, {_sql_text(r)})" for p, r in layouts)
    months = "MAP {" + ", ".join(f"'{name}': {n}" for n, names in instants.MONTHS.items() for name in names) + "}"
    number = lambda i: f"TRY_CAST(f[{i}] AS INTEGER)"
    fold = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}]+', '', 'g')"
    away = lambda us: f"(epoch_us(timezone(z, make_timestamptz({us}))) - ({us}))"
    zone = r"'^(?:utc|gmt)?\s?([+-])(\d{1,2}):?(\d{2})?$'"
    return f"""u0 AS (SELECT {fold("source")} AS k, MIN(site_zone) AS z, MAX(upper(date_order) = 'MDY') AS mdy FROM outlets GROUP BY 1),
  u AS (SELECT id, COALESCE(z, 'UTC') AS z, COALESCE(mdy, false) AS mdy, regexp_replace(regexp_replace(trim(regexp_replace(lower(published_at), {pattern(instants.SPACES)}, ' ', 'g'), ' '), {pattern(instants._LEAD)}, ''), {pattern(instants._DAYNAME)}, '') AS c
    FROM articles LEFT JOIN u0 ON u0.k = {fold("articles.source")}),
  u1 AS (SELECT *, string_split(CASE {laid} END, '|') AS f FROM u),
  u2 AS (SELECT *, f[1] = 'epoch' AS ep, f[1] = 'ordered' AND NOT mdy AS swap, {number(2)} + CASE WHEN {number(2)} < 100 THEN 2000 ELSE 0 END AS y, CASE WHEN f[1] = 'ordered' THEN {number(3)} ELSE COALESCE({months}[f[3]], {number(3)}) END AS a, {number(4)} AS b,
    COALESCE({number(5)}, 0) AS h0, COALESCE({number(6)}, 0) AS mi, COALESCE({number(7)}, 0) AS s, TRY_CAST(rpad(substr(f[8], 1, 6), 6, '0') AS BIGINT) AS fr, TRY_CAST(f[2] AS BIGINT) AS n FROM u1),
  u3 AS (SELECT *, CASE WHEN f[9] = '' OR h0 > 12 THEN h0 ELSE h0 % 12 + CASE WHEN f[9] LIKE 'p%' THEN 12 ELSE 0 END END AS h, TRY_CAST(printf('%04d-%02d-%02d', y, CASE WHEN swap THEN b ELSE a END, CASE WHEN swap THEN a ELSE b END) AS DATE) AS dd,
    CASE WHEN ep OR f[10] IN ('z', 'utc', 'gmt') THEN 0 WHEN regexp_matches(f[10], {zone}) THEN CASE WHEN regexp_extract(f[10], {zone}, 1) = '-' THEN -1 ELSE 1 END * (CAST(regexp_extract(f[10], {zone}, 2) AS INTEGER) * 3600 + COALESCE(TRY_CAST(regexp_extract(f[10], {zone}, 3) AS INTEGER), 0) * 60) END AS off FROM u2),
  u4 AS (SELECT *, CASE WHEN ep THEN CASE WHEN length(f[2]) >= 16 THEN n WHEN length(f[2]) >= 13 THEN n * 1000 ELSE n * 1000000 + fr END WHEN s < 60 AND mi < 60 AND h < 24 THEN epoch_us(CAST(dd AS TIMESTAMP)) + (h * 3600 + mi * 60 + s)::BIGINT * 1000000 + fr END AS l FROM u3),
  u5 AS (SELECT *, {away("l - 86400000000")} AS o1, {away("l + 86400000000")} AS o2 FROM u4),
  utc AS (SELECT id, CASE WHEN off IS NOT NULL THEN l - off::BIGINT * 1000000 WHEN {away("l - o1")} = o1 THEN l - o1 WHEN {away("l - o2")} = o2 THEN l - o2 ELSE l - o1 END AS utc_us FROM u5)"""


SQL_UTC = _sql_instants()
SQL_A = f"""{SQL_UTC}, a AS (SELECT articles.id, source, category, raw_category, title, url, content, is_funds, tags, published_at, make_timestamp(epoch_us(inserted_at)) AS ins,
  make_timestamp(COALESCE(utc_us, epoch_us(inserted_at))) AS moment, CAST(make_timestamp(COALESCE(utc_us, epoch_us(inserted_at))) + INTERVAL 8 HOUR AS DATE) AS day FROM articles LEFT JOIN utc ON utc.id = articles.id)"""
SQL_B = """b AS (SELECT id, article_id, model_version, model_type, sentiment_score, sentiment_label, political_bias_score, toxicity_score, confidence_score, make_timestamp(epoch_us(created_at)) AS created,
  model_metadata.direction AS direction FROM bias_analysis)"""


def us(column: str):
    """Microseconds since 1970, which compare alike everywhere."""
    return F.unix_micros(column)
