"""Read-side queries over articles and analyses: filters, joins, aggregates, windows, pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions.dates import bounded, day_window, utc_bounds
from pressmill.functions.text import contains_all, preview, threshold_label
from pressmill.operators.relational import latest_per_key, optional_filters, page, top_k_per_key
from pressmill.plans.common import AS_OF, SQL_A, SQL_B, analyses, articles, between, by_article, mean_of, rounded, us
from pressmill.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def trends(spark: SparkSession, d: str, days: int = 30, source: str | None = None) -> DataFrame:
    """Sentiment by Manila day: all articles, their sentiment rows by label, mean score and shares of all articles. Days without articles don't appear; rows without a label count as neutral."""
    first, last = day_window(AS_OF, bounded(days, 1, 180))
    lo, hi = utc_bounds(first, last)
    a = between(optional_filters(articles(spark, d), source=source), lo, hi).select("id", "day")
    b = by_article(analyses(spark, d).where(F.col("model_type") == "sentiment")).withColumnRenamed("article_id", "id")
    scored = b.join(a, "id").groupBy("day").agg(
        F.sum("l_positive").alias("positive"), F.sum("l_negative").alias("negative"), F.sum(F.col("k") - F.col("l_positive") - F.col("l_negative")).alias("neutral"), mean_of("sentiment_score").alias("s"))
    out = a.groupBy("day").agg(F.count("*").alias("total")).join(scored, "day", "left").fillna(0, ["positive", "negative", "neutral"])
    pct = lambda c: F.round(F.col(c) / F.col("total") * 100, 4)
    return out.select("day", "total", "positive", "negative", "neutral", rounded(F.coalesce("s", F.lit(0.0))).alias("avg_sentiment"), pct("positive").alias("positive_pct"), pct("negative").alias("negative_pct"), pct("neutral").alias("neutral_pct"))


def _trends_sql(days: int, source: str | None = None) -> str:
    first, last = day_window(AS_OF, days)
    where = f" AND source = '{source}'" if source else ""
    return f"""WITH {SQL_A}, {SQL_B}, w AS (SELECT id, day FROM a WHERE day BETWEEN DATE '{first}' AND DATE '{last}'{where}),
      t AS (SELECT day, COUNT(*) AS total FROM w GROUP BY day),
      s AS (SELECT day, COUNT(*) FILTER (sentiment_label = 'positive') AS p, COUNT(*) FILTER (sentiment_label = 'negative') AS n,
              COUNT(*) FILTER (sentiment_label IS NULL OR sentiment_label NOT IN ('positive', 'negative')) AS u, AVG(sentiment_score) AS s
            FROM b JOIN w ON w.id = b.article_id WHERE model_type = 'sentiment' GROUP BY day)
      SELECT t.day, total, COALESCE(p, 0) AS positive, COALESCE(n, 0) AS negative, COALESCE(u, 0) AS neutral, ROUND(COALESCE(s, 0) + 1e-9, 6) AS avg_sentiment,
        ROUND(COALESCE(p, 0) / total * 100, 4) AS positive_pct, ROUND(COALESCE(n, 0) / total * 100, 4) AS negative_pct, ROUND(COALESCE(u, 0) / total * 100, 4) AS neutral_pct
      FROM t LEFT JOIN s ON s.day = t.day"""


@query(_trends_sql(30))
def trends_daily(spark, d):
    return trends(spark, d, 30)


@query(_trends_sql(7))
def trends_daily_7d(spark, d):
    return trends(spark, d, 7)


@query(_trends_sql(30, "Bayan Ledger"))
def trends_daily_source(spark, d):
    return trends(spark, d, 30, "Bayan Ledger")


@query(f"""SELECT SUM(total)::BIGINT AS total, SUM(positive)::BIGINT AS positive, SUM(negative)::BIGINT AS negative, SUM(neutral)::BIGINT AS neutral, COUNT(*) AS days,
  ROUND(SUM(total) / COUNT(*), 6) AS avg_daily, ROUND(SUM(positive) / SUM(total) * 100, 4) AS positive_pct FROM ({_trends_sql(30)}) q""")
def trends_summary(spark, d):
    t = trends(spark, d, 30)
    s = t.agg(F.sum("total").alias("total"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.sum("neutral").alias("neutral"), F.count("*").alias("days"))
    return s.withColumns({"avg_daily": F.round(F.col("total") / F.col("days"), 6), "positive_pct": F.round(F.col("positive") / F.col("total") * 100, 4)})


@query(f"""SELECT day, total, LEAST(positive + negative + neutral, total) AS analyzed, GREATEST(0, total - (positive + negative + neutral)) AS unscored,
  ROUND(LEAST(positive + negative + neutral, total) / total * 100, 4) AS analyzed_pct FROM ({_trends_sql(30)}) q""")
def coverage_daily(spark, d):
    t = trends(spark, d, 30)
    n = F.col("positive") + F.col("negative") + F.col("neutral")
    return t.select("day", "total", F.least(n, "total").alias("analyzed"), F.greatest(F.lit(0), F.col("total") - n).alias("unscored"), F.round(F.least(n, "total") / F.col("total") * 100, 4).alias("analyzed_pct"))


@query(f"WITH {SQL_A} SELECT source, id, rank FROM (SELECT source, id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY moment DESC, id DESC) AS rank FROM a) q WHERE rank <= 10")
def home_topn_per_source(spark, d):
    a = articles(spark, d).select("source", "id", "at")
    return top_k_per_key(a, ["source"], [F.desc("at"), F.desc("id")], 10).select("source", "id", "rank")


@query(f"""WITH {SQL_A}, wanted AS (SELECT source FROM outlets UNION ALL SELECT 'No Such Outlet'), r AS (SELECT source, id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY moment DESC, id DESC) AS rank FROM a)
  SELECT w.source, r.id, r.rank FROM wanted w LEFT JOIN r ON r.source = w.source AND r.rank <= 3""")
def home_fixed_sources(spark, d):
    """The newest three of each listed outlet, one row for an outlet without any."""
    wanted = table(spark, d, "outlets").select("source").unionByName(spark.createDataFrame([("No Such Outlet",)], "source string"))
    a = articles(spark, d).select("source", "id", "at").join(wanted, "source", "left_semi")
    return wanted.join(top_k_per_key(a, ["source"], [F.desc("at"), F.desc("id")], 3).select("source", "id", "rank"), "source", "left")


@query(f"""WITH {SQL_B} SELECT article_id, id, sentiment_label, sentiment_score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id ORDER BY created DESC, id DESC) AS rn FROM b
  WHERE model_type = 'sentiment' AND article_id IS NOT NULL) q WHERE rn = 1""")
def latest_sentiment(spark, d):
    b = analyses(spark, d).where((F.col("model_type") == "sentiment") & F.col("article_id").isNotNull()).select("article_id", "id", "sentiment_label", "sentiment_score", "created_at")
    return latest_per_key(b, ["article_id"], ["created_at", "id"]).drop("created_at")


@query(f"""WITH {SQL_B} SELECT article_id, id, direction, ROUND(political_bias_score, 6) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id ORDER BY created DESC, id DESC) AS rn FROM b
  WHERE model_type = 'political_bias' AND article_id IS NOT NULL) q WHERE rn = 1""")
def latest_political(spark, d):
    b = analyses(spark, d).where((F.col("model_type") == "political_bias") & F.col("article_id").isNotNull()).select("article_id", "id", "direction", F.round("political_bias_score", 6).alias("score"), "created_at")
    return latest_per_key(b, ["article_id"], ["created_at", "id"]).drop("created_at")


@query(f"""WITH {SQL_B} SELECT article_id, model_type AS used, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id ORDER BY (model_type = 'sentiment') DESC, created DESC, id DESC) AS rn FROM b
  WHERE article_id IS NOT NULL AND model_type IN ('sentiment', 'political_bias')) q WHERE rn = 1""")
def preferred_analysis(spark, d):
    b = analyses(spark, d).where(F.col("article_id").isNotNull() & F.col("model_type").isin("sentiment", "political_bias"))
    b = b.select("article_id", F.col("model_type").alias("used"), "id", "created_at", (F.col("model_type") == "sentiment").alias("first"))
    return latest_per_key(b, ["article_id"], ["first", "created_at", "id"]).select("article_id", "used", "id")


@query(f"""WITH {SQL_A}, {SQL_B}, l AS (SELECT article_id, sentiment_label FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY article_id ORDER BY created DESC, id DESC) AS rn FROM b
  WHERE model_type = 'sentiment') q WHERE rn = 1) SELECT a.id, a.source, a.title, l.sentiment_label FROM a LEFT JOIN l ON l.article_id = a.id""")
def articles_enriched(spark, d):
    return articles(spark, d).select("id", "source", "title").join(latest_sentiment(spark, d).select(F.col("article_id").alias("id"), "sentiment_label"), "id", "left")


@query(f"WITH {SQL_A} SELECT id, source, epoch_us(moment) AS at_us FROM a WHERE category = 'Metro' ORDER BY moment DESC, id DESC LIMIT 20 OFFSET 20")
def articles_page(spark, d):
    a = articles(spark, d).where(F.col("category") == "Metro").select("id", "source", us("at").alias("at_us"))
    return page(a, [F.desc("at_us"), F.desc("id")], 20, 20)


@query("SELECT category, COUNT(*) AS n, GREATEST(1, CEIL(COUNT(*) / 20.0))::BIGINT AS pages FROM articles GROUP BY category")
def page_counts(spark, d):
    return table(spark, d, "articles").groupBy("category").agg(F.count("*").alias("n")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("n") / 20)))


@query("SELECT id, source FROM articles WHERE contains(lower(title), 'bus depot') OR contains(lower(content), 'bus depot')")
def articles_search(spark, d):
    return table(spark, d, "articles").where(contains_all(F.col("title"), "bus depot") | contains_all(F.col("content"), "bus depot")).select("id", "source")


@query("SELECT id FROM articles WHERE source = 'Isla Dispatch' AND is_funds AND category IN ('Metro', 'Health', 'Sports')")
def articles_filtered(spark, d):
    return optional_filters(table(spark, d, "articles"), source="Isla Dispatch", is_funds=True, category=["Metro", "Health", "Sports"]).select("id")


@query("SELECT id, category FROM articles WHERE category IS NULL OR category IN ('Post', 'General', 'Uncategorized')")
def generic_category(spark, d):
    return table(spark, d, "articles").where(F.col("category").isNull() | F.col("category").isin("Post", "General", "Uncategorized")).select("id", "category")


@query(f"WITH {SQL_A} SELECT id FROM a WHERE moment >= TIMESTAMP '2025-06-01' AND moment <= TIMESTAMP '2025-06-30 23:59:59.999999'")
def articles_in_range(spark, d):
    utc = dt.timezone.utc
    return between(articles(spark, d), dt.datetime(2025, 6, 1, tzinfo=utc), dt.datetime(2025, 7, 1, tzinfo=utc)).select("id")


@query("SELECT id, CASE WHEN length(title) > 160 THEN substr(title, 1, 160) || '...' ELSE title END AS title, CASE WHEN length(title) > 60 THEN substr(title, 1, 60) || '...' ELSE title END AS head, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview FROM articles")
def article_previews(spark, d):
    return table(spark, d, "articles").select("id", preview(F.col("title"), 160).alias("title"), preview(F.col("title"), 60).alias("head"), preview(F.col("content")).alias("preview"))


@query("""SELECT id, CASE WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score <= -0.05 THEN 'negative' WHEN sentiment_score IS NOT NULL THEN 'neutral' END AS label,
  CASE WHEN sentiment_score > 0.05 THEN 'positive' WHEN sentiment_score < -0.05 THEN 'negative' WHEN sentiment_score IS NOT NULL THEN 'neutral' END AS strict_label FROM bias_analysis""")
def score_labels(spark, d):
    s = F.col("sentiment_score")
    return table(spark, d, "bias_analysis").select("id", threshold_label(s).alias("label"), threshold_label(s, strict=True).alias("strict_label"))


@query("SELECT a.id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM bias_analysis b WHERE b.article_id = a.id)")
def unanalyzed_anti(spark, d):
    return table(spark, d, "articles").select("id").join(table(spark, d, "bias_analysis").select(F.col("article_id").alias("id")), "id", "left_anti")


@query(f"WITH {SQL_A} SELECT a.id, a.day FROM a WHERE a.day >= DATE '2025-11-01' AND NOT EXISTS (SELECT 1 FROM bias_analysis b WHERE b.article_id = a.id AND b.model_type = 'political_bias')")
def unanalyzed_in_period(spark, d):
    b = table(spark, d, "bias_analysis").where(F.col("model_type") == "political_bias").select(F.col("article_id").alias("id"))
    return articles(spark, d).where(F.col("day") >= F.lit("2025-11-01").cast("date")).select("id", "day").join(b, "id", "left_anti")


@query("SELECT b.id, b.article_id, a.source, a.title FROM bias_analysis b LEFT JOIN articles a ON a.id = b.article_id WHERE b.model_type = 'political_bias'")
def analysis_with_article(spark, d):
    b = table(spark, d, "bias_analysis").where(F.col("model_type") == "political_bias").select("id", "article_id")
    return b.join(table(spark, d, "articles").select(F.col("id").alias("article_id"), "source", "title"), "article_id", "left").select("id", "article_id", "source", "title")


@query("SELECT id, model_type FROM bias_analysis WHERE article_id IN (SELECT id FROM articles WHERE source = 'Dagat Post')")
def analysis_of_source(spark, d):
    a = table(spark, d, "articles").where(F.col("source") == "Dagat Post").select(F.col("id").alias("article_id"))
    return table(spark, d, "bias_analysis").join(a, "article_id", "left_semi").select("id", "model_type")


@query(f"""WITH {SQL_B} SELECT b.id, b.article_id, a.title FROM b LEFT JOIN articles a ON a.id = b.article_id WHERE b.direction = 'pro_opposition' ORDER BY b.created DESC, b.id DESC LIMIT 50""")
def bias_articles_by_direction(spark, d):
    b = analyses(spark, d).where(F.col("direction") == "pro_opposition").orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "article_id")
    return b.join(table(spark, d, "articles").select(F.col("id").alias("article_id"), "title"), "article_id", "left").select("id", "article_id", "title")


@query("SELECT source, category, COUNT(*) AS n, COUNT(DISTINCT url) AS urls FROM articles GROUP BY source, category")
def counts_by_source_category(spark, d):
    return table(spark, d, "articles").groupBy("source", "category").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query(f"WITH {SQL_A} SELECT CAST(date_trunc('week', moment) AS DATE) AS week, source, category, COUNT(*) AS n FROM a GROUP BY 1, 2, 3")
def weekly_counts(spark, d):
    return articles(spark, d).groupBy(F.to_date(F.date_trunc("week", "at")).alias("week"), "source", "category").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_A}, {SQL_B} SELECT a.day, a.source, COUNT(DISTINCT a.id) AS articles, ROUND(AVG(sentiment_score) + 1e-9, 6) AS avg_sentiment, COUNT(*) FILTER (sentiment_label = 'positive') AS pos,
  COUNT(*) FILTER (sentiment_label = 'negative') AS neg, COUNT(*) FILTER (sentiment_label = 'neutral') AS neu FROM b JOIN a ON a.id = b.article_id WHERE model_type = 'sentiment' GROUP BY 1, 2""")
def sentiment_daily_mv(spark, d):
    b = analyses(spark, d).where(F.col("model_type") == "sentiment").select(F.col("article_id").alias("id"), "sentiment_score", "sentiment_label")
    # one row an article first, so that no distinct count is needed
    per = b.where(F.col("id").isNotNull()).groupBy("id").agg(F.sum("sentiment_score").alias("s"), F.count("sentiment_score").alias("k"), *[F.count_if(F.col("sentiment_label") == x).alias(x[:3]) for x in ("positive", "negative", "neutral")])
    j = per.join(articles(spark, d).select("id", "day", "source"), "id")
    g = j.groupBy("day", "source").agg(F.count("*").alias("articles"), rounded(F.try_divide(F.sum("s"), F.sum("k"))).alias("avg_sentiment"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("neu").alias("neu"))
    return g


@query("SELECT t.tag, COUNT(*) AS n, COUNT(DISTINCT t.id) AS articles FROM (SELECT id, unnest(tags) AS tag FROM articles) t GROUP BY t.tag")
def tag_counts(spark, d):
    a = table(spark, d, "articles").select("id", F.explode("tags").alias("tag"))
    return a.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("id").alias("articles"))


@query("SELECT id, array_to_string(list_sort(list_distinct(tags)), '|') AS tags FROM articles WHERE tags IS NOT NULL AND len(tags) > 0")
def distinct_tags(spark, d):
    return table(spark, d, "articles").where(F.size("tags") > 0).select("id", F.array_join(F.sort_array(F.array_distinct("tags")), "|").alias("tags"))
