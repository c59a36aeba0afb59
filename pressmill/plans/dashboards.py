"""Dashboard aggregates: timelines, source comparisons, direction buckets, health, run logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.models import funds
from pressmill.operators.relational import top_k_per_key
from pressmill.plans.common import SQL_A, SQL_B, analyses, articles, by_article, mean_of, rounded
from pressmill.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


@query(f"""WITH {SQL_A}, {SQL_B}, j AS (SELECT a.day, b.* FROM b JOIN a ON a.id = b.article_id WHERE b.model_version IN ('vader_v1', 'philippine_bias_v1'))
  SELECT day, COUNT(*) AS analyses, COUNT(*) FILTER (sentiment_label = 'positive') AS positive, COUNT(*) FILTER (sentiment_label = 'negative') AS negative, COUNT(*) FILTER (sentiment_label = 'neutral') AS neutral,
    ROUND(COALESCE(AVG(sentiment_score), 0) + 1e-9, 6) AS avg_sentiment, ROUND(COALESCE(AVG(political_bias_score), 0) + 1e-9, 6) AS avg_bias, ROUND(COALESCE(AVG(confidence_score), 0) + 1e-9, 6) AS avg_confidence,
    COUNT(*) FILTER (direction = 'pro_government') AS pro_government, COUNT(*) FILTER (direction = 'pro_opposition') AS pro_opposition, COUNT(*) FILTER (direction = 'mixed') AS mixed
  FROM j GROUP BY day""")
def dashboard_timeline(spark, d):
    b = by_article(analyses(spark, d).where(F.col("model_version").isin("vader_v1", "philippine_bias_v1")))
    j = b.join(articles(spark, d).select(F.col("id").alias("article_id"), "day"), "article_id")
    counts = [F.sum("l_" + x).alias(x) for x in ("positive", "negative", "neutral")] + [F.sum("d_" + x).alias(x) for x in ("pro_government", "pro_opposition", "mixed")]
    means = [rounded(F.coalesce(mean_of(c), F.lit(0.0))).alias(n) for c, n in _MEANS]
    return j.groupBy("day").agg(F.sum("k").alias("analyses"), *counts, *means)


_MEANS = (("sentiment_score", "avg_sentiment"), ("political_bias_score", "avg_bias"), ("confidence_score", "avg_confidence"))


def _labels():
    return [F.count_if(F.col("sentiment_label") == x).alias(x) for x in ("positive", "negative", "neutral")]


def _means():
    return [rounded(F.coalesce(F.avg(c), F.lit(0.0))).alias(n) for c, n in _MEANS[:1]]


@query(f"""WITH {SQL_A}, {SQL_B}, n AS (SELECT source, COUNT(*) AS articles FROM a GROUP BY source), s AS (SELECT a.source, ROUND(COALESCE(AVG(political_bias_score), 0) + 1e-9, 6) AS avg_bias,
    ROUND(COALESCE(AVG(confidence_score), 0) + 1e-9, 6) AS avg_confidence, COUNT(*) FILTER (direction = 'pro_government') AS pro_government, COUNT(*) FILTER (direction = 'pro_opposition') AS pro_opposition,
    COUNT(*) FILTER (COALESCE(direction, 'neutral') = 'neutral') AS neutral FROM b JOIN a ON a.id = b.article_id WHERE model_version = 'philippine_bias_v1' GROUP BY a.source)
  SELECT n.source, articles, COALESCE(avg_bias, 0) AS avg_bias, COALESCE(avg_confidence, 0) AS avg_confidence, COALESCE(pro_government, 0) AS pro_government, COALESCE(pro_opposition, 0) AS pro_opposition, COALESCE(neutral, 0) AS neutral
  FROM n LEFT JOIN s ON s.source = n.source""")
def dashboard_by_source(spark, d):
    a = articles(spark, d).select(F.col("id").alias("article_id"), "source")
    b = by_article(analyses(spark, d).where(F.col("model_version") == "philippine_bias_v1")).join(a, "article_id")
    means = [rounded(F.coalesce(mean_of(c), F.lit(0.0))).alias(n) for c, n in _MEANS[1:]]
    s = b.groupBy("source").agg(*means, F.sum("d_pro_government").alias("pro_government"), F.sum("d_pro_opposition").alias("pro_opposition"), F.sum(F.col("d_neutral") + F.col("d_none")).alias("neutral"))
    return a.groupBy("source").agg(F.count("*").alias("articles")).join(s, "source", "left").fillna(0)


@query(f"""WITH {SQL_A}, {SQL_B} SELECT a.source, COUNT(*) AS analyses, ROUND(AVG(COALESCE(political_bias_score, 0)) + 1e-9, 3) AS avg_bias, ROUND(AVG(COALESCE(sentiment_score, 0)) + 1e-9, 3) AS avg_sentiment
  FROM b JOIN a ON a.id = b.article_id GROUP BY a.source""")
def source_means_null_as_zero(spark, d):
    b = by_article(analyses(spark, d)).join(articles(spark, d).select(F.col("id").alias("article_id"), "source"), "article_id")
    zero = lambda c: rounded(F.coalesce(F.sum("s_" + c), F.lit(0.0)) / F.sum("k"), 3)
    return b.groupBy("source").agg(F.sum("k").alias("analyses"), zero("political_bias_score").alias("avg_bias"), zero("sentiment_score").alias("avg_sentiment"))


@query(f"""WITH {SQL_B} SELECT CAST(created + INTERVAL 8 HOUR AS DATE) AS day, COALESCE(direction, 'unknown') AS direction, COUNT(*) AS n FROM b WHERE model_type = 'political_bias' GROUP BY 1, 2""")
def bias_daily_buckets(spark, d):
    from pressmill.functions.dates import local_date

    b = analyses(spark, d).where(F.col("model_type") == "political_bias")
    return b.groupBy(local_date(F.col("created_at")).alias("day"), F.coalesce("direction", F.lit("unknown")).alias("direction")).agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_A}, {SQL_B} SELECT COALESCE(a.source, 'unknown') AS source, COALESCE(b.direction, 'unknown') AS direction, COUNT(*) AS n
  FROM b LEFT JOIN a ON a.id = b.article_id WHERE model_type = 'political_bias' GROUP BY 1, 2""")
def bias_source_direction(spark, d):
    b = analyses(spark, d).where(F.col("model_type") == "political_bias").select("article_id", "direction")
    # counted by article first: an article with many rows becomes one
    per = b.groupBy("article_id", "direction").agg(F.count("*").alias("k"))
    j = per.join(articles(spark, d).select(F.col("id").alias("article_id"), "source"), "article_id", "left")
    return j.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("direction", F.lit("unknown")).alias("direction")).agg(F.sum("k").alias("n"))


@query(f"""WITH {SQL_A}, {SQL_B} SELECT a.category, COUNT(*) AS n FROM b JOIN a ON a.id = b.article_id WHERE model_type = 'political_bias' AND a.category IS NOT NULL AND a.category <> '' GROUP BY a.category
  ORDER BY n DESC, a.category LIMIT 10""")
def top_categories(spark, d):
    b = analyses(spark, d).where((F.col("model_type") == "political_bias") & F.col("article_id").isNotNull()).groupBy("article_id").agg(F.count("*").alias("k"))
    j = b.join(articles(spark, d).where(F.col("category") != "").select(F.col("id").alias("article_id"), "category"), "article_id")
    return j.groupBy("category").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "category").limit(10)


@query("SELECT source, COUNT(*) AS n FROM articles GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark, d):
    return table(spark, d, "articles").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query(f"""WITH {SQL_B} SELECT COUNT(*) AS n, COUNT(sentiment_score) AS scored, ROUND(COALESCE(AVG(sentiment_score), 0) + 1e-9, 6) AS avg_sentiment, ROUND(COALESCE(AVG(toxicity_score), 0) + 1e-9, 6) AS avg_toxicity,
  COUNT(*) FILTER (sentiment_label = 'positive') AS positive, COUNT(*) FILTER (sentiment_label = 'negative') AS negative, COUNT(*) FILTER (sentiment_label = 'neutral') AS neutral FROM b""")
def label_distribution(spark, d):
    return analyses(spark, d).agg(F.count("*").alias("n"), F.count("sentiment_score").alias("scored"), _means()[0], rounded(F.coalesce(F.avg("toxicity_score"), F.lit(0.0))).alias("avg_toxicity"), *_labels())


@query("""WITH n AS (SELECT COUNT(*) AS articles FROM articles), u AS (SELECT COUNT(*) AS unanalyzed FROM articles a WHERE NOT EXISTS (SELECT 1 FROM bias_analysis b WHERE b.article_id = a.id))
  SELECT articles, unanalyzed, ROUND((articles - unanalyzed) / articles * 100, 4) AS coverage_pct,
    CASE WHEN (articles - unanalyzed) / articles >= 0.95 THEN 'healthy' WHEN (articles - unanalyzed) / articles >= 0.80 THEN 'degraded' ELSE 'critical' END AS state FROM n, u""")
def pipeline_health(spark, d):
    b = table(spark, d, "bias_analysis").where(F.col("article_id").isNotNull()).groupBy(F.col("article_id").alias("id")).agg(F.lit(1).alias("has"))
    j = table(spark, d, "articles").select("id").join(b, "id", "left").agg(F.count("*").alias("articles"), F.count_if(F.col("has").isNull()).alias("unanalyzed"))
    share = (F.col("articles") - F.col("unanalyzed")) / F.col("articles")
    return j.withColumns({"coverage_pct": F.round(share * 100, 4), "state": F.when(share >= 0.95, "healthy").when(share >= 0.80, "degraded").otherwise("critical")})


@query("""SELECT source, COUNT(*) AS runs, COUNT(*) FILTER (status = 'success') AS ok, COUNT(*) FILTER (status = 'error') AS failed, COUNT(*) FILTER (completed_at IS NULL) AS open,
  ROUND(SUM(articles_scraped) / NULLIF(SUM(execution_time_ms) / 1000.0, 0), 6) AS per_second,
  ROUND(COUNT(*) FILTER (status = 'success') / NULLIF(COUNT(*) FILTER (status IN ('success', 'error')), 0) * 100, 1) AS success_pct FROM scraping_logs GROUP BY source""")
def run_metrics(spark, d):
    ok, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "error")
    return table(spark, d, "scraping_logs").groupBy("source").agg(
        F.count("*").alias("runs"), ok.alias("ok"), bad.alias("failed"), F.count_if(F.col("completed_at").isNull()).alias("open"),
        F.round(F.try_divide(F.sum("articles_scraped"), F.sum("execution_time_ms") / 1000.0), 6).alias("per_second"), F.round(F.try_divide(ok, ok + bad) * 100, 1).alias("success_pct"))


@query("""SELECT source, id, run_id, status, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY started_at DESC NULLS LAST, id DESC) AS rank FROM scraping_logs) q WHERE rank <= 5""")
def run_log_recent(spark, d):
    r = table(spark, d, "scraping_logs").select("source", "id", "run_id", "status", "started_at")
    return top_k_per_key(r, ["source"], [F.desc_nulls_last("started_at"), F.desc("id")], 5).drop("started_at")


@query("""SELECT run_id, id, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY completed_at DESC NULLS LAST, id DESC) AS rn FROM scraping_logs) q WHERE rn = 1""")
def run_log_once(spark, d):
    from pressmill.operators.relational import latest_per_key

    return latest_per_key(table(spark, d, "scraping_logs").select("run_id", "id", "status", "completed_at"), ["run_id"], ["completed_at", "id"]).drop("completed_at")


@query("""SELECT id, date_diff('minute', started_at, TIMESTAMPTZ '2025-12-15 04:00:00+00') AS minutes FROM scraping_logs
  WHERE completed_at IS NULL AND started_at IS NOT NULL AND epoch_us(started_at) < epoch_us(TIMESTAMP '2025-12-15 02:00:00')""")
def stuck_runs(spark, d):
    now = F.lit("2025-12-15 04:00:00+00:00").cast("timestamp")
    r = table(spark, d, "scraping_logs").where(F.col("completed_at").isNull() & (F.col("started_at") < now - F.expr("INTERVAL 2 HOURS")))
    minute = lambda c: F.floor(F.unix_seconds(c) / 60)
    return r.select("id", (minute(now) - minute(F.col("started_at"))).alias("minutes"))


@query("SELECT category, COUNT(*) AS terms, COUNT(DISTINCT lower(term)) AS words, ROUND(AVG(weight), 6) AS avg_weight FROM lexicon GROUP BY category")
def lexicon_sizes(spark, d):
    return table(spark, d, "lexicon").groupBy("category").agg(F.count("*").alias("terms"), F.count_distinct(F.lower("term")).alias("words"), F.round(F.avg("weight"), 6).alias("avg_weight"))


@query("SELECT source, MIN(length(content)) AS shortest, MAX(length(content)) AS longest, ROUND(AVG(length(content)), 6) AS average, COUNT(*) FILTER (content IS NULL) AS missing FROM articles GROUP BY source")
def content_lengths(spark, d):
    n = F.length("content")
    return table(spark, d, "articles").groupBy("source").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("average"), F.count_if(F.col("content").isNull()).alias("missing"))


@query()
def confusion_matrix(spark, d):
    """The rule for public money against what the articles are marked as."""
    a = spread(table(spark, d, "articles").where(F.col("is_funds").isNotNull()).select("id", "is_funds", "title", "content"), "id")
    x, y = F.col("is_funds"), F.col("said")
    a = a.select("is_funds", funds.by_rule(F.col("title"), F.col("content")).alias("said"))
    return a.agg(F.count("*").alias("n"), F.count_if(x & y).alias("both_yes"), F.count_if(x & ~y).alias("missed"), F.count_if(~x & y).alias("extra"), F.count_if(~x & ~y).alias("both_no"), F.round(F.count_if(x == y) / F.count("*"), 6).alias("agreement"))


@query()
def funds_disagreements(spark, d):
    """The first 25 articles that rule and mark don't agree on."""
    a = spread(table(spark, d, "articles").where(F.col("is_funds").isNotNull()).select("id", "is_funds", "title", "content"), "id")
    a = a.select("id", "is_funds", funds.by_rule(F.col("title"), F.col("content")).alias("said")).where(F.col("is_funds") != F.col("said"))
    return a.orderBy("id").limit(25)


@query("SELECT a.id, a.source FROM articles a WHERE NOT EXISTS (SELECT 1 FROM bias_analysis b WHERE b.article_id = a.id) ORDER BY a.id LIMIT 10")
def unanalyzed_sample(spark, d):
    a = table(spark, d, "articles").select("id", "source")
    return a.join(table(spark, d, "bias_analysis").select(F.col("article_id").alias("id")), "id", "left_anti").orderBy("id").limit(10)


def _json_map(key: str, n: str):
    """A JSON object of counts by name, in the order of the names."""
    return F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, n))))).alias("by_" + key)


_JSON_MAP = """'{' || string_agg('"' || direction || '":' || n::VARCHAR, ',' ORDER BY direction) || '}' AS by_direction"""


@query(f"""WITH {SQL_B}, g AS (SELECT CAST(created + INTERVAL 8 HOUR AS DATE) AS day, COALESCE(direction, 'unknown') AS direction, COUNT(*) AS n FROM b WHERE model_type = 'political_bias' GROUP BY 1, 2)
  SELECT day, SUM(n)::BIGINT AS total, {_JSON_MAP}, ROW_NUMBER() OVER (ORDER BY day DESC) AS place FROM g GROUP BY day""")
def bias_summary(spark, d):
    """Analyses by day with the counts by direction as one map, newest first (`place`)."""
    g = bias_daily_buckets(spark, d).groupBy("day").agg(F.sum("n").alias("total"), _json_map("direction", "n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("day"))).cast("bigint"))  # a row a day


@query(f"""WITH {SQL_A}, {SQL_B}, g AS (SELECT COALESCE(a.source, 'unknown') AS source, COALESCE(b.direction, 'unknown') AS direction, COUNT(*) AS n FROM b LEFT JOIN a ON a.id = b.article_id WHERE model_type = 'political_bias' GROUP BY 1, 2)
  SELECT source, SUM(n)::BIGINT AS total, {_JSON_MAP} FROM g GROUP BY source""")
def bias_source_summary(spark, d):
    """Analyses by source with the counts by direction as one map."""
    return bias_source_direction(spark, d).groupBy("source").agg(F.sum("n").alias("total"), _json_map("direction", "n"))


@query("""SELECT d.article_id, d.duplicate_of, a.title AS title, b.title AS original FROM article_duplicates d LEFT JOIN articles a ON a.id = d.article_id LEFT JOIN articles b ON b.id = d.duplicate_of""")
def duplicate_pairs(spark, d):
    t = table(spark, d, "articles").select("id", "title")
    x = table(spark, d, "article_duplicates").select("article_id", "duplicate_of")
    x = x.join(t.withColumnRenamed("id", "article_id"), "article_id", "left")
    return x.join(t.select(F.col("id").alias("duplicate_of"), F.col("title").alias("original")), "duplicate_of", "left").select("article_id", "duplicate_of", "title", "original")

