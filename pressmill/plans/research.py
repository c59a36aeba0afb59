"""Research queries: trend lines, source bias, lagged correlation, influence, margins; and generic relational ones over the other tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.functions.dates import local_date
from pressmill.functions.keys import letters_only
from pressmill.operators import stats
from pressmill.operators.relational import top_k_per_key, union_in_priority
from pressmill.plans.common import SQL_A, SQL_B, analyses, articles, by_article
from pressmill.session import staged, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


_FOLD = r"regexp_replace(lower({}), '[^\p{{L}}]+', '', 'g')"
_DAY = f"""{SQL_A}, {SQL_B}, names AS (SELECT {_FOLD.format("source")} AS k, MIN(source) AS source FROM outlets GROUP BY 1),
  w AS (SELECT names.source, a.day, COUNT(*) FILTER (sentiment_label = 'positive') AS p, COUNT(*) FILTER (sentiment_label = 'negative') AS n, COUNT(*) FILTER (sentiment_label = 'neutral') AS u
    FROM b JOIN a ON a.id = b.article_id JOIN names ON names.k = {_FOLD.format("a.source")} WHERE model_type = 'sentiment' GROUP BY 1, 2),
  s AS (SELECT source, day, p, n, u, COALESCE((p - n)::DOUBLE / NULLIF(p + n + u, 0), 0) AS score, ROW_NUMBER() OVER (PARTITION BY source ORDER BY day) - 1 AS pos FROM w)"""
#: All outlets on all days, so that series are of one length; a day without analyses scores 0.
_GRID = f"""{_DAY}, grid AS (SELECT q.source, d.pos, COALESCE(s.score, 0) AS score FROM (SELECT DISTINCT source FROM s) q CROSS JOIN (SELECT day::DATE AS day, ROW_NUMBER() OVER (ORDER BY day) - 1 AS pos FROM (SELECT unnest(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS day FROM s) z) d
  LEFT JOIN s ON s.source = q.source AND s.day = d.day)"""


def daily_scores(spark, d):
    """(source, day, p, n, u, score, pos) of the outlets, by Manila day; names that fold alike are one outlet, under its name in `outlets`."""
    o = table(spark, d, "outlets").groupBy(letters_only(F.col("source")).alias("key")).agg(F.min("source").alias("source"))
    a = articles(spark, d).select(F.col("id").alias("article_id"), letters_only(F.col("source")).alias("key"), "day")
    b = by_article(analyses(spark, d).where(F.col("model_type") == "sentiment"))
    w = b.join(a.join(o, "key"), "article_id").groupBy("source", "day").agg(*[F.sum("l_" + x).alias(y) for x, y in (("positive", "p"), ("negative", "n"), ("neutral", "u"))])
    return stats.positions(w.withColumn("score", stats.daily_score(F.col("p"), F.col("n"), F.col("u"))), ["source"], "day")


def on_all_days(w):
    """(source, pos, score): every source of daily_scores on every day between the first and the last of all, so that series are of one length; a day without analyses scores 0."""
    w = staged(w.select("source", "day", "score"), "daily")
    span = w.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if span.lo is None:
        return w.select("source", F.lit(0).alias("pos"), "score")
    days = F.explode(F.sequence(F.lit(span.lo), F.lit(span.hi))).alias("day")
    g = w.select("source").distinct().select("source", days).join(w, ["source", "day"], "left")
    return g.select("source", F.datediff("day", F.lit(span.lo)).alias("pos"), F.coalesce("score", F.lit(0.0)).alias("score"))


@query(f"WITH {_DAY} SELECT source, day, p, n, u, ROUND(score, 6) AS score, pos FROM s")
def sentiment_daily_scores(spark, d):
    return daily_scores(spark, d).withColumn("score", F.round("score", 6))


@query(f"""WITH {_DAY}, r AS (SELECT source, COUNT(*) AS n, COALESCE(regr_slope(score, pos), 0) AS slope, COALESCE(regr_intercept(score, pos), AVG(score)) AS intercept, MAX(pos) AS last FROM s GROUP BY source HAVING COUNT(*) >= 14)
  SELECT source, n, ROUND(slope, 6) AS slope, ROUND(intercept, 6) AS intercept, CASE WHEN slope * 7 > 0.1 THEN 'up' WHEN slope * 7 < -0.1 THEN 'down' ELSE 'stable' END AS direction,
    ROUND(intercept + slope * (last + 1), 6) AS next_value FROM r""")
def daily_score_ols(spark, d):
    return _ols(daily_scores(spark, d))


def _ols(w):
    t = stats.trend(w, ["source"], "pos", "score")
    return t.select("source", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "direction", F.round(F.col("forecast")[0]["value"], 6).alias("next_value"))


@query()
def forecast_bands(spark, d):
    return _bands(daily_scores(spark, d))


def _bands(w):
    t = stats.trend(w, ["source"], "pos", "score")
    return t.select("source", F.round("r2", 6).alias("r2"), F.round("residual_std", 6).alias("residual_std"), F.explode("forecast").alias("f")).select("source", "r2", "residual_std", "f.*")


@query(f"""WITH {_DAY} SELECT source, ROUND(SUM(p - n)::DOUBLE / NULLIF(SUM(p + n + u), 0), 6) AS bias, ROUND(1 - stddev_pop(score), 6) AS consistency, SUM(p + n + u)::BIGINT AS n,
  CASE WHEN SUM(p - n)::DOUBLE / NULLIF(SUM(p + n + u), 0) > 0.2 THEN 'positive' WHEN SUM(p - n)::DOUBLE / NULLIF(SUM(p + n + u), 0) < -0.2 THEN 'negative' ELSE 'balanced' END AS positioning FROM s GROUP BY source""")
def source_bias(spark, d):
    return _bias(daily_scores(spark, d))


def _bias(w):
    w = w.groupBy("source").agg(F.sum(F.col("p") - F.col("n")).alias("k"), F.sum(F.col("p") + F.col("n") + F.col("u")).alias("n"), F.stddev_pop("score").alias("sd"))
    bias = F.try_divide(F.col("k"), F.col("n"))
    return w.select("source", F.round(bias, 6).alias("bias"), F.round(1 - F.col("sd"), 6).alias("consistency"), "n", F.when(bias > 0.2, "positive").when(bias < -0.2, "negative").otherwise("balanced").alias("positioning"))


@query(f"""WITH {_GRID}, c AS (SELECT x.source AS a, y.source AS b, l.lag, COUNT(*) AS n, covar_pop(x.score, y.score) AS c, stddev_pop(x.score) AS sx, stddev_pop(y.score) AS sy
  FROM grid x CROSS JOIN (VALUES (0), (1), (2), (3)) l(lag) JOIN grid y ON y.pos = x.pos + l.lag AND x.source < y.source GROUP BY 1, 2, 3)
  SELECT a, b, lag, n, ROUND(c / (sx * sy), 6) AS r FROM c WHERE n > 1 AND sx * sy > 0""")
def lagged_correlation(spark, d):
    return _correlation(daily_scores(spark, d)).withColumn("r", F.round("r", 6))


def _correlation(w):
    """Of the series on all days; their number is that of the outlets, a table of fixed size, so pairs are few."""
    return stats.lagged_correlation(on_all_days(w), "source", "pos", "score")


@query()
def propagation_edges(spark, d):
    return _edges(daily_scores(spark, d))


def _edges(w):
    return stats.edges(stats.strongest_lag(_correlation(w))).withColumn("r", F.round("r", 6))


@query()
def influence_scores(spark, d):
    return _influence(daily_scores(spark, d))


def _influence(w):
    i = stats.influence(stats.edges(stats.strongest_lag(_correlation(w))), w, "source")
    return i.withColumn("influence", F.round("influence", 6))


@query()
def propagation_pattern(spark, d):
    return _pattern(propagation_edges(spark, d))


def _pattern(e):
    e = e.agg(F.count_if(F.col("relation") == "leads").alias("leads"), F.count_if(F.col("relation") == "follows").alias("follows"))
    return e.withColumn("pattern", F.when(F.col("leads") > F.col("follows"), "hierarchical").otherwise("distributed"))


@query()
def top_influencers(spark, d):
    """The three outlets of most influence."""
    return influence_scores(spark, d).orderBy(F.desc("influence"), "source").limit(3)


@query(f"""WITH {_DAY}, q AS (SELECT source, score, ROW_NUMBER() OVER (PARTITION BY source ORDER BY pos DESC) AS back FROM s)
  SELECT source, ROUND(AVG(score) FILTER (back <= 7), 6) AS recent, ROUND(AVG(score), 6) AS overall, ROUND(stddev_pop(score), 6) AS volatility,
    ABS(AVG(score) FILTER (back <= 7) - AVG(score)) > 0.2 AS shifted, stddev_pop(score) > 0.3 AS volatile FROM q GROUP BY source""")
def recent_against_overall(spark, d):
    return _recent(daily_scores(spark, d))


def _recent(w):
    q = w.withColumn("back", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("pos"))))
    recent = F.avg(F.when(F.col("back") <= 7, F.col("score")))
    g = q.groupBy("source").agg(recent.alias("recent"), F.avg("score").alias("overall"), F.stddev_pop("score").alias("volatility"))
    return g.select("source", F.round("recent", 6).alias("recent"), F.round("overall", 6).alias("overall"), F.round("volatility", 6).alias("volatility"), (F.abs(F.col("recent") - F.col("overall")) > 0.2).alias("shifted"), (F.col("volatility") > 0.3).alias("volatile"))


@query(f"WITH {_DAY} SELECT source, day, ROUND(score - LAG(score) OVER (PARTITION BY source ORDER BY pos), 6) AS change FROM s")
def daily_change(spark, d):
    return _change(daily_scores(spark, d), "day")


def _change(w, day):
    return w.select("source", day, F.round(F.col("score") - F.lag("score").over(Window.partitionBy("source").orderBy("pos")), 6).alias("change"))


@query("SELECT source, COUNT(*) AS n, ROUND(1.96 * 0.5 / sqrt(COUNT(*)), 6) AS margin, CASE WHEN COUNT(*) > 1000 THEN 0.95 WHEN COUNT(*) > 100 THEN 0.8 ELSE 0.5 END::DOUBLE AS power FROM articles GROUP BY source")
def margin_of_error(spark, d):
    g = table(spark, d, "articles").groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumns({"margin": F.round(stats.margin_of_error(F.col("n")), 6), "power": stats.power_band(F.col("n"))})


@query("""WITH k AS (SELECT source, execution_time_ms AS v, ROW_NUMBER() OVER (PARTITION BY source ORDER BY execution_time_ms) - 1 AS i, COUNT(*) OVER (PARTITION BY source) AS n FROM scraping_logs WHERE execution_time_ms IS NOT NULL)
  SELECT source, v AS median FROM k WHERE i = n // 2""")
def funds_upper_median(spark, d):
    r = table(spark, d, "scraping_logs").where(F.col("execution_time_ms").isNotNull()).select("source", F.col("execution_time_ms").alias("v"))
    # by place in each source's sorted rows; equal values are counted once before they are sorted
    h = r.groupBy("source", "v").agg(F.count("*").alias("k"))
    w = Window.partitionBy("source").orderBy("v")
    h = h.withColumns({"upto": F.sum("k").over(w), "n": F.sum("k").over(Window.partitionBy("source"))})
    return h.where((F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("k") <= F.floor(F.col("n") / 2))).select("source", F.col("v").alias("median"))


@query("""WITH t AS (SELECT id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM articles), c AS (SELECT id, tag, COUNT(*) AS n, MIN(pos) AS first FROM t GROUP BY id, tag)
  SELECT id, tag FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY n DESC, first) AS rn FROM c) q WHERE rn = 1""")
def primary_agency_mode(spark, d):
    from pressmill.functions.money import first_mode

    return table(spark, d, "articles").where(F.size("tags") > 0).select("id", first_mode(F.col("tags")).alias("tag"))


@query("""SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_days(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1""")
def event_local_days(spark, d):
    return table(spark, d, "events").groupBy(local_date(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, ROUND(SUM(value), 4) AS impact, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY ROUND(SUM(value), 4) DESC, event_type) AS place FROM events GROUP BY event_type""")
def events_by_impact(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("impact"), F.count("*").alias("n"))
    return e.withColumn("place", F.row_number().over(Window.orderBy(F.desc("impact"), "event_type")).cast("bigint"))  # a row a type


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1) SELECT e.event_type, l.lag, COUNT(*) AS pairs, ROUND(AVG(d.n), 6) AS avg_after
  FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events) e CROSS JOIN range(0, 8) l(lag) JOIN d ON d.day = e.day + l.lag::INTEGER GROUP BY 1, 2""")
def event_lags(spark, d):
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"))
    days = e.groupBy("day").agg(F.count("*").alias("n"))
    lags = e.distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("lag"), "day").select("event_type", "lag", F.date_add("day", F.col("lag")).alias("day"))
    return lags.join(days, "day").groupBy("event_type", F.col("lag").cast("bigint").alias("lag")).agg(F.count("*").alias("pairs"), F.round(F.avg("n"), 6).alias("avg_after"))


@query("""SELECT n_name, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def orders_by_nation(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("t"))
    j = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    j = j.groupBy("c_nationkey").agg(F.sum("k").alias("k"), F.sum("t").alias("t"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return j.join(n, "c_nationkey").groupBy("n_name").agg(F.sum("k").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) q WHERE rank <= 3""")
def top_lines_per_supplier(spark, d):
    x = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_k_per_key(x, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).drop("l_extendedprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT r_name, COUNT(*) AS suppliers FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def suppliers_by_region(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return s.join(n, "n_nationkey").join(table(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey").groupBy("r_name").agg(F.sum("k").alias("suppliers"))


@query()
def priority_discovery(spark, d):
    a, r = table(spark, d, "articles"), table(spark, d, "raw_articles")
    parts = [a.where(F.col("source") == "Dagat Post").select(F.col("title").alias("key"), F.col("id").alias("pos")), r.where(F.col("source") == "Dagat Post").select(F.col("raw_html").alias("key"), F.col("id").alias("pos"))]
    return union_in_priority([p.where(F.col("key").isNotNull()) for p in parts], "key", 1_000_000, "pos").select("pos")


@query("SELECT lang, source, COUNT(*) AS n, ROUND(AVG(n_chars), 6) AS avg_chars, MAX(n_chars) AS most FROM documents GROUP BY lang, source")
def document_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("avg_chars"), F.max("n_chars").alias("most"))


@query("""SELECT label, COUNT(*) AS n, ROUND(AVG(embedding[1]), 6) AS first_mean FROM embeddings GROUP BY label""")
def embedding_labels(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("first_mean"))
