"""Compositions that an application asks for as a whole: explanations, insights, evaluation, backfill, research summary, export."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pressmill.functions import entities, money, text, urls
from pressmill.functions.dates import local_format
from pressmill.models import funds, rows
from pressmill.operators.relational import latest_per_key
from pressmill.plans.common import AS_OF, SQL_A, SQL_B, analyses, articles, between
from pressmill.plans.research import daily_scores
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


@query(f"""WITH {SQL_B}, m AS (SELECT id, model_metadata.analysis_components.keyword_score AS keyword_score, model_metadata.analysis_components.version AS version FROM bias_analysis),
  r AS (SELECT b.*, ROW_NUMBER() OVER (PARTITION BY article_id ORDER BY created DESC, b.id DESC) AS rn FROM b WHERE model_type = 'political_bias' AND article_id IS NOT NULL)
  SELECT r.article_id, a.title, a.source, r.direction, ROUND(m.keyword_score, 6) AS keyword_score, m.version FROM r JOIN m ON m.id = r.id LEFT JOIN articles a ON a.id = r.article_id WHERE rn = 1""")
def bias_explain(spark, d):
    c = F.col("model_metadata.analysis_components")
    b = table(spark, d, "bias_analysis").where((F.col("model_type") == "political_bias") & F.col("article_id").isNotNull())
    b = b.select("article_id", "id", "created_at", F.col("model_metadata.direction").alias("direction"), F.round(c["keyword_score"], 6).alias("keyword_score"), c["version"].alias("version"))
    a = table(spark, d, "articles").select(F.col("id").alias("article_id"), "title", "source")
    return latest_per_key(b, ["article_id"], ["created_at", "id"]).join(a, "article_id", "left").select("article_id", "title", "source", "direction", "keyword_score", "version")


@query(f"""WITH {SQL_A} SELECT day, COUNT(*) AS n FROM a WHERE is_funds AND trim(published_at, ' ') <> '' GROUP BY 1""")
def funds_date_distribution(spark, d):
    """By the Manila day of publication; texts that denote no instant count for the day of ingestion."""
    return articles(spark, d).where(F.col("is_funds") & (F.trim("published_at") != "")).groupBy("day").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT 'source' AS kind, source AS value, COUNT(*) AS n FROM articles WHERE is_funds GROUP BY source ORDER BY n DESC, value LIMIT 10),
  c AS (SELECT 'category' AS kind, category AS value, COUNT(*) AS n FROM articles WHERE is_funds GROUP BY category ORDER BY n DESC, value NULLS FIRST LIMIT 10) SELECT * FROM s UNION ALL SELECT * FROM c""")
def funds_insights(spark, d):
    a = table(spark, d, "articles").where("is_funds").select("source", "category")
    top = lambda c: a.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(10).select(F.lit(c).alias("kind"), "value", "n")
    return top("source").unionByName(top("category"))


@query("""WITH t AS (SELECT id, lower(COALESCE(title, '') || ' ' || COALESCE(content, '')) AS t FROM articles WHERE is_funds), w AS (SELECT unnest(['pork','kickback','anomaly','graft','plunder','misuse','overprice','scam','whistleblower']) AS term)
  SELECT term, COUNT(*) AS articles FROM t, w WHERE contains(t, term) GROUP BY term""")
def funds_irregular_terms(spark, d):
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return table(spark, d, "articles").where("is_funds").select(F.explode(money.terms_in(t, money.IRREGULAR_TERMS)).alias("term")).groupBy("term").agg(F.count("*").alias("articles"))


@query()
def funds_eval(spark, d):
    """Candidates only: the rule against the gate."""
    t, c = F.col("title"), F.col("content")
    a = spread(table(spark, d, "articles").select("id", "title", "content"), "id").where(funds.candidate(t, c)).select(funds.by_rule(t, c).alias("x"), funds.gated(t, c).alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.agg(F.count("*").alias("n"), F.count_if(x & y).alias("both_yes"), F.count_if(x & ~y).alias("rule_only"), F.count_if(~x & y).alias("gate_only"), F.count_if(~x & ~y).alias("both_no"), F.round(F.avg((x == y).cast("double")), 6).alias("agreement"))


@query()
def funds_entity_spans(spark, d):
    a = spread(table(spark, d, "articles").select("id", "content"), "id")
    s = a.select("id", F.explode(entities.entity_spans(F.col("content"))).alias("s"))
    return s.select("id", "s.*")


@query()
def lexicon_entity_spans(spark, d):
    """Terms of the lexicon, by category, where they stand in titles."""
    terms: dict[str, list[str]] = {}
    for c, t in table(spark, d, "lexicon").where(F.col("term").isNotNull()).select("category", "term").collect():  # a table of fixed size
        terms.setdefault(c, []).append(t)
    s = table(spark, d, "articles").select("id", F.explode(entities.entity_spans(F.col("title"), entities.dictionary(terms))).alias("s"))
    return s.select("id", "s.label", "s.text", "s.start", "s.end")


@query("""SELECT id, CASE WHEN category IS NOT NULL AND trim(category, ' ') <> '' THEN 'kept' ELSE 'updated' END AS decision FROM articles WHERE category IS NULL OR trim(category, ' ') = '' OR category IN ('Post', 'General', 'Uncategorized')""")
def category_backfill(spark, d):
    c = F.col("category")
    blank = c.isNull() | (F.trim(c) == "")
    a = table(spark, d, "articles").where(blank | c.isin("Post", "General", "Uncategorized"))
    return a.select("id", F.when(~blank, "kept").otherwise("updated").alias("decision"))


@query()
def category_backfill_values(spark, d):
    """What each uncategorized article's URL says, by the section map, and whether that is more than the default."""
    a = table(spark, d, "articles").where(F.col("category").isNull() | F.col("category").isin("Post", "General", "Uncategorized"))
    s = a.select("id", urls.section_from_url(F.col("url")).alias("s"))
    return s.select("id", F.col("s.category").alias("category"), F.col("s.raw").alias("raw"), F.col("s.raw").isNotNull().alias("resolved"))


@query("""SELECT id FROM articles WHERE regexp_matches(lower(COALESCE(title, '')), 'lotto|swertres|ez2|6/4[0-9]|jackpot|winning numbers|horoscope|crossword')""")
def filler_titles(spark, d):
    return table(spark, d, "articles").where(F.lower(F.coalesce("title", F.lit(""))).rlike(r"lotto|swertres|ez2|6/4[0-9]|jackpot|winning numbers|horoscope|crossword")).select("id")


@query(r"""SELECT id, replace(replace(regexp_replace(regexp_replace(title, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?i)(?:javascript|data):', '', 'g'), '<', '&lt;'), '>', '&gt;') AS escaped,
  trim(replace(replace(trim(regexp_replace(regexp_replace(title, '<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g'), ' '), 'READ MORE', ''), 'ADVERTISEMENT', ''), ' ') AS cleaned FROM articles""")
def titles_sanitized(spark, d):
    t = F.col("title")
    return table(spark, d, "articles").select("id", text.without_active_parts(t).alias("escaped"), text.without_phrases(text.without_tags(t), ["READ MORE", "ADVERTISEMENT"]).alias("cleaned"))


@query(f"""WITH {SQL_A}, {SQL_B}, w AS (SELECT a.source, a.day, sentiment_label, sentiment_score FROM b JOIN a ON a.id = b.article_id WHERE model_type = 'sentiment')
  SELECT COUNT(*) AS n, COUNT(DISTINCT day) AS days, COUNT(DISTINCT source) AS sources, ROUND(AVG(sentiment_score), 6) AS average, ROUND(stddev_pop(sentiment_score), 6) AS volatility,
    COUNT(*) FILTER (sentiment_label = 'positive') AS positive, COUNT(*) FILTER (sentiment_label = 'negative') AS negative, COUNT(*) FILTER (sentiment_label = 'neutral') AS neutral,
    CASE WHEN COUNT(*) FILTER (sentiment_label = 'positive') > COUNT(*) FILTER (sentiment_label = 'negative') THEN 'positive' WHEN COUNT(*) FILTER (sentiment_label = 'positive') < COUNT(*) FILTER (sentiment_label = 'negative') THEN 'negative' ELSE 'balanced' END AS pattern,
    ROUND(1.96 * sqrt(0.25 / COUNT(*)), 6) AS margin, CASE WHEN COUNT(*) > 1000 THEN 0.95 WHEN COUNT(*) > 100 THEN 0.8 ELSE 0.5 END::DOUBLE AS power FROM w""")
def research_summary(spark, d):
    from pressmill.operators import stats

    w = analyses(spark, d).where(F.col("model_type") == "sentiment").join(articles(spark, d).select(F.col("id").alias("article_id"), "source", "day"), "article_id")
    label = lambda x: F.count_if(F.col("sentiment_label") == x).alias(x)
    s = w.agg(label("positive"), label("negative"), label("neutral"), F.count("*").alias("n"), F.count_distinct("day").alias("days"), F.count_distinct("source").alias("sources"), F.round(F.avg("sentiment_score"), 6).alias("average"), F.round(F.stddev_pop("sentiment_score"), 6).alias("volatility"))
    pattern = F.when(F.col("positive") > F.col("negative"), "positive").when(F.col("positive") < F.col("negative"), "negative").otherwise("balanced")
    return s.withColumns({"pattern": pattern, "margin": F.round(stats.margin_of_error(F.col("n")), 6), "power": stats.power_band(F.col("n"))})


@query()
def key_factors(spark, d):
    """What stands out in each outlet's series: volatility, the trend of seven days, a recent shift; an empty text for nothing."""
    from pyspark.sql import Window

    from pressmill.operators import stats

    w = daily_scores(spark, d)
    back = w.withColumn("back", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("pos"))))
    g = back.groupBy("source").agg(F.stddev_pop("score").alias("sd"), F.avg("score").alias("mean"), F.avg(F.when(F.col("back") <= 7, F.col("score"))).alias("recent"))
    t = stats.trend(w, ["source"], "pos", "score").select("source", (F.col("slope") * 7).alias("slope"))
    factors = F.array_compact(F.array(F.when(F.col("sd") > 0.3, "high volatility"), F.when(F.col("slope") > 0.1, "upward trend").when(F.col("slope") < -0.1, "downward trend"), F.when(F.abs(F.col("recent") - F.col("mean")) > 0.2, "recent shift")))
    return g.join(t, "source", "left").select("source", F.array_join(factors, "|").alias("factors"))


@query(f"WITH {SQL_A} SELECT id, source FROM a WHERE moment >= TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}' - INTERVAL 48 HOUR AND moment < TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'")
def recent_hours(spark, d):
    return between(articles(spark, d), AS_OF - dt.timedelta(hours=48), AS_OF).select("id", "source")


@query("""SELECT id, array_to_string(list_transform(string_split(coalesce(array_to_string(tags, ','), ''), ','), lambda x: lower(trim(x, ' ')))[1:3], '|') AS head, md5(source || ':' || id::VARCHAR) AS digest FROM articles""")
def array_and_hash_scalars(spark, d):
    parts = F.transform(F.split(F.coalesce(F.array_join("tags", ","), F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return table(spark, d, "articles").select("id", F.array_join(F.slice(parts, 1, 3), "|").alias("head"), F.md5(F.concat_ws(":", "source", F.col("id").cast("string"))).alias("digest"))


@query("""SELECT id, array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: TRY_CAST(trim(x, ' ') AS INTEGER)), lambda x: x IS NOT NULL), '|') AS ids FROM (SELECT id, id::VARCHAR || ', ' || COALESCE(source, '') || ',7 ,,x9' AS t FROM articles) q""")
def id_lists(spark, d):
    """Comma lists as typed, read as numbers; what is none is left out."""
    t = F.concat(F.col("id").cast("string"), F.lit(", "), F.coalesce("source", F.lit("")), F.lit(",7 ,,x9"))
    ids = F.array_compact(F.transform(F.split(t, ","), lambda x: F.trim(x).try_cast("int")))
    return table(spark, d, "articles").select("id", F.array_join(ids.cast("array<string>"), "|").alias("ids"))


@query("""SELECT id, strftime(m, '%Y-%m-%d %H:%M') AS shown, strftime(m, '%b %Y') AS month FROM (SELECT id, make_timestamp(epoch_us(inserted_at)) + INTERVAL 8 HOUR AS m FROM articles) q""")
def local_formats(spark, d):
    t = F.col("inserted_at")
    return table(spark, d, "articles").select("id", local_format(t, "yyyy-MM-dd HH:mm").alias("shown"), local_format(t, "MMM yyyy").alias("month"))


@query()
def analysis_rows(spark, d):
    """Both models' rows for the articles that have none yet."""
    a = table(spark, d, "articles").select("id", "title", "content")
    new = a.join(table(spark, d, "bias_analysis").select(F.col("article_id").alias("id")), "id", "left_anti")
    return rows.analysis_rows(new, [rows.sentiment_model(), rows.political_model(table(spark, d, "lexicon"))])


@query("""SELECT label, COUNT(*) AS spans, COUNT(DISTINCT id) AS articles FROM (SELECT id, 'agency' AS label, unnest(regexp_extract_all(content, '(?i)' || $A, 1)) AS t FROM articles UNION ALL SELECT id, 'amount', unnest(regexp_extract_all(content, '(?i)' || $M, 1)) FROM articles
  UNION ALL SELECT id, 'location', unnest(regexp_extract_all(content, '(?i)' || $P, 1)) FROM articles) q GROUP BY label""".replace("$A", f"'{money.AGENCY}'").replace("$M", f"'{money.AMOUNT}'").replace("$P", f"'{money.PLACE}'"))
def funds_entity_counts(spark, d):
    """Spans by label, and the articles that have any."""
    return funds_entity_spans(spark, d).groupBy("label").agg(F.count("*").alias("spans"), F.count_distinct("id").alias("articles"))


@query()
def dashboard_export(spark, d):
    """One JSON document per outlet, as the export writes them."""
    from pressmill.plans.dashboards import dashboard_by_source

    s = dashboard_by_source(spark, d)
    return s.select("source", F.to_json(F.struct(*[c for c in s.columns])).alias("json"))
