"""Queries of text, URL, date, money and lexicon functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.functions import dates, html, lexicon, money, sites, text, urls
from pressmill.models import funds, political, sentiment
from pressmill.operators import stats
from pressmill.operators.relational import append_absent, first_per_key, merge_latest
from pressmill.plans.common import SQL_A, SQL_B, analyses, articles
from pressmill.session import spread, staged, table
from pressmill.sources.readers import discovered_links, stubs



def _texts(spark, d, *columns):
    """(id, title, content) of all articles, over all cores even where one row group holds them: what follows is heavy per row."""
    return spread(table(spark, d, "articles").select("id", "title", "content", *columns), "id")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


_CANON = r"""CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) ||
  CASE WHEN regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') END ELSE url END"""


@query(f"SELECT id, {_CANON} AS url FROM articles")
def url_canonical(spark, d):
    return table(spark, d, "articles").select("id", urls.canonical_url(F.col("url")).alias("url"))


@query(f"SELECT u AS url, id FROM (SELECT {_CANON} AS u, id, ROW_NUMBER() OVER (PARTITION BY {_CANON} ORDER BY id) AS rn FROM articles WHERE url IS NOT NULL) q WHERE rn = 1")
def dedup_keep_first(spark, d):
    a = table(spark, d, "articles").where(F.col("url").isNotNull()).select("id", urls.canonical_url(F.col("url")).alias("url"))
    return first_per_key(a, ["url"], ["id"])


@query(f"SELECT id, u AS url FROM (SELECT id, {_CANON} AS u FROM articles WHERE url IS NOT NULL AND epoch_us(inserted_at) >= epoch_us(TIMESTAMP '2025-10-01')) n WHERE u NOT IN (SELECT {_CANON} FROM articles WHERE url IS NOT NULL AND epoch_us(inserted_at) < epoch_us(TIMESTAMP '2025-10-01'))")
def new_urls(spark, d):
    a = table(spark, d, "articles").where(F.col("url").isNotNull()).select("id", urls.canonical_url(F.col("url")).alias("url"), "inserted_at")
    cut = F.lit("2025-10-01 00:00:00+00:00").cast("timestamp")
    return a.where(F.col("inserted_at") >= cut).join(a.where(F.col("inserted_at") < cut).select("url"), "url", "left_anti").select("id", "url")


@query(rf"""WITH s AS (SELECT id, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM articles)
  SELECT id, len(seg) AS depth, CASE lower(seg[1]) WHEN 'news' THEN 'News' WHEN 'technology' THEN 'Technology' WHEN 'health' THEN 'Health' WHEN 'education' THEN 'Education' WHEN 'metro' THEN 'Metro'
    WHEN 'sports' THEN 'Sports' WHEN 'opinion' THEN 'Opinion' WHEN 'business' THEN 'Business' WHEN 'entertainment' THEN 'Entertainment' ELSE 'News' END AS category FROM s""")
def url_sections(spark, d):
    u = F.col("url")
    return table(spark, d, "articles").select("id", F.size(urls.segments(u)).alias("depth"), urls.section_from_url(u)["category"].alias("category"))


@query()
def url_category(spark, d):
    u = F.col("url")
    return table(spark, d, "articles").select("id", urls.category_from_url(u).alias("category"), F.coalesce(urls.category_from_url(u), F.lit("General")).alias("resolved"))


@query()
def url_validity(spark, d):
    u = F.col("url")
    dated = urls.valid_by_rules(u, [r"/\d{4}/\d{2}/\d{2}/"], [r"/page/\d+", r"/tag/"], least_segments=4, least_slug=10)
    return table(spark, d, "articles").where(u.isNotNull()).select("id", urls.valid_news_url(u, F.concat(text.fold_name(F.col("source")), F.lit(".example"))).alias("valid"), dated.alias("dated"))


@query()
def url_site_stories(spark, d):
    """What each site's rules say of the path of every article's URL, whatever its host."""
    u = F.col("url")
    return table(spark, d, "articles").where(u.isNotNull()).select("id", *[sites.is_story(u, r, host="").alias(k.replace(" ", "_")) for k, r in sites.STORIES.items()])


@query()
def url_site_sections(spark, d):
    """The section that each site's rules read in every article's URL."""
    return table(spark, d, "articles").select("id", *[sites.section(F.col("url"), r)["category"].alias(k.replace(" ", "_")) for k, r in sites.SECTIONS.items()])


@query("SELECT id, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS folded FROM articles")
def source_folded(spark, d):
    return table(spark, d, "articles").select("id", text.fold_name(F.col("source")).alias("folded"))


@query()
def names_normalized(spark, d):
    return table(spark, d, "articles").select("id", text.normalize_source(F.col("source")).alias("source"), text.normalize_category(F.col("category")).alias("category"))


@query("""SELECT id, CASE WHEN regexp_matches(lower(url), '/(videos|video|watch|play|stream)/') THEN 'video content' WHEN content IS NULL OR length(trim(content, ' ')) < 50 THEN 'insufficient content' END AS reason FROM articles""")
def skip_reasons(spark, d):
    return table(spark, d, "articles").select("id", text.skip_reason(F.col("url"), F.col("content")).alias("reason"))


@query("""SELECT id, CASE WHEN length(content) > 1000 THEN substr(content, 1, 1000) || '...' WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS cut,
  length(content) + 50 * GREATEST(1, length(content) - length(regexp_replace(content, '[.!?]', '', 'g'))) AS score, NULLIF(trim(title, ' '), '') AS title FROM articles""")
def content_shaping(spark, d):
    c = F.col("content")
    return table(spark, d, "articles").select("id", text.tiered_cut(c).alias("cut"), text.reading_score(c).alias("score"), text.blank_to_null(F.col("title")).alias("title"))


@query(r"SELECT id, trim(regexp_replace(regexp_replace(title, '<[^>]*>', '', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ') AS title FROM articles")
def titles_without_tags(spark, d):
    return table(spark, d, "articles").select("id", text.without_tags(F.col("title")).alias("title"))


@query(f"WITH {SQL_A} SELECT id, day, strftime(day, '%A') AS weekday, CAST(date_trunc('month', moment) AS DATE) AS month FROM a")
def date_parts(spark, d):
    return articles(spark, d).select("id", "day", dates.weekday_name(F.col("day")).alias("weekday"), F.to_date(F.date_trunc("month", "at")).alias("month"))


@query("""SELECT id, CASE WHEN s >= 86400 THEN (s // 86400)::VARCHAR || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN s >= 60 THEN (s // 60)::VARCHAR || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' ELSE 'just now' END AS age
  FROM (SELECT id, epoch_us(TIMESTAMP '2026-06-01') // 1000000 - epoch_us(inserted_at) // 1000000 AS s FROM articles) q""")
def relative_ages(spark, d):
    return table(spark, d, "articles").select("id", dates.relative_age(F.col("inserted_at"), F.lit("2026-06-01 00:00:00+00:00").cast("timestamp")).alias("age"))


@query("""SELECT id, CASE WHEN t = '' OR regexp_matches(t, '(?:basketball|volleyball|football|soccer|nba|pba|uaap|ncaa|tournament|match|game|coach|player|club)|(?:shabu|buy-bust|drug|narcotics|illegal\\s+drugs|anti-drug|meth|pdea)|(?:earthquake|typhoon|hurricane|natural\\s+disaster|magnitude|aftershock|tsunami|landslide|volcano|eruption|storm|cyclone|tornado|flash\\s+flood|flooding\\s+incident)|(?:damage|damages|destroyed|collapsed|injured|killed|deaths|casualties|evacuated|displaced|affected|victims|property\\s+damage)')
    THEN false ELSE regexp_matches(t, '(?:fund|budget|appropriation|allocation|disbursement|audit|coa|billion|million|trillion|peso|pesos)') AND regexp_matches(t, '(?:philippine|ph|dpwh|dbm|coa|comelec|dilg|doh|deped|dotr|senate|house|congress|solon|lawmaker|bill|appropriation|budget|malacañang|palace|president|vice president|ombudsman)|(?:pork|kickback|anomaly|graft|plunder|misuse|overprice|scam|whistleblower)') END AS is_funds
  FROM (SELECT id, lower(trim(COALESCE(title, '') || chr(10) || COALESCE(content, ''), ' ')) AS t FROM articles) q""".replace("\\\\", "\\"))
def funds_classify(spark, d):
    return _texts(spark, d).select("id", funds.by_rule(F.col("title"), F.col("content")).alias("is_funds"))


@query()
def funds_gated(spark, d):
    t, c = F.col("title"), F.col("content")
    return _texts(spark, d).select("id", funds.gated(t, c).alias("gated"), funds.gate(t, c)["confidence"].alias("confidence"), funds.candidate(t, c).alias("candidate"))


@query(r"""WITH n AS (SELECT unnest(regexp_extract_all(lower(COALESCE(title, '') || ' ' || COALESCE(content, '')), '(\d+(?:\.\d+)?)\s*(?:billion|million|b|m|php|peso|pesos)', 1))::DOUBLE AS x FROM articles WHERE is_funds)
  SELECT COUNT(*) AS n, MAX(x) AS largest, MIN(x) AS least, ROUND(AVG(x), 6) AS average FROM n""")
def funds_money_stats(spark, d):
    a = table(spark, d, "articles").where("is_funds").select(F.explode(money.loose_numbers(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))))).alias("x"))
    return a.agg(F.count("*").alias("n"), F.max("x").alias("largest"), F.min("x").alias("least"), F.round(F.avg("x"), 6).alias("average"))


@query("""WITH t AS (SELECT id, lower(COALESCE(title, '') || ' ' || COALESCE(content, '')) AS t FROM articles), w AS (SELECT unnest(['dpwh','dbm','coa','comelec','dilg','doh','deped','dotr','senate','house','congress']) AS term)
  SELECT term, COUNT(*) AS articles FROM t, w WHERE contains(t, term) GROUP BY term""")
def funds_term_docfreq(spark, d):
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return table(spark, d, "articles").select(F.explode(money.terms_in(t, money.AGENCY_TERMS)).alias("term")).groupBy("term").agg(F.count("*").alias("articles"))


def _entities(spark, d):
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return _texts(spark, d).withColumn("t", t).select("id", money.mentions(F.col("t"), money.AGENCY).alias("agencies"), money.mentions(F.col("t"), money.AMOUNT).alias("amounts"), money.mentions(F.col("t"), money.IRREGULAR).alias("irregular"), money.mentions(F.col("t"), money.PROJECT).alias("projects"), money.mentions(F.col("t"), money.PLACE).alias("places"))


@query()
def funds_entities(spark, d):
    e = _entities(spark, d)
    e = e.withColumns({"total": money.total_amount(F.col("amounts")), "primary_agency": money.first_mode(F.col("agencies")), "relevance": money.relevance(F.col("agencies"), F.col("amounts"), F.col("irregular"), F.col("projects"))})
    return e.select("id", *[F.array_join(c, "|").alias(c) for c in ("agencies", "amounts")], "total", "primary_agency", "relevance")


@query()
def funds_trends(spark, d):
    e = _entities(spark, d).select(money.total_amount(F.col("amounts")).alias("total"), (F.size("irregular") > 0).alias("irregular"))
    e = staged(e, "funds")
    middle = stats.upper_median_of(e, "total")
    s = e.agg(F.count("*").alias("articles"), F.round(F.sum("total") / 1e6, 2).alias("total_millions"), F.min("total").alias("least"), F.max("total").alias("largest"), F.round(F.avg(F.col("irregular").cast("double")), 6).alias("irregular_rate"))
    return s.withColumns({"average_millions": F.round(F.col("total_millions") / F.col("articles"), 4), "median": F.lit(middle).cast("double")})


@query(rf"""SELECT id, array_to_string(list_distinct(regexp_extract_all(COALESCE(title, '') || ' ' || COALESCE(content, ''), '{money.CONTRACTOR}', 1)), '|') AS contractors FROM articles""")
def funds_contractors(spark, d):
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    found = F.regexp_extract_all(t, F.lit(money.CONTRACTOR), F.lit(1))
    return _texts(spark, d).select("id", F.array_join(F.array_distinct(found), "|").alias("contractors"))


@query()
def funds_agencies(spark, d):
    e = funds_entities(spark, d).where(F.col("primary_agency").isNotNull())
    return e.groupBy("primary_agency").agg(F.count("*").alias("n"), F.round(F.sum("total") / 1e6, 2).alias("total_millions")).orderBy(F.desc("n"), "primary_agency").limit(10)


@query(r"""SELECT l.category, a.id, COUNT(*) AS n FROM (SELECT id, lower(COALESCE(content, '')) AS t FROM articles) a JOIN (SELECT category, lower(trim(term)) AS term FROM lexicon) l
  ON CASE WHEN contains(l.term, ' ') THEN contains(a.t, l.term) ELSE regexp_matches(a.t, '\b' || l.term || '\b') END GROUP BY 1, 2""")
def keyword_match_counts(spark, d):
    c = lexicon.category_counts(_texts(spark, d).select("id", "content"), F.col("content"), table(spark, d, "lexicon"))
    names = [x[2:] for x in c.columns if x.startswith("n_")]
    if not names:
        return c.select(F.lit(None).cast("string").alias("category"), "id", F.lit(0).cast("bigint").alias("n")).limit(0)
    return c.select("id", F.explode(F.array(*[F.struct(F.lit(x).alias("category"), F.col("n_" + x).alias("n")) for x in names])).alias("e")).where("e.n > 0").select("e.category", "id", "e.n")


@query()
def political_scores(spark, d):
    t = F.concat_ws(" ", "title", "content")
    a = _texts(spark, d).select("id", t.alias("t")).withColumn("compound", sentiment.score(F.col("t")))
    c = political.components(a, F.col("t"), table(spark, d, "lexicon"), F.col("compound"))
    return c.select("id", "matches", F.round("bias_score", 6).alias("bias_score"), "direction", F.round("confidence", 6).alias("confidence"))


@query(r"""WITH k AS (SELECT a.id, l.category, COUNT(*) AS n FROM (SELECT id, lower(concat_ws(' ', title, content)) AS t FROM articles) a JOIN (SELECT category, lower(trim(term)) AS term FROM lexicon) l
    ON CASE WHEN contains(l.term, ' ') THEN contains(a.t, l.term) ELSE regexp_matches(a.t, '\b' || l.term || '\b') END GROUP BY 1, 2),
  s AS (SELECT id, SUM(n) AS matches, SUM(n * CASE category WHEN 'administration' THEN 0.4 WHEN 'local_government' THEN 0.3 WHEN 'public_works' THEN 0.2 WHEN 'praise' THEN 0.1 ELSE 0 END) AS g, SUM(n * CASE category WHEN 'opposition' THEN 0.3 WHEN 'graft_terms' THEN 0.3 WHEN 'protest' THEN 0.2 WHEN 'audit_terms' THEN 0.2 ELSE 0 END) AS o FROM k GROUP BY id),
  t AS (SELECT id, lower(concat_ws(' ', title, content)) AS t FROM articles),
  c AS (SELECT id, contains(t, 'government') OR contains(t, 'official') AS official, contains(t, 'slammed')::INT + contains(t, 'blasted')::INT + contains(t, 'hit back')::INT + contains(t, 'fired back')::INT AS informal,
    contains(t, 'according to')::INT + contains(t, 'stated')::INT + contains(t, 'announced')::INT + contains(t, 'reported')::INT + contains(t, 'confirmed')::INT AS formal FROM t)
  SELECT c.id, COALESCE(matches, 0)::BIGINT AS matches, ROUND(COALESCE(g, 0), 6)::DOUBLE AS government, ROUND(COALESCE(o, 0), 6)::DOUBLE AS opposition, ROUND(COALESCE(GREATEST(g, o)::DOUBLE / matches, 0), 6) AS keyword_score,
    CASE WHEN official THEN 0.1 ELSE 0 END::DOUBLE AS source_pattern, CASE WHEN informal > formal THEN 0.2 WHEN formal > informal THEN -0.1 ELSE 0 END::DOUBLE AS language_patterns FROM c LEFT JOIN s ON s.id = c.id""")
def political_keywords(spark, d):
    """What the leaning of an article is made of, but for its sentiment."""
    a = _texts(spark, d).select("id", F.concat_ws(" ", "title", "content").alias("t"))
    c = political.components(a, F.col("t"), table(spark, d, "lexicon"), F.lit(0.0))
    r = lambda x: F.round(x, 6).alias(x)
    return c.select("id", F.col("matches").cast("bigint").alias("matches"), r("government"), r("opposition"), r("keyword_score"), "source_pattern", "language_patterns")


@query()
def sentiment_scores(spark, d):
    s = _texts(spark, d).select("id", sentiment.score(F.concat_ws(" ", "title", "content")).alias("compound"))
    return s.withColumn("label", text.threshold_label(F.col("compound")))


@query(r"""WITH m AS (SELECT unnest(regexp_extract_all(COALESCE(title, '') || ' ' || COALESCE(category, '') || ' ' || COALESCE(source, ''), '\b([A-Z]{2,6})\b', 1)) AS w FROM articles)
  SELECT w AS acronym, COUNT(*) AS n FROM m WHERE w NOT IN ('PH', 'PHL', 'GDP', 'AI', 'NBA', 'UFC', 'NCAA', 'UAAP', 'PBA', 'PNR', 'LRT', 'MRT') AND regexp_matches(w, '^[A-Z]+$') GROUP BY w ORDER BY n DESC, w LIMIT 50""")
def mined_acronyms(spark, d):
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("category", F.lit("")), F.coalesce("source", F.lit("")))
    m = table(spark, d, "articles").select(F.explode(F.regexp_extract_all(t, F.lit(r"(?<![A-Za-z0-9_])([A-Z]{2,6})(?![A-Za-z0-9_])"), F.lit(1))).alias("acronym"))
    return m.where(~F.col("acronym").isin(*text.NO_ACRONYMS)).groupBy("acronym").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "acronym").limit(50)


@query()
def mined_names(spark, d):
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("category", F.lit("")), F.coalesce("source", F.lit("")))
    m = table(spark, d, "articles").select(F.explode(F.regexp_extract_all(t, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})(?![A-Za-z0-9_])"), F.lit(1))).alias("name"))
    m = m.where((F.length("name") > 2) & ~F.split("name", r"\s+")[0].isin(*text.NO_NAMES))
    return m.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(50)


@query(r"""WITH m AS (SELECT unnest(regexp_extract_all(COALESCE(title, '') || ' ' || COALESCE(content, ''), '\b([A-Z]{2,6})\b', 1)) AS w FROM articles), c AS (SELECT w, COUNT(*) AS n FROM m WHERE regexp_matches(w, '^[A-Z]+$') GROUP BY w)
  SELECT w AS acronym, n, ROW_NUMBER() OVER (ORDER BY n DESC, w) AS place FROM c WHERE w IN ('DPWH','DOF','DOJ','NEDA','DILG','DOH','DEPED','DND','AFP','PNP','COMELEC','OMBUDSMAN','COA','DBM','NBI','BI','BIR','BOC','BSP')""")
def mined_bodies(spark, d):
    """The known bodies among the acronyms, in the order of their number."""
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    m = table(spark, d, "articles").select(F.explode(F.regexp_extract_all(t, F.lit(r"(?<![A-Za-z0-9_])([A-Z]{2,6})(?![A-Za-z0-9_])"), F.lit(1))).alias("acronym")).where(F.col("acronym").isin(*text.KNOWN_BODIES))
    g = m.groupBy("acronym").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "acronym")).cast("bigint"))  # a row a body


@query(r"""SELECT id, array_to_string(list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: length(x) BETWEEN 3 AND 80)[1:10], '|') AS phrases FROM (SELECT id, regexp_extract_all(content, '(?:^|[^\p{L}\p{N}_])((?:[A-Z][\p{L}\p{N}_\-]+\s+){1,4}[A-Z][\p{L}\p{N}_\-]*[\p{L}\p{N}_])', 1) AS l FROM articles WHERE content IS NOT NULL) q""")
def keyphrases(spark, d):
    runs = F.filter(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?<![\p{L}\p{N}_])((?:[A-Z][\p{L}\p{N}_\-]+\s+){1,4}[A-Z][\p{L}\p{N}_\-]*[\p{L}\p{N}_])"), F.lit(1))), lambda p: F.length(p).between(3, 80))
    return _texts(spark, d).where(F.col("content").isNotNull()).select("id", F.array_join(F.slice(runs, 1, 10), "|").alias("phrases"))


@query("SELECT DISTINCT lower(term) AS term FROM lexicon EXCEPT SELECT DISTINCT unnest(tags) FROM articles")
def lexicon_diff(spark, d):
    tags = table(spark, d, "articles").select(F.explode("tags").alias("term")).distinct()
    return table(spark, d, "lexicon").select(F.lower("term").alias("term")).distinct().join(tags, "term", "left_anti")


@query("SELECT DISTINCT lower(term) AS term FROM lexicon INTERSECT SELECT DISTINCT unnest(tags) FROM articles")
def lexicon_intersection(spark, d):
    return table(spark, d, "lexicon").select(F.lower("term").alias("term")).intersect(table(spark, d, "articles").select(F.explode("tags").alias("term")))


@query("SELECT category, array_to_string(list_sort(list_distinct(list(lower(term)))), '|') AS terms FROM lexicon GROUP BY category")
def lexicon_union(spark, d):
    return table(spark, d, "lexicon").groupBy("category").agg(F.array_join(F.sort_array(F.collect_set(F.lower("term"))), "|").alias("terms"))


@query("SELECT id, source, 'a' AS part FROM articles WHERE is_funds UNION ALL SELECT id, source, 'b' AS part FROM articles WHERE category IS NULL")
def union_all(spark, d):
    a = table(spark, d, "articles")
    return a.where("is_funds").select("id", "source", F.lit("a").alias("part")).unionByName(a.where(F.col("category").isNull()).select("id", "source", F.lit("b").alias("part")))


@query(f"""WITH {SQL_B}, r AS (SELECT article_id, model_version, model_type, id, ROW_NUMBER() OVER (PARTITION BY article_id, model_version, model_type ORDER BY (id % 2) DESC, created DESC, id DESC) AS rn FROM b)
  SELECT article_id, model_version, model_type, id FROM r WHERE rn = 1""")
def upsert_latest_wins(spark, d):
    b = analyses(spark, d).select("article_id", "model_version", "model_type", "id", "created_at")
    old, new = b.where(F.col("id") % 2 == 0), b.where(F.col("id") % 2 == 1)
    return merge_latest(old, new, ["article_id", "model_version", "model_type"], ["created_at", "id"]).drop("created_at")


@query("SELECT DISTINCT source FROM raw_articles WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM outlets WHERE source IS NOT NULL)")
def append_if_absent(spark, d):
    return append_absent(table(spark, d, "outlets").select("source"), table(spark, d, "raw_articles").select("source"), "source")


@query("SELECT id, CASE WHEN is_funds IS NULL OR category = 'Budget Watch' THEN COALESCE(category = 'Budget Watch', false) ELSE is_funds END AS is_funds FROM articles")
def conditional_update(spark, d):
    from pressmill.sources.sinks import rewrite

    funded = F.coalesce(F.col("category") == "Budget Watch", F.lit(False))
    return rewrite(table(spark, d, "articles").select("id", "category", "is_funds"), F.col("is_funds").isNull() | funded, is_funds=funded).select("id", "is_funds")


@query("""SELECT id, NULLIF(regexp_extract(raw_html, '<title>([^<]*)</title>', 1), '') AS title, COALESCE(len(regexp_extract_all(raw_html, '<a href="[^"#]')) - (CASE WHEN regexp_matches(raw_html, '<a href="[^"]*("[^>]*(>[^<]*(<(/(a)?)?)?)?)?$') THEN 1 ELSE 0 END), 0) AS anchors FROM raw_articles""")
def html_titles(spark, d):
    r = table(spark, d, "raw_articles")
    p = r.select("id", html.parsed(F.col("raw_html"), F.lit(None).cast("string")).alias("p"))
    return p.select("id", F.col("p.title").alias("title"), F.size("p.links").alias("anchors"))


@query()
def html_articles(spark, d):
    r = table(spark, d, "raw_articles").select("id", "source", "raw_html", html.parsed(F.col("raw_html"), F.lit(None).cast("string")).alias("p"))
    p = F.col("p")
    body = html.body_text(p)
    return r.select("id", html.title_text(p).alias("title"), html.page_category(p, F.lit(None).cast("string")).alias("category"), p["date"].alias("date"), body.alias("content"), html.is_thin(p, body).alias("thin"), html.jsonld_article(p)["headline"].alias("headline"), html.meta_content(F.col("raw_html"), "property", "og:type").alias("og_type"), html.data_layer_category(F.col("raw_html")).alias("data_layer"))


@query(r"""WITH a AS (SELECT id, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS h, unnest(regexp_extract_all(raw_html, '<a href="([^"#][^"]*)"[^>]*>[^<]*</a>', 1)) AS u, unnest(regexp_extract_all(raw_html, '<a href="[^"#][^"]*"[^>]*>([^<]*)</a>', 1)) AS t,
    unnest(range(len(regexp_extract_all(raw_html, '<a href="[^"#][^"]*"[^>]*>[^<]*</a>')))) AS pos FROM raw_articles),
  n AS (SELECT id, pos, CASE WHEN u LIKE '/%' THEN COALESCE('https://www.' || h || '.example', '') || u ELSE u END AS url, t FROM a)
  SELECT id, pos, url, t AS text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, url ORDER BY pos) AS rn FROM n) q WHERE rn = 1""")
def html_links(spark, d):
    r = table(spark, d, "raw_articles").withColumn("base", F.concat(F.lit("https://www."), text.fold_name(F.col("source")), F.lit(".example/")))
    return discovered_links(r, "id", "raw_html", "base")


@query()
def html_stubs(spark, d):
    return stubs(html_links(spark, d))


@query("SELECT id, article_id, direction FROM (SELECT id, article_id, json_extract_string(to_json(model_metadata), '$.direction') AS direction FROM bias_analysis) q WHERE direction = 'pro_government'")
def json_field_filter(spark, d):
    # the field itself: the condition and the one leaf of the struct reach the scan
    b = table(spark, d, "bias_analysis").where(F.col("model_metadata.direction") == "pro_government")
    return b.select("id", "article_id", F.col("model_metadata.direction").alias("direction"))


@query("""SELECT id, k.key AS term, k.value AS n FROM (SELECT id, unnest(map_entries(model_metadata.keyword_matches)) AS k FROM bias_analysis) q""")
def metadata_map_rows(spark, d):
    return table(spark, d, "bias_analysis").select("id", F.explode("model_metadata.keyword_matches").alias("term", "n"))


@query("""SELECT id, COALESCE(list_sum(map_values(model_metadata.keyword_matches)), 0)::BIGINT AS total, COALESCE(cardinality(model_metadata.keyword_matches), 0)::BIGINT AS categories FROM bias_analysis""")
def metadata_map_sums(spark, d):
    m = F.col("model_metadata.keyword_matches")
    total = F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return table(spark, d, "bias_analysis").select("id", F.coalesce(total, F.lit(0)).cast("bigint").alias("total"), F.coalesce(F.cardinality(m), F.lit(0)).cast("bigint").alias("categories"))
