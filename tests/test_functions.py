import datetime as dt

from pyspark.sql import functions as F

from pressmill.functions import dates, html, lexicon, money, text, urls
from pressmill.models import funds, political, sentiment


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()[0]


def many(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").coalesce(1).select(expression(F.col("x")).alias("y")).collect()]


def test_title_case(spark):
    assert many(spark, ["manila-times", "o'neil 3d", "MANILA", "", None], text.title_case) == ["Manila-Times", "O'Neil 3D", "Manila", "", None]


def test_normalize_names(spark):
    assert many(spark, ["gma", " ABS-CBN ", "daily news", "", None], text.normalize_source) == ["GMA", "ABS-CBN", "Daily News", None, None]
    assert many(spark, ["tech", "general_santos", "foo bar"], text.normalize_category) == ["Technology", "General Santos", "Foo Bar"]


def test_threshold_label(spark):
    assert many(spark, [0.05, -0.05, 0.0499, None], text.threshold_label, "double") == ["positive", "negative", "neutral", None]
    assert many(spark, [0.05, -0.05], lambda c: text.threshold_label(c, strict=True), "double") == ["neutral", "neutral"]


def test_shaping(spark):
    assert one(spark, "a" * 1200, text.tiered_cut) == "a" * 1000 + "..."
    assert one(spark, "a" * 600, text.tiered_cut) == "a" * 500 + "..."
    assert one(spark, "ab. c!", text.reading_score) == 6 + 100
    assert one(spark, "<p>a  b</p>\n c", text.without_tags) == "a b c"
    assert one(spark, "<script>x</script>a<b", text.without_active_parts) == "a&lt;b"
    assert one(spark, "x" * 201, text.preview) == "x" * 200 + "..."
    assert many(spark, ["Short", "x" * 63, "", None], text.content_valid) == [False, True, False, False]


def test_canonical_url(spark):
    cases = {"https://WWW.A.com/b/c/?q=1#z": "https://www.a.com/b/c", "https://a.com": "https://a.com/", "no url": "no url", None: None}
    assert many(spark, list(cases), urls.canonical_url) == list(cases.values())
    once = many(spark, [c for c in cases if c], urls.canonical_url)
    assert many(spark, once, urls.canonical_url) == once


def test_category_from_url(spark):
    cases = {"https://x.com/technology/a": "Technology", "https://x.com/sports/volleyball/b": "Sports", "https://x.com/world/asia-pacific/c": "World", "https://x.com/photos/a": None, None: None}
    assert many(spark, list(cases), urls.category_from_url) == list(cases.values())
    assert one(spark, "https://x.com/top-business/b/c", lambda c: urls.section_from_url(c)["raw"]) == "Top Business"


def test_valid_news_url(spark):
    cases = {"https://x.com/news/lotto/results/test/": False, "https://x.com/news/nation/metro/": True, "https://x.com/news/videos/test/": False, "https://y.com/news/nation/metro/": False, "https://x.com/a/b": False}
    assert many(spark, list(cases), lambda c: urls.valid_news_url(c, "x.com")) == list(cases.values())
    assert one(spark, "https://g.com/r?url=https%3A%2F%2Fa.com%2Fb&x=1", urls.redirect_target) == "https://a.com/b"


def test_dates(spark):
    assert one(spark, "Tue, 02 Sep 2025 22:43:35 +0800", lambda c: F.unix_seconds(dates.rfc2822(c))) == 1756824215
    assert one(spark, "Tue, 02 Sep 2025 22:43:35 GMT", lambda c: F.unix_seconds(dates.rfc2822(c))) == 1756853015
    assert one(spark, "rubbish", lambda c: F.unix_seconds(dates.rfc2822(c))) is None
    assert one(spark, "Published September 3, 2025 5:30pm", lambda c: F.unix_seconds(dates.published_line(c))) == 1756891800
    assert one(spark, "2025-01-01T20:00:00Z", dates.iso_date) == "2025-01-02"
    assert one(spark, "2025-01-01 whatever", dates.iso_date) == "2025-01-01"
    noon = dt.datetime(2025, 1, 10, 4, tzinfo=dt.timezone.utc)
    assert dates.day_window(noon, 7) == (dt.date(2025, 1, 4), dt.date(2025, 1, 10))
    assert dates.day_window(noon, 7, include_today=False)[1] == dt.date(2025, 1, 9)
    assert dates.utc_bounds(dt.date(2025, 1, 1), dt.date(2025, 1, 1))[0] == dt.datetime(2024, 12, 31, 16, tzinfo=dt.timezone.utc)
    assert dates.period_days("?") == 7 and dates.bounded(500, 1, 180) == 180


def test_money(spark):
    found = one(spark, "P5 billion, P1,000, 3.5 million pesos, 7 trillion", lambda c: money.mentions(c, money.AMOUNT))
    assert found == ["P5 billion", "P1", "3.5 million pesos", "7 trillion"]
    assert one(spark, "P5 billion, P1,000, 3.5 million pesos, 7 trillion", lambda c: money.total_amount(money.mentions(c, money.AMOUNT))) == 5003500008.0
    assert one(spark, "nothing", lambda c: money.total_amount(money.mentions(c, money.AMOUNT))) is None
    assert one(spark, "5 men and 3.5 million", money.loose_numbers) == [5.0, 3.5]
    assert one(spark, ["b", "a", "a", "b"], money.first_mode, "array<string>") == "b"
    assert one(spark, [], money.first_mode, "array<string>") is None
    assert one(spark, "PARAÑAQUE and Las Piñas", lambda c: money.mentions(c, money.PLACE)) == ["PARAÑAQUE", "Las Piñas"]


def test_funds(spark):
    rows = [("DPWH allocates P5 billion for flood control", "Government infrastructure funding", True), ("P1M worth of shabu seized in buy-bust", "Police seized illegal drugs", False), ("Senate approves P500M budget for education", "Congressional budget approval", True), ("PBA Finals Ginebra wins championship", "Basketball tournament results", False), ("", "", False), (None, None, False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "t string, c string").coalesce(1)
    assert [r[0] for r in df.select(funds.by_rule(F.col("t"), F.col("c"))).collect()] == [x for _, _, x in rows]
    assert df.select(funds.gated(F.col("t"), F.col("c")).alias("g")).where("g is null").count() == 0


def test_lexicon_counts(spark):
    lex = spark.createDataFrame([("a", "tulay", 1.0), ("a", "Tulay", 1.0), ("a", "bus depot", 1.0), ("b", "half-finished", 1.0), ("b", None, 1.0)], "category string, term string, weight double")
    df = spark.createDataFrame([(1, "Ang tulay sa bus depot"), (2, "a half-finished tulayan"), (3, None)], "id int, t string")
    got = {r.id: (r.n_a, r.n_b) for r in lexicon.category_counts(df, F.col("t"), lex).collect()}
    assert got == {1: (3, 0), 2: (0, 1), 3: (0, 0)}


def test_political_invariants(spark):
    lex = spark.createDataFrame([("administration", "president", 1.0), ("opposition", "senator", 1.0), ("graft_terms", "graft", 1.0)], "category string, term string, weight double")
    df = spark.createDataFrame([(1, "The president spoke", 0.9), (2, "Senator on graft", -0.5), (3, None, None)], "id int, t string, s double")
    got = {r.id: r for r in political.components(df, F.col("t"), lex, F.coalesce("s", F.lit(0.0))).collect()}
    assert got[1].direction == "pro_government" and got[2].direction == "pro_opposition" and got[3].direction == "neutral"
    assert all(0 <= r.bias_score and r.confidence <= 1 for r in got.values())


def test_sentiment():
    assert sentiment.compound(None) == 0 and sentiment.compound("") == 0
    assert sentiment.compound("a great win") > 0.5 > -0.3 > sentiment.compound("a terrible failure")
    assert sentiment.compound("not good") < 0 < sentiment.compound("good") < sentiment.compound("very good!!")
    assert all(-1 <= sentiment.compound(w * 50) <= 1 for w in ("great ", "killed "))


PAGE = """<html><head><title>T</title><meta property="article:section" content="sports"><meta property="og:type" content="article">
<script type="application/ld+json">{"@type":"NewsArticle","headline":"H","datePublished":"2025-01-01","articleSection":"World"}</script></head>
<body><div class="breadcrumb"><a href="/home">Home</a></div><h1>A headline long enough</h1><time datetime="2025-01-02T00:00:00Z">x</time>
<p>First paragraph of some length.</p><p>First paragraph of some length.</p><p>Advertisement and more text here</p><a href="/a?b">Link</a><script>var primary_category = 'x';</script><p>Broken off"""


def test_html(spark):
    row = spark.createDataFrame([(PAGE,), (None,)], "h string").coalesce(1).select(html.parsed(F.col("h"), F.lit("https://x.com/")).alias("p"), F.col("h"))
    r = row.select("p.*", html.page_category(F.col("p"), F.lit(None).cast("string")).alias("cat"), html.body_text(F.col("p")).alias("body"), html.title_text(F.col("p")).alias("t"), html.jsonld_article(F.col("p"))["headline"].alias("hl"), html.meta_content(F.col("h"), "property", "og:type").alias("og")).collect()
    assert r[0].title == "T" and r[0].cat == "Sports" and r[0].date == "2025-01-02T00:00:00Z" and r[0].t == "A headline long enough"
    assert r[0].body == "First paragraph of some length." and r[0].hl == "H" and r[0].og == "article" and r[0].paragraphs[-1] == "Broken off"
    assert [x.url for x in r[0].links] == ["https://x.com/home", "https://x.com/a?b"]
    assert r[1].title is None and r[1].links == [] and r[1].body is None and r[1].cat == "General"
