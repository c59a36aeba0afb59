import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressmill.operators import instants, relational, stats
from pressmill.sources import readers, sinks

UTC = dt.timezone.utc


def us(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1_000_000)


CASES = [  # (outlet, text, UTC)
    ("m", "2025-09-24T16:50:31Z", "2025-09-24T16:50:31"), ("m", "2025-03-20T16:06", "2025-03-20T08:06:00"), ("m", "Updated November 9, 2025 - 12:24 PM", "2025-11-09T04:24:00"),
    ("m", "28/Mar/2025:23:56:15 +0800", "2025-03-28T15:56:15"), ("m", "Updated August 7, 2025 | 9:34pm", "2025-08-07T13:34:00"), ("m", "Ika-10 ng Nobyembre 2025, 1:39 PM", "2025-11-10T05:39:00"),
    ("m", "Pebrero 27, 2025 00:22", "2025-02-26T16:22:00"), ("m", "20250812211306", "2025-08-12T13:13:06"), ("m", "1761454197", "2025-10-26T04:49:57"), ("m", "1745396087399", "2025-04-23T08:14:47.399"),
    ("m", "1765746269.350", "2025-12-14T21:04:29.350"), ("m", "21-Mar-25 02:23", "2025-03-20T18:23:00"), ("m", "Tue, 01 Jul 2025 05:15:48 +0000", "2025-07-01T05:15:48"), ("m", "2025-02-18 02:15:40 GMT+1", "2025-02-18T01:15:40"),
    ("m", "2025-11-19T21:24:28.249980+08:00", "2025-11-19T13:24:28.249980"), ("m", "2024-12-14T23:39:37+08:00[Asia/Manila]", "2024-12-14T15:39:37"), ("m", "Fri May 23 08:38:43 2025", "2025-05-23T00:38:43"),
    ("m", "16 de septiembre de 2025, 13:14", "2025-09-16T05:14:00"), ("m", "Monday, 18 Aug 2025", "2025-08-17T16:00:00"), ("m", "  2025-06-18 19:29:25+0200 ", "2025-06-18T17:29:25"), ("m", "05/21/2025 3:03 PM", "2025-05-21T07:03:00"),
    ("n", "16/10/2024 01:29", "2024-10-16T05:29:00"), ("n", "Aug 19, 2025, 5:09 PM EDT", "2025-08-19T21:09:00"), ("n", "2025-11-02 01:30:00", "2025-11-02T05:30:00"), ("n", "2025-03-09 02:30:00", "2025-03-09T07:30:00"),
    ("m", "20241206T140912Z", "2024-12-06T14:09:12"), ("m", "2025/08/15 03:23:47 UTC", "2025-08-15T03:23:47"), ("m", "12:00 PM", None), ("m", "February 30, 2025", None), ("m", "2025-13-40T25:61:00Z", None), ("m", "just now", None),
    ("m", "N/A", None), ("m", "", None), ("m", None, None), ("m", "October 30, 2025 - 12:05 a.m.", "2025-10-29T16:05:00"),
]
ARTICLES = "id long, source string, published_at string, inserted_at timestamp, outlet string"


def test_instants(spark):
    rows = [(i, {"m": "The Outlet", "n": " other  OUTLET"}[o], t, dt.datetime.fromisoformat(u or "2025-01-01") + dt.timedelta(hours=1), "x") for i, (o, t, u) in enumerate(CASES)]
    a = spark.createDataFrame(rows, ARTICLES)
    o = spark.createDataFrame([("the outlet", "Asia/Manila", "MDY"), ("Other Outlet", "America/New_York", "DMY")], "source string, site_zone string, date_order string")
    got = {r.article_id: r.utc_us for r in instants.utc_instants(a, o).collect()}
    assert got == {i: (us(u) if u else None) for i, (_, _, u) in enumerate(CASES)}


def test_zone_is_estimated_where_none_is_declared(spark):
    rows, n = [], 0
    for day in range(1, 28):
        for zone, off in (("tokyo", 9), ("dubai", 4)):
            local = dt.datetime(2025, 5, day, 12)
            rows.append((n, zone, local.strftime("%Y-%m-%d %H:%M:%S"), local - dt.timedelta(hours=off) + dt.timedelta(minutes=20), None))
            n += 1
    a = spark.createDataFrame(rows, ARTICLES)
    o = spark.createDataFrame([("tokyo", None, "MDY"), ("x", "Asia/Tokyo", "MDY"), ("y", "Asia/Dubai", "DMY"), ("z", "Europe/Madrid", "DMY")], "source string, site_zone string, date_order string")
    z = {r.outlet: r.zone for r in instants.estimate_zones(instants.read_local(a, o), o.select(F.col("site_zone").alias("zone"))).collect()}
    assert z == {"tokyo": "Asia/Tokyo", "dubai": "Asia/Dubai"}
    assert instants.utc_instants(a.limit(0), o).count() == 0


def test_latest_and_merge(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", {"k": 1}), (2, None, "c", None), (None, 1, "d", None)], "k int, t int, v string, m map<string,int>")
    assert {(r.k, r.v) for r in relational.latest_per_key(df, ["k"], ["t"]).collect()} == {(1, "b"), (2, "c"), (None, "d")}
    new = spark.createDataFrame([(1, 0, "n", None), (3, 0, "m", None)], df.schema)
    once = relational.merge_latest(df, new, ["k"], ["t"])
    twice = relational.merge_latest(once, new, ["k"], ["t"])
    assert {(r.k, r.v) for r in once.collect()} == {(r.k, r.v) for r in twice.collect()} == {(1, "n"), (2, "c"), (3, "m"), (None, "d")}
    assert relational.latest_per_key(df.limit(0), ["k"], ["t"]).count() == 0


def test_top_k_page_and_absent(spark):
    df = spark.createDataFrame([(s, i) for s in "ab" for i in range(5)], "s string, i int")
    assert sorted((r.s, r.i) for r in relational.top_k_per_key(df, ["s"], [F.desc("i")], 2).collect()) == [("a", 3), ("a", 4), ("b", 3), ("b", 4)]
    assert [r.i for r in relational.page(df.where("s = 'a'"), [F.col("i")], 1, 2).collect()] == [1, 2]
    rows = spark.createDataFrame([("a", 9), ("c", 1), ("c", 2), (None, 3)], "s string, i int")
    assert [r.s for r in relational.append_absent(df, rows, "s").collect()] == ["c"]


def test_union_in_priority(spark):
    p = [spark.createDataFrame([(k, i) for i, k in enumerate(x)], "key string, pos int") for x in ("ab", "bcd", "e")]
    assert [r.key for r in relational.union_in_priority(p, "key", 2, "pos").collect()] == ["a", "b"]
    assert [r.key for r in relational.union_in_priority(p, "key", 4, "pos").collect()] == ["a", "b", "c", "d"]


def test_trend_and_correlation(spark):
    rows = [("up", i, 0.1 * i) for i in range(20)] + [("flat", i, 0.5) for i in range(20)] + [("short", i, 1.0) for i in range(5)]
    s = spark.createDataFrame(rows, "k string, p int, v double")
    t = {r.k: r for r in stats.trend(s, ["k"], "p", "v").collect()}
    assert set(t) == {"up", "flat"} and t["up"].direction == "up" and abs(t["up"].slope - 0.1) < 1e-9 and t["flat"].slope == 0 and t["flat"].r2 == 1
    assert abs(t["up"].forecast[0]["value"] - 2.0) < 1e-9 and t["up"].residual_std < 1e-6
    wave = [0.0, 1.0, 0.0, -1.0] * 6
    w = spark.createDataFrame([("a", i, wave[i]) for i in range(20)] + [("b", i, wave[i - 1]) for i in range(20)] + [("c", i, 1.0) for i in range(20)], "k string, p int, v double")
    best = stats.strongest_lag(stats.lagged_correlation(w, "k", "p", "v"))
    assert [(r.a, r.b, r.lag) for r in best.collect()] == [("a", "b", 1)]
    inf = {r.k: r.influence for r in stats.influence(stats.edges(best), w, "k").collect()}
    assert abs(inf["a"] - 1) < 1e-9 and inf["b"] == 0 == inf["c"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=9))
def test_upper_median(spark, xs):
    assert spark.createDataFrame([(xs,)], "x array<int>").select(stats.upper_median(F.col("x"))).first()[0] == sorted(xs)[len(xs) // 2]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, 1, "x")], "k int, t int, v string")
    sinks.upsert(a, path, ["k"], ["t"])
    for _ in range(2):
        sinks.upsert(spark.createDataFrame([(1, 2, "y"), (2, 1, "z")], a.schema), path, ["k"], ["t"])
    assert {(r.k, r.v) for r in sinks.merged(spark, path).collect()} == {(1, "y"), (2, "z")}
    new = sinks.append_new(sinks.with_ids(spark.createDataFrame([("u",), ("u",), ("w",)], "url string"), "url"), str(tmp_path / "n"), "url")
    assert new.count() == 2 and sinks.append_new(new, str(tmp_path / "n"), "url").count() == 0
    assert sinks.cache_key("q", b=1, a=2) == sinks.cache_key("q", a=2, b=1) != sinks.cache_key("q", a=1, b=2)
    calls = []
    for _ in range(2):
        sinks.cached(spark, str(tmp_path), "q", lambda: calls.append(1) or a, p=1)
    assert len(calls) == 1
    assert sinks.clear_cached(spark, str(tmp_path), "q") == 1 and sinks.clear_cached(spark, str(tmp_path / "none")) == 0


def test_merged_tables_rewrite_only_touched_buckets_and_recover(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, t int, v string, bucket_of string"
    sinks.upsert(spark.createDataFrame([(k, 1, "a", None) for k in range(200)] + [(None, 1, "n", None)], schema), path, ["k"], ["t"])
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    sinks.upsert(spark.createDataFrame([(7, 2, "b", None), (7, 1, "late", None)], schema), path, ["k"], ["t"])
    kept = {f for f in before if f.exists() and f.stat().st_mtime_ns == before[f]}
    assert len(before) - len(kept) == 1
    rows = {r.k: r.v for r in sinks.merged(spark, path).collect()}
    assert len(rows) == 201 and rows[7] == "b" and rows[8] == "a" and rows[None] == "n"
    bucket = next(f for f in (tmp_path / "t").iterdir() if f.name.startswith("bucket="))
    bucket.rename(tmp_path / "t" / f".{bucket.name}.old")  # an interrupted swap
    sinks.upsert(spark.createDataFrame([(8, 3, "c", None)], schema), path, ["k"], ["t"])
    assert {r.k: r.v for r in sinks.merged(spark, path).collect()} == rows | {8: "c"}
    sinks.upsert(spark.createDataFrame([], schema), path, ["k"], ["t"])
    assert sinks.merged(spark, path).count() == 201


def test_run_log(spark, tmp_path):
    import datetime as dt

    path, at = str(tmp_path / "log"), dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    sinks.start_run(spark, path, "r", "s", at)
    assert sinks.merged(spark, path).first().status == "partial"
    for _ in range(2):
        sinks.finish_run(spark, path, "r", "error", 3, at + dt.timedelta(milliseconds=1500), "broken")
    r = sinks.merged(spark, path).collect()
    assert len(r) == 1 and (r[0].status, r[0].articles_scraped, r[0].error_message, r[0].execution_time_ms) == ("error", 3, "broken", 1500)
    with pytest.raises(ValueError):
        sinks.finish_run(spark, path, "r", "unknown", 0, at)
    with pytest.raises(ValueError):
        sinks.finish_run(spark, path, "no such run", "success", 0, at)


def test_pages_deep_and_by_key(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("g")).repartition(6)
    want = [r.id for r in df.orderBy(F.desc("g"), "id").collect()]
    for offset, limit in ((0, 5), (300, 20), (990, 50), (1000, 5)):
        got = relational.page(df, [F.desc("g"), F.col("id")], offset, limit, near=10)
        assert sorted(r.id for r in got.collect()) == sorted(want[offset : offset + limit])
    keys, last, seen = [("g", True), ("id", False)], None, []
    while rows := relational.page_after(df, keys, last, 150).collect():
        seen += [r.id for r in rows]
        last = (rows[-1].g, rows[-1].id)
    assert seen == want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e9, 1e9), st.sampled_from([0.0, 1e300, -1e300, 5.0])), max_size=40))
def test_upper_median_of_a_column(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    held = sorted(x for x in xs if x is not None)
    assert stats.upper_median_of(df, "x", buckets=3, most=2) == (held[len(held) // 2] if held else None)


def test_lexicons_of_any_size(spark, monkeypatch, tmp_path):
    from pressmill.functions import lexicon

    lex = spark.createDataFrame([("a", f"word{i}", 1.0) for i in range(30)] + [("a", "two words", 1.0), ("b", "word3", 1.0), ("b", None, 1.0)], lexicon.SCHEMA)
    df = spark.createDataFrame([(1, "word3 word29 and two words"), (2, None), (3, "")], "id int, t string")
    count = lambda: sorted((r.id, r.n_a, r.n_b) for r in lexicon.category_counts(df, F.col("t"), lex).collect())
    want = [(1, 3, 1), (2, 0, 0), (3, 0, 0)]
    assert count() == want
    monkeypatch.setattr(lexicon, "TERMS", 7)
    assert count() == want
    (tmp_path / "l.json").write_text(json.dumps({"version": "1", "keywords": {"a": ["x", "y"], "b": ["z"]}, "weights": {"a": 0.4}}))
    assert sorted(map(tuple, lexicon.load_json(spark, str(tmp_path / "l.json")).collect())) == [("a", "x", 0.4), ("a", "y", 0.4), ("b", "z", 1.0)]
    (tmp_path / "broken.json").write_text("{")
    own = {"version": "own", "keywords": {"k": ["v"]}, "weights": {}}
    for bad in ("broken.json", "none.json"):
        assert lexicon.load_json(spark, str(tmp_path / bad)).count() == 0 and lexicon.load_json(spark, str(tmp_path / bad), own).first().term == "v"


def test_site_rules(spark):
    from pressmill.functions import sites

    cases = [("rappler", "https://www.rappler.com/technology/a-long-story-slug", True, "Technology"), ("rappler", "https://www.rappler.com/newsbreak/sports/a-long-story-slug", True, "Sports"), ("rappler", "https://www.rappler.com/world/asia-pacific/a-long-story-slug", True, "World"),
             ("rappler", "https://www.rappler.com/tag/x/", False, "General"), ("gma", "https://www.gmanetwork.com/news/topstories/nation/1/a/story/", True, "Nation"), ("gma", "https://www.gmanetwork.com/news/lotto/results/test/", False, "Lotto"),
             ("gma", "https://www.gmanetwork.com/lifestyle/a/b", False, "General"), ("sunstar", "https://www.sunstar.com.ph/cebu/local-news/x", True, "Nation"), ("sunstar", "https://www.sunstar.com.ph/cebu/business/x", True, "Business"), ("manila times", "https://www.manilatimes.net/2025/01/02/news/regions/x/123", False, "Nation"),
             ("manila times", "https://www.manilatimes.net/2025/01/02/business/top-business/x/123", True, "Business"), ("philstar", "https://www.philstar.com/nation/2025/01/02/123/x", True, "Nation"), ("philstar", "https://www.philstar.com/headlines/2025/01/02/123/x", False, "Headlines"), ("inquirer", "https://radyo.inquirer.net/123456/a-story", False, None), ("rappler", None, None, "General")]
    for site, u, story, section in cases:
        df = spark.createDataFrame([(u,)], "u string")
        assert df.select(sites.is_story(F.col("u"), sites.STORIES[site])).first()[0] is story, u
        if section:
            assert df.select(sites.section(F.col("u"), sites.SECTIONS[site])["category"]).first()[0] == section, u


def test_jdbc(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(100)], "id int, name string")
    url = "jdbc:derby:memory:tests;create=true"
    df.write.format("jdbc").option("url", url).option("dbtable", "t").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").save()
    whole = readers.jdbc(spark, "jdbc:derby:memory:tests", 'select * from t where "id" < 50')
    parts = readers.jdbc(spark, "jdbc:derby:memory:tests", "select * from t", "id", (0, 100), 4)
    assert whole.count() == 50 and parts.count() == 100 and parts.rdd.getNumPartitions() == 4


def test_readers(spark, tmp_path):
    rss = '<rss><channel><item><title>A</title><link> https://g.com/x?url=https%3A%2F%2FA.com%2Fb%2F </link><pubDate>Tue, 02 Sep 2025 22:43:35 +0800</pubDate><category>News</category></item><item><title>B</title><link>https://b.com</link></item></channel></rss>'
    (tmp_path / "r.xml").write_text(rss)
    got = {r.title: (r.url, r.published) for r in readers.aggregator(spark, str(tmp_path / "r.xml")).collect()}
    assert got["A"][0] == "https://a.com/b" and got["A"][1] is not None and got["B"] == ("https://b.com/", None)
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a.com/1</loc></url><url><loc>https://a.com/2</loc><lastmod>2025-01-01</lastmod></url></urlset>")
    assert readers.sitemap(spark, str(tmp_path / "s.xml")).count() == 2
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert readers.json_array(spark, str(tmp_path / "a.json")).count() == 2
    pages = spark.createDataFrame([(1, '<a href="/b">Some longer title</a><a href="/c">x</a><a href="/b">again</a>', "https://h.com/"), (2, None, None)], "id long, h string, base string")
    links = readers.discovered_links(pages, "id", "h", "base")
    assert sorted((r.pos, r.url) for r in links.collect()) == [(0, "https://h.com/b"), (1, "https://h.com/c")]
    assert [r.title for r in readers.stubs(links).collect()] == ["Some longer title"]


def test_analysis_rows(spark):
    from pressmill.models import rows

    lex = spark.createDataFrame([("administration", "president", 1.0), ("opposition", "senator", 1.0)], "category string, term string, weight double")
    a = spark.createDataFrame([(1, "A great win", "The president spoke"), (2, None, None)], "id long, title string, content string")
    got = rows.analysis_rows(a, [rows.sentiment_model(), rows.political_model(lex)]).collect()
    assert len(got) == 4 and {r.model_type for r in got} == {"sentiment", "political_bias"}
    by = {(r.article_id, r.model_type): r for r in got}
    assert by[1, "sentiment"].sentiment_label == "positive" and by[2, "sentiment"].sentiment_score == 0
    assert by[1, "political_bias"].direction == "pro_government" and by[2, "political_bias"].direction == "neutral"


def test_entity_spans(spark):
    from pressmill.functions import entities

    text = "x" * 60 + " The DPWH gave P5 billion to Manila. " + "y" * 60
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").coalesce(1).select(entities.entity_spans(F.col("t")).alias("s")).collect()
    assert [(s.label, s.text) for s in got[0].s] == [("agency", "DPWH"), ("amount", "P5 billion"), ("location", "Manila")]
    assert all(text[s.start : s.end] == s.text and s.text in s.context and len(s.context) <= len(s.text) + 100 for s in got[0].s)
    assert got[1].s == [] == got[2].s
    p = entities.dictionary({"k": ["bus depot", "bus"]})
    assert spark.createDataFrame([("a bus depot, busy bus",)], "t string").select(entities.entity_spans(F.col("t"), p).alias("s")).first().s[0].text == "bus depot"
