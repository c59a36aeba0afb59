import datetime
import glob
import math
import os

import duckdb
import pytest

from pressmill.plans import registry


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


#: Queries without SQL that find nothing in the smallest tables.
NO_ROWS = ("html_stubs",)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    assert columns and len(set(columns)) == len(columns)
    if name not in registry.SQL:
        assert rows or name in NO_ROWS
        return
    q = duck.execute(registry.SQL[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == columns
    other = [tuple(norm(r[names.index(c)]) for c in columns) for r in q.fetchall()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows, key=key) == sorted(other, key=key)


def test_filters_reach_the_scan(spark, data):
    df = registry.QUERIES["articles_filtered"](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(source,Isla Dispatch)" in plan and "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_outlets_by_day_and_in_any_spelling(spark, data, duck):
    """Against plain Python: every analysis of an outlet counts, however its name is spelled, and a day is a point."""
    from collections import Counter

    from pressmill.plans.common import analyses, articles

    fold = lambda s: "".join(c for c in s.lower() if c.isalpha())
    names = {fold(r[0]): r[0] for r in duck.execute("SELECT source FROM outlets WHERE source IS NOT NULL ORDER BY source DESC").fetchall()}
    at = {r.id: (names.get(fold(r.source or "")), r.day) for r in articles(spark, data).select("id", "source", "day").collect()}
    want = {}
    for r in analyses(spark, data).where("model_type = 'sentiment'").select("article_id", "sentiment_label").collect():
        if at.get(r.article_id, (None,))[0]:
            want.setdefault(at[r.article_id], Counter())[r.sentiment_label] += 1
    got = {(r.source, r.day): r for r in registry.QUERIES["sentiment_daily_scores"](spark, data).collect()}
    assert {k: (r.p, r.n, r.u) for k, r in got.items()} == {k: (c["positive"], c["negative"], c["neutral"]) for k, c in want.items()}
    assert any(s is not None and s not in names.values() and fold(s) in names for (s,) in duck.execute("SELECT source FROM articles").fetchall())
    days = Counter(s for s, _ in got)
    assert {r.source: r.n for r in registry.QUERIES["daily_score_ols"](spark, data).collect()} == {s: n for s, n in days.items() if n >= 14}
    assert {r.source for r in registry.QUERIES["key_factors"](spark, data).collect()} == set(days)


def test_empty_tables_and_clashing_columns(spark, data, tmp_path):
    """Every query by day runs over empty tables, and over tables with further columns of the names it uses itself."""
    names = ("trends_daily", "coverage_daily", "sentiment_daily_scores", "daily_score_ols", "lagged_correlation", "top_influencers", "key_factors", "funds_trends", "funds_date_distribution", "keyword_match_counts", "bias_summary", "confusion_matrix", "upsert_twice", "p2_found")
    want = {}
    for name in names:
        want[name] = registry.QUERIES[name](spark, data).count()
    for kind in ("empty", "clash"):
        folder = tmp_path / kind
        for t in ("articles", "bias_analysis", "outlets", "lexicon", "scraping_logs"):
            df = spark.read.parquet(f"{data}/{t}.parquet")
            df = df.limit(0) if kind == "empty" else df.selectExpr("*", *[f"'x' AS {c}" for c in ("at", "day", "month", "outlet", "zone", "utc_us", "local_us", "n", "k", "bucket", "seen") if c not in df.columns])
            df.write.parquet(f"{folder}/{t}.parquet")
        for name in names:
            rows = registry.QUERIES[name](spark, str(folder)).count()
            assert rows == want[name] if kind == "clash" else rows <= 1, (kind, name)
