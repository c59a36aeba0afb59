"""All queries of the core, and their SQL."""

from __future__ import annotations

from functools import wraps

from pressmill.plans import dashboards, endpoints, landing, more_sql, problems, reading, research, texts

_MODULES = (reading, dashboards, texts, research, endpoints, landing, more_sql, problems)
#: Queries whose ranks, sizes and lengths come out as BIGINT, as in SQL.
_LONG = (
    "home_topn_per_source", "home_fixed_sources", "run_log_recent", "content_lengths", "url_sections", "content_shaping", "keyword_match_counts", "html_titles", "sentiment_daily_scores", "top_lines_per_supplier",
)


def _long(f):
    @wraps(f)
    def run(spark, d):
        df = f(spark, d)
        return df.select(*[df[c].cast("bigint").alias(c) if kind == "int" else df[c] for c, kind in df.dtypes])

    return run


QUERIES = {k: _long(f) if k in _LONG else f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
FLAGSHIP = QUERIES["trends_daily"]
