"""SQL for queries whose rules are tables: built from the same fixed values, stated with other means."""

from __future__ import annotations

from pressmill.functions import money, sites, text, urls
from pressmill.models import funds
from pressmill.plans import dashboards
from pressmill.plans.research import _DAY, _GRID


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _title(s: str) -> str:
    return rf"array_to_string(list_transform(string_split({s}, ''), lambda x, i: CASE WHEN i > 1 AND regexp_matches(string_split({s}, '')[i - 1], '\p{{L}}') THEN lower(x) ELSE upper(x) END), '')"


def _any(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, '{x}')" for x in terms) + ")"


_SEG = r"list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"
_PATH = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1))"
_T = "lower(trim(COALESCE(title, '') || chr(10) || COALESCE(content, ''), ' '))"
_NEGATIVE = f"{funds.SPORTS}|{funds.CRIME}|{funds.DISASTER}|{funds.DAMAGE}"
_RULE = f"""CASE WHEN t = '' OR regexp_matches(t, '{_NEGATIVE}') THEN false ELSE regexp_matches(t, '{funds.MONEY}') AND regexp_matches(t, '{funds.GOVERNMENT}|{funds.IRREGULAR}') END"""
_SURE = f"""CASE WHEN {_any('t', funds.GATE_NOT)} THEN 0.9 WHEN {_any('t', funds.GATE_GOVERNMENT)} AND {_any('t', funds.GATE_MONEY)} THEN 0.8 WHEN {_any('t', funds.GATE_GOVERNMENT)} AND regexp_matches(t, '{funds.AMOUNT_NAMED}') THEN 0.7 ELSE 0.3 END::DOUBLE"""
_GATED = f"""CASE WHEN regexp_matches(t, '{_NEGATIVE}') THEN false WHEN c = 0.9 THEN false WHEN c >= 0.7 THEN true ELSE false END"""
_CANDIDATE = f"({_any('t', funds.CANDIDATE_MONEY)} OR {_any('t', funds.CANDIDATE_BODIES)})"
_E = f"""e AS (SELECT id, regexp_extract_all(t, '(?i){money.AGENCY}', 1) AS agencies, regexp_extract_all(t, '(?i){money.AMOUNT}', 1) AS amounts, regexp_extract_all(t, '(?i){money.IRREGULAR}', 1) AS irregular,
  regexp_extract_all(t, '(?i){money.PROJECT}', 1) AS projects FROM (SELECT id, COALESCE(title, '') || ' ' || COALESCE(content, '') AS t FROM articles) q),
  x AS (SELECT *, NULLIF(COALESCE(list_sum(list_transform(amounts, lambda a: TRY_CAST(regexp_extract(lower(a), '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) * CASE WHEN contains(lower(a), 'billion') THEN 1e9 WHEN contains(lower(a), 'million') THEN 1e6
    WHEN contains(lower(a), 'thousand') THEN 1e3 ELSE 1.0 END)), 0), 0) AS total FROM e),
  n AS (SELECT id, v, COUNT(*) AS k, MIN(i) AS first FROM (SELECT id, unnest(agencies) AS v, unnest(range(len(agencies))) AS i FROM e) q GROUP BY id, v),
  p AS (SELECT id, v AS primary_agency FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY k DESC, first) AS rn FROM n) q WHERE rn = 1)""".replace("\\\\", "\\")
_CORR = f"""{_GRID}, c AS (SELECT x.source AS a, y.source AS b, l.lag, COUNT(*) AS n, covar_pop(x.score, y.score) AS c, stddev_pop(x.score) AS sx, stddev_pop(y.score) AS sy
    FROM grid x CROSS JOIN (VALUES (0), (1), (2), (3)) l(lag) JOIN grid y ON y.pos = x.pos + l.lag AND x.source < y.source GROUP BY 1, 2, 3),
  r AS (SELECT a, b, lag, c / (sx * sy) AS r FROM c WHERE n > 1 AND sx * sy > 0), m AS (SELECT a, b, lag, r FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a, b ORDER BY ROUND(ABS(r), 9) DESC, lag) AS rn FROM r) q WHERE rn = 1),
  g AS (SELECT a, b, lag, r, CASE WHEN lag > 0 THEN 'leads' ELSE 'follows' END AS relation FROM m WHERE ABS(r) > 0.3)"""
_OLS = f"""{_DAY}, o AS (SELECT source, COUNT(*) AS n, MAX(pos) AS last, AVG(pos) AS mx, AVG(score) AS my, covar_pop(pos, score) AS c, var_pop(pos) AS vx, var_pop(score) AS vy FROM s GROUP BY source HAVING COUNT(*) >= 14),
  l AS (SELECT *, c / vx AS slope, my - c / vx * mx AS intercept, sqrt(GREATEST(0, vy - c / vx * c)) AS sd, CASE WHEN vy = 0 THEN 1.0 ELSE c / vx * c / vy END AS r2 FROM o)"""

_PQ = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)) || lower(regexp_extract(url, '(\?[^#]*)', 1))"
_LSEG = f"list_transform({_SEG}, lambda x: lower(x))"


def _story(r: sites.Story) -> str:
    parts = [f"len({_SEG}) >= {r.least}", f"length({_PATH}) >= {r.least_path}"]
    if r.deny:
        parts.append(f"NOT {_any(_PQ, r.deny)}")
    if r.deny_segments:
        parts.append(f"NOT list_has_any({_LSEG}, {list(r.deny_segments)})")
    if r.deny_paths:
        parts.append(f"regexp_replace({_PATH}, '/+$', '') NOT IN {_list(r.deny_paths)}")
    if r.begins:
        parts.append("(" + " OR ".join(f"starts_with({_PATH}, '{x}')" for x in r.begins) + ")")
    if r.any_of:
        parts.append(_any(_PATH, r.any_of))
    last = f"COALESCE({_LSEG}[-1], '')"
    if r.slug:
        parts.append(f"((contains({last}, '-') AND length({last}) > 8) OR regexp_matches({_PATH}, '/20\\d{{2}}/'))")
    if r.number_or_long:
        parts.append(f"(regexp_matches({last}, '^\\d+$') OR length({_PATH}) > 40)")
    return " AND ".join(parts)


def _section(r: sites.Section) -> str:
    m = _map(r.names)
    if r.anywhere:
        s = f"list_filter({list(r.anywhere)}, lambda x: list_contains({_LSEG}[1:len({_LSEG}) - 1], x))[1]"
    else:
        s = f"{_LSEG}[{r.at + 1}]"
        if r.drill:
            s = f"CASE WHEN {s} IN {_list(r.drill) if len(r.drill) > 1 else _list(r.drill).replace(',', '')} AND {m}[{_LSEG}[{r.at + 2}]] IS NOT NULL THEN {_LSEG}[{r.at + 2}] ELSE {s} END"
        for k, x in enumerate(r.under):
            s = f"CASE WHEN {_LSEG}[{k + 1}] = '{x}' THEN {s} END"
    if r.city_first:
        return f"CASE WHEN COALESCE({m}[{s}], 'News') IN ('News', 'General') AND len({_LSEG}) > {r.at} THEN 'Nation' ELSE COALESCE({m}[{s}], '{r.default}') END"
    return f"COALESCE({m}[{s}], '{r.default}')"


_name = lambda site: site.replace(" ", "_")
_STORIES = ", ".join(f"{_story(r)} AS {_name(k)}" for k, r in sites.STORIES.items())
_SECTIONS = ", ".join(f"{_section(r)} AS {_name(k)}" for k, r in sites.SECTIONS.items())
SQL = {
    "url_category": f"""SELECT id, c AS category, COALESCE(c, 'General') AS resolved FROM (SELECT id, {_map(text.CATEGORIES)}[replace(lower(list_filter({_SEG}, lambda x: lower(x) NOT IN {_list(urls.NO_SECTION)}
      AND replace(lower(x), '_', '-') IN {_list(text.CATEGORIES)})[1]), '_', '-')] AS c FROM articles) q""",
    "url_validity": f"""SELECT id, len(list_filter({_SEG}, lambda x: x = 'page')) = 0 AND regexp_replace({_PATH}, '/+$', '') NOT IN {_list(urls.LISTINGS)} AND NOT {_any(_PATH, urls.BLOCKED)} AND len({_SEG}) >= 3 AND ends_with(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), regexp_replace(lower(source), '[^a-z0-9]', '', 'g') || '.example') AS valid,
      len({_SEG}) >= 4 AND regexp_matches({_PATH}, '/\\d{{4}}/\\d{{2}}/\\d{{2}}/') AND NOT regexp_matches({_PATH}, '/page/\\d+|/tag/') AND length({_SEG}[-1]) >= 10 AS dated FROM articles WHERE url IS NOT NULL""",
    "url_site_stories": f"SELECT id, {_STORIES} FROM articles WHERE url IS NOT NULL",
    "url_site_sections": f"SELECT id, {_SECTIONS} FROM articles",
    "names_normalized": f"""SELECT id, CASE WHEN source <> '' THEN COALESCE({_map(text.SOURCES)}[lower(trim(source, ' '))], {_title("trim(source, ' ')")}) END AS source,
      CASE WHEN category <> '' THEN COALESCE({_map(text.CATEGORIES)}[replace(lower(trim(category, ' ')), '_', '-')], {_title("trim(category, ' ')")}) END AS category FROM articles""",
    "funds_gated": f"SELECT id, {_GATED} AS gated, c AS confidence, {_CANDIDATE} AS candidate FROM (SELECT id, t, {_SURE} AS c FROM (SELECT id, {_T} AS t FROM articles) q) q",
    "confusion_matrix": f"""SELECT COUNT(*) AS n, COUNT(*) FILTER (x AND y) AS both_yes, COUNT(*) FILTER (x AND NOT y) AS missed, COUNT(*) FILTER (NOT x AND y) AS extra, COUNT(*) FILTER (NOT x AND NOT y) AS both_no, ROUND(AVG((x = y)::INTEGER), 6) AS agreement
      FROM (SELECT is_funds AS x, {_RULE} AS y FROM (SELECT is_funds, {_T} AS t FROM articles WHERE is_funds IS NOT NULL) q) q""",
    "funds_disagreements": f"SELECT id, is_funds, said FROM (SELECT id, is_funds, {_RULE} AS said FROM (SELECT id, is_funds, {_T} AS t FROM articles WHERE is_funds IS NOT NULL) q) q WHERE is_funds <> said ORDER BY id LIMIT 25",
    "dashboard_export": f"SELECT source, to_json(struct_pack(source := source, articles := articles, avg_bias := avg_bias, avg_confidence := avg_confidence, pro_government := pro_government, pro_opposition := pro_opposition, neutral := neutral))::VARCHAR AS json FROM ({dashboards.SQL['dashboard_by_source']}) q",
    "html_articles": rf"""SELECT id, COALESCE(list_filter(list_transform(regexp_extract_all(raw_html, '<h[12][^>]*>([^<]*)(?:</h[12]>|$)', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: length(x) >= 10)[1], NULLIF(trim(regexp_replace(regexp_extract(raw_html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'), ' '), '')) AS title,
      COALESCE({_map(text.CATEGORIES)}[replace(lower(trim(c, ' ')), '_', '-')], {_title("trim(c, ' ')")}, 'General') AS category, NULL::VARCHAR AS date, NULLIF(array_to_string(list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: length(x) >= 20 AND NOT regexp_matches(x, '(?i)^(?:advertisement|read more|related|follow us|copyright|all rights reserved)')), chr(10)), '') AS content,
      false AS thin, NULL::VARCHAR AS headline, NULL::VARCHAR AS og_type, NULL::VARCHAR AS data_layer FROM (SELECT id, raw_html, NULLIF(replace(regexp_extract(raw_html, 'article:section" content="([^"]*)"', 1), '&amp;', '&'), '') AS c, list_transform(regexp_extract_all(raw_html, '<p>([^<]*)(?:</p>|$)', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')) AS l FROM raw_articles) q""",
    "funds_eval": f"""SELECT COUNT(*) AS n, COUNT(*) FILTER (x AND y) AS both_yes, COUNT(*) FILTER (x AND NOT y) AS rule_only, COUNT(*) FILTER (NOT x AND y) AS gate_only, COUNT(*) FILTER (NOT x AND NOT y) AS both_no, ROUND(AVG((x = y)::INTEGER), 6) AS agreement
      FROM (SELECT {_RULE} AS x, {_GATED} AS y FROM (SELECT t, {_SURE} AS c FROM (SELECT {_T} AS t FROM articles) q) q WHERE {_CANDIDATE}) q""",
    "funds_entities": f"""WITH {_E} SELECT x.id, array_to_string(agencies, '|') AS agencies, array_to_string(amounts, '|') AS amounts, total, p.primary_agency, ROUND(LEAST(CASE WHEN len(agencies) > 0 THEN 0.3 ELSE 0 END + CASE WHEN len(amounts) > 0 THEN 0.4 ELSE 0 END + CASE WHEN len(irregular) > 0 THEN 0.2 ELSE 0 END
      + CASE WHEN len(projects) > 0 THEN 0.1 ELSE 0 END, 1.0), 6)::DOUBLE AS relevance FROM x LEFT JOIN p ON p.id = x.id""",
    "funds_agencies": f"WITH {_E} SELECT primary_agency, COUNT(*) AS n, ROUND(SUM(total) / 1e6, 2) AS total_millions FROM x JOIN p ON p.id = x.id GROUP BY primary_agency ORDER BY n DESC, primary_agency LIMIT 10",
    "funds_trends": f"""WITH {_E}, k AS (SELECT total, ROW_NUMBER() OVER (ORDER BY total) - 1 AS i, COUNT(*) OVER () AS n FROM x WHERE total IS NOT NULL)
      SELECT COUNT(*) AS articles, ROUND(SUM(total) / 1e6, 2) AS total_millions, MIN(total) AS least, MAX(total) AS largest, ROUND(AVG((len(irregular) > 0)::INTEGER), 6) AS irregular_rate, ROUND(ROUND(SUM(total) / 1e6, 2) / COUNT(*), 4) AS average_millions,
        (SELECT total FROM k WHERE i = n // 2) AS median FROM x""",
    "mined_names": rf"""WITH m AS (SELECT unnest(regexp_extract_all(COALESCE(title, '') || ' ' || COALESCE(category, '') || ' ' || COALESCE(source, ''), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,3}})\b', 1)) AS name FROM articles)
      SELECT name, COUNT(*) AS n FROM m WHERE length(name) > 2 AND string_split_regex(name, '\s+')[1] NOT IN {_list(text.NO_NAMES)} GROUP BY name ORDER BY n DESC, name LIMIT 50""",
    "category_backfill_values": f"""SELECT id, COALESCE(m, 'News') AS category, CASE WHEN m IS NOT NULL THEN {_title("replace(g, '-', ' ')")} END AS raw, m IS NOT NULL AS resolved FROM (SELECT id, g, {_map(urls.SECTIONS)}[g] AS m
      FROM (SELECT id, lower({_SEG}[1]) AS g FROM articles WHERE category IS NULL OR category IN ('Post', 'General', 'Uncategorized')) q) q""",
    "propagation_edges": f"WITH {_CORR} SELECT a, b, lag, ROUND(r, 6) AS r, relation FROM g",
    "propagation_pattern": f"""WITH {_CORR} SELECT COUNT(*) FILTER (relation = 'leads') AS leads, COUNT(*) FILTER (relation = 'follows') AS follows,
      CASE WHEN COUNT(*) FILTER (relation = 'leads') > COUNT(*) FILTER (relation = 'follows') THEN 'hierarchical' ELSE 'distributed' END AS pattern FROM g""",
    "influence_scores": f"WITH {_CORR} SELECT n.source, ROUND(COALESCE(SUM(ABS(g.r)) * AVG(ABS(g.r)), 0), 6) AS influence FROM (SELECT DISTINCT source FROM s) n LEFT JOIN g ON g.a = n.source GROUP BY n.source",
    "top_influencers": f"WITH {_CORR} SELECT n.source, ROUND(COALESCE(SUM(ABS(g.r)) * AVG(ABS(g.r)), 0), 6) AS influence FROM (SELECT DISTINCT source FROM s) n LEFT JOIN g ON g.a = n.source GROUP BY n.source ORDER BY influence DESC, source LIMIT 3",
    "forecast_bands": f"""WITH {_OLS} SELECT source, ROUND(r2, 6) AS r2, ROUND(sd, 6) AS residual_std, k::INTEGER AS step, intercept + slope * (last + k) AS value, intercept + slope * (last + k) - 1.96 * sd AS low, intercept + slope * (last + k) + 1.96 * sd AS high
      FROM l CROSS JOIN range(1, 8) t(k)""",
    "key_factors": f"""WITH {_OLS}, q AS (SELECT source, stddev_pop(score) AS sd, AVG(score) AS mean, AVG(score) FILTER (back <= 7) AS recent FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY pos DESC) AS back FROM s) z GROUP BY source)
      SELECT q.source, array_to_string(list_filter([CASE WHEN q.sd > 0.3 THEN 'high volatility' END, CASE WHEN slope * 7 > 0.1 THEN 'upward trend' WHEN slope * 7 < -0.1 THEN 'downward trend' END, CASE WHEN ABS(recent - mean) > 0.2 THEN 'recent shift' END], lambda x: x IS NOT NULL), '|') AS factors
      FROM q LEFT JOIN l ON l.source = q.source""",
    "priority_discovery": """SELECT MIN(pos) AS pos FROM (SELECT 0 AS s, title AS k, id AS pos FROM articles WHERE source = 'Dagat Post' AND title IS NOT NULL UNION ALL SELECT 1, raw_html, id FROM raw_articles WHERE source = 'Dagat Post' AND raw_html IS NOT NULL) q
      GROUP BY k, s QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY s) = 1""",
}
SQL = {k: " ".join(v.split()) for k, v in SQL.items()}
QUERIES: dict = {}
