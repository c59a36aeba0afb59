"""URL expressions. NULL in gives NULL out; a text that is no URL is kept as it is where a URL is returned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.text import CATEGORIES, literal_map, normalize_category, title_case

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
# Path segments that name no section, paths that are no story, sections of older resolvers.
NO_SECTION = ("photo", "photos", "video", "videos", "about", "section", "tag", "author", "page")
LISTINGS = ("/latest", "/section", "/tag", "/author", "/topics")
BLOCKED = (
    "lotto", "swertres", "stl", "pcso", "gambling", "betting", "photo", "photos", "video", "videos", "modal", "popup", "advertisement", "ad", "promo", "promotion", "results",
    "draw", "winning", "numbers", "play", "ticket", "/wp-content/", "/wp-", "/tachyon/",
)
SECTIONS = {
    "news": "News", "top-news": "News", "headlines": "News", "business": "Business", "top-business": "Business", "foreign-business": "Business", "sports": "Sports", "top-sports": "Sports",
    "opinion": "Opinion", "columns": "Opinion", "editorial": "Opinion", "world": "World", "regions": "Nation", "nation": "Nation", "politics": "Politics", "lifestyle": "Lifestyle",
    "entertainment": "Entertainment", "metro": "Metro", "technology": "Technology", "tech": "Technology", "health": "Health", "education": "Education",
}


def host(u: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(u, _PARTS, 2), F.lit("")))


def path(u: Column) -> Column:
    return F.regexp_extract(u, _PARTS, 3)


def segments(u: Column) -> Column:
    """ARRAY<STRING> of the non-empty path segments."""
    return F.filter(F.split(path(u), "/"), lambda s: s != "")


def canonical_url(u: Column) -> Column:
    """Host in lower case, query and fragment cut, no trailing slash but for the root."""
    p = F.regexp_replace(path(u), r"/+$", "")
    canon = F.concat(F.regexp_extract(u, _PARTS, 1), F.lit("://"), F.lower(F.regexp_extract(u, _PARTS, 2)), F.when(p == "", "/").otherwise(p))
    return F.when(u.rlike(_PARTS), canon).otherwise(u)


def category_from_url(u: Column) -> Column:
    """The first path segment that is a known category, NULL if none is."""
    known = list(dict.fromkeys(CATEGORIES.values()))
    usable = F.filter(segments(u), lambda s: ~F.lower(s).isin(*NO_SECTION))
    return F.get(F.filter(F.transform(usable, normalize_category), lambda s: s.isin(*known)), F.lit(0))


def section_from_url(u: Column, mapping: dict[str, str] | None = None, default: str = "News") -> Column:
    """STRUCT<category, raw>: the first segment by a section map; default and NULL where it isn't in it."""
    seg = F.lower(F.get(segments(u), F.lit(0)))
    hit = F.try_element_at(literal_map(mapping or SECTIONS), seg)
    return F.struct(F.coalesce(hit, F.lit(default)).alias("category"), F.when(hit.isNotNull(), title_case(F.replace(seg, F.lit("-"), F.lit(" ")))).alias("raw"))


def valid_news_url(u: Column, domain: str | Column, least_segments: int = 3) -> Column:
    """A story of the domain: no listing, no page of one, none of the blocked substrings, deep enough."""
    p, s = F.lower(path(u)), segments(u)
    d = F.lit(domain) if isinstance(domain, str) else domain
    blocked = reduce(lambda a, b: a | b, [F.contains(p, F.lit(x)) for x in BLOCKED])
    listing = F.regexp_replace(p, r"/+$", "").isin(*LISTINGS)
    return F.endswith(host(u), d) & ~F.array_contains(s, "page") & ~listing & ~blocked & (F.size(s) >= least_segments)


def valid_by_rules(u: Column, allow: list[str], deny: list[str], least_segments: int = 0, least_slug: int = 0) -> Column:
    """A site's rule table: one of the allowed patterns (all if none), none of the denied ones, depth, length of the last segment."""
    p, s = F.lower(path(u)), segments(u)
    ok = F.size(s) >= least_segments
    if allow:
        ok = ok & reduce(lambda a, b: a | b, [p.rlike(x) for x in allow])
    if deny:
        ok = ok & ~reduce(lambda a, b: a | b, [p.rlike(x) for x in deny])
    return ok & (F.length(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))) >= least_slug)


def redirect_target(u: Column, parameter: str = "url") -> Column:
    """The URL that an aggregator's link carries in a query parameter; the link itself without one."""
    found = F.nullif(F.regexp_extract(u, rf"[?&]{parameter}=([^&#]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(found), u)
