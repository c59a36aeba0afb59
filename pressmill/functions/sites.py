"""Rules of single sites as data: which URLs are stories, and which section a URL names. Two engines read them: `is_story` and `section`."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions import urls
from pressmill.functions.text import literal_map, title_case


@dataclass(frozen=True)
class Story:
    """host: what the host must end with; hosts_not: hosts that never have stories; deny: substrings of path and query; deny_segments, deny_paths: whole ones;
    begins, any_of: substrings one of which the path must begin with or hold; least: path segments; least_path: characters of the path;
    slug: a hyphenated last segment of more than 8 characters, or a year in the path; number_or_long: last segment a number or a path of more than 40 characters."""

    host: str
    hosts_not: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    deny_segments: tuple[str, ...] = ()
    deny_paths: tuple[str, ...] = ()
    begins: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    least: int = 0
    least_path: int = 0
    slug: bool = False
    number_or_long: bool = False


@dataclass(frozen=True)
class Section:
    """The segment at place `at` (from 0), of paths that begin with the segments `under`, by `names`. drill: segments in whose place the next one counts, if it is known.
    city_first: the segment before it is a city, which is the section of plain news. anywhere: the first of these that is a segment before the last, wherever it stands."""

    at: int = 0
    under: tuple[str, ...] = ()
    names: dict[str, str] = field(default_factory=lambda: urls.SECTIONS)
    drill: tuple[str, ...] = ()
    city_first: bool = False
    anywhere: tuple[str, ...] = ()
    default: str = "News"


# The sites' rules.
_MEDIA = ("photo", "photos", "video", "videos")
STORIES = {
    "inquirer": Story("inquirer.net", hosts_not=("radyo.inquirer.net", "pep.inquirer.net"), deny=("/tag/", "/author/", "/search", "/privacy-policy", "/user-agreement", "/contact", "/newsletter", "/job-openings", "/article-index", "/fullfeed", "/category/", "/regions", "/page-one-single"), least=2, least_path=10),
    "rappler": Story("rappler.com", deny=("/feed/", "/search", "/tag/", "/author/", "/newsletter", "/subscribe", "/login", "/register", "/wp-", "/tachyon/", "/latest-from", "/topics/", "/section/", "/category/", "/categories/", ".css", ".js", ".png", ".jpg", ".gif", ".pdf"), any_of=("/20", "/news/", "/newsbreak/", "/nation/", "/business/", "/sports/", "/technology/", "/world/"), least=2, slug=True),
    "gma": Story("gmanetwork.com", deny_segments=(*_MEDIA, "balitambayan", "cbb", "lotto"), begins=("/news/",), least=3),
    "philstar": Story("philstar.com", deny=urls.BLOCKED, deny_segments=("page",), deny_paths=urls.LISTINGS, least=3),
    "manila times": Story("manilatimes.net", deny_segments=(*_MEDIA, "gallery", "opinion", "regions"), any_of=("/2025/", "/news/"), number_or_long=True),
    "manila bulletin": Story("mb.com.ph", deny=("/search", "?s=", "/feed", "/wp-admin"), least=1),
    "sunstar": Story("sunstar.com.ph", deny=("/category/", "/tag/", "/author/", "/page/", "/search/", "/contact/", "/about/", "/advertisement/", ".jpg", ".png", ".gif", ".pdf")),
}
_CITIES = {"cebu": "Cebu", "davao": "Davao", "bohol": "Bohol", "pampanga": "Pampanga", "baguio": "Baguio", "zamboanga": "Zamboanga", "iloilo": "Iloilo", "tacloban": "Tacloban", "general-santos": "General Santos"}
_COMMON = {"business": "Business", "sports": "Sports", "entertainment": "Entertainment", "world": "World", "lifestyle": "Lifestyle", "opinion": "Opinion", "nation": "Nation", "politics": "Politics"}
SECTIONS = {
    "gma": Section(at=1, under=("news",), names=_COMMON | _CITIES | {"topstories": "News", "metro": "Metro", "lotto": "Lotto", "weather": "Weather", "technology": "Technology", "health": "Health", "education": "Education"}, drill=("topstories",), default="General"),
    "philstar": Section(names=_COMMON | _CITIES | {"headlines": "Headlines", "news": "News", "metro": "Metro"}, default="General"),
    "rappler": Section(names=_COMMON | {"technology": "Technology", "tech": "Technology", "newsbreak": "News", "latest": "News"}, drill=("newsbreak",), default="General"),
    "sunstar": Section(at=1, city_first=True, default="Nation"),
    "manila bulletin": Section(),
    "manila times": Section(anywhere=("business", "sports", "opinion", "world", "regions", "politics", "lifestyle", "entertainment", "top-business", "foreign-business", "top-sports", "columns", "the-sunday-times", "news", "top-news")),
}


def is_story(u: Column, rule: Story, host: str | None = None) -> Column:
    """NULL for NULL. host: another host than the rule's (for mirrors)."""
    path, segments, h = F.lower(urls.path(u)), urls.segments(F.lower(u)), urls.host(u)
    full = F.concat(path, F.lower(F.regexp_extract(u, r"(\?[^#]*)", 1)))
    domain = rule.host if host is None else host
    ok = F.coalesce(h.endswith(domain), F.lit(False)) & (F.size(segments) >= rule.least) & (F.length(path) >= rule.least_path)
    for x in rule.hosts_not:
        ok &= h != x
    if rule.deny:
        ok &= ~reduce(lambda a, b: a | b, [F.contains(full, F.lit(x)) for x in rule.deny])
    if rule.deny_segments:
        ok &= ~F.arrays_overlap(segments, F.array(*[F.lit(x) for x in rule.deny_segments]))
    if rule.deny_paths:
        ok &= ~F.regexp_replace(path, r"/+$", "").isin(*rule.deny_paths)
    if rule.begins:
        ok &= reduce(lambda a, b: a | b, [path.startswith(x) for x in rule.begins])
    if rule.any_of:
        ok &= reduce(lambda a, b: a | b, [F.contains(path, F.lit(x)) for x in rule.any_of])
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    if rule.slug:
        ok &= (F.contains(last, F.lit("-")) & (F.length(last) > 8)) | path.rlike(r"/20\d{2}/")
    if rule.number_or_long:
        ok &= last.rlike(r"^\d+$") | (F.length(path) > 40)
    return F.when(u.isNotNull(), F.coalesce(ok, F.lit(False)))


def section(u: Column, rule: Section) -> Column:
    """STRUCT<category, raw>: raw is the segment as a title, NULL where it isn't known; NULL URLs have the default."""
    segments = F.coalesce(urls.segments(F.lower(u)), F.array().cast("array<string>"))
    names = literal_map(rule.names)
    known = lambda s: F.try_element_at(names, s)
    if rule.anywhere:
        inner = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
        seg = F.get(F.filter(F.array(*[F.lit(x) for x in rule.anywhere]), lambda x: F.array_contains(inner, x)), F.lit(0))
    else:
        seg = F.get(segments, F.lit(rule.at))
        if rule.drill:
            deeper = F.get(segments, F.lit(rule.at + 1))
            seg = F.when(seg.isin(*rule.drill) & known(deeper).isNotNull(), deeper).otherwise(seg)
        for k, x in enumerate(rule.under):
            seg = F.when(F.get(segments, F.lit(k)) == x, seg)
    name = known(seg)
    raw = F.when(name.isNotNull(), title_case(F.replace(seg, F.lit("-"), F.lit(" "))))
    if rule.city_first:
        plain = F.coalesce(name, F.lit("News")).isin("News", "General") & (F.size(segments) > rule.at)
        city = title_case(F.replace(F.get(segments, F.lit(rule.at - 1)), F.lit("-"), F.lit(" ")))
        return F.struct(F.when(plain, F.lit("Nation")).otherwise(F.coalesce(name, F.lit(rule.default))).alias("category"), F.when(plain, city).otherwise(raw).alias("raw"))
    return F.struct(F.coalesce(name, F.lit(rule.default)).alias("category"), raw.alias("raw"))
