"""What landed HTML pages say: links, section, title, date, JSON-LD, text. Parsed once per page by an Arrow UDF over the standard library's streaming parser; metadata that a pattern finds are JVM expressions.

Broken-off pages give what was read up to the break; NULL pages give NULLs and empty arrays.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.text import normalize_category

SCHEMA = "title string, headings array<string>, section string, breadcrumb string, date string, og_type string, jsonld array<string>, links array<struct<url:string,text:string>>, paragraphs array<string>"
_SKIP = frozenset(("script", "style", "noscript", "template", "svg"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DATES = (("property", "article:published_time"), ("name", "pubdate"), ("name", "date"), ("itemprop", "datePublished"))


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.headings, self.paragraphs, self.links, self.jsonld = "", [], [], [], []
        self.meta: dict[tuple[str, str], str] = {}
        self.time = self.crumb = None
        self._open: list[tuple[str, bool]] = []
        self._text: dict[str, list[str]] = {}
        self._href = None
        self._json = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            for kind in ("property", "name", "itemprop"):
                if kind in a:
                    self.meta.setdefault((kind, a[kind]), a.get("content", ""))
        elif tag == "time" and self.time is None:
            self.time = a.get("datetime")
        elif tag == "a":
            self._href, self._text["a"] = a.get("href"), []
        elif tag in ("h1", "h2", "p", "title"):
            self._text[tag] = []
        elif tag == "script":
            self._json = a.get("type") == "application/ld+json"
            self._text["script"] = []
        if tag not in _VOID:
            marks = a.get("class", "") + " " + a.get("id", "")
            self._open.append((tag, "breadcrumb" in marks))

    def handle_endtag(self, tag):
        text = " ".join("".join(self._text.get(tag, [])).split())
        if tag == "title" and not self.title:
            self.title = text
        elif tag in ("h1", "h2") and text:
            self.headings.append(text)
        elif tag == "p" and text:
            self.paragraphs.append(text)
        elif tag == "a" and self._href is not None:
            self.links.append((self._href, text))
            if self.crumb is None and text and any(c for _, c in self._open):
                self.crumb = text
            self._href = None
        elif tag == "script" and self._json:
            self.jsonld.append("".join(self._text.get("script", [])))
            self._json = False
        self._text.pop(tag, None)
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                del self._open[k:]
                break

    def handle_data(self, data):
        inside = {t for t, _ in self._open}
        for tag, parts in self._text.items():
            if tag == "script" or not inside & _SKIP:
                parts.append(data)


def parse(html: str | None, base: str | None = None) -> tuple:
    if not html:
        return None, [], None, None, None, None, [], [], []
    p = _Page()
    try:
        p.feed(html)
        p.close()
    except Exception:  # noqa: BLE001 - what was read still counts
        pass
    for tag in ("p", "h1"):  # cut off inside
        rest = " ".join("".join(p._text.get(tag, [])).split())
        if rest:
            (p.paragraphs if tag == "p" else p.headings).append(rest)
    section = next((p.meta[k] for k in (("property", "article:section"), ("name", "section"), ("name", "category")) if p.meta.get(k)), None)
    date = p.time or next((p.meta[k] for k in _DATES if p.meta.get(k)), None)
    links = [(urljoin(base, u) if base else u, t) for u, t in p.links if u and not u.startswith(("javascript:", "mailto:", "#"))]
    return p.title or None, p.headings, section, p.crumb, date, p.meta.get(("property", "og:type")), p.jsonld, links, p.paragraphs


def _parsed(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    rows = [parse(h if isinstance(h, str) else None, b if isinstance(b, str) else None) for h, b in zip(html, base)]
    out = pd.DataFrame(rows, columns=["title", "headings", "section", "breadcrumb", "date", "og_type", "jsonld", "links", "paragraphs"])
    out["links"] = [[{"url": u, "text": t} for u, t in x] for x in out["links"]]
    return out


def parsed(html: Column, base: Column) -> Column:
    """STRUCT of what a page says (SCHEMA); base completes relative links."""
    return F.pandas_udf(_parsed, SCHEMA)(html, base)


def meta_content(html: Column, kind: str, name: str) -> Column:
    """The content of a meta tag, by pattern alone."""
    n = re.escape(name)
    a = F.regexp_extract(html, rf'(?is)<meta[^>]*\b{kind}\s*=\s*["\']{n}["\'][^>]*\bcontent\s*=\s*["\']([^"\']*)', 1)
    b = F.regexp_extract(html, rf'(?is)<meta[^>]*\bcontent\s*=\s*["\']([^"\']*)["\'][^>]*\b{kind}\s*=\s*["\']{n}["\']', 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def page_category(page: Column, from_url: Column) -> Column:
    """Section of the page: meta tags, then breadcrumb, then JSON-LD, then the URL, then "General"."""
    ld = F.get(F.filter(F.transform(page["jsonld"], lambda j: F.get_json_object(j, "$.articleSection")), lambda s: s.isNotNull()), F.lit(0))
    return F.coalesce(normalize_category(page["section"]), normalize_category(page["breadcrumb"]), normalize_category(ld), from_url, F.lit("General"))


def jsonld_article(page: Column) -> Column:
    """STRUCT<headline, published, body> of the first JSON-LD block that has a headline, those of a @graph included."""
    fields = "struct<headline:string,datePublished:string,articleBody:string>"
    one = F.from_json(F.lit(None).cast("string"), fields)
    blocks = F.transform(page["jsonld"], lambda j: F.from_json(j, "headline string, datePublished string, articleBody string"))
    graph = F.flatten(F.transform(page["jsonld"], lambda j: F.coalesce(F.from_json(F.get_json_object(j, "$['@graph']"), f"array<{fields}>"), F.array().cast(f"array<{fields}>"))))
    hits = F.filter(F.concat(blocks, graph), lambda s: s["headline"].isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), one)


def data_layer_category(html: Column) -> Column:
    """primary_category of a data layer."""
    return F.nullif(F.regexp_extract(html, r'["\']?primary_category["\']?\s*:\s*["\']([^"\']+)', 1), F.lit(""))


def body_text(page: Column, least: int = 20, cap: int | None = None, drop: str = r"(?i)^(?:advertisement|read more|related|follow us|copyright|all rights reserved)") -> Column:
    """Paragraphs of at least `least` characters, each once, without boilerplate, whole unless a `cap` of characters is given; NULL for none."""
    kept = F.array_distinct(F.filter(page["paragraphs"], lambda p: (F.length(p) >= least) & ~p.rlike(drop)))
    text = F.array_join(kept, "\n")
    return F.nullif(text if cap is None else F.substring(text, 1, cap), F.lit(""))


def title_text(page: Column, least: int = 10) -> Column:
    """The first heading that is long enough, else the document's title."""
    return F.coalesce(F.get(F.filter(page["headings"], lambda h: F.length(h) >= least), F.lit(0)), page["title"])


def is_thin(page: Column, content: Column, least: int = 80) -> Column:
    """Too short for a report, on a page that says it is something else."""
    return (F.coalesce(F.length(content), F.lit(0)) < least) & F.coalesce(page["og_type"] != "article", F.lit(False))
