"""Texts cut off by field limits (problem 5).

The report is read by a stack automaton (`unclosed`: quotes, brackets, elements and
a tag still open at its end), its last line for an entity, an escape or a multibyte
sequence that was begun, and for its end: a terminator, a sign-off after one, or an
entry of a list that ends as such entries do. Something left open or broken, or a
mark or cue that says so ("...", "(more)"), is sure, whatever the end looks like; a
mere missing terminator counts only where the source sets terminators, that is in
fewer than `baseline` of its articles it is missing.

Defined results: NULL and blank contents, and contents that are no report, are
never cases; an article without a line of its own isn't either.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.keys import letters_only
from pressmill.llm import article_pass
from pressmill.llm import page_lines as pages
from pressmill.llm import residue
from pressmill.session import spread, staged

WHOLE, MISSING, BROKEN = 0, 1, 2
_OPENERS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”"}
# what a cut leaves of a multibyte sequence, an entity, an escape; each is of bounded length
_BROKEN = re.compile(r"�$|&#?\w{0,8}$|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]{0,2})?$|%[0-9A-F]?$")
# Marks and cues of a cut.
_CUT = re.compile(r"(?:\.{3,}|…|\[(?:\.{2,}|…)\]|\((?:more|continued|cont'?d?\.?|itutuloy|sundan|continúa)\)|[-–—]+\s*more\s*[-–—]*|\[\+?\d+ ?(?:chars?|characters|more)\]|(?:read|see|show) (?:more|full)\b.{0,20}|continue reading.{0,12}|>>+|→)\s*$", re.IGNORECASE)
_QUOTED = re.compile(r"(?:\.{3}|…)[\"”’'»)\]]+$")
_MARK = re.compile(r'["()\[\]{}«»“”<]')
_TAG = re.compile(r"""<(/?)([A-Za-z][\w-]*)((?:\s+(?:[^\s"'<>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?|/))*)\s*(/?)>|<!--.*?-->|<![A-Za-z][^<>]*>""", re.DOTALL)
_BEGUN = re.compile(r"""<(?:/?[A-Za-z][\w-]*|/|!(?:--.*)?)?(?:\s[^<>]*=[^<>]*)?$""", re.DOTALL)
# Elements whose end tag HTML demands.
_PAIRED = frozenset("a abbr article b big blockquote button cite code del div em figcaption figure font form h1 h2 h3 h4 h5 h6 i ins label mark ol pre q s section small span strike strong sub sup table tt u ul".split())
_ENTRY = re.compile(r"^\s*(?:[-*•–·]|\d{1,2}[.)]|\w\))\s+\S")


def unclosed(text: str) -> list[str]:
    """The stack of quotes, brackets and elements still open at the end of a text, each as what would close it; ">" is a tag that was begun.

    A quote that a later line opens again goes on; inch marks and faces made of a bracket open nothing.
    """
    stack: list[str] = []
    after = 0
    for m in _MARK.finditer(text):
        i, c = m.start(), m.group()
        if i < after:
            continue  # inside a tag
        before = text[i - 1] if i else "\n"
        if c == "<":
            if t := _TAG.match(text, i):
                after, name = t.end(), (t[2] or "").lower()
                if t[1]:
                    _close(stack, f"</{name}>")
                elif name in _PAIRED and not t[4]:
                    stack.append(f"</{name}>")
            elif _BEGUN.match(text, i):
                return stack + [">"]
        elif c == '"':
            if stack and stack[-1] in ('"', "”"):
                if before != "\n":
                    stack.pop()
            elif not before.isdigit():
                stack.append('"')
        elif c in _OPENERS:
            if not (c == "“" and stack and stack[-1] == "”" and before == "\n") and not (c == "(" and before in ":;=" and text[i + 1 : i + 2].strip() == ""):
                stack.append(_OPENERS[c])
        elif c == "”" and stack and stack[-1] == '"':
            stack.pop()
        else:
            _close(stack, c)
    return stack


def _close(stack: list[str], c: str) -> None:
    """Takes what c closes off the stack, and what was opened within and never closed."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] == c:
            del stack[k:]
            return


def report_ending(lines: list[str], entry_ends: frozenset[str]) -> int:
    """WHOLE, MISSING or BROKEN, of the lines of a report: what is still open at its end comes before how it ends."""
    return BROKEN if unclosed("\n".join(lines)) else ending(lines[-1], entry_ends)


def ending(line: str, entry_ends: frozenset[str]) -> int:
    """WHOLE, MISSING (no terminator) or BROKEN, of the last line of a report."""
    s = line.translate(pages._ODD).rstrip()
    tag = s.rfind("<")
    if _BROKEN.search(s, max(0, len(s) - 12)) or (tag >= 0 and ">" not in s[tag:] and _BEGUN.match(s, tag)):
        return BROKEN
    if _QUOTED.search(s[-12:]) and not s.endswith("]") and not unclosed(s):
        return WHOLE  # the ellipsis is part of what is quoted
    if _CUT.search(s[-80:]):
        return BROKEN
    for _ in range(2):
        if pages._END.search(s[-8:]):
            return WHOLE if s.endswith(("!", "?", ".")) or not unclosed(s) else BROKEN
        cut = s[:-60] + pages._SIGNOFF.sub("", s[-60:]).rstrip()
        if cut == s or not cut:
            break
        if _ENTRY.match(cut) and _last(cut) in entry_ends:
            return WHOLE
        if not pages._END.search(cut):
            break
        s = cut
    if _ENTRY.match(s) or pages.labelled(s):
        return WHOLE if _last(s) in entry_ends else MISSING
    return MISSING


def _last(s: str) -> str:
    words = pages._WORD.findall(s.lower())
    return words[-1] if words else ""


#: A word ends entries as a rule if one in so many of all entries of the table ends in it, and so many entries at least.
ENTRIES, LEAST = 250, 5


def _entry_words(content: str) -> Counter:
    """The words that entries of bulleted lists end in; numbered lines are mostly other stories."""
    n = Counter()
    for x in content.split("\n"):
        if pages._BULLET.match(x.strip()) or pages.labelled(x):
            n[_last(pages._SIGNOFF.sub("", x))] += 1
    return n


def entry_ends(articles: DataFrame) -> frozenset[str]:
    """The words that entries of lists end in, of all articles: summed where the rows lie, then by word; at most `ENTRIES` come out."""

    def run(batches):
        n = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                n.update(_entry_words(x))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    held = spread(articles.select("id", "content"), "id").where(F.col("content").isNotNull()).select("content")
    n = staged(held.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "entry-words")
    total = n.agg(F.sum("n")).first()[0] or 0
    return frozenset(r[0] for r in n.where((F.col("n") >= LEAST) & (F.col("n") * ENTRIES >= total)).select("word").collect())


def endings(articles: DataFrame, sample: int = residue.SAMPLE) -> DataFrame:
    """(article_id, source_key, ending) of the articles that have a report."""
    rows = residue._sampled(articles, sample)
    ends, model = entry_ends(articles), residue.ResidueModel.fit(*residue._training(rows)[:3])

    def each(chunk):
        ids, sources, marks = [], [], []
        for a in chunk:
            own = [x for x, m in zip(a.lines, a.marks) if m == pages.REPORT and x.strip()]
            if own and not a.residue:
                ids.append(a.id), sources.append(a.source), marks.append(report_ending(own, ends))
        return [ids, sources, marks]

    schema = pa.schema([("article_id", pa.int64()), ("source", pa.string()), ("ending", pa.int32())])
    out = article_pass.mapped(articles, "article_id long, source string, ending int", schema, each, model, article_pass.recurring(articles))
    return out.select("article_id", F.coalesce(letters_only(F.col("source")), F.lit("")).alias("source_key"), "ending")


def _judged(articles: DataFrame, baseline: float) -> DataFrame:
    e = staged(endings(articles), "endings")
    base = e.groupBy("source_key").agg(F.avg((F.col("ending") == MISSING).cast("double")).alias("missing"))
    return e.join(base, "source_key").withColumn("cut", (F.col("ending") == BROKEN) | ((F.col("ending") == MISSING) & (F.col("missing") < baseline)))


def found(articles: DataFrame, baseline: float = 0.5) -> DataFrame:
    """p5_found: (article_id) of the articles whose content breaks off."""
    return _judged(articles, baseline).where("cut").select("article_id")


def shares(articles: DataFrame, baseline: float = 0.5) -> DataFrame:
    """(source_key, articles, cut, share): how often each source truncates."""
    g = _judged(articles, baseline).groupBy("source_key").agg(F.count("*").alias("articles"), F.sum(F.col("cut").cast("long")).alias("cut"))
    return g.withColumn("share", F.round(F.col("cut") / F.col("articles"), 6))
