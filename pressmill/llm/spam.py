"""Keyword-stuffed and link-list pages (problem 10).

A page is read line by line. Lines without clause structure (hardly any of the
words that hold sentences together) that report nothing (no counts) are keyword
lists; lines of links, product tags and hashtags are known by their marks. For the
rest, and to tell repetition from variety, a suffix automaton is built over the
page's words, function words and numbers ending a string: the characters covered by
maximal substrings that occur often enough for their length. (A phrase of `PHRASE`
words must occur `least` times, a longer one fewer times in proportion, `LEAST` at
least; so coverage is more than counts of neighbouring words could tell.) A line
that phrases of the page's own repertoire cover to a good part is stuffed, sentence
or not. A page is spam if such lines are the greater part of its characters.

The automaton is left out only where it can't matter: where no line has enough
words that occur `LEAST` times, all of them together, to be stuffed; and, where only
the verdict at a threshold is asked for (`found`), on pages that can't reach it. It
holds some 0.5 KB a word of the page at hand, whatever the number of pages.

Defined results: NULL and blank texts are no spam; copies are judged alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from pressmill.llm.page_lines import FUNCTION
from pressmill.session import spread

_TOKEN = re.compile(r"\w+(?:['’]\w+)?")
_LINK = re.compile(r"(?:https?://|www\.)\S+|<a\s[^>]*>.*?</a>|\[[^\]]*\]\([^)]*\)", re.IGNORECASE)
_CITED = re.compile(r"^\s*(?:\d{1,3}[.)]|\[\d{1,3}\]|[-*•])\s+\S.*[,:;.]\s*(?:https?://|www\.)", re.IGNORECASE)
_PRODUCT = re.compile(r"\bsku\b|\btags?:|\bbuy now\b|\badd to cart\b|\bin stock\b|(?:[₱$€]|\bp)\d[\d,.]*\s+\w*-?\d{3,}", re.IGNORECASE)
_HASH = re.compile(r"#\w+")

#: Occurrences that make a phrase repeated at least; words of a phrase at least; share of a line's characters that stuffs it.
LEAST, PHRASE, STUFFED = 4, 2, 0.30


def occurrences_wanted(words: int) -> int:
    """How often a phrase of PHRASE words must occur on a page of so many: as their root, since names recur in any long text."""
    return max(LEAST, math.isqrt(words) // 3)


class SuffixAutomaton:
    """Over strings of words; counts how often each substring occurs."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, last: int, w) -> int:
        """One more word after state `last` (0 to begin a string); the new state."""
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # another string went this way before
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                self.count[q] += 1
                return q
            clone = self._clone(last, w, q)
            self.count[clone] += 1
            return clone
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.count.append(1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone


def covered(strings: list[list[str]], least: int, phrase: int, floor: int | None = None) -> list[list[bool]]:
    """For each word of each string, whether a maximal substring of n >= `phrase` words covers it that occurs `least` times; with a floor, least * phrase / n times, `floor` at least."""
    sam, ends = SuffixAutomaton(), []
    for s in strings:
        state, path = 0, []
        for w in s:
            state = sam.add(state, w)
            path.append(state)
        ends.append(path)
    order = sorted(range(1, len(sam.next)), key=sam.length.__getitem__)
    count, link, length = sam.count, sam.link, sam.length
    for v in reversed(order):
        count[link[v]] += count[v]
    # the longest suffix of each state that occurs often enough: of the substrings of one state, which occur alike, the longest
    top = [0] * len(sam.next)
    for v in order:
        n = length[v]
        wanted = least if floor is None else max(floor, -(-least * phrase // n))
        top[v] = n if n >= phrase and count[v] >= wanted else top[link[v]]
    out = []
    for path in ends:
        marks = [False] * len(path)
        done = len(path)
        for i in range(len(path) - 1, -1, -1):
            n = top[path[i]]
            if n >= phrase:
                for j in range(i - n + 1, min(i + 1, done)):
                    marks[j] = True
                done = min(done, i - n + 1)
        out.append(marks)
    return out


def _strings(tokens: list[str]) -> list[list[int]]:
    """Places of the words between function words and numbers."""
    out, cur = [], []
    for k, t in enumerate(tokens):
        if t in FUNCTION or t[0].isdigit() or len(t) < 2:
            if cur:
                out.append(cur)
                cur = []
        else:
            cur.append(k)
    if cur:
        out.append(cur)
    return out


def spam_share(text: str | None, threshold: float | None = None) -> float:
    """The share of a text's characters that are there for search only.

    With a threshold only whether the share exceeds it is sure: a page that can't is not read to the end.
    """
    if not text or not text.strip():
        return 0.0
    total = spam = 0
    rest: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        size = len(line.strip())
        if not size:
            continue
        total += size
        low = line.lower()
        links = sum(m.end() - m.start() for m in _LINK.finditer(line)) if "http" in low or "www." in low or "](" in low else 0
        if links:
            cited = _CITED.match(line)
            if cited or links * 5 >= size:
                spam += links if cited else size
                continue
            spam += links  # what stands around the links is judged as any line
            line = _LINK.sub(" ", line)
            low, size = line.lower(), size - links
        tags = _HASH.findall(line) if "#" in line else []
        if len(tags) >= 3 and sum(map(len, tags)) * 2 > size:
            spam += size
            continue
        tokens = _TOKEN.findall(low)
        if not tokens:
            continue
        if _PRODUCT.search(line) and sum(t in FUNCTION for t in tokens) * 8 < len(tokens):
            spam += size
            continue
        rest.append((size, tokens))
    if threshold is not None and (spam + sum(n for n, _ in rest)) / total <= threshold:
        return spam / total
    words = Counter(t for _, ts in rest for t in ts)
    least = occurrences_wanted(sum(words.values()))
    # upper bound: the characters of all words that occur often enough to be part of a repeated phrase
    bound = 0
    lines = []
    for size, ts in rest:
        frequent = sum(len(t) + 1 for t in ts if words[t] >= LEAST and t not in FUNCTION and not t[0].isdigit())
        held = sum(t in FUNCTION for t in ts)
        is_loose = held * 8 < len(ts)
        lines.append((size, ts, is_loose, frequent))
        if is_loose or frequent >= STUFFED * size:
            bound += size
    if threshold is not None and (spam + bound) / total <= threshold:
        return spam / total
    strings, place = [], []
    if any(frequent >= STUFFED * size for size, _, _, frequent in lines):
        for k, (_, ts, _, _) in enumerate(lines):
            for s in _strings(ts):
                strings.append([ts[i] for i in s])
                place.append(k)
    cover = [0] * len(lines)
    for s, marks, k in zip(strings, covered(strings, least, PHRASE, LEAST), place):
        cover[k] += sum(len(w) + 1 for w, m in zip(s, marks) if m)
    for (size, ts, is_loose, _), c in zip(lines, cover):
        share = c / size
        if is_loose:
            # no clause: a list of keywords unless it reports counts (different numbers) or is a short line of its own
            reports = len({t for t in ts if t[0].isdigit()}) * 8 >= len(ts)
            if not reports and (share >= STUFFED or len(ts) >= 20):
                spam += size
        elif share >= STUFFED:
            spam += size
    return spam / total


def _scored(documents: DataFrame, schema: str, keep, threshold: float | None = None):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = keep(ids, [spam_share(t, threshold) for t in texts])
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=[x.split()[0] for x in schema.split(", ")])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, schema)


def found(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """p10_found: (doc_id) of the documents the greater part of which is spam."""
    return _scored(documents, "doc_id long", lambda ids, s: [[i for i, x in zip(ids, s) if x > threshold]], threshold)


def shares(documents: DataFrame) -> DataFrame:
    """(doc_id, share) of every document."""
    return _scored(documents, "doc_id long, share double", lambda ids, s: [ids, s])
