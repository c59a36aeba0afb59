"""Template residue, filler and error pages in place of a report (problem 6).

A regularized logistic regression over hashed one- and two-word n-grams, length
and title features. Its labels are weak: wording of response statuses, browser
notices, unfilled placeholders and filler makes a page positive if nothing but
such lines and furniture is there; lines of running prose make it negative.
Beginnings of negative pages, cut anywhere, are negatives too, so that a short
text isn't suspect for being short. It is fitted on a bounded sample of rows
(`SAMPLE`), one in so many by a hash of the id, and measured on hosts that it
hasn't seen (`validation`); every row is then scored, whole.

Defined results: NULL and blank contents are never cases; a page without any
letters is scored by its other marks.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm import page_lines as pages
from pressmill.llm.page_lines import _FURN, _HEADER, _ITEM, _OPEN, _POINTER, _PROSE
from pressmill.llm.tokens import Tokens, Vocabulary

#: Rows of the training sample, about.
SAMPLE = 12_000
#: Longer texts are left out of the sample (never of the scoring), so that its size is bounded in bytes too.
SAMPLE_CHARS = 20_000
#: Negative pages among them that the fit uses, about.
NEGATIVES = 4_000
BITS = 16
_SIZE = 1 << BITS
_EXTRA = 64  # weights kept for length and title features

# Wording of responses and of what templates leave behind.
_WEAK = (
    r"\{\{.*?\}\}|\{\{|\{%|<%|%%\w+%%|\$\{|\[\[\w+\]\]|\{[a-z_]+\}.*\{[a-z_]+\}|\[(?:insert|reporter|publication|link|headline|name|date|photo|caption)\b[^\]]*\]|\btk(?:tk)+\b|^tk\b|\blorem\b|\bipsum\b|dummy (?:copy|text)|(?:text|copy|content|story) goes here|sample (?:paragraph|text)|placeholder|type your (?:story|text)|^(?:asdf|qwer|x{3,})|(?:headline ){2}"
    r"|^(?:undefined|null|nan|none|loading)\b[\s.]*(?:undefined|null|nan)?$|\[object object\]|\b(?:http )?(?:error )?[45]\d\d\b.{0,30}(?:error|not found|forbidden|unavailable|gateway|time-?out|bad request|too many)|(?:error|http)\s*[:#]?\s*[45]\d\d|access denied|permission to view|fatal error|uncaught|traceback|^\s*at \w[\w.]* \(.*\)|warning: \w+\(|\"error\"\s*:|database connection|tablespace|too many connections"
    r"|javascript|scripts? (?:enabled|to read|in your browser)|without scripts|checking your browser|complete the check|enable cookies|are you (?:a )?(?:human|robot)|request has been blocked|unusual traffic|under maintenance|down for maintenance|being upgraded|domain has expired|page you are looking for|could not find that|nothing was found|link is broken|server is too busy|try again (?:in|later)|^oops|have been blocked|^forbidden\b|verifying that you|too many requests|maintenance in progress|incident id|^\(?(?:session |ray id:? ?|trace:? ?)?[0-9a-f]{6,}\)?$"
    r"|hindi makita ang pahina|may problema sa server|wala makit-i ang panid|saan a nasarakan|p[áa]gina no encontrada|servicio no disponible|buksan ang javascript|habilit[ae] javascript"
)
_WEAK_FIRST = re.compile("|".join(a for a in pages._alternatives(_WEAK) if a.startswith("^")))
_WEAK_ANYWHERE = re.compile("|".join(a for a in pages._alternatives(_WEAK) if not a.startswith("^")))

_weak_memo: dict[str, bool] = {}


def _weak(line: str) -> bool:
    """Whether a line's wording is that of a response or a template; lines that aren't long, which recur, are remembered."""
    k = _weak_memo.get(line)
    if k is None:
        low = line.lower()
        k = bool(_WEAK_FIRST.match(low) or _WEAK_ANYWHERE.search(low))
        if len(line) <= 400:
            if len(_weak_memo) > 300_000:
                _weak_memo.clear()
            _weak_memo[line] = k
    return k


class Body(list):
    """The lines of a page that are neither blank, nor furniture by their wording, nor the headline; `prose` counts those of running prose, `at` has their places."""

    prose = 0

    def __init__(self, lines=(), at=None):
        super().__init__(lines)
        self.at = list(range(len(self))) if at is None else at


def body(lines: list[str], title: str | None, kinds: list[int] | None = None) -> Body:
    own = (title or "").strip().lower()
    size = len(own)
    out, widget = Body(), False
    for n, (x, k) in enumerate(zip(lines, [pages.kind(x) for x in lines] if kinds is None else kinds)):
        s = x if k == _PROSE else x.strip()
        if not s or (size <= len(s) <= size + 16 and s.strip().lower() == own):
            continue
        if k == _PROSE:
            widget = False
            out.prose += len(s) > 60
        elif k == _HEADER:
            widget = True
            continue
        elif k == _ITEM:
            widget = False
        elif (k == _FURN or k == _POINTER or (widget and k == _OPEN)) and not _weak(s):
            continue
        out.append(s)
        out.at.append(n)
    return out


def _prose(tokens: list[str]) -> bool:
    """Running prose: eight words or more, two different ones among them that hold sentences together."""
    return len(tokens) >= 8 and len(pages.FUNCTION.intersection(tokens)) >= 2


def weak_label(lines: list[str]) -> int | None:
    """1, 0 or None (can't say) for the body of a page."""
    words, rest, residue = 0, [], False
    for x in lines:
        tokens = pages._WORD.findall(x.lower())
        if _weak(x):
            residue = True
        elif _prose(tokens):
            return 0
        else:
            words += len(tokens)
            rest += tokens
    filler = words >= 8 and not pages.FUNCTION.intersection(rest)
    return 1 if (residue and words < 25) or filler else None


_vocabulary = Vocabulary()


def _indexes(tokens: Tokens, bodies: list[Body], titles: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(feature indexes, page of each), all pages of a batch at once. A body's lines stand in the tokens behind each other or, with `at`, where the page has them."""
    page_of = np.full(int(tokens.first[-1]) + 1, -1, np.int64)
    for k, b in enumerate(bodies):
        page_of[int(tokens.first[k]) + np.array(b.at, np.int64)] = k
    page = page_of[tokens.line]
    keep = page >= 0
    flat, page = tokens.hash[keep], page[keep]
    lengths = np.bincount(page, minlength=len(bodies))
    follow = np.full_like(flat, 7)
    if len(flat):
        same = page[1:] == page[:-1]
        follow[:-1][same] = flat[1:][same]
    uni = flat % (_SIZE - _EXTRA) + _EXTRA
    bi = (flat * 1_000_003 + follow * 31 + 5) % (_SIZE - _EXTRA) + _EXTRA
    extra = []
    for n, b, t in zip(lengths.tolist(), bodies, titles):
        first = b[0].lower() if b else ""
        extra.append([min(n.bit_length(), 15), 16 + min(b.prose, 7), 24 + min(len(b), 15), 40 + any(len(w) > 4 and w in first for w in (t or "").lower().split())])
    return np.concatenate([uni, bi, np.array(extra, np.int64).ravel()]), np.concatenate([page, page, np.repeat(np.arange(len(bodies)), 4)])


def _alone(bodies: list[Body]) -> tuple[Tokens, list[Body]]:
    """The tokens of bodies without their pages."""
    out = []
    for b in bodies:
        c = Body(b)
        c.prose = b.prose
        out.append(c)
    return Tokens(list(map(list, bodies)), _vocabulary), out


class ResidueModel:
    """Weights over hashed features; a page's features are weighed by one over the root of their number."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, bodies: list[Body], titles: list[str | None], tokens: Tokens | None = None) -> np.ndarray:
        """The probability of each page to be residue. tokens: those of the pages that the bodies were taken from, if known."""
        if not bodies:
            return np.zeros(0)
        if tokens is None:
            tokens, bodies = _alone(bodies)
        idx, owner = _indexes(tokens, bodies, titles)
        n = np.bincount(owner, minlength=len(bodies))
        z = np.bincount(owner, weights=self.weights[idx], minlength=len(bodies)) / np.sqrt(np.maximum(n, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, bodies: list[list[str]], titles: list[str | None], labels: list[int], l2: float = 1e-6, steps: int = 120, rate: float = 0.05) -> ResidueModel:
        if not bodies:
            return cls(np.zeros(_SIZE, np.float32), -5.0)
        idx, owner = _indexes(*_alone(bodies), titles)
        y = np.array(labels, float)
        n = len(bodies)
        value = 1 / np.sqrt(np.bincount(owner, minlength=n))[owner]
        # both classes weigh the same
        cost = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * n
        # Adam: a feature that few pages have moves as far as one that many have
        w, m1, m2 = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)
        for t in range(1, steps + 1):
            z = np.bincount(owner, weights=w[idx] * value, minlength=n) + w[-1]
            g = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            grad = np.append(np.bincount(idx, weights=g[owner] * value, minlength=_SIZE), g.sum()) + l2 * w
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.999 * m2 + 0.001 * grad * grad
            w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w[:-1], w[-1]
        return cls(w.astype(np.float32), float(b))


def _sampled(articles: DataFrame, sample: int) -> list[tuple]:
    total = max(1, articles.count())
    every = max(1, total // sample)
    rows = articles.where((F.length("content") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0))
    return [tuple(r) for r in rows.select("id", "source", "title", "content").collect()]  # about `sample` rows


def _training(rows: list[tuple]) -> tuple[list, list, list, list]:
    bodies, titles, labels, hosts = [], [], [], []
    negatives, each = 0, max(1, len(rows) // NEGATIVES)
    for i, source, title, content in rows:
        lines = content.split("\n")
        b = body(lines, title)
        y = weak_label(b)
        if not b or y is None:
            continue
        if y == 0:
            negatives += 1
            if negatives % each:
                continue
        host = re.sub(r"[\W\d_]+", "", (source or "").lower())
        bodies.append(b), titles.append(title), labels.append(y), hosts.append(host)
        if y == 0:  # the same text, broken off early
            k = 1 + zlib.crc32(str(i).encode()) % 90
            bodies.append(body([b[0][:k]], None)), titles.append(title), labels.append(0), hosts.append(host)
        elif len(b) > 1:  # each of its lines alone
            for x in b:
                bodies.append(Body([x])), titles.append(title), labels.append(1), hosts.append(host)
    return bodies, titles, labels, hosts


def train(articles: DataFrame, sample: int = SAMPLE) -> ResidueModel:
    """The model of a table of (id, source, title, content)."""
    b, t, y, _ = _training(_sampled(articles, sample))
    return ResidueModel.fit(b, t, y)


def validation(articles: DataFrame, sample: int = SAMPLE, held_out: float = 0.3) -> DataFrame:
    """(pages, positives, accuracy, precision, recall) on hosts left out of the fit."""
    b, t, y, h = _training(_sampled(articles, sample))
    out = [zlib.crc32(x.encode()) % 100 < 100 * held_out for x in h]
    pick = lambda a, k: [x for x, o in zip(a, out) if o == k]
    m = ResidueModel.fit(pick(b, False), pick(t, False), pick(y, False))
    truth, said = np.array(pick(y, True), bool), m.scores(pick(b, True), pick(t, True)) > 0.5
    tp = int((truth & said).sum())
    row = (len(truth), int(truth.sum()), float((truth == said).mean()) if len(truth) else None, tp / max(1, int(said.sum())), tp / max(1, int(truth.sum())))
    return articles.sparkSession.createDataFrame([row], "pages long, positives long, accuracy double, precision double, recall double")
