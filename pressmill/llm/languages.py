"""Language of documents and of their mixed-language passages (problem 3).

Script ranges narrow the candidates of a word: a word of another script leaves only
that script's language. Among the languages written in Latin letters, each word has
a score per language, the log of its relative frequency there over the mean of all.
A Viterbi path over all words of a document, title first, with a penalty for each
switch, labels its passages: a short line that any of several languages could have
goes with its neighbours. A document is written in a language if a passage of at
least `min_span` words (or the better part of the lines it touches, of `LEAST_WORDS`
words or more; or all of a shorter document) is. Words that sentences of all
languages share (names, loan words) score about nothing in any, so they change no
label. Passages come out line by line (`passages`), with their confidence.

The scores are learned from a bounded sample: documents are labelled by function
words first, their words counted, each sentence labelled by the counts, and the
words counted again. Paths of all documents of a batch are found at once, word by
word, in NumPy; no path is ever cut.

Defined results: a text without known words has no language; NULL and empty
texts have none.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm import article_pass
from pressmill.llm import page_lines as pages
from pressmill.llm import residue
from pressmill.llm.tokens import Tokens, Vocabulary

#: The languages, with words that hold sentences together in each and in few of the others.
SEEDS = {
    "en": "the of and to for was were that with from by is are had have has on at who which their they will would been not but as before after over",
    "tl": "ng ay hindi ayon sinabi upang dahil habang kaysa noong ani bago matapos subalit ngunit rin ito sila niya namin natin lahat wala walang bakit nagtipon tumaas",
    "ceb": "og ug nga dili apan aron alang gikan niadtong sulod dunay matod miingon gihapon nganong ilang atubangan samtang kini ka mi wala walay dayon dugay tanan usab gihangyo unsay",
    "ilo": "ti iti dagiti kadagiti idiay ken no saan ngem tapno daytoy pay laeng kinuna gapu uray idi bayat sakbay apay kalpasan awan amin",
    "es": "el la los las de del que un una por para con se su no al lo como pero sin según desde tras este esta porque hubo fue dijo más",
}
LANGS = tuple(SEEDS)
#: Documents of the sample that the scores are learned from, about.
LEARNED_FROM = 5_000
#: Words of a passage at least, unless the document has no more.
LEAST_WORDS = 4
#: Other spellings of the codes.
SPELLINGS = {"eng": "en", "english": "en", "fil": "tl", "tgl": "tl", "tagalog": "tl", "filipino": "tl", "cebuano": "ceb", "bisaya": "ceb", "iloko": "ilo", "ilocano": "ilo", "ilokano": "ilo", "spa": "es", "spanish": "es", "espanol": "es", "español": "es"}
#: Scripts other than Latin, the languages they leave as candidates, first code point, last.
SCRIPTS = [("el", 0x370, 0x3FF), ("ru", 0x400, 0x4FF), ("he", 0x590, 0x5FF), ("ar", 0x600, 0x6FF), ("hi", 0x900, 0x97F), ("th", 0xE00, 0xE7F), ("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("ko", 0xAC00, 0xD7AF)]
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»']?\s+")


def normal_code(label: str | None) -> str | None:
    """The code a label stands for; None for a missing one (NULL, blank, "und")."""
    s = re.split(r"[-_\s]", (label or "").strip().lower())[0]
    s = SPELLINGS.get(s, s)
    return None if s in ("", "und", "unknown", "none", "null", "mis", "zxx") else s


def script_of(word: str) -> str | None:
    """The only candidate a word of another script leaves; None for Latin letters."""
    c = ord(word[0])
    if c < 0x370:
        return None
    return next((lang for lang, lo, hi in SCRIPTS if lo <= c <= hi), None)


#: All labels of a path: the languages, then those that a script alone leaves.
LABELS = (*LANGS, *(x for x, _, _ in SCRIPTS))
#: The score of a word in the only language it can be of, and less that in all others.
CERTAIN = 4.0


class WordScores:
    """Word -> row of a matrix of scores by label; the last rows are those of unknown words and of each script's."""

    def __init__(self, rows: dict[str, int], matrix: np.ndarray):
        """matrix: scores of the known words by language, then a row of zeros for unknown ones."""
        self.rows, self.none = rows, len(matrix) - 1
        n = len(SCRIPTS)
        latin = np.hstack([matrix, np.full((len(matrix), n), -CERTAIN, np.float32)])
        script = np.full((n, len(LABELS)), -CERTAIN, np.float32)
        script[np.arange(n), len(LANGS) + np.arange(n)] = CERTAIN
        self.matrix = np.vstack([latin, script]).astype(np.float32)
        self.latin = np.ascontiguousarray(self.matrix[:, : len(LANGS)])

    def row(self, word: str) -> int:
        k = self.rows.get(word)
        if k is None:
            s = script_of(word)
            k = self.none if s is None else self.none + 1 + next(i for i, x in enumerate(SCRIPTS) if x[0] == s)
        return k

    @classmethod
    def fit(cls, documents: list[list[list[str]]], rounds: int = 2, least: int = 3) -> WordScores:
        """documents: each a list of sentences, a sentence a list of words."""
        seeds = [frozenset(SEEDS[x].split()) for x in LANGS]
        sentences, labels = [], []
        for d in documents:
            hits = [sum(w in s for words in d for w in words) for s in seeds]
            top = max(hits)
            k = hits.index(top) if top >= 3 and sorted(hits)[-2] * 2 < top else None
            sentences += d
            labels += [k] * len(d)
        scores = cls({}, np.zeros((1, len(LANGS)), np.float32))
        for _ in range(rounds):
            counts = [Counter() for _ in LANGS]
            for words, k in zip(sentences, labels):
                if k is not None:
                    counts[k].update(words)
            known = sorted(w for w, n in sum(counts, Counter()).items() if n >= least)
            totals = [sum(c.values()) + 1.0 for c in counts]
            table = np.array([[(c[w] + 0.02) / t for c, t in zip(counts, totals)] for w in known]).reshape(-1, len(LANGS))
            # a language with few words must not look sure of each
            table = np.log(table + 2e-5)
            table -= table.mean(axis=1, keepdims=True)
            matrix = np.vstack([np.clip(table, -4, 4), np.zeros((1, len(LANGS)))]).astype(np.float32)
            scores = cls({w: i for i, w in enumerate(known)}, matrix)
            labels = [scores._best(words) for words in sentences]
        return scores

    def _best(self, words: list[str]) -> int | None:
        z = self.matrix[[self.rows.get(w, self.none) for w in words], : len(LANGS)].sum(axis=0) if words else np.zeros(len(LANGS))
        order = np.sort(z)
        return int(z.argmax()) if order[-1] - order[-2] > 3 else None


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of each sequence; scores are those of all sequences one after the other."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    n, k = scores.shape
    back = np.empty((n, k), np.int8)
    own = np.arange(k, dtype=np.int8)[None, :]
    value = np.zeros((len(lengths), k), np.float32)
    most = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, most + 1), side="right")
    for t in range(most):
        a = active[t]
        idx = starts[:a] + t
        v = value[:a]
        if t:
            arg = v.argmax(axis=1)
            best = v[np.arange(a), arg][:, None] - penalty
            switch = best > v
            back[idx] = np.where(switch, arg[:, None].astype(np.int8), own)
            v = np.where(switch, best, v)
        v = v + scores[idx]
        value[:a] = v if t % 64 else v - v.max(axis=1, keepdims=True)  # sums of very long texts stay small
    path = np.zeros(n, np.int8)
    state = value.argmax(axis=1).astype(np.int8) if len(lengths) else np.zeros(0, np.int8)
    for t in range(most - 1, -1, -1):
        a = active[t]
        idx = starts[:a] + t
        path[idx] = state[:a]
        if t:
            state[:a] = back[idx, state[:a]]
    return path


def passages(rows: np.ndarray, line: np.ndarray, doc: np.ndarray, model: WordScores, penalty: float = 6.0, min_span: int = 5, min_margin: float = 0.35, whole_margin: float = 0.2) -> dict[str, np.ndarray]:
    """The passages of documents, cut at the ends of lines: arrays doc, line, first, last (words of the line, from 1), lang (number of its label), confidence.

    rows, line and doc are those of each word, in order. A passage that is the whole document, or stands over whole lines,
    needs less of a margin than one within a line, which may be a name.
    """
    none = {k: np.zeros(0, np.int64) for k in ("doc", "line", "first", "last", "lang", "confidence")}
    if not len(rows):
        return none
    other = np.zeros(int(doc[-1]) + 1, bool)
    other[doc[rows > model.none]] = True
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    sizes = np.diff(np.r_[np.flatnonzero(new_doc), len(rows)])
    if not other.any():  # as a rule
        scores = model.latin[rows]
        path = viterbi(scores, sizes, penalty)
    else:
        scores = model.matrix[rows]
        odd, of = other[doc], other[doc[new_doc]]
        path = np.empty(len(rows), np.int8)
        path[~odd] = viterbi(scores[~odd, : len(LANGS)], sizes[~of], penalty)
        path[odd] = viterbi(scores[odd], sizes[of], penalty)
    new_line = new_doc | np.r_[True, line[1:] != line[:-1]]
    n = len(rows)
    # islands: words in a row of one document and label
    edge = np.flatnonzero(new_doc | np.r_[True, path[1:] != path[:-1]])
    size, lang = np.diff(np.r_[edge, n]), path[edge].astype(np.int64)
    total = np.add.reduceat(scores, edge, axis=0)
    at = np.arange(len(edge))
    mine = total[at, lang]
    total[at, lang] = -np.inf
    margin = (mine - total.max(axis=1)) / size
    held = np.minimum(size, 8)
    line_begins = np.flatnonzero(new_line)
    line_ends = np.r_[line_begins[1:], n]
    of_line = np.cumsum(new_line) - 1
    begin, end = line_begins[of_line[edge]], line_ends[of_line[edge + size - 1]]
    whole = size == end - begin
    doc_size = sizes[np.cumsum(new_doc)[edge] - 1]
    enough = (size >= min_span) | ((2 * size >= end - begin) & (size >= LEAST_WORDS)) | (2 * size >= doc_size) & (doc_size < 2 * LEAST_WORDS)
    keep = enough & (margin * held >= 8 * np.where(whole, whole_margin, min_margin))
    sure = 1 / (1 + np.exp(-np.clip(2 * margin * np.sqrt(held), -30, 30)))
    # passages: islands cut at the ends of lines
    new_line[edge] = True
    cut = np.flatnonzero(new_line)
    island = np.searchsorted(edge, cut, side="right") - 1
    cut_size = np.diff(np.r_[cut, n])
    k = keep[island]
    first = cut - line_begins[of_line[cut]] + 1
    return {"doc": doc[cut][k], "line": line[cut][k], "first": first[k], "last": (first + cut_size - 1)[k], "lang": lang[island][k], "confidence": sure[island][k]}


def segments(texts: list[str], model: WordScores, **params) -> list[list[tuple[str, int, float]]]:
    """For each text its passages: (language, words in it, confidence)."""
    t = Tokens([(x or "").split("\n") for x in texts], Vocabulary(model.row))
    doc = np.searchsorted(t.first, t.line, side="right") - 1
    p = passages(t.row[t.word], t.line[t.word], doc[t.word], model, **params)
    out: list[list[tuple[str, int, float]]] = [[] for _ in texts]
    for i, k, a, b, c in zip(*(p[x].tolist() for x in ("doc", "lang", "first", "last", "confidence"))):
        out[i].append((LABELS[k], b - a + 1, c))
    return out


def fit(rows: list[tuple]) -> WordScores:
    """The scores learned from sampled rows of (id, source, title, content)."""
    documents = []
    for _, _, title, content in rows:
        lines = content.split("\n") if content else []
        own = [x for x, m in zip(lines, pages.label(lines, title)) if m == pages.REPORT]
        documents.append([w for x in [title or "", *own] for s in _SENTENCE.split(x) if (w := _WORD.findall(s.lower()))])
    return WordScores.fit(documents)


def _labelled(articles: DataFrame, sample: int, columns: str, each) -> DataFrame:
    rows = residue._sampled(articles, sample)
    scores, model = fit(rows[:: max(1, len(rows) // LEARNED_FROM)]), residue.ResidueModel.fit(*residue._training(rows)[:3])

    def labels(chunk: article_pass.Chunk) -> list:
        t = chunk.tokens
        own = np.zeros(int(t.first[-1]) + 1, bool)
        for k, a in enumerate(chunk):
            if not a.residue:
                at = int(t.first[k])
                own[at] = True
                own[at + 1 : at + 1 + len(a.marks)] = np.array(a.marks, np.int8) == pages.REPORT
        keep = t.word & own[t.line]
        line = t.line[keep]
        doc = np.searchsorted(t.first, line, side="right") - 1
        p = passages(t.row[keep], line, doc, scores)
        ids = np.array([a.id for a in chunk], np.int64)
        return each(p | {"id": ids[p["doc"]], "line_no": p["line"] - t.first[p["doc"]]})

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in columns.split(", "))])
    return article_pass.mapped(articles, columns, schema, labels, model, article_pass.recurring(articles), scores.row)


_NAMES = np.array(LABELS, object)


def segments_of(articles: DataFrame, sample: int = residue.SAMPLE) -> DataFrame:
    """(article_id, line_no, first_word, last_word, lang, confidence): the passages of each article; line 0 is its title, words count from 1."""
    return _labelled(articles, sample, "article_id long, line_no int, first_word int, last_word int, lang string, confidence double",
                     lambda p: [p["id"], p["line_no"].astype(np.int32), p["first"].astype(np.int32), p["last"].astype(np.int32), _NAMES[p["lang"].astype(np.int64)], p["confidence"]])


def languages(articles: DataFrame, sample: int = residue.SAMPLE) -> DataFrame:
    """(article_id, lang, words, confidence) of the title and the report's own lines; none for contents that are no report."""

    def each(p: dict) -> list:
        n = p["last"] - p["first"] + 1
        key, at = np.unique(p["doc"] * len(LABELS) + p["lang"], return_index=True)
        place = np.searchsorted(key, p["doc"] * len(LABELS) + p["lang"])
        words = np.bincount(place, weights=n, minlength=len(key))
        sure = np.bincount(place, weights=n * p["confidence"], minlength=len(key))
        return [p["id"][at], _NAMES[p["lang"][at].astype(np.int64)], words.astype(np.int64), sure / np.maximum(words, 1)]

    return _labelled(articles, sample, "article_id long, lang string, words long, confidence double", each)


def found(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """p3_found: (article_id, lang) of the articles whose label is missing or wrong, or that are in several languages."""
    # copies of a row count once: an article has at most as many rows as there are languages
    spoken = languages(articles).groupBy("article_id").agg(F.collect_set("lang").alias("langs"))
    code = F.lower(F.regexp_extract(F.trim("lang"), r"^([^-_\s]*)", 1))
    pairs = [F.lit(x) for kv in SPELLINGS.items() for x in kv]
    given = labels.select("article_id", F.coalesce(F.try_element_at(F.create_map(*pairs), code), code).alias("given"))
    j = spoken.join(given, "article_id", "left")
    wrong = F.col("given").isNull() | F.col("given").isin("", "und") | ~F.array_contains("langs", F.col("given")) | (F.size("langs") > 1)
    return j.where(wrong).select("article_id", F.explode("langs").alias("lang"))
