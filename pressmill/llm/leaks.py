"""Evaluation texts that leaked into a corpus (problem 9).

Items and documents are read as words without case, punctuation, spacing, line
breaks and line-end hyphens. Every window of `width` words (the least run that
counts as a leak) gets a 64-bit SimHash of its word pairs, for all windows of a
document at once. The fingerprints of the items' windows stand in four tables,
one per block of 16 bits: two fingerprints within `RADIUS` bits agree in one
block at least, so looking up each block finds all of them. A candidate is
verified by the weighted similarity of the pairs of both windows, rare pairs
weighing more, and then letter by letter.

Windows that several items have in common stand for none of them. The items' windows
are counted first: up to `MAX_WINDOWS` the documents are read once, in Arrow batches,
without a shuffle. A longer list is searched in several passes, of which each holds
the index of its own items only; which windows items share is then found by a
grouping of all windows.

Defined results: NULL and empty texts, and items shorter than a window, match
nothing; copies of a document are judged alike; an item that stands in the list
twice counts as wording that items share.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.session import spread, staged

WIDTH = 12
RADIUS = 3
SIMILAR = 0.8
MAX_WINDOWS = 2_000_000
#: Words that are fingerprinted at once.
CHUNK = 120_000
_HYPHEN = re.compile(r"[-‐­]\s*\n\s*")
_DASH = re.compile(r"[—–/…]")
_MARK = re.compile(r"[^\w\s]|_")
_hashes: dict[str, int] = {}


def words_of(text: str) -> list[str]:
    return _MARK.sub("", _DASH.sub(" ", _HYPHEN.sub("", text.lower()))).split()


def _hash(word: str) -> int:
    h = _hashes.get(word)
    if h is None:
        if len(_hashes) > 1_000_000:
            _hashes.clear()
        h = _hashes[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """One hash for each two neighbouring words."""
    x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + ((h[1:] << np.uint64(29)) | (h[1:] >> np.uint64(35)))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def fingerprints(pairs: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each window of `width` words, from the hashes of its width - 1 pairs."""
    n = width - 1
    if len(pairs) < n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)
    total, done, power, size = None, 0, bits, 1
    while True:  # sums of 1, 2, 4, ... rows, put together to n
        if n & size:
            part = power[done:]
            total = part if total is None else total[: len(part)] + part[: len(total)]
            done += size
        size *= 2
        if size > n:
            break
        power = power[: len(power) - size // 2] + power[size // 2 :]
    total = total[: len(pairs) - n + 1]
    return np.packbits(total * 2 > n, axis=1).reshape(-1).view(np.uint64)


def window_hash(g: tuple[str, ...]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(g).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class ItemIndex:
    """Windows of the items, their fingerprints in tables by block."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, shared: frozenset[int] = frozenset()):
        """shared: hashes (`window_hash`) of windows that items beyond these have too."""
        self.width = width
        texts = {i: words_of(t) for i, t in items if t}
        owners: dict[tuple, set] = {}
        for i, w in texts.items():
            for j in range(len(w) - width + 1):
                g = tuple(w[j : j + width])
                owners.setdefault(g, set()).add(i)
        self.windows = [(i, g) for g, own in owners.items() if len(own) == 1 and not (shared and window_hash(g) in shared) for i in own]
        pairs = Counter(p for w in texts.values() for p in set(zip(w, w[1:])))
        n = max(1, len(texts))
        self.weight = {p: math.log(1 + n / k) for p, k in pairs.items()}
        self.most = math.log(1 + n)
        flat = np.array([_hash(x) for _, g in self.windows for x in g], np.uint64).reshape(-1, width)
        prints = np.concatenate([fingerprints(pair_hashes(row), width) for row in flat]) if len(flat) else np.zeros(0, np.uint64)
        self.prints = prints
        self.tables = []
        for b in range(4):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.tables.append((np.searchsorted(key[order], np.arange(65537)).astype(np.int32), order))
        self.item = np.array([i for i, _ in self.windows], np.int64)
        # letters of a window, for the last check
        self.squashed = ["".join(g) for _, g in self.windows]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all pairs within RADIUS bits."""
        places, found = [], []
        for b, (start, order) in enumerate(self.tables):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            first, n = start[key], start[key + 1] - start[key]
            at = np.flatnonzero(n)
            if not len(at):
                continue
            n = n[at]
            place = np.repeat(at, n)
            inner = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            window = order[np.repeat(first[at], n) + inner]
            near = np.bitwise_count(prints[place] ^ self.prints[window]) <= RADIUS
            places.append(place[near]), found.append(window[near])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(found)

    def similarity(self, a: tuple, b: tuple) -> float:
        """Weighted share of the word pairs of two windows that both have."""
        x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
        w = lambda c: sum(self.weight.get(p, self.most) * k for p, k in c.items())
        either = w(x | y)
        return w(x & y) / either if either else 0.0

    def verify(self, words: list[str], place: int, window: int) -> bool:
        mine = tuple(words[place : place + self.width])
        item, theirs = self.windows[window]
        if mine == theirs:
            return True
        if self.similarity(mine, theirs) < SIMILAR:
            return False
        return self.squashed[window] in "".join(words[max(0, place - 2) : place + self.width + 3])

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(number of the text, item) of all leaks."""
        out: set[tuple[int, int]] = set()
        todo, size = [], 0
        for k, t in enumerate(texts):
            if t:
                todo.append((k, words_of(t)))
                size += len(todo[-1][1])
            if size >= CHUNK:
                out |= self._search(todo)
                todo, size = [], 0
        return sorted(out | self._search(todo))

    def _search(self, todo: list[tuple[int, list[str]]]) -> set[tuple[int, int]]:
        words = [w for _, ws in todo for w in ws]
        if len(words) < self.width or not len(self.prints):
            return set()
        get = _hashes.get
        hashes = [get(w) or _hash(w) for w in words]
        pairs = pair_hashes(np.array(hashes, np.uint64))
        step = self.width - 2  # pieces of one long text overlap by what a window reaches over
        prints = np.concatenate([fingerprints(pairs[a : a + CHUNK + step], self.width) for a in range(0, max(1, len(pairs) - step), CHUNK)])
        ends = np.cumsum([len(ws) for _, ws in todo])
        out = set()
        places, windows = self.candidates(prints)
        text = np.searchsorted(ends, places, side="right")
        inside = places + self.width <= ends[np.minimum(text, len(ends) - 1)] if len(places) else np.zeros(0, bool)
        for p, w, t in zip(places[inside].tolist(), windows[inside].tolist(), text[inside].tolist()):
            hit = (todo[t][0], int(self.item[w]))
            start = int(ends[t]) - len(todo[t][1])
            if hit not in out and self.verify(todo[t][1], p - start, w):
                out.add(hit)
        return out


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, window): the hashes of each item's windows."""

    def run(batches):
        for b in batches:
            ids, hashes = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(t)
                own = {window_hash(tuple(w[j : j + width])) for j in range(len(w) - width + 1)}
                ids += [i] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], names=["item_id", "window"])

    return items.mapInArrow(run, "item_id long, window long")


def _search(documents: DataFrame, rows: list[tuple[int, str]], width: int, shared: frozenset[int]) -> DataFrame:
    state: dict = {}

    def run(batches):
        if not state:
            state["index"] = ItemIndex(rows, width, shared)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            hits = state["index"].search(texts)
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], names=["doc_id", "item_id"])

    return documents.mapInArrow(run, "doc_id long, item_id long")


def found(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """p9_found: (doc_id, item_id), one row for each document and each item whose wording it carries."""
    it = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    docs = spread(documents.select("doc_id", "text"), "doc_id")
    total = it.agg(F.sum(F.length("text") - F.length(F.regexp_replace("text", r"\s+", "")))).first()[0] or 0  # at least as many as windows
    parts = max(1, -(-total // MAX_WINDOWS))
    if parts == 1:
        return _search(docs, [(r[0], r[1]) for r in it.collect()], width, frozenset())
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    w = staged(_windows(it, width), "windows")
    several = w.groupBy("window").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where(F.col("a") < F.col("b")).select("window")
    shared = staged(w.join(several, "window").select(part.alias("part"), "window").distinct(), "shared")
    passes = []
    for k in range(parts):  # about MAX_WINDOWS windows each
        known = frozenset(r[0] for r in shared.where(F.col("part") == k).select("window").collect())
        passes.append(_search(docs, [(r[0], r[1]) for r in it.where(part == k).collect()], width, known))
    return reduce(DataFrame.unionByName, passes)


def leaked_items(documents: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, documents): the items that leaked, with the number of documents that carry them."""
    return found(documents, items, width).groupBy("item_id").agg(F.count("*").alias("documents"))
