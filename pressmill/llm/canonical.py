"""Free-entered values -> entries of a reference list (problem 1).

All names of the entries, aliases among them, stand in one trie. A typed value is
read in a few ways (as it stands, without breadcrumbs, without words such as
"News" or "Section" around it), each reduced to bare letters, and a Levenshtein
automaton walks the trie: its state after each edge is the row of edit distances
to all prefixes of the value, clipped one above the distance allowed, so that a
branch ends as soon as no prefix is within reach. A swap of two neighbouring
letters is one edit. The distance allowed depends on the length (`allowed`).

Values are matched where they lie, by an Arrow UDF that remembers values it has
seen: no shuffle, and no key can be hot. Lists beyond `SHARD` names are searched
shard by shard, so that no worker holds a trie of unbounded size.

Defined results: NULL and blank values, and values without letters, match nothing
(entry 0); of several entries at the least distance the one with an exact alias,
then the lowest id, is taken; repeated rows keep their number.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names in one trie at most; a longer list is searched in several.
SHARD = 200_000
#: Values remembered by a worker.
REMEMBERED = 200_000
#: Words that stand around a section's name and don't belong to it.
AROUND = frozenset("home news latest section sections stories story page online cat category channel topic tag all more the".split())
_SPLIT = re.compile(r"\s*(?:[»›>|:=\\]|/|\s[-–—]\s)\s*")


def bare(text: str) -> str:
    """Letters only, without case, width, accents, ligatures; "&" and "+" are dropped, as spacing is."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)).casefold()
    return "".join(c for c in text if c.isalpha() and not unicodedata.combining(c))


def readings(typed: str) -> list[str]:
    """The bare forms a value may be meant as, the plainest first."""
    typed = html.unescape(html.unescape(unicodedata.normalize("NFKC", typed)))
    parts = [typed, *(p for p in reversed(_SPLIT.split(typed)) if p)]
    out: list[str] = []
    for p in parts:
        words = [w for w in re.split(r"[\s_\-()\[\]#\"'.,!?]+", p) if w]
        inner = list(words)
        while inner and (bare(inner[0]) in AROUND or not bare(inner[0])):
            inner.pop(0)
        while inner and (bare(inner[-1]) in AROUND or not bare(inner[-1])):
            inner.pop()
        for form in (bare(p), bare("".join(inner))):
            if form and form not in out and form not in AROUND:
                out.append(form)
    return out


def allowed(n: int) -> int:
    """Edits allowed for the shorter of the two names."""
    return 0 if n < 3 else 1 if n < 8 else 2 if n < 14 else 3


class Trie:
    """Names with the ids they stand for."""

    def __init__(self, names: list[tuple[str, int]]):
        self.root: dict = {}
        for name, entry in names:
            node = self.root
            for c in name:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((entry, len(name)))

    def within(self, value: str, k: int) -> Iterator[tuple[int, int, int]]:
        """(distance, entry, length of its name) of every name within k edits, by a depth-first walk of the trie with the automaton's state."""
        n = len(value)
        stack = [(self.root, tuple(min(i, k + 1) for i in range(n + 1)), None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for entry, length in node.get("", ()):
                if row[n] <= k:
                    yield row[n], entry, length
            for c, child in node.items():
                if not c:
                    continue
                new = [min(row[0] + 1, k + 1)]
                for i in range(1, n + 1):
                    d = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (value[i - 1] != c))
                    if before is not None and i > 1 and value[i - 1] == last and value[i - 2] == c:
                        d = min(d, before[i - 2] + 1)
                    new.append(d if d <= k else k + 1)
                if min(new) <= k or min(row) <= k - 1:
                    stack.append((child, tuple(new), row, c))

    def near(self, typed: str) -> dict[int, int]:
        """entry -> least distance, of every entry that any reading of the value is within the distance allowed of."""
        out: dict[int, int] = {}
        for form in readings(typed):
            for d, entry, length in self.within(form, allowed(len(form))):
                if d <= allowed(min(length, len(form))):
                    out[entry] = min(d, out.get(entry, d))
        return out

    def best(self, typed: str) -> tuple[int, int]:
        """(entry, distance), (0, -1) if none is within the distance allowed."""
        found: list[tuple[int, int]] = []
        for form in readings(typed):
            for d, entry, length in self.within(form, allowed(len(form))):
                if d <= allowed(min(length, len(form))):
                    found.append((d, entry))
            if found and min(found)[0] == 0:
                break
        return (min(found)[1], min(found)[0]) if found else (0, -1)


def _names(rows: list) -> list[tuple[str, int]]:
    out = {}
    for entry, name, aliases in rows:
        for x in [name, *(aliases or [])]:
            if x and bare(x):
                out[(bare(x), entry)] = None
                if re.search(r"[&+]", x):
                    out[(bare(re.sub(r"[&+]", " and ", x)), entry)] = None
    return sorted(out)


def matcher(names: list[tuple[str, int]]):
    """Arrow UDF STRING -> STRUCT<entry INT, distance INT>."""
    state: dict = {}

    @F.pandas_udf("entry int, distance int")
    def match(values: pd.Series) -> pd.DataFrame:
        if not state:
            state.update(trie=Trie(names), seen={})
        trie, seen = state["trie"], state["seen"]
        out = []
        for v in values:
            if v not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[v] = trie.best(v) if isinstance(v, str) and v.strip() else (0, -1)
            out.append(seen[v])
        return pd.DataFrame(out, columns=["entry", "distance"])

    return match


def match_values(df: DataFrame, value: Column, reference: DataFrame, id_col: str, name_col: str, alias_col: str, into: str = "match") -> DataFrame:
    """df with a column `into` STRUCT<entry, distance>. The reference list is counted first; beyond SHARD entries it is searched in shards of that size."""
    ref = reference.where(F.col(name_col).isNotNull()).select(F.col(id_col).cast("int"), name_col, alias_col)
    shards = max(1, -(-ref.count() // SHARD))
    best = F.lit(None).cast("struct<d:int,entry:int,distance:int>")
    for k in range(shards):
        rows = ref.where(F.pmod(F.hash(name_col), F.lit(shards)) == k).collect()  # at most about SHARD rows
        m = matcher(_names([tuple(r) for r in rows]))(value)
        mine = F.struct(F.when(m["distance"] < 0, 99).otherwise(m["distance"]).alias("d"), m["entry"].alias("entry"), m["distance"].alias("distance"))
        best = mine if shards == 1 else F.least(F.coalesce(best, mine), mine)
    return df.withColumn("_best", best).withColumn(into, F.struct(F.col("_best.entry").alias("entry"), F.col("_best.distance").alias("distance"))).drop("_best")


def candidates(values: DataFrame, value_col: str, reference: DataFrame, id_col: str, name_col: str, alias_col: str) -> DataFrame:
    """(value, entry, distance): every entry within the distance allowed, of each different value; values near to none have no row."""
    ref = reference.where(F.col(name_col).isNotNull()).select(F.col(id_col).cast("int"), name_col, alias_col)
    shards = max(1, -(-ref.count() // SHARD))
    different = values.where(F.col(value_col).isNotNull()).select(F.col(value_col).alias("value")).distinct()

    def searched(names: list[tuple[str, int]]):
        state: dict = {}

        @F.pandas_udf("array<struct<entry:int,distance:int>>")
        def near(column: pd.Series) -> pd.Series:
            if not state:
                state["trie"] = Trie(names)
            return pd.Series([[{"entry": e, "distance": d} for e, d in sorted(state["trie"].near(v).items())] for v in column])

        return near

    parts = []
    for k in range(shards):
        rows = ref.where(F.pmod(F.hash(name_col), F.lit(shards)) == k).collect()  # at most about SHARD rows
        parts.append(different.select("value", F.explode(searched(_names([tuple(r) for r in rows]))("value")).alias("e")).select("value", "e.entry", "e.distance"))
    return parts[0] if shards == 1 else reduce(DataFrame.unionByName, parts).groupBy("value", "entry").agg(F.min("distance").alias("distance"))


def typed_sections(articles: DataFrame) -> DataFrame:
    """(article_id, typed): typed is raw_category, or category where that is NULL or blank."""
    blank = lambda c: c.isNull() | F.regexp_replace(c, r"[\s\p{Z}\p{Cf}]+", "").eqNullSafe("")
    raw, cat = F.col("raw_category"), F.col("category")
    return articles.select(F.col("id").alias("article_id"), F.when(~blank(raw), raw).when(~blank(cat), cat).alias("typed"))


def article_sections(articles: DataFrame, category_list: DataFrame) -> DataFrame:
    """(article_id, typed, category_id, distance): category_id 0 = fits none."""
    a = typed_sections(articles)
    m = match_values(a, F.col("typed"), category_list, "category_id", "category_name", "known_as")
    return m.select("article_id", "typed", F.col("match.entry").alias("category_id"), F.col("match.distance").alias("distance"))


def found(articles: DataFrame, category_list: DataFrame) -> DataFrame:
    """p1_found: (article_id, category_id) of the typed values that aren't, character for character, a name of the list."""
    names = category_list.select(F.col("category_name").alias("typed")).where(F.col("typed").isNotNull()).distinct()
    s = article_sections(articles, category_list).where(F.col("typed").isNotNull())
    return s.join(names, "typed", "left_anti").select("article_id", "category_id")
