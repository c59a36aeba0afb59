"""Lexicons compiled to expressions: how many of a category's terms a text holds."""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Terms that are compiled into one expression; a larger lexicon is counted in several passes over the columns.
TERMS = 2_000


#: What stands for a lexicon that can't be read: no terms, no weights.
EMBEDDED = {"version": "embedded", "keywords": {}, "weights": {}}
SCHEMA = "category string, term string, weight double"


def load_json(spark: SparkSession, path: str, default: dict = EMBEDDED) -> DataFrame:
    """(category, term, weight) of a lexicon file {version, keywords, weights}; of `default` where the file is missing or broken."""
    try:
        doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
        doc = doc if isinstance(doc, dict) and doc else default
    except (AnalysisException, ValueError, TypeError):
        doc = default
    weights = doc.get("weights") or {}
    return spark.createDataFrame([(c, t, float(weights.get(c, 1.0))) for c, terms in (doc.get("keywords") or {}).items() for t in terms], SCHEMA)


def terms_by_category(lexicon: DataFrame) -> dict[str, list[str]]:
    """The lexicon as lists; a table of fixed size."""
    out: dict[str, list[str]] = {}
    for c, t in lexicon.where(F.col("term").isNotNull()).select("category", "term").collect():
        out.setdefault(c, []).append(t.strip().lower())
    return {c: [t for t in ts if t] for c, ts in sorted(out.items())}


def words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"))


def count_terms(low: Column, tokens: Column, terms: list[str]) -> Column:
    """How many of the terms occur: single words as whole words, others anywhere. A term that is listed twice counts twice."""
    plain = Counter(t for t in terms if re.fullmatch(r"[\w]+", t))
    total = F.lit(0)
    if plain:
        times = F.create_map(*[F.lit(x) for kv in plain.items() for x in kv])
        total = total + F.aggregate(F.array_intersect(tokens, F.array(*[F.lit(t) for t in plain])), F.lit(0), lambda acc, t: acc + F.try_element_at(times, t))
    for t, n in Counter(t for t in terms if t not in plain).items():
        hit = F.contains(low, F.lit(t)) if " " in t else low.rlike(rf"\b{re.escape(t)}\b")
        total = total + F.when(hit, n).otherwise(0)
    return total


def category_counts(df: DataFrame, text: Column, lexicon: DataFrame, prefix: str = "n_") -> DataFrame:
    """df with one INT column per category. The text is tokenized once."""
    terms = terms_by_category(lexicon)
    d = df.withColumns({"_low": F.lower(F.coalesce(text, F.lit(""))), "_words": words(text)})
    some = lambda t, k: count_terms(F.col("_low"), F.col("_words"), t[k : k + TERMS])
    for c, t in terms.items():
        d = d.withColumn(prefix + c, some(t, 0))
        for k in range(TERMS, len(t), TERMS):
            d = d.withColumn(prefix + c, F.col(prefix + c) + some(t, k))
    return d.drop("_low", "_words")
