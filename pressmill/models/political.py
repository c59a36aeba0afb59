"""Political leaning from counts of lexicon terms, cues of tone and the sentiment of a text, as expressions over columns.

Which categories speak for which side, with which weight, and which name persons,
are parameters. Defined results: without any match the keyword score is 0; NULL
sentiment counts as 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.lexicon import category_counts

VERSION = "philippine_bias_v1"
# Cues of formal and informal report.
FORMAL = ("according to", "stated", "announced", "reported", "confirmed")
INFORMAL = ("slammed", "blasted", "hit back", "fired back")


@dataclass(frozen=True)
class Sides:
    """Weights by category for both sides, and the categories whose terms name persons or bodies. The lexicon's own weights are those of its terms; counts don't use them."""

    government: dict[str, float] = field(default_factory=lambda: {"administration": 0.4, "local_government": 0.3, "public_works": 0.2, "praise": 0.1})
    opposition: dict[str, float] = field(default_factory=lambda: {"opposition": 0.3, "graft_terms": 0.3, "protest": 0.2, "audit_terms": 0.2})
    government_names: tuple[str, ...] = ("administration",)
    opposition_names: tuple[str, ...] = ("opposition",)


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def components(df: DataFrame, text: Column, lexicon: DataFrame, compound: Column, sides: Sides = Sides()) -> DataFrame:
    """Counts of terms by category are weighed by the sides' weights. df with matches, government, opposition, keyword_score, source_pattern, language_patterns, sentiment_context, bias_score, direction, confidence."""
    d = category_counts(df.withColumn("_text", F.coalesce(text, F.lit(""))), F.col("_text"), lexicon)
    counts = [c for c in d.columns if c.startswith("n_")]
    n = lambda c: F.col("n_" + c) if "n_" + c in counts else F.lit(0)
    low = F.lower("_text")
    hits = lambda cues: _sum([F.when(F.contains(low, F.lit(x)), 1.0).otherwise(0.0) for x in cues])
    d = d.withColumns({
        "matches": _sum([F.col(c).cast("double") for c in counts]).cast("int"),
        "government": _sum([n(c) * w for c, w in sides.government.items()]),
        "opposition": _sum([n(c) * w for c, w in sides.opposition.items()]),
        "source_pattern": F.when(F.contains(low, F.lit("government")) | F.contains(low, F.lit("official")), 0.1).otherwise(0.0),
        "language_patterns": F.when(hits(INFORMAL) > hits(FORMAL), 0.2).when(hits(FORMAL) > hits(INFORMAL), -0.1).otherwise(0.0),
        "sentiment_context": F.when(F.abs(compound) > 0.3, F.abs(compound)).otherwise(0.0),
        "_named": reduce(lambda a, b: a | b, [n(c) > 0 for c in (*sides.government_names, *sides.opposition_names)]),
    })
    d = d.withColumn("keyword_score", F.coalesce(F.try_divide(F.greatest("government", "opposition"), F.col("matches")), F.lit(0.0)))
    d = d.withColumn("bias_score", F.col("keyword_score") * 0.6 + F.col("source_pattern") * 0.1 + F.abs("language_patterns") * 0.1 + F.col("sentiment_context") * 0.2)
    leaning = F.col("_named") & (F.col("bias_score") > 0.1)
    d = d.withColumn("direction", F.when(leaning & (F.col("government") > F.col("opposition")), "pro_government").when(leaning & (F.col("opposition") > F.col("government")), "pro_opposition").otherwise("neutral"))
    return d.withColumn("confidence", F.least(F.lit(1.0), F.col("bias_score") + F.col("matches") / 10)).drop("_text", "_named")
