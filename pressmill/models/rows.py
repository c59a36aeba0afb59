"""Scoring models by name and version, and the analysis rows they give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.text import threshold_label
from pressmill.models import political, sentiment

COLUMNS = ("article_id", "model_version", "model_type", "sentiment_score", "sentiment_label", "political_bias_score", "confidence_score", "direction")


@dataclass(frozen=True)
class ScoringModel:
    """score takes (id, text, compound) and gives rows of COLUMNS."""

    model_type: str
    version: str
    score: Callable[[DataFrame], DataFrame]


def _row(df: DataFrame, model_type: str, version: str, **values) -> DataFrame:
    none = {c: F.lit(None).cast("string" if c in ("sentiment_label", "direction") else "double") for c in COLUMNS[3:]}
    fixed = {"article_id": F.col("id"), "model_version": F.lit(version), "model_type": F.lit(model_type)}
    return df.select(*[(fixed | none | values)[c].alias(c) for c in COLUMNS])


def sentiment_model() -> ScoringModel:
    return ScoringModel("sentiment", sentiment.VERSION, lambda df: _row(df, "sentiment", sentiment.VERSION, sentiment_score=F.col("compound"), sentiment_label=threshold_label(F.col("compound"))))


def political_model(lexicon: DataFrame, sides: political.Sides = political.Sides()) -> ScoringModel:
    def score(df: DataFrame) -> DataFrame:
        c = political.components(df, F.col("text"), lexicon, F.col("compound"), sides)
        return _row(c, "political_bias", political.VERSION, political_bias_score=F.col("bias_score"), confidence_score=F.col("confidence"), direction=F.col("direction"))

    return ScoringModel("political_bias", political.VERSION, score)


def analysis_rows(articles: DataFrame, models: list[ScoringModel]) -> DataFrame:
    """One row per article and model; title and content NULL or empty count as an empty text."""
    text = F.trim(F.concat_ws(" ", "title", "content"))
    base = articles.select("id", text.alias("text")).withColumn("compound", sentiment.score(F.col("text")))
    out = models[0].score(base)
    for m in models[1:]:
        out = out.unionByName(m.score(base))
    return out
