"""A lexicon scorer of sentiment with a compound in [-1, 1], after Hutto and Gilbert (2014).

Valences of words are adjusted for degree words before them, negation, emphasis by
capitals and exclamation marks, and the turn that "but" takes; their sum s becomes
s / sqrt(s * s + 15). The lexicon is a parameter; the one here is a small selection
of words of news texts with the valences and constants of the VADER lexicon
(C. J. Hutto and E. Gilbert, MIT licence), so scores don't equal those of the whole.

Defined results: NULL and empty texts score 0.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "vader_v1"
# Valences of the VADER lexicon, from -4 to 4.
LEXICON = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "best": 3.2, "win": 2.8, "won": 2.7, "wins": 2.7, "success": 2.7, "successful": 2.8, "progress": 1.8, "safe": 1.9, "support": 1.7, "help": 1.7,
    "helped": 1.8, "hope": 1.9, "peace": 2.5, "benefit": 2.0, "benefits": 1.6, "improve": 1.9, "improved": 2.1, "approve": 1.8, "approved": 1.8, "praise": 2.6, "praised": 2.2, "trust": 2.3, "agree": 1.5,
    "favor": 1.7, "ready": 1.5, "free": 2.3, "happy": 2.7, "strong": 2.3, "fair": 1.3, "honest": 2.3, "promise": 1.3, "promised": 1.5, "enough": 0.6, "celebrate": 2.7, "love": 3.2, "perfect": 2.7,
    "bad": -2.5, "worst": -3.1, "poor": -2.1, "poorly": -2.0, "fail": -2.5, "failed": -2.3, "failure": -2.3, "failures": -2.0, "lose": -1.7, "lost": -1.3, "losing": -1.6, "loss": -1.3, "crisis": -3.1,
    "corrupt": -3.0, "corruption": -2.8, "fraud": -2.8, "graft": -2.3, "scandal": -1.9, "kill": -3.7, "killed": -3.5, "dead": -3.3, "death": -2.9, "damage": -2.2, "damaged": -1.9, "danger": -2.4,
    "fear": -2.2, "complaint": -1.2, "complained": -1.7, "objections": -1.0, "deny": -1.4, "denied": -1.6, "blocked": -1.1, "suspended": -1.6, "delay": -1.3, "delayed": -0.9, "unpaid": -1.3,
    "unreported": -1.0, "hurt": -2.4, "wrong": -2.1, "angry": -2.3, "protest": -1.0, "attack": -2.1, "crime": -2.5, "questioned": -1.0, "cancelled": -1.0, "criticized": -1.6, "hate": -2.7, "terrible": -2.1,
}
DEGREE = {"very": 0.293, "extremely": 0.293, "really": 0.293, "so": 0.293, "most": 0.293, "totally": 0.293, "slightly": -0.293, "barely": -0.293, "hardly": -0.293, "somewhat": -0.293, "almost": -0.293}
NEGATION = frozenset("not no never neither nor none nobody nothing without cannot can't won't don't doesn't didn't isn't wasn't aren't weren't".split())
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def compound(text: str | None, lexicon: dict[str, float] = LEXICON) -> float:
    words = _WORD.findall(text or "")
    if not words:
        return 0.0
    low = [w.lower() for w in words]
    mixed = any(w.isupper() and len(w) > 1 for w in words) and not all(w.isupper() for w in words)
    scores, turn = [], None
    for i, w in enumerate(low):
        if w == "but":
            turn = len(scores)
        v = lexicon.get(w)
        if v is None:
            continue
        sign = 1 if v > 0 else -1
        if mixed and words[i].isupper() and len(w) > 1:
            v += sign * 0.733
        for d in range(1, 4):
            if i < d:
                break
            before = low[i - d]
            if before in DEGREE:
                v += sign * DEGREE[before] * (1, 0.95, 0.9)[d - 1]
            if before in NEGATION:
                v *= -0.74
        scores.append(v)
    if turn is not None:
        scores = [s * (0.5 if k < turn else 1.5) for k, s in enumerate(scores)]
    total = sum(scores)
    if total:
        total += math.copysign(0.292 * min(text.count("!"), 4), total)
    return round(max(-1.0, min(1.0, total / math.sqrt(total * total + 15))), 4) if total else 0.0


def scorer(lexicon: dict[str, float] = LEXICON):
    """Arrow UDF STRING -> DOUBLE."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([compound(t if isinstance(t, str) else None, lexicon) for t in texts], dtype="float64")

    return score


def score(text: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    return scorer(lexicon)(text)
