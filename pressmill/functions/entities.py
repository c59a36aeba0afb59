"""Named things in text with their places: dictionary and pattern spans by an Arrow UDF. NULL texts give an empty array."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions import money

SPAN = "array<struct<label:string,text:string,start:int,end:int,confidence:double,context:string>>"
#: label -> (pattern, confidence)
PATTERNS = {"agency": (money.AGENCY, 0.8), "amount": (money.AMOUNT, 0.9), "location": (money.PLACE, 0.7)}


def spans(text: str | None, patterns: dict[str, tuple[re.Pattern, float]], around: int = 50) -> list[dict]:
    """Matches of each pattern in order of place, with the characters around them."""
    out = []
    for label, (p, confidence) in patterns.items():
        for m in p.finditer(text or ""):
            out.append({"label": label, "text": m.group(), "start": m.start(), "end": m.end(), "confidence": confidence, "context": text[max(0, m.start() - around) : m.end() + around].strip()})
    return sorted(out, key=lambda x: (x["start"], x["end"], x["label"]))


def entity_spans(text: Column, patterns: dict[str, tuple[str, float]] | None = None) -> Column:
    chosen = patterns or PATTERNS

    def run(texts: pd.Series) -> pd.Series:
        compiled = {k: (re.compile(p, re.IGNORECASE), c) for k, (p, c) in chosen.items()}
        return pd.Series([spans(t if isinstance(t, str) else None, compiled) for t in texts])

    return F.pandas_udf(run, SPAN)(text)


def dictionary(terms: dict[str, list[str]]) -> dict[str, tuple[str, float]]:
    """Patterns of a dictionary label -> terms, longer terms first, whole words only."""
    return {k: (r"(?<!\w)(?:" + "|".join(re.escape(t) for t in sorted(set(ts), key=lambda t: (-len(t), t))) + r")(?!\w)", 0.8) for k, ts in terms.items() if ts}
