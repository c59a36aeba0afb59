"""Key expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters_only(c: Column) -> Column:
    """Lower case, letters only: two names that differ in case, spacing or punctuation get one key. NULL stays NULL."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")
