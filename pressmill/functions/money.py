"""Amounts of money and other named things in text, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of agencies, amounts, places, projects and irregularities.
AGENCY = r"\b(DPWH|DBM|COA|Comelec|DILG|DOH|DepEd|DOTR|Senate|House|Congress|LGU|Barangay|Province|City|Municipality|National|Government|Public|Malacañang|Palace|President|Vice President|Ombudsman|Philippine Government|PH Government)\b"
AMOUNT = r"\b(P\d+(?:\.\d+)?\s*(?:billion|million|thousand|trillion)?|\d+(?:\.\d+)?\s*(?:billion|million|thousand|trillion)\s*(?:pesos?|php)?|\d+(?:\.\d+)?\s*(?:billion|million|thousand|trillion))\b"
PLACE = r"\b(Philippines|Manila|Cebu|Davao|Quezon|Makati|Taguig|Pasig|Mandaluyong|San Juan|Marikina|Parañaque|Las Piñas|Muntinlupa|Caloocan|Malabon|Navotas|Valenzuela|Pasay|Pateros|Bohol|Cebu City|Davao City|Quezon City|Makati City|Taguig City|Pasig City)\b"
CONTRACTOR = r"\b([A-Z][a-zA-Z\s]+(?:Construction|Builders|Corp|Inc|Ltd|Company|Enterprises|Development))\b"
PROJECT = r"\b(flood control|infrastructure|road|bridge|school|hospital|building|project|program|initiative|development|construction)\b"
IRREGULAR = r"\b(corruption|kickback|anomaly|graft|plunder|misuse|overprice|scam|whistleblower|audit|irregularity|bidding|contract)\b"
LOOSE = r"(\d+(?:\.\d+)?)\s*(?:billion|million|b|m|php|peso|pesos)"
AGENCY_TERMS = ("dpwh", "dbm", "coa", "comelec", "dilg", "doh", "deped", "dotr", "senate", "house", "congress")
IRREGULAR_TERMS = ("pork", "kickback", "anomaly", "graft", "plunder", "misuse", "overprice", "scam", "whistleblower")


def mentions(text: Column, pattern: str, group: int = 1) -> Column:
    """ARRAY<STRING> of the matches in order, whatever their case; empty for NULL."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("(?iu)" + pattern), F.lit(group)), F.array().cast("array<string>"))


def amount_value(amount: Column) -> Column:
    """The number of an amount by its unit; trillion has none of its own."""
    a = F.lower(amount)
    n = F.regexp_extract(a, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return n * F.when(F.contains(a, F.lit("billion")), 1e9).when(F.contains(a, F.lit("million")), 1e6).when(F.contains(a, F.lit("thousand")), 1e3).otherwise(1.0)


def total_amount(amounts: Column) -> Column:
    """The sum of the amounts; NULL if it is nothing."""
    t = F.aggregate(F.transform(amounts, amount_value), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return F.when(t > 0, t)


def loose_numbers(text: Column) -> Column:
    """ARRAY<DOUBLE> of the numbers before a unit, the unit itself not counting."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(LOOSE), F.lit(1)), lambda x: x.try_cast("double"))


def relevance(agencies: Column, amounts: Column, irregular: Column, projects: Column) -> Column:
    part = lambda a, w: F.when(F.size(a) > 0, w).otherwise(0.0)
    return F.round(F.least(part(agencies, 0.3) + part(amounts, 0.4) + part(irregular, 0.2) + part(projects, 0.1), F.lit(1.0)), 6)


def terms_in(text: Column, terms: tuple[str, ...]) -> Column:
    """ARRAY<STRING> of the terms that occur anywhere in the text, whatever its case."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))


def first_mode(values: Column) -> Column:
    """The most frequent element, of several the one that comes first; NULL for none."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-F.array_position(values, v)).alias("at"), v.alias("v")))
    return F.array_max(counted)["v"]
