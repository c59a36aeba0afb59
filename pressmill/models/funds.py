"""Whether a text is about public money: a rule of three patterns, and a dictionary gate beside it.

NULL title and content count as empty; an empty text is not about public money.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns over lower-case text.
MONEY = r"(?:fund|budget|appropriation|allocation|disbursement|audit|coa|billion|million|trillion|peso|pesos)"
GOVERNMENT = r"(?:philippine|ph|dpwh|dbm|coa|comelec|dilg|doh|deped|dotr|senate|house|congress|solon|lawmaker|bill|appropriation|budget|malacañang|palace|president|vice president|ombudsman|philippines|filipino)"
IRREGULAR = r"(?:pork|kickback|anomaly|graft|plunder|misuse|overprice|overpriced|scam|whistleblower)"
SPORTS = r"(?:basketball|volleyball|football|soccer|nba|pba|uaap|ncaa|tournament|match|game|coach|player|club)"
CRIME = r"(?:shabu|buy-bust|drug|narcotics|illegal\s+drugs|anti-drug|meth|pdea)"
DISASTER = r"(?:earthquake|typhoon|hurricane|natural\s+disaster|magnitude|aftershock|tsunami|landslide|volcano|eruption|storm|cyclone|tornado|flash\s+flood|flooding\s+incident)"
DAMAGE = r"(?:damage|damages|destroyed|collapsed|injured|killed|deaths|casualties|evacuated|displaced|affected|victims|property\s+damage)"
GATE_GOVERNMENT = ("dpwh", "dbm", "coa", "comelec", "dilg", "doh", "deped", "dotr", "senate", "house", "congress", "lgu", "barangay", "province", "city", "municipality", "national", "government", "public")
GATE_MONEY = ("pork", "kickback", "anomaly", "graft", "plunder", "misuse", "overprice", "scam", "whistleblower", "audit", "appropriation", "budget", "allocation", "disbursement", "fund", "billion", "million")
GATE_NOT = ("shabu", "buy-bust", "drug", "narcotics", "basketball", "volleyball", "football", "soccer", "nba", "pba", "tournament", "match", "game")
AMOUNT_NAMED = r"(?:[p₱$]|php|usd)\s?\d|\d[\d,.]*\s*(?:pesos?|php|dollars?|thousand|trillion)"
CANDIDATE_MONEY = ("billion", "million", "budget", "fund", "peso", "php", "₱")
CANDIDATE_BODIES = ("dpwh", "dbm", "coa", "dilg", "doh", "deped", "senate", "house", "congress", "ombudsman")


def text_of(title: Column, content: Column) -> Column:
    return F.lower(F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))))


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def by_rule(title: Column, content: Column) -> Column:
    """Money and a body or an irregularity, and neither sports, crime, disaster nor damage; each pattern is tried only where those before it leave it open."""
    t = text_of(title, content)
    negative = f"{SPORTS}|{CRIME}|{DISASTER}|{DAMAGE}"
    return F.when(t == "", False).when(t.rlike(negative), False).when(~t.rlike(MONEY), False).otherwise(t.rlike(f"{GOVERNMENT}|{IRREGULAR}"))


def gate(title: Column, content: Column) -> Column:
    """STRUCT<is_funds, confidence> by dictionary; a named amount of money beside a body counts less than a word for public money."""
    t = text_of(title, content)
    s = lambda v, c: F.struct(F.lit(v).alias("is_funds"), F.lit(c).alias("confidence"))
    government = _any(t, GATE_GOVERNMENT)
    return F.when(_any(t, GATE_NOT), s(False, 0.9)).when(government & _any(t, GATE_MONEY), s(True, 0.8)).when(government & t.rlike(AMOUNT_NAMED), s(True, 0.7)).otherwise(s(False, 0.3))


def gated(title: Column, content: Column) -> Column:
    """The rule, overruled by the gate where that is sure (above .6), dropped where it is unsure (below .5)."""
    rule, g = by_rule(title, content), gate(title, content)
    negative = text_of(title, content).rlike(f"{SPORTS}|{CRIME}|{DISASTER}|{DAMAGE}")
    return F.when(negative, False).when(g["confidence"] > 0.6, g["is_funds"]).when(rule & (g["confidence"] < 0.5), False).otherwise(rule)


def candidate(title: Column, content: Column) -> Column:
    """A cheap test that keeps what an evaluation needs to look at."""
    t = text_of(title, content)
    return _any(t, CANDIDATE_MONEY) | _any(t, CANDIDATE_BODIES)
