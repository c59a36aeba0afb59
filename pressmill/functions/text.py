"""Text expressions: names, casing, sanitizing, content gates. All JVM-side; NULL in gives NULL out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of sources and categories.
SOURCES = {"gma": "GMA", "manila bulletin": "Manila Bulletin", "sunstar": "Sunstar", "inquirer": "Inquirer", "rappler": "Rappler", "philstar": "Philstar", "manila times": "Manila Times", "abs-cbn": "ABS-CBN"}
CATEGORIES = {
    "headlines": "Headlines", "news": "News", "nation": "Nation", "business": "Business", "sports": "Sports", "technology": "Technology", "tech": "Technology", "world": "World",
    "entertainment": "Entertainment", "lifestyle": "Lifestyle", "opinion": "Opinion", "cebu": "Cebu", "davao": "Davao", "manila": "Manila", "bohol": "Bohol", "pampanga": "Pampanga",
    "baguio": "Baguio", "zamboanga": "Zamboanga", "iloilo": "Iloilo", "tacloban": "Tacloban", "general-santos": "General Santos",
}
# Words that begin no name, acronyms that are none of a body.
NO_NAMES = (
    "News", "Latest", "Business", "Nation", "World", "Technology", "Sports", "Entertainment", "Opinion", "General", "Lifestyle", "Trends", "View", "Quick", "Open", "Original", "Editorial", "Cartoons",
    "Sept", "September", "Oct", "October", "Nov", "November", "Dec", "December", "Jan", "January", "Feb", "February", "Mar", "March", "Apr", "April", "May", "Jun", "June", "Jul", "July", "Aug", "August", "No",
)
NO_ACRONYMS = ("PH", "PHL", "GDP", "AI", "NBA", "UFC", "NCAA", "UAAP", "PBA", "PNR", "LRT", "MRT")
KNOWN_BODIES = ("DPWH", "DOF", "DOJ", "NEDA", "DILG", "DOH", "DEPED", "DND", "AFP", "PNP", "COMELEC", "OMBUDSMAN", "COA", "DBM", "NBI", "BI", "BIR", "BOC", "BSP")
VIDEO_PATHS = ("/videos/", "/video/", "/watch/", "/play/", "/stream/")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def title_case(c: Column) -> Column:
    """Every letter after a non-letter in upper case, every other in lower case ("o'neil 3d" -> "O'Neil 3D")."""
    chars = F.split(c, "")
    before = lambda i: F.coalesce(F.get(chars, i - 1), F.lit(""))
    return F.array_join(F.transform(chars, lambda x, i: F.when(before(i).rlike(r"\p{L}"), F.lower(x)).otherwise(F.upper(x))), "")


def normalize_source(c: Column) -> Column:
    s = F.trim(c)
    return F.when(c != "", F.coalesce(F.try_element_at(literal_map(SOURCES), F.lower(s)), title_case(s)))


def normalize_category(c: Column) -> Column:
    s = F.trim(c)
    return F.when(c != "", F.coalesce(F.try_element_at(literal_map(CATEGORIES), F.replace(F.lower(s), F.lit("_"), F.lit("-"))), title_case(s)))


def fold_name(c: Column) -> Column:
    """Letters a-z and digits only, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def without_active_parts(c: Column) -> Column:
    """Script tags, javascript: and data: tokens cut, angle brackets escaped."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", ""), r"(?i)(?:javascript|data):", "")
    return F.replace(F.replace(s, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def without_tags(c: Column) -> Column:
    """Tags cut and white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " "))


def without_phrases(c: Column, phrases: list[str]) -> Column:
    return F.trim(reduce(lambda acc, p: F.replace(acc, F.lit(p), F.lit("")), phrases, c))


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def tiered_cut(c: Column, tiers: tuple[int, ...] = (1000, 500)) -> Column:
    """Cut to the largest tier that the text exceeds, with an ellipsis."""
    return reduce(lambda acc, n: acc.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))), tiers[1:], F.when(F.length(c) > tiers[0], F.concat(F.substring(c, 1, tiers[0]), F.lit("...")))).otherwise(c)


def content_valid(c: Column, least: int = 50) -> Column:
    """False for NULL."""
    return F.coalesce(F.length(F.trim(c)) >= least, F.lit(False))


def skip_reason(url: Column, content: Column, least: int = 50) -> Column:
    """"video content", "insufficient content" or NULL (keep)."""
    video = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(url), F.lit(p)), F.lit(False)) for p in VIDEO_PATHS])
    return F.when(video, F.lit("video content")).when(~content_valid(content, least), F.lit("insufficient content"))


def reading_score(c: Column) -> Column:
    """Length plus 50 for each sentence end, for one at least."""
    return F.length(c) + 50 * F.greatest(F.lit(1), F.length(c) - F.length(F.regexp_replace(c, r"[.!?]", "")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def threshold_label(score: Column, cut: float = 0.05, strict: bool = False) -> Column:
    """positive / negative / neutral; the thresholds themselves belong to the outer labels unless strict."""
    up, down = (score > cut, score < -cut) if strict else (score >= cut, score <= -cut)
    return F.when(up, "positive").when(down, "negative").when(score.isNotNull(), "neutral")


def contains_all(c: Column, query: str) -> Column:
    """Case-insensitive substring test; % and _ have no special meaning."""
    return F.contains(F.lower(c), F.lit(query.lower()))
