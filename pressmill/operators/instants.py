"""Timestamps as scraped text -> one UTC instant (problem 2).

The text is read into local date and time fields by JVM expressions only. Where
it names an offset, that offset counts; else the outlet's zone does. The zone of
each outlet is estimated: local timestamps are laid against ingestion times under
every candidate zone (a whole offset history, with its daylight-saving changes),
and the history with the fewest violations wins, a text being in violation when
it would have been published after it was ingested. A zone declared for the
outlet stays unless the estimate contradicts it by more than `margin` and what the
number of timestamps leaves unsure.

Defined results: NULL or blank text, placeholders ("N/A", "just now") and dates
that don't exist give NULL; a local time that occurs twice is the earlier
instant; a skipped one is read with the offset before the change; digits beyond
microseconds are cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.keys import letters_only
from pressmill.session import staged

#: Outlets whose zones are broadcast at most.
BROADCAST_ROWS = 200_000
#: Candidate zones that are tried in one pass over the rows; more are tried in several.
ZONES = 600
# Month names in English, Filipino and Spanish, as their first three or more letters.
MONTHS = {
    1: ("january", "jan", "enero", "ene"), 2: ("february", "feb", "pebrero", "peb", "febrero"), 3: ("march", "mar", "marso", "marzo"),
    4: ("april", "apr", "abril", "abr"), 5: ("may", "mayo"), 6: ("june", "jun", "hunyo", "hun", "junio"), 7: ("july", "jul", "hulyo", "hul", "julio"),
    8: ("august", "aug", "agosto", "ago"), 9: ("september", "sept", "sep", "setyembre", "set", "septiembre", "setiembre"),
    10: ("october", "oct", "oktubre", "okt", "octubre"), 11: ("november", "nov", "nobyembre", "nob", "noviembre"), 12: ("december", "dec", "disyembre", "dis", "diciembre", "dic"),
}
_MONTH = "(?:" + "|".join(sorted({n for names in MONTHS.values() for n in names}, key=lambda n: (-len(n), n))) + ")"
_LEAD = r"^(?:[•·*|\-–—\s]*)(?:(?:date\s+)?(?:last\s+)?(?:first\s+)?(?:published|posted|updated|modified|inilathala|na-update|publicado|actualizado)(?:\s+on|\s+at|\s+el|\s+noong)?\s*:?\s*)?"
_DAYNAME = r"^(?:(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:day|sday|nesday|rsday|urday)?\.?|lunes|martes|mi[eé]rcoles|miyerkules|jueves|huwebes|viernes|biyernes|s[aá]bado|domingo|linggo),?\s+"
#: time of day, then whatever names a zone
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([ap]\.?m\b\.?)?"
_ZONE = r"\s*(z|utc|gmt|(?:utc|gmt)?\s?[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5})?(?:\s*\[[a-z0-9_/+\-]+\])?"
_BETWEEN = r"(?:\s*[,|\-–—·•]\s*|\s*,?\s+(?:at|ng|nang|a las)\s+|\s+|:)"
_AFTER = rf"(?:{_BETWEEN}{_TIME}{_ZONE})?$"

#: What counts as a space.
SPACES = r"[\s\x{a0}\x{200b}\x{202f}]+"

#: name -> (pattern over lower-case text, its fields as `kind|year|month|day|hour|minute|second|fraction|half|zone`)
_T = lambda at: "|".join(f"${at + i}" for i in range(6))
_LAYOUTS = {
    "year_first": (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:(?:t|\s+|,\s*)" + _TIME + _ZONE + ")?$", f"named|$1|$2|$3|{_T(4)}"),
    "day_month": (rf"^(?:ika-)?(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*[-/]\s*|\s+(?:ng|de|of)\s+|\s+)({_MONTH})\.?(?:\s*[-/]\s*|\s+de\s+|\s+del\s+|\s*,\s*|\s+)(\d{{4}}|\d{{2}})" + _AFTER, f"named|$3|$2|$1|{_T(4)}"),
    "month_day": (rf"^({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})" + _AFTER, f"named|$3|$1|$2|{_T(4)}"),
    "ctime": (rf"^({_MONTH})\s+(\d{{1,2}})\s+{_TIME}{_ZONE}\s+(\d{{4}})$", f"named|$9|$1|$2|{_T(3)}"),
    "numeric": (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _AFTER, f"ordered|$3|$1|$2|{_T(4)}"),
    "compact": (r"^((?:19|20)\d{2})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?()" + _ZONE + ")?$", f"named|$1|$2|$3|{_T(4)}"),
}
_EPOCH = (r"^(-?\d{9,10}|\d{13}|\d{16})(?:\.(\d{1,9}))?$", "epoch|$1||||||$2||")


def cleaned(text: Column) -> Column:
    """Lower case, spaces folded, lead words ("Updated", "Posted on") and weekday names cut."""
    c = F.trim(F.regexp_replace(F.lower(text), SPACES, " "))
    return F.regexp_replace(F.regexp_replace(c, _LEAD, ""), _DAYNAME, "")


def _month_number(c: Column) -> Column:
    pairs = [F.lit(x) for n, names in MONTHS.items() for name in names for x in (name, n)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c.try_cast("int"))


def fields(text: Column) -> Column:
    """ARRAY<STRING> of kind, year, month, day, hour, minute, second, fraction, half, zone; NULL where no layout fits."""
    c = cleaned(text)
    layouts = [_EPOCH, *_LAYOUTS.values()]
    laid = reduce(lambda acc, x: acc.when(c.rlike(x[0]), F.regexp_replace(c, *x)), layouts[1:], F.when(c.rlike(layouts[0][0]), F.regexp_replace(c, *layouts[0])))
    return F.split(laid, r"\|", -1)


def with_local_time(df: DataFrame, fields_col: str, month_first: Column) -> DataFrame:
    """Adds local_us BIGINT, microseconds of the local time as if it were UTC, and offset_s INT, the offset named (NULL if none); NULL where the fields denote no instant."""
    f = F.col(fields_col)
    number = lambda i: f[i].try_cast("int")
    none, zero = F.lit(None).cast("bigint"), F.lit(0)
    ordered, epoch = f[0] == "ordered", f[0] == "epoch"
    df = df.withColumns({
        "_y": number(1) + F.when(number(1) < 100, 2000).otherwise(0), "_a": F.when(ordered, number(2)).otherwise(_month_number(f[2])), "_b": number(3), "_h": F.coalesce(number(4), zero),
        "_s": F.coalesce(number(6), zero), "_f": F.rpad(F.substring(f[7], 1, 6), 6, "0").try_cast("bigint"), "_n": f[1].try_cast("bigint"),
    })
    swap = ordered & ~month_first
    hour = F.when((f[8] == "") | (F.col("_h") > 12), F.col("_h")).otherwise(F.col("_h") % 12 + F.when(f[8].startswith("p"), 12).otherwise(0))
    at = F.try_make_timestamp(F.col("_y"), F.when(swap, F.col("_b")).otherwise(F.col("_a")), F.when(swap, F.col("_a")).otherwise(F.col("_b")), hour, F.coalesce(number(5), zero), F.col("_s").cast("decimal(16,6)"), F.lit("UTC"))
    exact = F.when((F.col("_s") < 60) & (hour < 24), F.unix_micros(at) + F.col("_f"))
    since = F.when(F.length(f[1]) >= 16, F.col("_n")).when(F.length(f[1]) >= 13, F.col("_n") * 1000).otherwise(F.col("_n") * 1000000 + F.col("_f"))
    df = df.withColumns({"local_us": F.when(epoch, since).when(f.isNotNull(), exact).otherwise(none), "offset_s": F.when(epoch, zero).otherwise(offset_seconds(f[9]))})
    return df.drop("_y", "_a", "_b", "_h", "_s", "_f", "_n")


def offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of "z", "utc", "gmt+8", "+0800", "-04:00"; NULL for none and for abbreviations, which differ from country to country."""
    p = r"^(?:utc|gmt)?\s?([+-])(\d{1,2}):?(\d{2})?$"
    size = F.regexp_extract(zone, p, 2).try_cast("int") * 3600 + F.coalesce(F.nullif(F.regexp_extract(zone, p, 3), F.lit("")).try_cast("int"), F.lit(0)) * 60
    return F.when(zone.isin("z", "utc", "gmt"), F.lit(0)).when(zone.rlike(p), F.when(F.regexp_extract(zone, p, 1) == "-", -size).otherwise(size))


def to_instant(local_us: Column, offset_s: Column, zone: Column) -> Column:
    """Microseconds since 1970 UTC of a local time; the JVM's rule for doubled and skipped local times is the one wanted here."""
    in_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))
    return F.when(offset_s.isNotNull(), local_us - offset_s.cast("bigint") * 1000000).otherwise(in_zone)


def read_local(articles: DataFrame, outlets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(article_id, outlet, site_zone, published_at, ingested_us, local_us, offset_s, then the columns of `keep`), one row per article. outlets is a table of fixed size (one row an outlet)."""
    o = outlets.select(letters_only(F.col("source")).alias("outlet"), F.col("site_zone"), (F.upper("date_order") == "MDY").alias("_mdy"))
    o = o.groupBy("outlet").agg(F.min("site_zone").alias("site_zone"), F.max("_mdy").alias("_mdy"))
    a = articles.select(F.col("id").alias("article_id"), letters_only(F.col("source")).alias("outlet"), "published_at", F.unix_micros("inserted_at").alias("ingested_us"), *keep)
    j = a.join(o, "outlet", "left")
    p = with_local_time(j.withColumn("_fields", fields(F.col("published_at"))), "_fields", F.coalesce("_mdy", F.lit(False)))
    return p.select("article_id", "outlet", "site_zone", "published_at", "ingested_us", "local_us", "offset_s", *keep)


def estimate_zones(local: DataFrame, candidates: DataFrame, tolerance_s: int = 300, horizon_s: int = 6 * 3600, margin: float = 0.25) -> DataFrame:
    """(outlet, declared, estimated, zone, n, cost, declared_cost): for each outlet the candidate zone of least cost.

    cost is the mean over its local timestamps of 1 for a violation (published after it was ingested, beyond the tolerance),
    else of the delay as a share of the horizon, 1 at most. The sums are made before the shuffle; candidates has one row a zone.
    """
    us = 1_000_000
    rows = local.where(F.col("local_us").isNotNull() & F.col("offset_s").isNull() & F.col("ingested_us").isNotNull())
    delay = F.col("ingested_us") - to_instant(F.col("local_us"), F.lit(None).cast("int"), F.col("zone"))
    cost = F.when(delay < -tolerance_s * us, 1.0).otherwise(F.least(F.greatest(delay, F.lit(0)) / (horizon_s * us), F.lit(1.0)))
    # the candidates, a few, ride along each row as a literal: no join; the database of zones has some 600 names
    zones = sorted(r[0] for r in candidates.where(F.col("zone").isNotNull()).select("zone").distinct().collect())

    def tried(some: list[str]) -> DataFrame:
        each = rows.select("outlet", "site_zone", "ingested_us", "local_us", F.explode(F.array(*[F.lit(z) for z in some]).cast("array<string>")).alias("zone"))
        return each.groupBy("outlet", "zone").agg(F.max("site_zone").alias("declared"), F.count("*").alias("n"), F.avg(cost).alias("cost"))

    per = reduce(DataFrame.unionByName, [tried(zones[k : k + ZONES]) for k in range(0, max(1, len(zones)), ZONES)])
    best = per.groupBy("outlet").agg(F.max("declared").alias("declared"), F.max("n").alias("n"), F.min(F.struct("cost", "zone")).alias("b"),
                                     F.min(F.when(F.col("zone") == F.col("declared"), F.col("cost"))).alias("declared_cost"))
    # a mean of n costs is that sure only: few timestamps contradict nothing
    sure = 2.0 / F.sqrt("n")
    keep = F.col("declared").isNotNull() & (F.coalesce("declared_cost", F.lit(1.0)) <= F.col("b.cost") + margin + sure)
    return best.select("outlet", "declared", F.col("b.zone").alias("estimated"), F.when(keep, F.col("declared")).otherwise(F.col("b.zone")).alias("zone"), "n", F.col("b.cost").alias("cost"), "declared_cost")


def utc_instants(articles: DataFrame, outlets: DataFrame, staging=staged, keep: tuple[str, ...] = ()) -> DataFrame:
    """(article_id, outlet, published_at, utc_us, zone, zone_from, then the columns of `keep`): one row per article; utc_us is NULL where the text denotes no instant.

    The parsed fields are written once, so that the two passes over them read the small table.
    """
    local = staging(read_local(articles, outlets, keep), "local")
    est = staging(estimate_zones(local, outlets.select(F.col("site_zone").alias("zone"))).select("outlet", F.col("zone").alias("_z")), "zones")
    j = local.join(F.broadcast(est) if est.count() <= BROADCAST_ROWS else est, "outlet", "left")  # one row an outlet
    zone = F.coalesce("_z", "site_zone", F.lit("UTC"))
    how = F.when(F.col("offset_s").isNotNull(), "text").when(F.col("_z") == F.col("site_zone"), "declared").when(F.col("_z").isNotNull(), "estimated").otherwise("declared")
    return j.select("article_id", "outlet", "published_at", F.when(F.col("local_us").isNotNull(), to_instant(F.col("local_us"), F.col("offset_s"), zone)).alias("utc_us"), zone.alias("zone"), how.alias("zone_from"), *keep)
