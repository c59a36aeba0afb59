"""Date expressions and windows. Times are UTC instants; local days are of a named zone, never of the session's."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

MANILA = "Asia/Manila"


def local_date(ts: Column, zone: str = MANILA) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def iso_date(text: Column, zone: str = MANILA) -> Column:
    """The local date of an ISO text as a string, or its first ten characters where it can't be read."""
    ts = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")])
    return F.coalesce(F.date_format(local_date(ts, zone), "yyyy-MM-dd"), F.substring(text, 1, 10))


def day_window(as_of: dt.datetime, days: int, include_today: bool = True, zone: str = MANILA) -> tuple[dt.date, dt.date]:
    """First and last local day of the last `days` days, ending today or yesterday."""
    last = as_of.astimezone(ZoneInfo(zone)).date() - dt.timedelta(days=0 if include_today else 1)
    return last - dt.timedelta(days=days - 1), last


def utc_bounds(first: dt.date, last: dt.date, zone: str = MANILA) -> tuple[dt.datetime, dt.datetime]:
    """The instants from which (inclusive) to which (exclusive) the local days reach; for filters that reach the scan."""
    z = ZoneInfo(zone)
    return dt.datetime.combine(first, dt.time(), z).astimezone(dt.timezone.utc), dt.datetime.combine(last + dt.timedelta(days=1), dt.time(), z).astimezone(dt.timezone.utc)


def period_days(period: str) -> int:
    """Days of a named period; seven for an unknown name."""
    return {"1d": 1, "7d": 7, "30d": 30}.get(period, 7)


def bounded(value: int, least: int, most: int) -> int:
    """A parameter held within its bounds."""
    return max(least, min(most, value))


def coalesce_formats(text: Column, formats: list[str], zone: str | None = None) -> Column:
    """The first format that reads the text; local times are of the zone (UTC if none)."""
    ts = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return F.to_utc_timestamp(ts, zone) if zone else ts


def published_line(text: Column, zone: str = MANILA) -> Column:
    """ "Published September 3, 2025 5:30pm" and the like, as an instant."""
    s = F.regexp_replace(F.trim(text), r"(?i)^(?:published|updated)[:\s]+(?:on\s+)?", "")
    s = F.regexp_replace(F.upper(s), r"\s*(AM|PM)$", " $1")
    m = F.regexp_replace(s, r"^([A-Z])([A-Z]+)", "$1$2")
    return coalesce_formats(F.initcap(F.lower(m)), ["MMMM d, yyyy h:mm a", "MMM d, yyyy h:mm a", "MMMM d, yyyy", "MMM d, yyyy"], zone)


def kept_or(text: Column, as_of: dt.datetime) -> Column:
    """The text where it holds a day as yyyy-mm-dd, else the time `as_of` (a parameter, never the clock); NULL counts as without."""
    return F.when(text.rlike(r"\d{4}-\d{2}-\d{2}"), text).otherwise(F.lit(as_of.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")))


def rfc2822(text: Column) -> Column:
    """The instant of a pubDate ("Tue, 02 Sep 2025 22:43:35 +0800" or GMT)."""
    months = "JanFebMarAprMayJunJulAugSepOctNovDec"
    p = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}:\d{2}:\d{2})\s+(?:([+-]\d{2}):?(\d{2})|GMT|UTC|Z)$"
    g = lambda i: F.regexp_extract(text, p, i)
    month = F.lpad(((F.instr(F.lit(months), F.initcap(g(2))) + 2) / 3).cast("int").cast("string"), 2, "0")
    zone = F.when(g(5) == "", "+00:00").otherwise(F.concat(g(5), F.lit(":"), g(6)))
    return F.when(text.rlike(p), F.try_to_timestamp(F.concat(g(3), F.lit("-"), month, F.lit("-"), F.lpad(g(1), 2, "0"), F.lit("T"), g(4), zone), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def relative_age(ts: Column, as_of: Column) -> Column:
    """ "2 days ago", "1 hour ago", "just now"."""
    s = (F.unix_seconds(as_of) - F.unix_seconds(ts)).cast("bigint")
    say = lambda unit, name: F.concat(F.floor(s / unit).cast("string"), F.lit(f" {name}"), F.when(F.floor(s / unit) == 1, "").otherwise("s"), F.lit(" ago"))
    steps = [(86400, "day"), (3600, "hour"), (60, "minute")]
    return reduce(lambda acc, x: acc.when(s >= x[0], say(*x)), steps[1:], F.when(s >= 86400, say(86400, "day"))).when(s.isNotNull(), "just now")


def local_format(ts: Column, pattern: str = "MMM d, yyyy h:mm a", zone: str = MANILA) -> Column:
    """A time as it is shown to readers in a zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)


def weekday_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")
