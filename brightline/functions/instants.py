"""Instants, calendar dates and clocks as column expressions. Instants are epoch seconds (long) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Athens"


def local_seconds(at: Column, zone: str = ZONE) -> Column:
    """What the zone's wall clock shows at an instant, counted as if it were UTC."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), zone))


def offset_minutes(at: Column, zone: str = ZONE) -> Column:
    return ((local_seconds(at, zone) - at) / 60).cast("int")


def local_date(at: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(at), zone))


def local_day_start(date: Column, zone: str = ZONE, hours: int = 0) -> Column:
    """The instant at which the zone's clock shows the given hour of a calendar date."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(date).cast("long") * 86400 + hours * 3600), zone))


def wall_instant(wall: Column, zone: str = ZONE, offsets: tuple[int, ...] = (7200, 10800)) -> Column:
    """The one instant at which the zone's clock shows wall (seconds as of UTC); null where there is none or more than one."""
    fits = F.filter(F.array(*[wall - o for o in offsets]), lambda i: local_seconds(i, zone) == wall)
    return F.when(F.size(fits) == 1, F.get(fits, F.lit(0)))


def zoned_instant(text: Column) -> Column:
    """Epoch seconds of yyyy-MM-ddTHH:mm:ss with Z or an explicit offset up to 14:00; null for anything else."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"
    zone = F.substring(text, 20, 6)
    minutes = F.when(zone == "Z", F.lit(0)).otherwise(F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))
    signed = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    at = F.unix_seconds(F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return F.when(text.rlike(shape) & (minutes <= 840), at - signed * 60)


def mixed_instant(text: Column) -> Column:
    """Whole epoch seconds, or text as zoned_instant reads it."""
    return F.coalesce(F.when(text.rlike(r"^\d+$"), text.try_cast("long")), zoned_instant(text))


def date_key(text: Column) -> Column:
    """yyyy-MM-dd from a text that holds a year-month-day or a day/month/year, else null."""
    year = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    day = r"(\d{1,2})/(\d{1,2})/(\d{4})"
    part = lambda pattern, i, n: F.lpad(F.regexp_extract(text, pattern, i), n, "0")
    return F.when(text.rlike(year), F.concat_ws("-", part(year, 1, 4), part(year, 2, 2), part(year, 3, 2))).when(
        text.rlike(day), F.concat_ws("-", part(day, 3, 4), part(day, 2, 2), part(day, 1, 2))
    )


def bucket_start(at: Column, width: int, grace: int = 0) -> Column:
    """Start of the latest bucket that began at least grace seconds before."""
    return at - grace - F.pmod(at - grace, F.lit(width))


def compare_spans(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """before, after, equal or indeterminate of two times that are known to lie in closed spans."""
    same = (low_a == low_b) & (high_a == high_b) & (low_a == high_a)
    return F.when(same, "equal").when(high_a < low_b, "before").when(low_a > high_b, "after").otherwise("indeterminate")
