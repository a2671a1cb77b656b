"""Timestamps with offsets, in column arithmetic: days may overflow their month and roll on, which Spark's own parsers refuse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?$"


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01; a day beyond its month counts on into the next."""
    y = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468


def civil_from_days(z: Column) -> tuple[Column, Column, Column]:
    """Year, month and day."""
    z = z + 719468
    era = F.floor(z / 146097)
    doe = z - era * 146097
    yoe = F.floor((doe - F.floor(doe / 1460) + F.floor(doe / 36524) - F.floor(doe / 146096)) / 365)
    doy = doe - (yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100))
    mp = F.floor((doy * 5 + 2) / 153)
    day, month = doy - F.floor((mp * 153 + 2) / 5) + 1, F.when(mp < 10, mp + 3).otherwise(mp - 9)
    return yoe + era * 400 + F.when(month <= 2, 1).otherwise(0), month, day


def parse_iso(s: Column) -> tuple[Column, Column]:
    """(milliseconds since the epoch, offset in minutes); null for what isn't a timestamp."""
    at = lambda i, n: F.substring(s, i, n).try_cast("long")
    y, mo, d = at(1, 4), at(6, 2), at(9, 2)
    timed, has_seconds = F.length(s) > 10, F.substring(s, 17, 1) == ":"
    h, mi = F.when(timed, at(12, 2)).otherwise(0), F.when(timed, at(15, 2)).otherwise(0)
    sec = F.when(has_seconds, at(18, 2)).otherwise(0)
    # What follows the seconds, or the minutes if there are none: a fraction and a zone, one or both.
    fraction = F.when(F.substring(s, 20, 1) == ".", F.rpad(F.regexp_extract(s, r"\.([0-9]{1,3})", 1), 3, "0").try_cast("long")).otherwise(0)
    zone = F.when(timed & s.rlike("[+-][0-9:]+$"), F.regexp_extract(s, "T.*?([+-][0-9:]+)$", 1)).otherwise("")
    digits = F.replace(F.substring(zone, 2, 5), F.lit(":"), F.lit(""))
    minutes = F.left(digits, F.lit(2)).try_cast("long") * 60 + F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("long"), F.lit(0))
    offset = F.when(zone == "", 0).when(zone.startswith("-"), -minutes).otherwise(minutes)
    ok = s.rlike(ISO) & mo.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (sec <= 59)
    total = ((days_from_civil(y, mo, d) * 24 + h) * 60 + mi - offset) * 60000 + sec * 1000 + fraction
    return F.when(ok, total.cast("long")), F.when(ok, offset.cast("int"))


def format_millis(ms: Column, offset: Column) -> Column:
    """ISO 8601 in local time with its offset, Z for none; milliseconds only if there are any. Years outside 0 to 9999 are clamped."""
    ms = F.greatest(F.least(ms, F.lit(253402300799999)), F.lit(-62167219200000))
    local = F.greatest(F.least(ms + offset * 60000, F.lit(253402300799999)), F.lit(-62167219200000))
    days = F.floor(local / 86400000)
    rest = local - days * 86400000
    y, mo, d = civil_from_days(days)
    pad = lambda x, n=2: F.lpad(x.cast("long").cast("string"), n, "0")
    clock = F.concat(pad(F.floor(rest / 3600000)), F.lit(":"), pad(F.floor(rest / 60000) % 60), F.lit(":"), pad(F.floor(rest / 1000) % 60))
    part = rest % 1000
    fraction = F.when(part > 0, F.concat(F.lit("."), pad(part, 3))).otherwise("")
    zone = F.when(offset == 0, "Z").otherwise(F.concat(F.when(offset < 0, "-").otherwise("+"), pad(F.floor(F.abs(offset) / 60)), F.lit(":"), pad(F.abs(offset) % 60)))
    return F.concat(pad(y, 4), F.lit("-"), pad(mo), F.lit("-"), pad(d), F.lit("T"), clock, fraction, zone)


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def month_name(m: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in MONTHS)), m.cast("int") - 1)
