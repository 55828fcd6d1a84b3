"""Date/time column expressions (D1-D6).  The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DOW = "^(?i)\\s*(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\\s*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_lit(value: str) -> Column:
    return F.to_timestamp(F.lit(value))


# Zone names of RFC 822 (fixed values).
_ZONES = (("GMT|UTC|UT|Z", "+0000"), ("EDT", "-0400"), ("EST|CDT", "-0500"), ("CST|MDT", "-0600"),
          ("MST|PDT", "-0700"), ("PST", "-0800"))


def parse_published(raw) -> Column:
    """RFC-822 (numeric zone, zone name or none, two- or four-digit year) or
    ISO-8601 (date and time with or without seconds, fraction and zone, or the
    date alone); without a zone the time is UTC; NULL when none parses.  Spark
    cannot parse a day-of-week, so it is removed first."""
    raw = F.trim(_c(raw))
    rfc = F.regexp_replace(raw, _DOW, "")
    rfc = F.regexp_replace(rfc, "^(\\d{1,2}[ -][A-Za-z]{3})[a-z]*[ -](?=[0-6]\\d[ ,])", "$1 20")
    rfc = F.regexp_replace(rfc, "^(\\d{1,2}[ -][A-Za-z]{3})[a-z]*[ -](?=[7-9]\\d[ ,])", "$1 19")
    for names, offset in _ZONES:
        rfc = F.regexp_replace(rfc, f"\\s+\\(?(?:{names})\\)?$", f" {offset}")
    iso = F.regexp_replace(raw, "^(\\d{4}-\\d{2}-\\d{2})[Tt ](?=\\d)", "$1T")
    return F.coalesce(
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm[:ss][ Z]")),
        F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][.SSS][XXX][XX]")),
        F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")),
    )


def coalesce_published(published, updated) -> Column:
    """D1 order: the published date if usable, else the updated date."""
    return F.coalesce(parse_published(published), parse_published(updated))


def age_hours(ts, as_of) -> Column:
    """D3: hours from ``ts`` to ``as_of`` (negative for future dates)."""
    return (F.unix_micros(_c(as_of)) - F.unix_micros(_c(ts))) / F.lit(3.6e9)


def minute_stamp(ts) -> Column:
    """``yyyy-MM-dd HH:mm``; '' when missing."""
    return F.coalesce(F.date_format(_c(ts), "yyyy-MM-dd HH:mm"), F.lit(""))


def long_date(ts) -> Column:
    """E.g. ``Wednesday, 31 January 2024``."""
    return F.date_format(_c(ts), "EEEE, dd MMMM yyyy")


def day_start(ts) -> Column:
    """UTC midnight of the instant."""
    return F.date_trunc("day", _c(ts))


def iso_seconds(ts) -> Column:
    """Stable text form used in query outputs."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")
