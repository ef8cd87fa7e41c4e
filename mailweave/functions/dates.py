"""Date helpers: epoch milliseconds and RFC 2822 ``Date`` headers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# RFC 2822 layouts tried in order after the weekday and any
# comment are removed; named zones are rewritten to their offset first.
RFC2822_PATTERNS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z"]


# Zone names of RFC 2822 and their offsets.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
         "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def from_epoch_millis(c: Column) -> Column:
    """Epoch-ms text → UTC wall-clock timestamp."""
    return F.timestamp_millis(c.try_cast("bigint")).cast("timestamp_ntz")


def parse_rfc2822(c: Column) -> Column:
    """RFC 2822 date text → UTC wall-clock timestamp, null on failure."""
    s = F.regexp_replace(c, r"\([^)]*\)", " ")                 # comments
    s = F.regexp_replace(s, r"^\s*[A-Za-z]{3},", " ")           # weekday
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    zone = F.upper(F.substring_index(s, " ", -1))
    offset = F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), zone)
    s = F.when(offset.isNotNull(), F.concat(F.substr(s, F.lit(1), F.length(s) - F.length(zone)), offset)).otherwise(s)
    tries = [F.try_to_timestamp(s, F.lit(p)) for p in RFC2822_PATTERNS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def rfc2822(ts: Column, offset_minutes: Column | int = 0) -> Column:
    """Format a UTC wall-clock timestamp as an RFC 2822 date in the given
    zone offset (used to land raw fixtures)."""
    off = F.lit(offset_minutes) if isinstance(offset_minutes, int) else offset_minutes
    local = ts + F.make_dt_interval(F.lit(0), F.lit(0), off)
    sign = F.when(off < 0, F.lit("-")).otherwise(F.lit("+"))
    a = F.abs(off)
    zone = F.concat(sign, F.lpad(F.floor(a / 60).cast("string"), 2, "0"), F.lpad((a % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" "), zone)
