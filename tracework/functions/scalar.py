"""Times, names and values: column expressions only.

Times are timestamps in the session's UTC; arithmetic goes through whole microseconds since the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def moment(us: int | Column) -> Column:
    """The timestamp at some microseconds since the epoch."""
    return F.timestamp_micros(us if isinstance(us, Column) else F.lit(us))


def fraction(seed: str, key: Column) -> Column:
    """A uniform number in [0, 1) from seed and key: the first eight hexadecimal digits of an MD5 over 2 ** 32."""
    return F.conv(F.substring(lot(seed, key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def lot(seed: str, key: Column) -> Column:
    """A string to order by for a seeded draw."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ensure_fractional_seconds(c: Column) -> Column:
    """First space to T; `.000` before the offset of a time without fraction; null stays null."""
    t = F.regexp_replace(c, r"^([^ ]*) ", "$1T")
    added = F.when(t.rlike(r"T\d{2}:\d{2}:\d{2}"), F.regexp_replace(t, r"^(.*T\d{2}:\d{2}:\d{2})(.*)$", "$1.000$2")).otherwise(F.concat(t, F.lit(".000")))
    return F.when(F.instr(t, ".") > 0, t).otherwise(added)


def parse_datetime(c: Column) -> Column:
    """Empty or bad text is null; Z and numeric offsets are understood; without offset it is UTC."""
    return F.when(F.length(F.trim(c)) > 0, F.try_to_timestamp(c))


def format_ms(c: Column) -> Column:
    """ISO text to the millisecond, cut off, without zone."""
    return F.substring(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), 1, 23)


def format_enabled(c: Column) -> Column:
    """ISO text with milliseconds, the empty string for null."""
    return F.coalesce(format_ms(c), F.lit(""))


def format_iso_z(c: Column) -> Column:
    """Seconds precision with a closing Z, as cut folders are named."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def safe_name(c: Column) -> Column:
    """A name fit for a column: other characters than letters and digits become _, none at the ends, `act` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), r"^_+|_+$", "")
    return F.when(F.length(bare) > 0, bare).otherwise("act")


def missing_to_null(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def epoch_seconds(c: Column) -> Column:
    """Text as seconds since the epoch: numbers as they are, times parsed in UTC, anything else null."""
    return F.coalesce(c.try_cast("double"), F.unix_micros(F.try_to_timestamp(c)) / SECOND)
