"""Times, labels and exact rounding, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(c: Column) -> Column:
    """Local time without a zone from ``yyyy-MM-dd HH:mm:ss``, padded or not; null where it is no such time."""
    return F.try_to_timestamp(c, F.lit("y-M-d H:m:s")).cast("timestamp_ntz")


def parse_strict_time(c: Column) -> Column:
    """As :func:`parse_time`, and only if formatting the time again gives the same text."""
    t = parse_time(c)
    return F.when(F.date_format(t, "yyyy-MM-dd HH:mm:ss") == c, t)


def parse_epoch(c: Column) -> Column:
    """Seconds from an int, float or numeric string; null and '' and what is no finite number give null."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def epoch_utc8(t: Column) -> Column:
    """Epoch seconds of a local time at UTC+8."""
    return seconds(t) - 8 * 3600


def seconds(t: Column) -> Column:
    """Whole seconds of a local time on its own axis; differences are what matters."""
    return F.unix_timestamp(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")


def round1(x: Column) -> Column:
    """To one decimal, half to even on the exact binary value."""
    return F.call_function("format_number", x.cast("double"), F.lit("0.0")).cast("double")


def date_label(t: Column, text: Column) -> Column:
    """Day of a valid time; else the text's first 10 characters if it has as many; else ``unknown``."""
    return F.coalesce(F.date_format(t, "yyyy-MM-dd"), F.when(F.char_length(text) >= 10, F.substring(text, 1, 10)), F.lit("unknown"))


def month_label(t: Column, text: Column) -> Column:
    return F.coalesce(F.date_format(t, "yyyy-MM"), F.when(F.char_length(text) >= 7, F.substring(text, 1, 7)), F.lit("unknown"))
