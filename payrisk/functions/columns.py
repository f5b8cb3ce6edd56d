"""Column expressions. All are built-in functions that stay in generated code."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# The three payment methods and the labels shown for them.
METHOD_LABELS = {
    "Online Transaction": "Online",
    "Chip Transaction": "Chip",
    "Swipe Transaction": "Swipe",
}

# Names of the two sides of a time split.
PAST_LABEL = "TRAIN - Past"
FUTURE_LABEL = "TEST - Future"


def parse_number(text: Column) -> Column:
    """Text to double; anything unreadable becomes NULL.

    A trailing type letter ("1.5d") is readable to the cast but is not a number.
    """
    suffixed = F.rtrim(text).rlike("[0-9.][dDfF]$")
    return F.when(~suffixed, text.try_cast("double"))


def parse_amount(text: Column) -> Column:
    """Transaction amount: only the dollar sign goes, so thousands commas give NULL."""
    return parse_number(F.replace(text, F.lit("$"), F.lit("")))


def parse_money(text: Column) -> Column:
    """Limit, income or debt: dollar sign and thousands commas go."""
    no_sign = F.replace(text, F.lit("$"), F.lit(""))
    return parse_number(F.replace(no_sign, F.lit(","), F.lit("")))


def flag(condition: Column) -> Column:
    """1 where the condition is true; 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def yes_no_label(label: Column) -> Column:
    return flag(label == "Yes").cast("bigint")


def has_error(errors: Column) -> Column:
    """Only spaces are trimmed, so a tab still counts as an error text."""
    return F.when(errors.isNull() | (F.trim(errors) == ""), 0).otherwise(1)


def hour_of_day(time: Column) -> Column:
    return F.hour(time).cast("bigint")


def day_of_week(time: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(time) - 1).cast("bigint")


def month_start(time: Column) -> Column:
    return F.trunc(time.cast("date"), "month").cast("timestamp_ntz")


def ratio(part: Column, whole: Column) -> Column:
    """NULL unless the denominator is above zero."""
    return F.when(whole > 0, part / whole)


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100.0) * part / whole, 4)


def time_literal(value: datetime | str) -> Column:
    """A time without zone; a plain datetime literal would be shifted into the session zone."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def period(time: Column, cutoff: datetime | str) -> Column:
    """Side of the split. A missing time is not before the cut-off, so it is 'future'."""
    return F.when(time < time_literal(cutoff), PAST_LABEL).otherwise(FUTURE_LABEL)


def method_label(method: Column) -> Column:
    """Short name for the known payment methods, anything else unchanged."""
    named = None
    for value, label in METHOD_LABELS.items():
        named = F.when(method == value, label) if named is None else named.when(method == value, label)
    return named.otherwise(method)


def hash_bucket(identifier: Column, method: str = "xxhash64") -> Column:
    """Repeatable bucket 0-99 of an id.

    ``md5`` gives the same bucket in any engine; ``xxhash64`` is cheaper.
    """
    if method == "xxhash64":
        return F.pmod(F.xxhash64(identifier), F.lit(100))
    if method == "md5":
        digest = F.md5(identifier.cast("string").cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100
    raise ValueError(f"unknown bucket method: {method}")


def epoch_micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session zone is."""
    days = F.unix_date(time.cast("date")).cast("bigint")
    within = (F.hour(time) * 3600 + F.minute(time) * 60).cast("bigint") * 1_000_000
    seconds = (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
    return days * MICROS_PER_DAY + within + seconds


def from_epoch_micros(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds)
