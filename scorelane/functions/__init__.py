"""Column expressions: missing values, lenient parsing, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks stripped from formatted numbers, and what then counts as a number or a date.
STRIPPED = r"(?U)[,$£€%\s]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\s*(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})"


def finite(c: Column) -> Column:
    """NaN and infinities are missing."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def lenient_number(c: Column) -> Column:
    """A number out of formatted text; null where there is none."""
    bare = F.regexp_replace(c.cast("string"), STRIPPED, "")
    return finite(F.when(bare.rlike(NUMBER), bare.try_cast("double")))


def lenient_days(c: Column) -> Column:
    """Days since 1970 out of ISO or month/day/year text."""
    text = F.when(c.rlike(DATE), F.trim(c))
    parsed = F.coalesce(text.try_cast("timestamp"), F.try_to_timestamp(text, F.lit("M/d/yyyy")), F.try_to_timestamp(text, F.lit("M/d/yy")))
    return epoch_days(parsed)


def epoch_days(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 86_400_000_000.0


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clipped(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(high, F.greatest(low, c)))
