"""Coercion, time, thresholds and schedules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed words that count as true.
TRUE_WORDS = ("true", "1", "yes")
TRUE_WORDS_WIDE = ("true", "1", "yes", "y", "t")


def truthy(x: Column, words: tuple[str, ...] = TRUE_WORDS_WIDE) -> Column:
    """True for a true word, false for any other text, null stays null."""
    return F.lower(F.trim(x.cast("string"))).isin(*words)


def integral(x: Column) -> Column:
    """Non-negative whole number from JSON text, else null (true/false are not numbers)."""
    d = x.try_cast("double")
    return F.when((d >= 0) & (d == F.floor(d)), d.cast("long"))


def whole(x: Column) -> Column:
    """Integer from text that may carry a fraction ('12.0'), null if it is no number."""
    d = x.try_cast("double")
    return F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("long")


def to_utc(text: Column) -> Column:
    """Timestamp from ISO text; a missing zone means UTC (sessions run in UTC)."""
    return text.try_cast("timestamp")


def day_bucket(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def minute_bucket(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def seconds_to_next_day(ts: Column) -> Column:
    """Whole seconds until the next UTC day starts, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.lit(86400) - F.unix_timestamp(ts) % 86400)


def seconds_to_next_minute(ts: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.lit(60) - F.unix_timestamp(ts) % 60)


def capped_backoff(attempt: Column, base: float, limit: float) -> Column:
    """base * 2^(attempt - 1), capped."""
    power = F.greatest(F.lit(0), F.least(attempt - 1, F.lit(62)))
    return F.least(F.lit(limit), F.lit(base) * F.pow(F.lit(2.0), power))


def hybrid_backoff(streak: Column, base: float, factor: float, limit: float, exponential: int = 3) -> Column:
    """Exponential for the first steps, then linear, capped."""
    base, exponential = max(0.1, base), max(1, exponential)
    limit = max(base, limit)
    s = F.greatest(F.lit(0), streak)
    early = F.lit(base) * F.pow(F.lit(float(factor)), F.least(s, F.lit(exponential)))
    late = F.lit(base * factor ** exponential) + (s - exponential) * F.lit(base)
    value = F.when(s == 0, F.lit(base)).when(s <= exponential, early).otherwise(late)
    return F.when(s == 0, F.lit(base)).otherwise(F.least(value, F.lit(limit)))
