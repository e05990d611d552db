"""Years, stamps and waiting times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.identity import stripped

# Plausible years of a publication, the longest wait that a server may ask for.
FIRST_YEAR, LAST_YEAR, MOST_WAIT = 1500, 2100, 30.0


def leading_year(*texts: Column) -> Column:
    """The first plausible four-digit year that opens one of the texts."""
    def one(c: Column) -> Column:
        y = F.try_to_number(F.nullif(F.regexp_extract(c, r"^\s*([0-9]{4})(?![0-9])", 1), F.lit("")), F.lit("9999")).cast("int")
        return F.when(y.between(FIRST_YEAR, LAST_YEAR), y)

    return F.coalesce(*[one(c) for c in texts])


def first_year(*years: Column) -> Column:
    """The first plausible one of several numbers."""
    return F.coalesce(*[F.when(y.between(FIRST_YEAR, LAST_YEAR), y) for y in years])


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def retry_after(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for, from 0 to 30; null if it is absent or says neither seconds
    nor an HTTP date."""
    text = stripped(header)
    seconds = F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), text.cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC)$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, F.unix_micros(date.cast("timestamp")) / 1e6 - F.unix_micros(now.cast("timestamp")) / 1e6)
    return F.when(wait.isNotNull() & ~F.isnan(wait), F.least(F.greatest(wait, F.lit(0.0)), F.lit(MOST_WAIT)))


def backoff(base: Column, attempt: Column, asked: Column) -> Column:
    """What the server asked for, else the base doubled for each attempt (from 0)."""
    return F.coalesce(asked, base * F.pow(F.lit(2.0), attempt))
