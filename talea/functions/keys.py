"""Keys, days and normal forms shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def account_key(c: Column | str) -> Column:
    """Surrounding spaces and tabs removed, upper case; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.btrim(c, F.lit(" \t"))), F.lit(""))


def utc_day(c: Column | str) -> Column:
    """The UTC day of a timestamp, whatever the session's time zone."""
    us = F.unix_micros(F.col(c) if isinstance(c, str) else c)
    return F.date_from_unix_date(((us - F.pmod(us, F.lit(DAY_US))) / DAY_US).cast("int"))


def utc_month(c: Column | str) -> Column:
    """The first day of the UTC month of a timestamp."""
    return F.trunc(utc_day(c), "month")


def plain_text(c: Column | str) -> Column:
    """Trimmed of spaces; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def number(c: Column | str, scale: int = 6) -> Column:
    """A decimal(38, scale) from text with sign, exponent, leading zeros or commas between thousands.

    Null where the text is no number or has more digits than fit.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.trim(c), ",", "").try_cast(f"decimal(38,{scale})")
