"""Ticker spellings, as column expressions: index symbols begin with ^ and are left alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions.constants import EXCHANGE_SUFFIX


def clean(ticker: Column) -> Column:
    return F.upper(F.trim(ticker))


def is_index(ticker: Column) -> Column:
    return F.startswith(F.trim(ticker), F.lit("^"))


def to_exchange_symbol(ticker: Column) -> Column:
    """Upper case, trimmed, without the vendor's exchange suffix."""
    t, n = clean(ticker), len(EXCHANGE_SUFFIX)
    return F.when(~is_index(ticker) & F.endswith(t, F.lit(EXCHANGE_SUFFIX)), F.substring(t, F.lit(1), F.length(t) - n)).otherwise(t)


def to_vendor_symbol(ticker: Column) -> Column:
    t = clean(ticker)
    return F.when(is_index(ticker) | F.endswith(t, F.lit(EXCHANGE_SUFFIX)), t).otherwise(F.concat(t, F.lit(EXCHANGE_SUFFIX)))


def matches(ticker: Column, name: Column, needle: str) -> Column:
    """Case-insensitive search in ticker and name."""
    wanted = needle.strip().lower()
    return F.contains(F.lower(ticker), F.lit(wanted)) | F.contains(F.lower(name), F.lit(wanted))
