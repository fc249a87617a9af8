"""Symbols as people write them, and small code tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fixed

#: Exchange names and the suffix of their symbols; names of United States venues, which take none; countries and their codes.
SUFFIXES = {"LSE": "L", "LON": "L", "XETRA": "DE", "ETR": "DE", "FRA": "F", "EPA": "PA", "AMS": "AS", "BIT": "MI", "BME": "MC", "SWX": "SW", "STO": "ST", "CPH": "CO", "HEL": "HE", "OSL": "OL", "TSE": "T", "TYO": "T", "HKG": "HK", "ASX": "AX", "TSX": "TO"}
US_VENUES = ("NYSE", "NASDAQ", "AMEX", "ARCA", "BATS", "OTC")
COUNTRIES = {"IRELAND": "IE", "LUXEMBOURG": "LU", "GERMANY": "DE", "FRANCE": "FR", "UNITED STATES": "US", "UNITED KINGDOM": "GB", "SWITZERLAND": "CH"}


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def parse_ticker(cell: Column) -> Column:
    """The symbol in a free cell such as 'NYSE: BRK.B / ETR: 1BR' or 'Sony (TSE 6758)': a United States venue wins and takes a dash for
    a dot; else the first venue that is known gives the suffix; else a bare symbol is taken as it stands; null if there is none."""
    t = F.upper(F.trim(cell))
    venues = "|".join([*US_VENUES, *SUFFIXES])
    us = F.regexp_extract(t, r"\b(?:" + "|".join(US_VENUES) + r")\s*[:\s]\s*([A-Z0-9][A-Z0-9.\-]*)", 1)
    venue = F.regexp_extract(t, r"\b(" + "|".join(SUFFIXES) + r")\s*[:\s]\s*([A-Z0-9][A-Z0-9.\-]*)", 1)
    symbol = F.regexp_extract(t, r"\b(" + "|".join(SUFFIXES) + r")\s*[:\s]\s*([A-Z0-9][A-Z0-9.\-]*)", 2)
    bare = F.regexp_extract(F.trim(F.get(F.split(t, "/"), F.lit(0))), r"^([A-Z0-9][A-Z0-9.\-]{0,11})$", 1)
    abroad = F.concat(symbol, F.lit("."), F.try_element_at(_table(SUFFIXES), F.nullif(venue, F.lit(""))))
    return F.when(us != "", F.regexp_replace(us, r"\.", "-")).when(venue != "", abroad).when(~t.rlike(rf"^(?:{venues})$"), F.nullif(bare, F.lit("")))


def query_symbol(ticker: Column) -> Column:
    """The vendor's name of the German exchange."""
    return F.regexp_replace(ticker, r"\.DE$", ".XETRA")


def country_code(name: Column) -> Column:
    """A country's code; an unknown name passes through."""
    return F.coalesce(F.try_element_at(_table(COUNTRIES), F.upper(F.trim(name))), F.trim(name))


def compact_amount(v: Column) -> Column:
    """4172812800 to 4.17bn: three significant digits."""
    a = F.abs(v)
    unit = F.when(a >= 1e12, "tn").when(a >= 1e9, "bn").when(a >= 1e6, "m").when(a >= 1e3, "k").otherwise("")
    x = v / F.when(a >= 1e12, 1e12).when(a >= 1e9, 1e9).when(a >= 1e6, 1e6).when(a >= 1e3, 1e3).otherwise(1.0)
    digits = F.when(F.abs(x) >= 100, fixed(x, 0)).when(F.abs(x) >= 10, fixed(x, 1)).otherwise(fixed(x, 2))
    plain = F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
    return F.when(v.isNotNull(), F.concat(plain, unit))


def scan_key(name: Column) -> Column:
    """struct(date, rerun) of a file name such as scan_2026-01-05_r2.csv, for ordering."""
    return F.struct(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1).alias("date"), F.coalesce(F.regexp_extract(name, r"_r(\d+)\b", 1).try_cast("int"), F.lit(0)).alias("rerun"))


def is_transient(error: Column) -> Column:
    """Whether an error text speaks of something that may pass."""
    return F.coalesce(F.lower(error).rlike("timed? ?out|rate limit|too many requests|429|temporar|connection (?:reset|aborted|refused)|50[234]"), F.lit(False))
