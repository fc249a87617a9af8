"""Text, number and path functions of the display and audit side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 11th."""
    s = n.cast("string")
    tens = (n % 100).between(10, 20)
    return F.when(tens, F.concat(s, F.lit("th"))).when(n % 10 == 1, F.concat(s, F.lit("st"))).when(n % 10 == 2, F.concat(s, F.lit("nd"))).when(n % 10 == 3, F.concat(s, F.lit("rd"))).otherwise(F.concat(s, F.lit("th")))


def slug(name: Column) -> Column:
    """Lower case; runs of other characters than letters and digits become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def display_name(ticker: Column, name: Column) -> Column:
    return F.when(F.trim(name) != "", F.concat(name, F.lit(" ("), ticker, F.lit(")"))).otherwise(ticker)


def fixed(v: Column, decimals: int) -> Column:
    """A double to so many decimals, by its exact binary value, halves to even, as printf and Python have it: 14.85, which is a little less, is 14.8. (Spark's own format
    rounds the shortest decimal that stands for the double, halves up.) Not finite, or from 2^63 on: as Spark formats it."""
    a, scale = F.abs(v), F.lit(10.0**decimals)
    whole = F.floor(a)
    part = a - whole  # exact
    p = part * scale
    # What the product lost, exactly: each factor in two halves whose products have no rounding (the scale is short enough for one).
    high = part * 134217729.0 - (part * 134217729.0 - part)
    lost = (high * scale - p) + (part - high) * scale
    down = F.floor(p)
    over = ((p - down) - 0.5) + lost
    odd = (down + whole if decimals == 0 else down) % 2 == 1
    n = down + F.when((over > 0) | ((over == 0) & odd), 1).otherwise(0)
    carry = F.floor(n / scale)
    text = (whole + carry).cast("string")
    if decimals:
        text = F.concat(text, F.lit("."), F.lpad((n - carry * int(10.0**decimals)).cast("string"), decimals, "0"))
    signed = F.concat(F.when(v.cast("string").startswith("-"), "-").otherwise(""), text)
    return F.when(a < 9.2e18, signed).otherwise(F.format_string(f"%.{decimals}f", v.cast("double")))


def percent(v: Column, decimals: int = 1) -> Column:
    return F.when(v.isNotNull(), F.concat(fixed(v * 100, decimals), F.lit("%")))


def price(v: Column, decimals: int = 2) -> Column:
    return F.format_number(v, decimals)


def large_currency(v: Column, code: Column) -> Column:
    """USD 149.8bn."""
    a = F.abs(v)
    t = F.when(a >= 1e12, F.concat(fixed(v / 1e12, 1), F.lit("tn"))).when(a >= 1e9, F.concat(fixed(v / 1e9, 1), F.lit("bn"))).when(a >= 1e6, F.concat(fixed(v / 1e6, 1), F.lit("m"))).otherwise(fixed(v, 0))
    return F.when(v.isNotNull(), F.concat_ws(" ", code, t))


def score_text(v: Column) -> Column:
    """11 or 11.5."""
    return F.when(v == F.floor(v), F.format_string("%d", F.floor(v).cast("long"))).when(v.isNotNull(), F.format_string("%.1f", v))


def position_text(position: Column, n: Column, tied: Column, score: Column) -> Column:
    return F.concat(F.format_string("#%d of %d", position, n), F.when(tied, " (tied)").otherwise(""), F.lit(", score "), score_text(score))


def short(c: Column, limit: int = 120) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def criterion_of(reason: Column) -> Column:
    """The criterion that a reason text begins with."""
    return F.nullif(F.regexp_extract(reason, r"^(?:screen: )?([a-z_0-9]+)", 1), F.lit(""))


def without_citations(c: Column) -> Column:
    """Text without bracketed call ids and field paths; doubled spaces and spaces before stops go, line ends stay."""
    c = F.regexp_replace(c, r"[\[(](?:call[_-][A-Za-z0-9]+)(?:[:.,; ]+[A-Za-z0-9_.\[\]-]+)*[\])]", "")
    c = F.regexp_replace(c, r"\bcall[_-][A-Za-z0-9]+\b", "")
    return F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}", " "), r"[ \t]+([.,;:])", "$1")


def sentences(c: Column) -> Column:
    """Sentences: decimals and dotted symbols stay whole."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+(?=[A-Z#\d])"), lambda s: F.trim(s) != "")


def rounding_matches(cited: Column, actual: Column, ceiling: float = 0.05) -> Column:
    """Equal, or within a relative ceiling and a rounding or truncation of the value at 0 to 12 decimals."""
    digits = F.sequence(F.lit(0), F.lit(12))
    near = F.abs(cited - actual) <= ceiling * F.abs(actual)
    scale = lambda d: F.pow(F.lit(10.0), d)
    rounded = F.exists(digits, lambda d: (F.abs(F.rint(actual * scale(d)) / scale(d) - cited) < 1e-12) | (F.abs(F.signum(actual) * F.floor(F.abs(actual) * scale(d)) / scale(d) - cited) < 1e-12))
    return (cited == actual) | (near & rounded)


def compare_cited(cited: Column, actual: Column) -> Column:
    """VERIFIED, UNIT_SCALED (off by a hundred), MISMATCH or UNVERIFIABLE."""
    return F.when(cited.isNull() | actual.isNull(), "UNVERIFIABLE").when(rounding_matches(cited, actual), "VERIFIED").when(rounding_matches(cited / 100, actual) | rounding_matches(cited, actual / 100), "UNIT_SCALED").otherwise("MISMATCH")


def member_hash(tickers: Column) -> Column:
    """Eight hexadecimal digits that name a set of symbols."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(tickers)), ","), 256), 1, 8)
