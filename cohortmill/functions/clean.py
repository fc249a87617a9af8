"""Tolerant casts, sentinels and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for an absent value.
SENTINELS = ("NA", "N/A", "NONE", "-", "")
#: The vendor's instrument types and the kinds they mean.
KINDS = {"EQUITY": "equity", "ETF": "etf", "MUTUALFUND": "fund"}


def sentinel(c: Column) -> Column:
    """Trimmed text; null for a sentinel in any case."""
    t = F.trim(c)
    return F.when(~F.upper(t).isin(*SENTINELS), t)


def finite(c: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def number(c: Column) -> Column:
    """Sentinel-cleaned text as a finite double, else null."""
    return finite(sentinel(c.cast("string")).try_cast("double"))


def iso_date(c: Column) -> Column:
    """The date that a text begins with, else null."""
    return F.to_date(F.try_to_timestamp(F.substring(F.trim(c), 1, 10), F.lit("yyyy-MM-dd")))


def any_date(c: Column) -> Column:
    """A date in one of several notations, or in milliseconds since 1970."""
    t = F.trim(c)
    tries = [F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy", "dd/MM/yyyy")]
    return F.coalesce(*tries, F.when(t.rlike("^[0-9]{12,13}$"), F.to_date(F.timestamp_millis(t.try_cast("bigint")))), iso_date(t))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def ticker(c: Column) -> Column:
    """Trimmed, upper case, without dots at the end."""
    return F.regexp_replace(F.upper(F.trim(c)), r"\.+$", "")


def holdings_number(c: Column) -> Column:
    """A numeric symbol as spreadsheets show it ('1,211.0') back to its digits."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[0-9][0-9,]*(\.0+)?$"), F.regexp_replace(F.regexp_replace(t, r"\.0+$", ""), ",", "")).otherwise(t)


def implausible_ticker(c: Column) -> Column:
    """Why a token cannot be a symbol; null if it can, or is blank."""
    t = F.trim(c)
    return F.when(t.rlike(r"[/\\]"), "path separator").when(F.lower(t).endswith(".py"), "python file").when(t.startswith("-"), "leading dash")


def asset_kind(quote_type: Column) -> Column:
    """The kind a vendor's type means; an unknown type in lower case; null for none."""
    t = sentinel(quote_type)
    pairs = [F.lit(x) for kv in KINDS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(t)), F.lower(t))


def dividend_yield(v: Column) -> Column:
    """A yield above 1 is a percentage."""
    return F.when(v > 1, v / 100).otherwise(v)


def present(c: Column) -> Column:
    """Not null and not blank; zero is present."""
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def currency(c: Column) -> Column:
    """A code of three letters, upper case, else null."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike("^[A-Z]{3}$"), t)


def converted(value: Column, from_ccy: Column, rate: Column, as_of: Column, to_ccy: str = "EUR") -> Column:
    """struct(value, rate, from_ccy, to_ccy, as_of); null where value, code or a positive rate is missing."""
    code = currency(from_ccy)
    ok = value.isNotNull() & code.isNotNull() & (rate > 0) & ~F.isnan(rate)
    return F.when(ok, F.struct((value * rate).alias("value"), rate.alias("rate"), code.alias("from_ccy"), F.lit(to_ccy).alias("to_ccy"), as_of.alias("as_of")))


def implausible_fields(yield_: Column, cap: Column, debt_to_equity: Column, price_to_book: Column, roe: Column) -> Column:
    """Names of the vendor fields that cannot be true."""
    checks = [(yield_ > 0.15, "dividend_yield"), (cap < 0, "market_cap"), (F.abs(debt_to_equity) > 10000, "debt_to_equity"), (price_to_book > 100, "price_to_book"), (F.abs(roe) > 3, "return_on_equity")]
    return F.array_compact(F.array(*[F.when(c, n) for c, n in checks]))
