"""Display functions: rows and phrases of reports as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fixed, large_currency, ordinal, percent, score_text

#: Words that do not name a company.
FILLER = ("the", "inc", "inc.", "corp", "corp.", "co", "co.", "ltd", "ltd.", "plc", "ag", "sa", "nv", "se", "group", "holding", "holdings", "company", "class", "a", "b")
PERCENT_FIELDS = ("dividend_yield", "roic", "earnings_yield", "revenue_growth", "momentum_12m", "momentum_6m", "return_on_equity", "payout_ratio", "low_volatility")


def short_reason(reason: Column) -> Column:
    """A reason without its prefix, with shorter numbers and 'vs' for 'against'."""
    c = F.regexp_replace(reason, r"^(?:screen|gate): ", "")
    c = F.regexp_replace(c, r"(\d+\.\d{2})\d+", "$1")
    return F.regexp_replace(c, r"\bagainst\b", "vs")


def brand_token(company: Column) -> Column:
    """The first word of a name that is not filler, lower case."""
    return F.get(F.filter(F.split(F.lower(F.trim(company)), r"[\s,]+"), lambda w: (w != "") & ~w.isin(*FILLER)), F.lit(0))


def suspect_mapping(shown: Column, company: Column) -> Column:
    """Whether the name that a symbol resolves to lacks the brand that was asked for; unknown is not suspect."""
    return F.coalesce(~F.contains(F.lower(shown), brand_token(company)), F.lit(False))


def factor_value(name: Column, value: Column, currency: Column) -> Column:
    """A factor's value by the kind of its field."""
    return (
        F.when(value.isNull(), "n/a").when(name.isin(*PERCENT_FIELDS), percent(value)).when(name == "piotroski_f_score", F.concat(fixed(value, 0), F.lit("/9")))
        .when(name.isin("market_cap", "fund_size"), large_currency(value, currency)).when(name == "valuation_band_percentile", F.concat(ordinal(F.rint(value).cast("int")), F.lit(" percentile"))).otherwise(fixed(value, 2))
    )


def signed_percent(value: Column) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise(""), percent(value))


def fee_gloss(fee: Column) -> Column:
    """What a fee in percent costs a year for each 1000 held."""
    return F.when(fee.isNotNull(), F.concat(F.lit("about "), fixed(fee * 10, 2), F.lit(" a year per 1,000 held")))


def explain(ticker: Column, ranks: Column, combined: Column, seq: Column, n: Column) -> Column:
    """ranks: array of struct(factor, rank)."""
    parts = F.array_join(F.transform(ranks, lambda x: F.concat(x["factor"], F.lit(" "), score_text(x["rank"]))), " + ")
    return F.concat(ticker, F.lit(": "), parts, F.lit(" = "), score_text(combined), F.format_string(", #%d of %d", seq, n))


def integrity_entry(tag: Column, names: Column, limit: int = 5) -> Column:
    """'tag: n (A, B)' with the names where they are few."""
    return F.concat(tag, F.lit(": "), F.size(names).cast("string"), F.when(F.size(names) <= limit, F.concat(F.lit(" ("), F.array_join(names, ", "), F.lit(")"))).otherwise(""))


def boundary_note(ticker: Column, score: Column, partners: Column) -> Column:
    return F.concat(ticker, F.lit(" shares score "), score_text(score), F.lit(" with "), F.array_join(partners, ", "), F.lit(" under another verdict"))


def glyphs(checks: Column) -> Column:
    """Nine checks in order: P point, - none, ? not known."""
    return F.array_join(F.transform(checks, lambda c: F.when(c, "P").when(~c, "-").otherwise("?")), "")


def f_score_cell(score: Column, computed: Column) -> Column:
    """A score, or why there is none; never 0 for unknown."""
    return F.when(score.isNotNull(), F.concat(score.cast("string"), F.lit("/9"))).otherwise(F.concat(F.lit("ABSTAIN ("), computed.cast("string"), F.lit(" of 9 computable)")))


def csv_line(*columns: Column) -> Column:
    """One CSV line, quoted where needed; null is empty."""
    q = lambda c: F.coalesce(F.when(c.cast("string").rlike("[\",\n]"), F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), '"', '""'), F.lit('"'))).otherwise(c.cast("string")), F.lit(""))
    return F.concat_ws(",", *map(q, columns))


def trimmed(cells: Column) -> Column:
    """An array of cells without the blank ones at its end."""
    last = F.aggregate(F.transform(cells, lambda c, i: F.when(F.trim(c) != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(cells, F.lit(1), last)


def run_cost(n: Column, per_run: float = 0.19) -> Column:
    return n * per_run
