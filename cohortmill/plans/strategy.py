"""Strategies: the declarative queries of the engine, validated before any plan is built."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from ..operators.factors import FACTORS
from ..operators.rank import Cut, FactorSpec
from ..operators.screen import Gates, validate


@dataclass(frozen=True)
class ScreenStrategy:
    id: str
    criteria: tuple[tuple[str, float], ...]
    gating: tuple[str, ...] = ()
    weights: dict = field(default_factory=dict)
    buy: float = 0.0
    sell: float = 0.0

    def __post_init__(self):
        check_id(self.id)
        validate(list(self.criteria))
        if unknown := set(self.gating) - {n for n, _ in self.criteria}:
            raise ValueError(f"gating names no criterion: {sorted(unknown)}")


@dataclass(frozen=True)
class RankStrategy:
    id: str
    factors: tuple[str, ...]
    missing: str = "worst"
    cut: Cut = Cut()
    gates: Gates = Gates()
    screen: str | None = None

    def __post_init__(self):
        check_id(self.id)
        if unknown := [f for f in self.factors if f not in FACTORS]:
            raise ValueError(f"unknown factors: {unknown}")
        if self.missing not in ("worst", "neutral", "exclude"):
            raise ValueError(f"unknown way with missing values: {self.missing}")

    def specs(self) -> list[FactorSpec]:
        return [FactorSpec(f, FACTORS[f].direction, self.missing) for f in self.factors]


def check_id(id_: str) -> None:
    if not re.search(r"_v\d+$", id_):
        raise ValueError(f"{id_}: an id ends in its version, _v<n>")


def next_version(strategy, **updates):
    """A changed copy under the next version of its id."""
    stem, _, n = strategy.id.rpartition("_v")
    return replace(strategy, id=f"{stem}_v{int(n) + 1}", **updates)


def differences(a, b) -> dict:
    """Fields in which two strategies differ: name -> (old, new)."""
    x, y = asdict(a), asdict(b)
    return {k: (x[k], y[k]) for k in x if x[k] != y[k]}


def parse(text: str) -> RankStrategy | ScreenStrategy:
    """A strategy of a JSON text: factors make a rank strategy, criteria a screen."""
    d = json.loads(text)
    if "factors" in d:
        return RankStrategy(d["id"], tuple(d["factors"]), d.get("missing", "worst"), Cut(**d.get("cut", {})), Gates(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.get("gates", {}).items()}), d.get("screen"))
    return ScreenStrategy(d["id"], tuple((k, float(v)) for k, v in d["criteria"].items()), tuple(d.get("gating", ())), d.get("weights", {}), d.get("buy", 0.0), d.get("sell", 0.0))


_FINANCE = ("Financial Services", "Financials")
SCREENS = {
    s.id: s
    for s in (
        ScreenStrategy("conservative_screen_v1", (("min_dividend_yield", 0.015), ("max_payout_ratio_fcf", 0.80), ("min_market_cap", 5e9), ("min_price_momentum", -0.10), ("min_dividend_streak", 10), ("max_debt_to_market_cap", 1.0))),
        ScreenStrategy("magic_value_screen_v1", (("min_roic", 0.12), ("min_market_cap", 5e9))),
        ScreenStrategy("growth_screen_v1", (("min_revenue_cagr", 0.10), ("min_roic", 0.12), ("max_peg_ratio", 2.0), ("min_market_cap", 5e9), ("min_price_momentum", 0.0))),
        ScreenStrategy("growth_screen_v2", (("min_revenue_cagr", 0.10), ("min_roic", 0.12), ("max_peg_ratio", 2.0), ("min_market_cap", 5e9))),
        ScreenStrategy("dividend_aristocrats_v1", (("min_dividend_yield", 0.025), ("max_payout_ratio", 0.75), ("min_market_cap", 1e10), ("min_dividend_growth_streak", 20)), ("min_dividend_growth_streak",)),
    )
}
RANKS = {
    s.id: s
    for s in (
        RankStrategy("conservative_plus_v1", ("low_volatility", "net_payout_yield", "momentum_12m"), gates=Gates(("equity",), 1e9), screen="conservative_screen_v1"),
        RankStrategy("magic_formula_v1", ("roic", "earnings_yield"), screen="magic_value_screen_v1"),
        RankStrategy("magic_formula_momentum_v1", ("roic", "earnings_yield", "momentum_12m"), gates=Gates(("equity",), 5e9, (*_FINANCE, "Utilities")), screen="magic_value_screen_v1"),
        RankStrategy("magic_formula_raw_v1", ("roic", "earnings_yield", "momentum_12m"), gates=Gates(("equity",), 5e9, (*_FINANCE, "Utilities"))),
        RankStrategy("growth_garp_v1", ("revenue_growth", "roic", "earnings_yield", "momentum_12m"), gates=Gates(("equity",), 5e9), screen="growth_screen_v1"),
        RankStrategy("growth_garp_v2", ("revenue_growth", "roic", "earnings_yield", "momentum_12m"), gates=Gates(("equity",), 5e9), screen="growth_screen_v2"),
        RankStrategy("financials_v1", ("price_to_book", "return_on_equity", "momentum_12m"), gates=Gates(("equity",), 5e9, include_sectors=_FINANCE)),
        RankStrategy("etf_dividend_v1", ("distribution_yield", "expense_ratio", "fund_size", "momentum_12m"), "neutral", gates=Gates(("etf",))),
        RankStrategy("etf_growth_v1", ("expense_ratio", "momentum_12m", "fund_size"), "neutral", gates=Gates(("etf",))),
        RankStrategy("etf_core_v1", ("expense_ratio", "fund_size", "momentum_12m"), "neutral", gates=Gates(("etf",))),
    )
}
