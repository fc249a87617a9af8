"""Claims of narratives against rank tables: hand-checked sentences of every kind, true, false and open."""

import pytest
from pyspark.sql import functions as F

from cohortmill.operators import narration, rank

# run -> cohort: name -> (position, rank-sum, verdict, ranks)
COHORTS = {
    "power": (10, {"SO": (2, 12.0, "buy", {"low_volatility": 2.0, "net_payout_yield": 4.0, "momentum_12m": 6.0}), "DUK": (1, 9.0, "buy", {"low_volatility": 1.0, "net_payout_yield": 3.0, "momentum_12m": 5.0})}),
    "funds": (5, {"AAA.DE": (4, 10.0, "hold", {"expense_ratio": 5.0, "fund_size": 2.0, "momentum_12m": 3.0}), "BBB.DE": (4, 10.0, "sell", {"expense_ratio": 2.0, "fund_size": 3.0, "momentum_12m": 5.0}), "CCC": (1, 6.5, "buy", {"expense_ratio": 1.0, "fund_size": 1.5, "momentum_12m": 4.0})}),
    "wide": (21, {"GG": (4, 17.0, "buy", {"roic": 9.0, "momentum_12m": 2.0, "earnings_yield": 6.0}), "MM": (5, 17.0, "hold", {"roic": 5.0, "momentum_12m": 8.0, "earnings_yield": None})}),
}
# (run, name, narrative, flagged sentences)
CASES = [
    # cited ranks
    ("power", "SO", "A rank of 2 out of 10 makes it the second-worst of all.", [0]),
    ("power", "SO", "Rank 2 out of 10, so second best. It is rank 9 out of 10, second worst.", []),
    ("power", "SO", "The name is rank 2/10 and rank 3/10, the worst.", []),
    ("power", "SO", "Momentum 6/10 is exceptional.", [0]),
    ("power", "DUK", "Low volatility 1/10 is exceptional. Momentum 5/7 is outstanding. In 5/10 it is unmatched.", []),
    ("power", "SO", "An exceptional momentum of 40%.", []),
    # superlatives
    ("power", "SO", "It shows the best-in-cohort low volatility.", [0]),
    ("power", "DUK", "It shows the best-in-cohort low volatility. Its volatility is strongest.", []),
    ("power", "SO", "It is the second-least-volatile name. Third from the bottom on momentum.", []),
    ("power", "SO", "Its volatility is near-best. Its momentum is not the best. Its momentum is third-best. The worst possible momentum is 10.", []),
    ("power", "SO", "Its momentum is near-*best*. `Momentum` is **not** the best.", []),
    ("power", "SO", "`momentum_12m` is the **best** of all.", [0]),
    ("power", "SO", "SO is the best name in the cohort.", [0]),
    ("power", "SO", "The best name in the cohort is not safe. The strongest names overall fall too.", []),
    ("power", "SO", "It has the best combined rank-sum.", [0]),
    ("power", "DUK", "It has the best combined rank-sum of 9.", []),
    ("funds", "CCC", "expense_ratio is the best, momentum_12m is second-worst, fund_size is second best.", []),
    ("funds", "CCC", "expense_ratio is second-best, momentum_12m is second-worst.", [0]),
    ("funds", "AAA.DE", "Its worst cost rank and middling momentum rank give a low place.", []),
    ("funds", "AAA.DE", "Its momentum and fund size are the best.", []),
    ("funds", "AAA.DE", "Expense ratio (low best) weighs on it. Fund size (high = best) helps. The expense ratio (lower is better) is the best.", [2]),
    # polarity
    ("funds", "AAA.DE", "The expense ratio (rank 5/5) is the strongest negative signal. Expense ratio rank 5/5 is its strongest single drag.", []),
    ("funds", "AAA.DE", "Momentum rank 3/5 is the strongest headwind.", [0]),
    ("funds", "AAA.DE", "Momentum rank 3/5 is its worst headwind. The expense ratio rank 5/5 is the worst drag.", []),
    ("funds", "AAA.DE", "The expense ratio is its strongest weakness. Momentum is the strongest drag.", [1]),
    # ordinals
    ("power", "SO", "4th on net payout, 6th on momentum_12m, 2nd on volatility.", []),
    ("power", "SO", "4th on momentum_12m, 2nd on volatility.", [0]),
    ("power", "SO", "It is 3rd or 4th on momentum. About 3rd on momentum. It is 9th on something.", []),
    ("power", "SO", "It sits 2nd on the combined list. It sits 3rd overall. SO sits 3rd overall.", [2]),
    ("power", "SO", "Growth of 31.4% ranks it 5th on momentum! All well", [0]),
    ("wide", "MM", "It is 4th on earnings_yield.", []),  # no rank of it
    # enumerations
    ("wide", "GG", "Three cautions: (1) the combined sum places it 4th (2) momentum_12m is rank 2 out of 21, second-best (iii) ROIC 9th.", []),
    ("wide", "GG", "Cautions: (1) the combined sum places it 4th (2) momentum_12m is 3rd.", [0]),
    # other names
    ("wide", "GG", "MM is 5th on roic. The equally scored MM received HOLD. MM would have been a BUY. MM sits in the SELL tier.", []),
    ("wide", "GG", "MM is 9th on roic. GG and MM are 5th on roic.", [0]),
    ("wide", "GG", "The equally scored MM, which did well, received BUY. GG received SELL.", [0]),
    ("funds", "CCC", "AAA.DE is 5th on expense ratio and AAA.DE was rated HOLD. BBB.DE was rated HOLD.", [1]),
    # scores
    ("funds", "CCC", "It carries a combined rank-sum 6. Its overall score is 6.5. Its rank-sum of 6.5 leads. A rank-sum of 60 is beyond all.", [0]),
    ("funds", "CCC", "The worst possible rank-sum = 15. The average rank-sum is 9. QQQ's rank-sum of 8 is higher. The ETF's combined score of 8 is good.", [3]),
    ("funds", "CCC", "AAA.DE has a rank-sum of 10. AAA.DE has a rank-sum of 9.5.", [1]),
    # ties
    ("funds", "AAA.DE", "It ranks decisively ahead of BBB.DE. Its fee is lower than BBB.DE's. It shares rank 4 with BBB.DE. It ranks nearly above BBB.DE.", [0]),
    ("funds", "BBB.DE", "BBB.DE and AAA.DE both score lower than CCC. It scores lower than AAA.DE.", [1]),
    ("power", "SO", "It ranks below DUK.", []),
    # repeats and edges
    ("power", "SO", "Its momentum is  the best. Fine. Its momentum is the best.", [0]),
    ("power", "SO", None, []),
    ("power", "SO", "", []),
    ("power", "GONE", "Its momentum is the best.", []),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows, ranks, said = [], [], []
    for i, (run, name, narrative, _) in enumerate(CASES):
        n, names = COHORTS[run]
        said.append((f"{i}", name, narrative))
        for t, (position, score, verdict, f) in names.items():
            rows.append((f"{i}", t, n, score, position, verdict))
            ranks += [(f"{i}", t, k, v) for k, v in f.items()]
    ranked = spark.createDataFrame(rows, "run string, ticker string, n int, combined double, position int, verdict string")
    return spark.createDataFrame(said, "run string, ticker string, narrative string"), ranked, spark.createDataFrame(ranks, "run string, ticker string, factor string, rank double")


def test_every_case(spark, tables):
    said, ranked, ranks = tables
    got = {}
    for r in narration.check(said, ranked, ranks, ties=rank.boundary_ties(ranked)).where("kind is not null").collect():
        got.setdefault(int(r.run), []).append(r.i)
    wrong = [(CASES[i][2], sorted(got.get(i, []))) for i, c in enumerate(CASES) if sorted(got.get(i, [])) != c[3]]
    assert wrong == []


def test_claims_carry_spans(spark, tables):
    said, ranked, ranks = tables
    rows = narration.claims(said, ranked, ranks).collect()
    words = {"ordinal": lambda s: s[0].isdigit(), "score": lambda s: "s" in s.lower(), "verdict": lambda s: s in ("BUY", "HOLD", "SELL"), "cited": str.islower, "superlative": lambda s: s.lower() == s}
    assert {r.kind for r in rows} == set(words)
    assert all(words[r.kind](r.text[r.start : r.end]) for r in rows)
    x = {(r.run, r.i, r.kind): r for r in rows}
    i = str(next(i for i, c in enumerate(CASES) if (c[2] or "").startswith("4th on momentum")))
    assert (x[i, 0, "ordinal"].said, x[i, 0, "ordinal"].about, x[i, 0, "ordinal"].subject) in {("4", "momentum_12m", "SO"), ("2", "low_volatility", "SO")}


def test_annotations(spark, tables):
    said, ranked, ranks = tables
    checked = narration.check(said, ranked, ranks, ties=rank.boundary_ties(ranked))
    out = {int(r.run): r.narrative for r in narration.annotated(said, checked).collect()}
    assert len(out) == len(CASES)
    at = lambda start: next(i for i, c in enumerate(CASES) if (c[2] or "").startswith(start))
    i = at("`momentum_12m` is")
    assert out[i] == CASES[i][2] + '\n[⚠ narration check: "`momentum_12m` is the **best** of all" contradicts rank table — table is authoritative]'
    i = at("The equally scored MM, which")
    assert out[i].endswith("received BUY\" misstates MM's verdict — it says BUY, the table says HOLD; table is authoritative]")
    i = at("BBB.DE and AAA.DE both")
    assert out[i].endswith('"It scores lower than AAA.DE" orders a TIED pair — tied with AAA.DE at combined rank-sum 10; the verdict split on the alphabetical tie-break, not a score difference — table is authoritative]')
    assert out[at("Its momentum is  the best")].count("narration check") == 1
    assert all(out[i] == c[2] for i, c in enumerate(CASES) if not c[3])


def test_spans(spark):
    t = "ab 12 cd 3"
    r = spark.createDataFrame([(t,), ("x",), ("",), (None,), ("7",)], "t string").select("t", narration.spans(F.col("t"), r"\d+").alias("s")).collect()
    assert [[(x.start, x.end, x.match) for x in y.s or []] for y in r] == [[(3, 5, "12"), (9, 10, "3")], [], [], [], [(0, 1, "7")]]
    n = spark.createDataFrame([("Of BRK-B and A.B.C: x",)], "t string").select(narration.names_in(F.col("t")).alias("n")).first().n
    assert {"Of", "BRK-B", "BRK", "B", "and", "A.B.C", "A.B", "B.C", "A", "C", "x"} == set(n)
