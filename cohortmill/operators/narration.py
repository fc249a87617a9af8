"""Checks the claims of narratives against the rank table. A narrative is never rewritten: what contradicts the table is annotated.

A narrative is cut into sentences, these into items at enumeration marks, and items into clauses at commas and semicolons. A clause is a claim's home:
whose row it is held against depends on the names it mentions (``bound``), and what it says is found as spans of characters (``spans``), so that a claim binds only to a subject in
its own noun phrase. Where several readings are open (two names, two factors, two citations, a conjunction between claim and subject) nothing is held
against the table. Rank 1 is the best.

Everything is expressions over clauses; the only exchanges are the look-ups of mentioned names and of their rows, joins on (run, name). ``claims`` has a row for each
claim, with its span, what it says, of whom, and what the table says; ``check`` has one flag for a sentence at most.

Null and empty narratives have no claims. Names are found as words; a name inside a longer dotted one counts as mentioned, as does the longer one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import score_text

# The words of a narrative that make, void or turn a claim.
#: Superlatives: words, counted from the best or the worst, place from there, only with a cited rank beside it.
SUPERLATIVES = (
    ("second worst", "worst", 2, False),
    ("second best", "best", 2, False),
    ("best in cohort", "best", 1, False),
    ("strongest", "best", 1, False),
    ("weakest", "worst", 1, False),
    ("worst", "worst", 1, False),
    ("best", "best", 1, False),
    ("exceptional", "best", 1, True),
    ("outstanding", "best", 1, True),
    ("unmatched", "best", 1, True),
)
HEDGES = "near nearly almost approx\\w* roughly about ~ not never third fourth fifth sixth seventh eighth ninth tenth".split()
BOUNDS = "possible case conceivable imaginable".split()
ARTICLES = "the a an its his her their our any single such".split()
NEGATIVES = "negative negatives bearish downside weakness weaknesses drag drags headwind headwinds detractor detractors drawback drawbacks liability liabilities concern concerns deficit penalty blemish".split()
CONJUNCTIONS = "and or but while whereas versus vs though although yet plus alongside".split()
SCORE_VOIDS = "best worst lowest highest min minimum max maximum theoretical possible average mean median between from range as\\s+low\\s+as as\\s+high\\s+as".split()
SCORE_BETWEEN = "possible conceivable case combined overall total".split()
NOT_NAMES = "ETF ETFS FUND NAV TER AUM USD EUR GBP CHF US UK EU ESG UCITS KIID AI IT ROIC PEG EPS CAGR BUY HOLD SELL".split()
ASSERTING = "received receives got gets was is are rated carries carried earned earns issued assigned scored lands landed sits sat".split()
HYPOTHETICAL = "would could should might may if were unless tier tiers threshold boundary cut band bands either any not never".split()
RANK_WORDS = "rank\\w* scor\\w* position\\w* plac(?:e|ed|es|ing)\\b combined".split()
ORDERING = ("below", "beneath", "behind", r"ahead\s+of", "above", r"outrank\w*", r"outscor\w*", r"trail\w*", r"lag\w*", r"(?:better|worse|weaker|stronger|higher|lower)\s+than")
#: Phrases that name a factor, in the order they are looked for, and the factors they may stand for; phrases given whole are not parts of words.
FACTOR_WORDS: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = (
    (("low volatilit", "volatilit", "volatile"), ("low_volatility",)),
    (("revenue growth", "revenue cagr", "revenue"), ("revenue_growth", "revenue_cagr")),
    (("return on capital", "return on invested capital", "=roic"), ("roic",)),
    (("earnings yield",), ("earnings_yield",)),
    (("net payout", "payout yield"), ("net_payout_yield",)),
    (("price to book", "p/b"), ("price_to_book",)),
    (("return on equity", "=roe"), ("return_on_equity",)),
    (("expense ratio",), ("expense_ratio",)),
    (("fund size",), ("fund_size",)),
    (("momentum",), ("momentum_12m", "momentum_6m")),
)


def one_of(words, start: str = r"\b", end: str = r"\b") -> str:
    return f"{start}(?:{'|'.join(words)}){end}"


def joined(phrase: str) -> str:
    """A phrase whose words may be joined by a space, a hyphen, an underscore or nothing."""
    return rf"\b{phrase[1:]}\b" if phrase[0] == "=" else phrase.replace(" ", r"[-\s_]?")


# The forms of claims, marks and names, over the words above.
ANY = "(?i)"
EMPHASIS = "[*`]+"
POLARITY = ANY + r"\(\s*(?:low|high|lower|higher)\s*(?:=|is)?\s*(?:best|better|worst)\s*\)"
ENUMERATION = ANY + r"\(\s*(?:\d{1,2}|[ivx]{1,4}|[a-h])\s*\)|[•‣▪]"
STOPS = r"(?<!\w)\.|\.(?!\w)|[!?\n]+"
HEDGED = ANY + r"\b(?:" + "|".join(HEDGES) + r")(?:[-\s]+the)?[-\s]?$"
BOUND = ANY + one_of(BOUNDS, r"^[-\s]?")
NEGATIVE = ANY + rf"^[-\s]?(?:(?:{'|'.join(ARTICLES)})[-\s]+){{0,3}}(?:{'|'.join(NEGATIVES)})\b"
CONJUNCTION = ANY + one_of(CONJUNCTIONS)
ORDINAL = ANY + r"\b(\d+)(?:st|nd|rd|th)\b"
CITED = ANY + r"\brank(?:\s+of)?\s+(\d+)(?:\s*(?:out\s+of|/)\s*(\d+))?"
SHARE = r"(?<![\d./])(\d+)\s*/\s*(\d+)(?![\d./])"
COMBINED, LOOSE = ANY + r"combined|rank[-\s]sum", ANY + "in the cohort|overall"
SCORE = ANY + r"\b(?:rank[-\s]sum|(?:combined|overall|total)\s+score)\b[\s:=(]*(?:of|is|at|was|to)?[\s:=(]*(\d+(?:\.\d+)?)"
SCORE_VOID = ANY + rf"\b(?:{'|'.join(SCORE_VOIDS)})(?:[-\s]+(?:{'|'.join(SCORE_BETWEEN)}))*[-\s]*$"
POSSESSIVE = r"\b([A-Z][A-Z0-9]{1,5}(?:\.[A-Z]{1,2})?)'s\b"
VERDICT = r"\b(BUY|HOLD|SELL)\b"
NAME = r"\w+(?:[.\-&^=#]\w+)*"
KEY = ["run", "ticker", "i"]


def spans(text: Column, pattern: str) -> Column:
    """Every match of a pattern: array<struct<start, end, match>>, from 0. What stands between matches gives their places."""
    lens = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    end = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
    step = lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(F.concat(acc, F.array(F.struct((end(acc) + x["gap"]).alias("start"), (end(acc) + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("match")))))
    return F.aggregate(lens, none, step)


def upto(text: Column, at: Column) -> Column:
    return F.substring(text, F.lit(1), at)


def past(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.length(text))


def nonblank(parts: Column) -> Column:
    return F.filter(parts, lambda x: F.trim(x) != "")


def names_in(text: Column) -> Column:
    """Every name a text may mention: its words, and the dotted or hyphened runs of words, whole and in part."""

    def of(run: Column) -> Column:
        parts = F.split(run, r"[.\-&^=#]")
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 1)))
        n = F.size(parts)
        return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(a, n), lambda b: F.substring(run, F.element_at(ends, a) + 1, F.element_at(ends, b + 1) - F.element_at(ends, a) - 1))))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), of)))


def sentences_of(narratives: DataFrame) -> DataFrame:
    """(run, ticker, narrative) -> run, ticker, i, sentence, parsed: without emphasis and notes of a factor's direction.

    Reading narratives costs far more than their bytes tell, by which tasks are cut; so they are dealt over all the tasks of a shuffle."""
    narratives = narratives.repartition(int(narratives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run", "ticker")
    parts = F.filter(F.transform(F.split("narrative", STOPS, -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    s = narratives.select("run", "ticker", F.posexplode(parts).alias("i", "sentence"))
    return s.withColumn("parsed", F.regexp_replace(F.regexp_replace("sentence", EMPHASIS, ""), POLARITY, ""))


def units(sentences: DataFrame) -> DataFrame:
    """run, ticker, i, level (item or clause), no, text: what names are bound in. Clauses are numbered through a sentence."""
    items = nonblank(F.split("parsed", ENUMERATION, -1))
    clauses = F.flatten(F.transform(items, lambda x: nonblank(F.split(x, "[,;]", -1))))
    of = lambda level, texts: sentences.select(*KEY, F.lit(level).alias("level"), F.posexplode(texts).alias("no", "text"))
    return of("item", items).unionByName(of("clause", clauses))


def bound(parts: DataFrame, ranked: DataFrame, ranks: DataFrame) -> DataFrame:
    """Each unit with the row it is held against: the only other name that it mentions, if it does not mention its own too; else, if it mentions no other, its own.
    Units of open attribution are left out. Adds subject, n, position, score, verdict, factors (map), named: whether the subject is mentioned."""
    named = parts.withColumn("names", names_in(F.col("text")))
    members = ranked.select("run", F.col("ticker").alias("name"))
    met = named.select(*KEY, "level", "no", F.explode("names").alias("name")).where("name <> ticker").join(members, ["run", "name"], "left_semi")
    others = met.groupBy(*KEY, "level", "no").agg(F.count(F.lit(1)).alias("k"), F.min("name").alias("other"))
    u = named.join(others, [*KEY, "level", "no"], "left")
    own = F.array_contains("names", F.col("ticker"))
    u = u.withColumn("subject", F.when(F.col("k").isNull(), F.col("ticker")).when((F.col("k") == 1) & ~own, F.col("other"))).withColumn("named", F.col("k").isNotNull() | own)
    factors = ranks.groupBy("run", "ticker").agg(F.map_from_entries(F.collect_list(F.struct("factor", "rank"))).alias("factors"))  # a strategy's few factors
    rows = ranked.select("run", "ticker", "n", "position", F.col("combined").alias("score"), F.upper("verdict").alias("verdict")).join(factors, ["run", "ticker"], "left").withColumnRenamed("ticker", "subject")
    return u.where("subject is not null").drop("k", "other", "names").join(rows, ["run", "subject"]).where("n >= 1")


def superlative(text: Column, cited: Column) -> Column:
    """The earliest superlative that claims a rank: struct(start, end, from_best, k). Hedged, negated and relative ones and bounds do not; on a negative noun, one of
    the good side counts from the worst, and one of the bad side is open, and left out."""
    found = []
    for o, (words, side, k, only_cited) in enumerate(SUPERLATIVES):
        pattern = ANY + words.replace(" ", r"[-\s]")
        at, match = F.regexp_instr(text, F.lit(pattern)) - 1, F.regexp_substr(text, F.lit(pattern))
        before, after = upto(text, at), past(text, at + F.length(match))
        turned = after.rlike(NEGATIVE)
        claim = F.struct(at.alias("start"), F.lit(o).alias("o"), (at + F.length(match)).alias("end"), (~turned if side == "best" else F.lit(False)).alias("from_best"), F.lit(k).alias("k"))
        ok = (at >= 0) & ~before.rlike(HEDGED) & ~after.rlike(BOUND)
        ok = ok if side == "best" else ok & ~turned
        found.append(F.when(ok & cited if only_cited else ok, claim))
    return F.array_min(F.array_compact(F.array(*found)))


def place(claim: Column, n: Column) -> Column:
    return F.when(claim["from_best"], claim["k"]).otherwise(n + 1 - claim["k"])


def binds(text: Column, a: Column, b: Column) -> Column:
    """No conjunction stands between two spans."""
    first, second = F.when(a["start"] <= b["start"], a["end"]).otherwise(b["end"]), F.greatest(a["start"], b["start"])
    return ~F.when(second > first, F.substring(text, first + 1, second - first)).otherwise("").rlike(CONJUNCTION)


def about(text: Column, vocabulary) -> tuple[Column, Column]:
    """(subject, k): the rank a clause speaks of, struct(rank, start, end, kind), and how many factors it names. The first factor of the vocabulary that is named, whether or not
    the row has a rank of it; without one, the combined place, if it is spoken of as such, or loosely beside the name."""
    seen, subject = [], None
    span = lambda pattern: (F.regexp_instr(text, F.lit(pattern)) - 1, F.length(F.regexp_substr(text, F.lit(pattern))))

    def struct(rank: Column, pattern: str, kind: Column) -> Column:
        at, size = span(pattern)
        return F.struct(rank.cast("int").alias("rank"), at.alias("start"), (at + size).alias("end"), kind.alias("kind"))

    for phrases, keys in vocabulary:
        pattern = ANY + "|".join(map(joined, phrases))
        hit = text.rlike(pattern)
        seen.append(hit.cast("int"))
        rank = F.coalesce(*[F.try_element_at("factors", F.lit(k)) for k in keys])
        cell = struct(F.rint(rank), pattern, F.lit(keys[0]))
        subject = F.when(hit, cell) if subject is None else subject.when(hit, cell)
    combined = struct(F.col("position"), COMBINED, F.lit("combined"))
    loose = struct(F.col("position"), LOOSE, F.lit("combined"))
    subject = subject.when(text.rlike(COMBINED), combined).when(text.rlike(LOOSE) & F.col("named"), loose)
    return F.when(subject["rank"].isNotNull(), subject), reduce(lambda a, b: a + b, seen)


def citations(text: Column, subject: Column) -> Column:
    """Cited ranks, array<struct<r, m>>: `rank r out of m`; without one, `r/m` where m is the cohort's size and the clause has a subject."""
    of = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, 1).try_cast("bigint").alias("r"), F.coalesce(F.regexp_extract(m, pattern, 2).try_cast("bigint"), F.col("n").cast("bigint")).alias("m")))
    shares = F.filter(of(SHARE), lambda x: (x["m"] == F.col("n")) & x["r"].between(F.lit(1), F.col("n")))
    return F.when(F.size(of(CITED)) > 0, of(CITED)).when(subject.isNotNull(), shares).otherwise(F.array().cast("array<struct<r:bigint,m:bigint>>"))


def cell(kind: str, span: Column, said: Column, actual: Column, about_: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), text(said).alias("said"), text(actual).alias("actual"), about_.alias("about"))


def claims(narratives: DataFrame, ranked: DataFrame, ranks: DataFrame, vocabulary=FACTOR_WORDS) -> DataFrame:
    """(run, ticker, narrative); ranked: run, ticker, n, position, combined, verdict; ranks: run, ticker, factor, rank.

    A row for each claim that binds: run, ticker, i, level, no, text, subject, kind (cited, superlative, ordinal, score, verdict), start, end, said, actual, about,
    contradicts. A claim without a subject, or of open binding, is no row."""
    u = bound(units(sentences_of(narratives)), ranked, ranks)
    t = F.col("text")
    c = u.where("level = 'clause'")
    subject, k = about(t, vocabulary)
    c = c.withColumn("topic", subject).withColumn("topics", k)
    c = c.withColumn("cites", citations(t, F.col("topic")))
    c = c.withColumn("best", superlative(t, F.size("cites") == 1))
    topic, best, one = F.col("topic"), F.col("best"), F.col("cites")[0]
    alone = topic.isNotNull() & (F.col("topics") <= 1)
    cited = F.when(best.isNotNull() & (F.size("cites") == 1), cell("cited", best, place(best, one["m"]), one["r"], F.coalesce(topic["kind"], F.lit("cited rank"))))
    said = F.when(best.isNotNull() & (F.size("cites") == 0) & alone & binds(t, best, topic), cell("superlative", best, place(best, F.col("n")), topic["rank"], topic["kind"]))
    ordinals = F.filter(spans(t, ORDINAL), lambda x: ~upto(t, x["start"]).rlike(HEDGED))
    c = c.withColumn("ordinals", ordinals)
    nth = F.col("ordinals")[0]
    number = F.when((F.size("ordinals") == 1) & alone & binds(t, nth, topic), cell("ordinal", nth, F.regexp_extract(nth["match"], ORDINAL, 1).try_cast("bigint"), topic["rank"], topic["kind"]))
    size = F.size("factors")

    def counts(x: Column) -> Column:
        before = upto(t, x["start"])
        owner = F.regexp_extract(F.right(before, F.lit(60)), POSSESSIVE, 1)
        value = F.regexp_extract(x["match"], SCORE, 1).try_cast("double")
        other = (owner != "") & (owner != F.col("subject")) & ~owner.isin(*NOT_NAMES)
        return F.col("score").isNotNull() & (size > 0) & ~before.rlike(SCORE_VOID) & ~other & value.between(size, size * F.col("n"))

    sums = F.transform(F.filter(spans(t, SCORE), counts), lambda x: cell("score", x, F.regexp_extract(x["match"], SCORE, 1).try_cast("double"), F.col("score").cast("double"), F.lit("rank-sum")))
    keep = [*KEY, "level", "no", "text", "subject"]
    rows = c.select(*keep, F.explode(F.concat(F.array_compact(F.array(cited, said, number)), F.coalesce(sums, F.array().cast("array<struct<kind:string,start:int,end:int,said:string,actual:string,about:string>>")))).alias("x"))
    # A verdict is read over an item: the name and the verdict may stand in different clauses of it.
    v = u.where((F.col("level") == "item") & (F.col("subject") != F.col("ticker")) & (F.col("verdict") != ""))
    v = v.where(t.rlike(ANY + one_of(ASSERTING)) & ~t.rlike(ANY + one_of(HYPOTHETICAL)))
    v = v.select(*keep, F.explode(F.transform(spans(t, VERDICT), lambda x: cell("verdict", x, x["match"], F.col("verdict"), F.lit("verdict")))).alias("x"))
    numbers = F.abs(F.col("x.said").try_cast("double") - F.col("x.actual").try_cast("double")) > 1e-9
    return rows.unionByName(v).select(*keep, "x.*", F.when(F.col("x.kind") == "verdict", F.col("x.said") != F.col("x.actual")).otherwise(numbers).alias("contradicts"))


def ordered_ties(sentences: DataFrame, ties: DataFrame) -> DataFrame:
    """Sentences that order a name against one it is tied with: run, ticker, i, partner, score. ties: run, ticker, partners, combined.

    In one clause: a word of rank or score, a comparison that is not hedged, and after it the partner."""
    s = sentences.join(ties.select("run", "ticker", "partners", "combined"), ["run", "ticker"])

    def partner(clause: Column) -> Column:
        targets = F.transform(F.filter(spans(clause, ANY + one_of(ORDERING)), lambda x: ~upto(clause, x["start"]).rlike(HEDGED)), lambda x: past(clause, x["end"]))
        named = F.transform(targets, lambda after: F.get(F.filter("partners", lambda p: F.rlike(after, F.concat(F.lit(r"(?<![\w.])\Q"), p, F.lit(r"\E(?!\w)")))), F.lit(0)))
        return F.when(clause.rlike(ANY + "|".join(RANK_WORDS)), named).otherwise(F.array().cast("array<string>"))

    found = F.get(F.array_compact(F.flatten(F.transform(F.split("parsed", "[,;]", -1), partner))), F.lit(0))
    return s.withColumn("partner", found).where("partner is not null").select(*KEY, "partner", F.col("combined").alias("tied_at"))


def check(narratives: DataFrame, ranked: DataFrame, ranks: DataFrame, vocabulary=FACTOR_WORDS, ties: DataFrame | None = None) -> DataFrame:
    """run, ticker, i, sentence, kind (rank, verdict or tie; null: nothing to say), reason, annotation: for every sentence, one flag at most.

    A contradicted rank or score comes before another name's verdict, and that before the order of a tied pair. A sentence that a narrative repeats is annotated once."""
    s = sentences_of(narratives)
    bad = claims(narratives, ranked, ranks, vocabulary).where("contradicts")
    order = F.struct((F.col("kind") == "verdict").alias("late"), "no", F.array_position(F.array(*map(F.lit, ("cited", "superlative", "ordinal", "score", "verdict"))), F.col("kind")).alias("o"), "start")
    first = bad.groupBy(*KEY).agg(F.min_by(F.struct("kind", "subject", "said", "actual"), order).alias("x"))
    j = s.join(first, KEY, "left")
    if ties is not None:
        j = j.join(ordered_ties(s, ties), KEY, "left")
    else:
        j = j.withColumns({"partner": F.lit(None).cast("string"), "tied_at": F.lit(None).cast("double")})
    kind = F.when(F.col("x.kind") == "verdict", "verdict").when(F.col("x").isNotNull(), "rank").when(F.col("partner").isNotNull(), "tie")
    j = j.withColumn("kind", kind).withColumn("quoted", F.regexp_replace("sentence", r"\s+", " "))
    once = j.where("kind is not null").groupBy("run", "ticker", "quoted").agg(F.min("i").alias("first"))
    j = j.join(once, ["run", "ticker", "quoted"], "left").withColumn("kind", F.when(F.col("i") == F.col("first"), F.col("kind")))
    verb = F.when(F.col("x.kind").isin("ordinal", "score"), "cited").otherwise("said")
    what = F.when(F.col("x.kind") == "score", "score").when(F.col("kind") == "verdict", "verdict").otherwise("rank")
    tie_score = score_text(F.col("tied_at"))
    reason = F.when(F.col("kind").isin("rank", "verdict"), F.concat(what, F.lit(": "), verb, F.lit(" "), F.col("x.said"), F.lit(", is "), F.col("x.actual"))).when(F.col("kind") == "tie", F.concat(F.lit("tie: with "), "partner", F.lit(" at "), tie_score))
    # The texts of annotations.
    head = F.concat(F.lit('[⚠ narration check: "'), "quoted", F.lit('" '))
    note = (
        F.when(F.col("kind") == "rank", F.concat(head, F.lit("contradicts rank table — table is authoritative]")))
        .when(F.col("kind") == "verdict", F.concat(head, F.lit("misstates "), F.col("x.subject"), F.lit("'s verdict — it says "), F.col("x.said"), F.lit(", the table says "), F.col("x.actual"), F.lit("; table is authoritative]")))
        .when(F.col("kind") == "tie", F.concat(head, F.lit("orders a TIED pair — tied with "), "partner", F.lit(" at combined rank-sum "), tie_score, F.lit("; the verdict split on the alphabetical tie-break, not a score difference — table is authoritative]")))
    )
    return j.select(*KEY, "sentence", "kind", reason.alias("reason"), note.alias("annotation"))


def annotated(narratives: DataFrame, checked: DataFrame) -> DataFrame:
    """Narratives with their annotations on lines below, in order; others as they are."""
    a = checked.where("annotation is not null").groupBy("run", "ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "annotation"))), lambda x: x["annotation"]), "\n").alias("notes"))
    out = F.when(F.col("notes").isNotNull(), F.concat(F.regexp_replace("narrative", r"\s+$", ""), F.lit("\n"), "notes")).otherwise(F.col("narrative"))
    return narratives.join(a, ["run", "ticker"], "left").withColumn("narrative", out).drop("notes")
