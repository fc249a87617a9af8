"""Lines and rows of reports, as columns and aggregations over the tables they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import implausible_ticker
from ..functions.display import signed_percent
from ..functions.text import fixed
from .sets import integrity

#: Names listed in a line, at most; closes that make a year of history; columns of a snapshot line from before names were kept.
LISTED, YEAR_CLOSES = 5, 250
OLD_SNAPSHOT = "snapshot_date string, strategy string, universe_id string, ticker string, verdict string"


def screen_status(passed: Column) -> Column:
    return F.when(passed, "PASS").when(~passed, "FAIL").otherwise("NOT-EVAL")


def abstention_reason(note: Column) -> Column:
    """A note without its opening words, up to the first dash."""
    return F.trim(F.get(F.split(F.regexp_replace(note, r"^not evaluated:\s*", ""), " — "), F.lit(0)))


def _names(tickers: Column) -> Column:
    return F.when(F.size(tickers) <= LISTED, F.concat(F.lit(" ("), F.array_join(tickers, ", "), F.lit(")"))).otherwise("")


def basis_lines(rows: DataFrame, primary: str = "fcf", abstained: str = "abstained") -> DataFrame:
    """(criterion, ticker, basis) -> criterion, total, line: the primary basis, then others with few names listed, then what abstained. Names are gathered per basis only where they are few."""
    per = integrity(rows, ["criterion", "basis"], LISTED + 1)
    order = F.when(F.col("basis") == primary, 0).when(F.col("basis") == abstained, 2).otherwise(1)
    cells = F.array_sort(F.collect_list(F.struct(order.alias("o"), "basis", "n", "names")))
    total = per.groupBy("criterion").agg(F.sum("n").alias("total"), cells.alias("cells"))
    show = lambda x: F.concat(x["basis"], F.lit(" "), x["n"].cast("string"), F.when(x["o"] == 2, "").otherwise(F.concat(F.lit("/"), F.col("total").cast("string"))), F.when(x["o"] == 0, "").otherwise(_names(x["names"])))
    return total.select("criterion", "total", F.array_join(F.transform("cells", show), " · ").alias("line"))


def health_line(screen: DataFrame, sources: DataFrame) -> DataFrame:
    """screen: (ticker, criterion, passed); sources: (ticker, source, status), OK where nothing is said. ticker, line."""
    c = screen.groupBy("ticker").agg(F.count("passed").alias("done"), F.array_sort(F.collect_list(F.when(F.col("passed").isNull(), F.col("criterion")))).alias("open"))
    s = sources.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "status"))), lambda x: F.concat_ws(" ", x["source"], x["status"])), " / ").alias("of"), F.bool_or(F.col("status") != "OK").alias("bad"))
    j = c.join(s, "ticker", "left")
    named = F.when(F.size("open") > 0, F.concat(F.lit(" ("), F.array_join("open", ", "), F.lit(")"))).otherwise("")
    line = F.concat(F.when(F.coalesce("bad", F.lit(False)), "DEGRADED").otherwise("OK"), F.lit(": "), F.col("done").cast("string"), F.lit(" evaluated, "), F.size("open").cast("string"), F.lit(" abstained"), named, F.coalesce(F.concat(F.lit("; "), F.col("of")), F.lit("")))
    return j.select("ticker", line.alias("line"))


def contested_label(reasons: Column) -> Column:
    """[CONTESTED: a, b], or nothing."""
    return F.when(F.size(reasons) > 0, F.concat(F.lit("[CONTESTED: "), F.array_join(reasons, ", "), F.lit("]"))).otherwise("")


def divergence_line(ticker: Column, verdict: Column, mean: Column, bucket: Column, disagree: Column, sticky: Column) -> Column:
    flags = F.array_compact(F.array(F.when(disagree, "DISAGREE"), F.when(sticky, "STICKY")))
    return F.concat_ws(" | ", ticker, verdict, F.when(mean.isNull(), "—").otherwise(fixed(mean, 2)), F.coalesce(bucket, F.lit("—")), F.array_join(flags, ", "))


def bucket_line(bucket: Column, n: Column, mean: Column, relative: Column) -> Column:
    """A bucket of the scoreboard: its count, its mean and that against all names."""
    dash = lambda v: F.coalesce(signed_percent(v), F.lit("—"))
    return F.concat(bucket, F.lit(": n="), n.cast("string"), F.lit(" mean "), dash(mean), F.lit(" vs all "), dash(relative))


def rank_sum_cell(rank_sum: Column, n_ranked: Column, lenses: int) -> Column:
    """A rank sum; ‡ where fewer lenses than all have ranked the name."""
    return F.when(rank_sum.isNull(), "—").otherwise(F.concat(rank_sum.cast("string"), F.when(n_ranked < lenses, "‡").otherwise("")))


def band_cell(percentile: Column, note: Column) -> Column:
    """Where a price stands in its own history, or why that is not known; a dash where it was not looked for."""
    return F.when(percentile.isNotNull(), F.concat(fixed(percentile, 1), F.lit(" of its own band"))).when(note.isNotNull(), F.concat(F.lit("not evaluated: "), note)).otherwise("—")


def run_id(at: Column, strategy: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss'Z'"), F.lit("_"), strategy)


def history_present(closes: Column) -> Column:
    """Whether a year of closes is there."""
    return F.coalesce(closes >= YEAR_CLOSES, F.lit(False))


def argument_faults(tokens: DataFrame, universe_id: str | None) -> DataFrame:
    """(ord, token) -> fault: the first token that cannot be a symbol, or tokens beside the id of a universe; no row where all is well."""
    bad = tokens.withColumn("why", implausible_ticker(F.col("token"))).agg(F.min_by(F.when(F.col("why").isNotNull(), F.concat(F.trim("token"), F.lit(": "), F.col("why"))), F.when(F.col("why").isNotNull(), F.col("ord"))).alias("bad"), F.count(F.lit(1)).alias("n"))
    both = F.when((F.col("n") > 0) & F.lit(bool(universe_id)), "either symbols or a universe")
    return bad.select(F.coalesce("bad", both).alias("fault")).where("fault is not null")


def request_faults(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """requests: (request, universe_id or null); tokens: (request, ord, token) -> request, fault: the first token that cannot be a symbol, symbols beside a universe, or neither."""
    why = implausible_ticker(F.col("token"))
    t = tokens.groupBy("request").agg(F.min_by(F.concat(F.trim("token"), F.lit(": "), why), F.when(why.isNotNull(), F.col("ord"))).alias("bad"), F.count(F.lit(1)).alias("n"))
    j = requests.join(t, "request", "left")
    named, given = F.col("universe_id").isNotNull(), F.coalesce("n", F.lit(0)) > 0
    fault = F.coalesce("bad", F.when(named & given, "either symbols or a universe").when(~named & ~given, "symbols or a universe are needed"))
    return j.select("request", fault.alias("fault")).where("fault is not null")


def graded_ids(snapshots: DataFrame) -> DataFrame:
    """Ids of universes that a scoreboard has graded: these are not rewritten."""
    return snapshots.where(F.trim("universe_id") != "").select("universe_id").distinct()


def visible(rows: DataFrame, show_all: bool, hidden: str = "hidden") -> DataFrame:
    return rows if show_all else rows.where(~F.coalesce(F.col(hidden), F.lit(False)))


def digest(rows: DataFrame) -> DataFrame:
    """(source, ticker, verdict; null: no lens ranked it) -> source, verdict, n, buys: the names only of what is rated BUY."""
    v = F.coalesce("verdict", F.lit("NONE"))
    return rows.groupBy("source", v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(v == "BUY", F.col("ticker")))).alias("buys"))


def scores_for(names: DataFrame, scores: DataFrame) -> DataFrame:
    """ticker, score, cell of each name asked for, once: ABSTAIN without enough checks, empty where it was never scored."""
    j = names.select("ticker").distinct().join(scores, "ticker", "left")
    cell = F.when(F.col("score").isNotNull(), F.concat(F.col("score").cast("string"), F.lit("/9"))).when(F.col("computed").isNotNull(), "ABSTAIN").otherwise("")
    return j.select("ticker", "score", cell.alias("cell"))


def repaired(lines: DataFrame) -> DataFrame:
    """Snapshot rows of which some were written as one quoted text: where the symbol is missing and the first field holds commas, the field is read as the row."""
    whole = (F.coalesce(F.trim("ticker"), F.lit("")) == "") & F.col("snapshot_date").contains(",")
    f = F.from_csv("snapshot_date", F.lit(OLD_SNAPSHOT))
    names = [c.split()[0] for c in OLD_SNAPSHOT.split(", ")]
    return lines.select(*[F.when(whole, f[n]).otherwise(F.col(n)).alias(n) for n in names])
