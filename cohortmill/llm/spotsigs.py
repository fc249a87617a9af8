"""Document fingerprints by spot signatures, in DataFrame functions only.

A signature is a common word (the anchor) with the chain of the next CHAIN content words after it,
hashed; a text's fingerprint is the set of its signatures, ascending. Common words are fixed lists of function
words; punctuation is taken off and letters lower-cased first. A text of words without such a chain
takes every word as an anchor; a text without words has the hash of the text itself. The empty text
and null have the empty fingerprint. Likeness is the sets' Jaccard similarity; of two empty ones it is 1.

``similar_pairs`` compares fingerprints: equal ones form a class, classes are partitioned by the length of
their sets, only neighbouring partitions meet, on the signatures of a prefix, and pairs whose lengths rule the
threshold out are pruned before the sets are compared.

Extra columns are not read; a null doc_id is kept and counts as the smallest. Rows that repeat are kept; among equal ids the smaller text comes
first. A single document is its own next one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

# Common function words of English, French, German and Spanish; characters taken off words.
ANCHORS = (
    "the of and to in is that for it as was with be by on are at this from an a or not have has had he she they we you i his her its their will would can but if all which one there been were "
    "de la le et les des en un du une que est pour qui dans par sur pas au avec il elle ce se ne plus sont ou "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am noch wie "
    "el y los del las por para con no una su al lo como más pero sus o este sí porque esta entre cuando muy sin"
).split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—"
WHITE = "\t\n\x0b\x0c\r\xa0"
CHAIN = 2


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words without punctuation, in order."""
    plain = F.translate(F.lower(text), WHITE + PUNCTUATION, " " * len(WHITE))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def fingerprint(text: Column) -> Column:
    """The set of a text's spot signatures, ascending: array<int>."""
    text = F.coalesce(text, F.lit(""))
    common = sorted(set(ANCHORS))

    def chains(w: Column) -> Column:
        # Each content word with the word before it.
        spots = F.filter(F.zip_with(F.concat(F.array(F.lit(None).cast("string")), w), w, lambda before, x: F.struct(before.alias("b"), x.alias("x"))), lambda s: s["x"].isNotNull() & ~s["x"].isin(common))
        return let(
            spots,
            lambda s: F.filter(
                F.transform(F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), lambda a, b: F.struct(a["b"].alias("b"), a["x"].alias("x"), b["x"].alias("y"))), lambda t: F.when(t["y"].isNotNull() & t["b"].isin(common), F.hash(t["b"], t["x"], t["y"]))),
                lambda h: h.isNotNull(),
            ),
        )

    def every(w: Column) -> Column:
        return F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.hash(a, b))

    def of(w: Column) -> Column:
        return let(chains(w), lambda c: F.when(F.size(c) > 0, c).when(F.size(w) > 0, every(w)).when(F.length(text) > 0, F.array(F.hash(text))).otherwise(F.array().cast("array<int>")))

    return F.sort_array(F.array_distinct(let(words(text), of)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(both / (F.size(a) + F.size(b) - both), F.lit(0.0)))


def as_text(prints: Column) -> Column:
    return F.array_join(prints.cast("array<string>"), ",")


def similar_pairs(prints: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """prints: (doc_id, prints). (pairs, members): pairs (a, b, likeness) of different fingerprints at ``threshold`` or above, each named by its
    smallest doc_id, and members (doc_id, representative) of every document."""
    named = prints.where(F.size("prints") > 0).withColumn("key", F.sha2(as_text(F.col("prints")), 256))
    classes = named.groupBy("key").agg(F.min("doc_id").alias("representative"), F.any_value("prints").alias("prints"))
    members = named.select("doc_id", "key").join(classes.select("key", "representative"), "key").select("doc_id", "representative")
    n = F.size("prints")
    # Partition p holds lengths from t**-p on: sets of partitions further than one apart cannot reach the threshold.
    part = F.floor(F.log(n) / F.log(F.lit(1 / threshold))).cast("int")
    c = classes.select("representative", "prints", n.alias("n"), part.alias("part"))
    spots = c.select("representative", "n", "part", F.explode(F.slice("prints", F.lit(1), (n - F.ceil(F.lit(threshold) * n) + 1).cast("int"))).alias("spot"))
    x = spots.select(F.col("representative").alias("a"), F.col("n").alias("n_a"), "spot", "part")
    y = spots.select(F.col("representative").alias("b"), F.col("n").alias("n_b"), "spot", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    fits = (F.col("n_b") < F.col("n_a")) | ((F.col("n_a") == F.col("n_b")) & (F.col("b") < F.col("a")))
    pairs = x.join(y, ["spot", "part"]).where(fits & (F.col("n_b") >= F.col("n_a") * threshold)).select("a", "b").distinct()
    sets = c.select("representative", "prints")
    pairs = pairs.join(sets.select(F.col("representative").alias("a"), F.col("prints").alias("p_a")), "a").join(sets.select(F.col("representative").alias("b"), F.col("prints").alias("p_b")), "b")
    pairs = pairs.withColumn("likeness", likeness(F.col("p_a"), F.col("p_b"))).where(F.col("likeness") >= threshold).select("a", "b", "likeness")
    return pairs, members


def with_next(docs: DataFrame, made: dict[str, Column], carried: list[str], groups: int) -> DataFrame:
    """The rows of ``docs`` with the columns ``made``, and next_<name> of the carried columns: those of the next document by descending doc_id; after the last comes the first.

    Ids are cut into ranges of about equal counts; each range is one window, and the first row of a range also ends the range before it."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    d = docs.withColumn("__k", key)
    cuts = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / groups for i in range(1, groups)] or [0.5], 20 * groups)).first()[0]
    if cuts is None:
        return docs.withColumns(made).withColumns({f"next_{c}": F.col(c) for c in carried})
    cuts = sorted(set(cuts), reverse=True)
    span = max(1, int(len(cuts) ** 0.5))
    # How many cuts lie at or above the id: coarse ones first, then those of one span.
    of = lambda v: F.from_json(F.lit("[" + ",".join(map(str, v)) + "]"), "array<bigint>")
    above = lambda a: F.size(F.filter(a, lambda c: c >= F.col("__k")))
    d = d.withColumn("__c", above(of(cuts[span - 1 :: span])) * span)
    d = d.withColumn("__g", (F.col("__c") + above(F.slice(of(cuts), F.col("__c") + 1, F.lit(span)))).cast("int")).drop("__c")
    first = d.groupBy("__g").agg(F.max("__k").alias("k")).orderBy("__g").collect()  # one row for each range
    before = [(r.k, first[i - 1]["__g"]) for i, r in enumerate(first)]
    tails = d.join(F.broadcast(spark.createDataFrame(before, "__h long, __to int")), F.col("__k") == F.col("__h")).withColumn("__g", F.col("__to")).drop("__h", "__to")
    both = d.withColumns(made).withColumn("__tail", F.lit(False)).unionByName(tails.withColumns(made).withColumn("__tail", F.lit(True)))
    w = W.partitionBy("__g").orderBy("__tail", F.desc("__k"), "text")
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where("not __tail").drop("__k", "__g", "__tail")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> fingerprints of each text, and of the text with its second half replaced by the next document's beginning."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d, {"prints": fingerprint(F.col("text"))}, ["text", "prints"], 2 * shuffle_partitions(docs.sparkSession))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "prints", fingerprint(F.col("edited")).alias("edited_prints"), "next_prints")
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("prints")).alias("fingerprint"), as_text(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
