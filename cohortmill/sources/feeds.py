"""Feeds whose faults are rows: a broken source is named with its reason, and the job and the other sources go on.

What is asked for is a table (source, required columns aside), so a source that sends nothing is told from one that nobody asked. Lines that cannot be read do not fail a task; they become
their source's fault.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ways a source can fail, and what a run is called that had one of them.
FETCH_ERROR, EMPTY_RESPONSE, MISSING_KEY, OK = "FETCH_ERROR", "EMPTY_RESPONSE", "MISSING_KEY", "OK"
BAD = "__corrupt"


def feed_lines(spark: SparkSession, root: str, sources: list[str]) -> DataFrame:
    """source, line: the lines of all files in a folder for each source below ``root``, in any store that Spark reads. A folder that is not there, or is lost while it is read, gives no lines."""
    out = spark.createDataFrame([], "source string, line string")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for s in sources:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{s}")
        if path.getFileSystem(conf).exists(path):
            files = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").text(f"{root}/{s}")
            out = out.union(files.select(F.lit(s).alias("source"), F.col("value").alias("line")))
    return out


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """(source, line of JSON) -> source, ok, the schema's fields, detail. Blank lines are none. A field of another type than declared makes the line a bad one."""
    full = T.StructType.fromDDL(schema).add(BAD, T.StringType())
    r = F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    p = lines.where(F.trim("line") != "").withColumn("r", r)
    bad = F.col("r").isNull() | F.col(f"r.{BAD}").isNotNull()
    return p.select("source", (~bad).alias("ok"), *[F.when(~bad, F.col(f"r.{n}")).alias(n) for n in full.names if n != BAD], F.when(bad, F.substring("line", 1, 80)).alias("detail"))


def outcomes(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """wanted: (source, has_key); rows of ``parsed``. source, status, n, n_bad, detail: one row for each source asked for.

    Without its key a source is not read: MISSING_KEY. A line that cannot be read, or a source of which nothing came at all, is a FETCH_ERROR; a source of which only blank lines
    came is asked and empty, EMPTY_RESPONSE (``rows`` then has a row of it without ok)."""
    per = rows.groupBy("source").agg(F.count_if("ok").alias("n"), F.count_if(~F.col("ok")).alias("n_bad"), F.min("detail").alias("detail"))
    j = wanted.select("source", "has_key").join(per, "source", "left")
    status = F.when(~F.col("has_key"), MISSING_KEY).when(F.col("n").isNull() | (F.col("n_bad") > 0), FETCH_ERROR).when(F.col("n") == 0, EMPTY_RESPONSE).otherwise(OK)
    why = F.when(status == MISSING_KEY, "no key is set").when(status == FETCH_ERROR, F.coalesce(F.concat(F.lit("cannot be read: "), "detail"), F.lit("nothing came"))).when(status == EMPTY_RESPONSE, "no rows")
    known = F.col("has_key")
    return j.select("source", status.alias("status"), F.when(known, F.coalesce("n", F.lit(0))).otherwise(0).alias("n"), F.when(known, F.coalesce("n_bad", F.lit(0))).otherwise(0).alias("n_bad"), why.alias("detail"))


def gathered(wanted: DataFrame, lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes): the readable rows of sources that have their key, faulty lines left out, and what became of each source."""
    asked = lines.join(wanted.where("has_key").select("source"), "source", "left_semi")
    p = parsed(asked, schema)
    # Sources of which only blank lines came.
    blank = asked.groupBy("source").agg(F.count_if(F.trim("line") != "").alias("k")).where("k = 0").select("source", F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("string").alias("detail"))
    return p.where("ok").drop("ok", "detail"), outcomes(wanted, p.select("source", "ok", "detail").union(blank))


def issues(members: DataFrame, needs: DataFrame, done: DataFrame) -> DataFrame:
    """members: (cohort, ticker); needs: (cohort, source), what a cohort's strategy asks for; done: rows of ``outcomes``. cohort, ticker, degraded, issues array<struct<source, reason,
    detail>> in the order of sources: a name is degraded by a fault of a source that its cohort needs, and by no other."""
    bad = needs.join(done.where(F.col("status") != OK).select("source", F.col("status").alias("reason"), "detail"), "source")
    per = bad.groupBy("cohort").agg(F.array_sort(F.collect_list(F.struct("source", "reason", "detail"))).alias("issues"))  # a strategy's few sources
    none = F.array().cast("array<struct<source:string,reason:string,detail:string>>")
    return members.join(per, "cohort", "left").select("cohort", "ticker", F.col("issues").isNotNull().alias("degraded"), F.coalesce("issues", none).alias("issues"))
