"""Appends that happen once: a run's rows count from the moment its manifest is published, and a run has one manifest.

Each attempt writes a folder of its own; nothing of it is read until the manifest of its run names it. A manifest is created exclusively, after the rows are there, so a rerun, a
second attempt at the same time and a killed job add nothing twice and nothing by half. Readers join the manifests, a small row for each run, with the rows' partition columns, which
prunes what was never committed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "run string, attempt string, n long"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """run, attempt, n of every committed run."""
    p, fs = _fs(spark, f"{root}/commits")
    return spark.read.schema(MANIFEST).json(f"{root}/commits") if fs.exists(p) else spark.createDataFrame([], MANIFEST)


def write_attempt(df: DataFrame, root: str, run: str) -> tuple[str, int]:
    """Writes the rows of an attempt, which nobody reads yet: its name, and how many they are, counted while they are written."""
    from pyspark.sql import Observation

    attempt, seen = uuid.uuid4().hex, Observation()
    path = f"{root}/rows/run={run}/attempt={attempt}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(path)
    return attempt, seen.get["n"]


def publish(spark: SparkSession, root: str, run: str, attempt: str, n: int) -> bool:
    """Commits an attempt, unless its run has been committed: whether it was. The manifest is written aside and renamed to its place, which fails where there is one."""
    jvm = spark.sparkContext._jvm
    draft, fs = _fs(spark, f"{root}/drafts/{attempt}.json")
    place, _ = _fs(spark, f"{root}/commits/{run}.json")
    out = fs.create(draft)
    out.write(bytearray((json.dumps({"run": run, "attempt": attempt, "n": n}) + "\n").encode()))
    out.close()
    fs.mkdirs(place.getParent())
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(draft), fs.makeQualified(place), kinds)
    except Exception as e:  # noqa: BLE001
        if "already exist" in str(e) or "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def append_once(df: DataFrame, root: str, run: str) -> bool:
    """Appends ``df`` as the rows of ``run``, a name safe in paths; a run that has been committed is left as it is. Whether rows were added."""
    spark = df.sparkSession
    p, fs = _fs(spark, f"{root}/commits/{run}.json")
    if fs.exists(p):
        return False
    attempt, n = write_attempt(df, root, run)
    done = publish(spark, root, run, attempt, n)
    if not done:
        path, fs = _fs(spark, f"{root}/rows/run={run}/attempt={attempt}")
        fs.delete(path, True)
    return done


def committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """run and the rows of all committed runs."""
    p, fs = _fs(spark, f"{root}/rows")
    full = T.StructType.fromDDL(schema)
    if not fs.exists(p):
        return spark.createDataFrame([], T.StructType([T.StructField("run", T.StringType()), *full.fields]))
    wide = T.StructType([*full.fields, T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType())])
    rows = spark.read.schema(wide).parquet(f"{root}/rows")
    return rows.join(manifests(spark, root).select("run", "attempt"), ["run", "attempt"], "left_semi").select("run", *full.names)
