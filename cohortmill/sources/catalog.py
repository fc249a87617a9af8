"""Readers and writers with declared schemas: Parquet, ORC, CSV and JSON; append-only snapshots with additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas


def scratch(spark: SparkSession) -> str:
    """A new folder below the one the session names in ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode, whose tasks
    share the machine; on a cluster an error, for executors could not read what is written there."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cohortmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/catalog-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written below the shared folder and read again: worked out once, and kept when executors are lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Catalog:
    """Resolves table names to DataFrames below a folder of any store that Spark reads; a provider can be chosen for each kind of data."""

    def __init__(self, spark: SparkSession, root: str, providers: dict[str, str] | None = None):
        self.spark, self.root, self.providers = spark, root.rstrip("/"), providers or {}

    def path(self, name: str) -> str:
        p = self.providers.get(name)
        return f"{self.root}/{p}/{name}" if p else f"{self.root}/{name}"

    def read(self, name: str, schema: T.StructType | None = None, fmt: str = "parquet", **options) -> DataFrame:
        schema = schema if schema is not None else getattr(schemas, name.upper(), None)
        r = self.spark.read.format(fmt).options(**options)
        return (r.schema(schema) if schema is not None else r).load(self.path(name))

    def prices(self, start: str, end: str, **options) -> DataFrame:
        """Bars in a range of days without a hole in any of their five values."""
        return self.read("bars", **options).where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).dropna(subset=["open", "high", "low", "close", "volume"])

    def consensus_of(self, names: DataFrame, **options) -> DataFrame:
        """A row for each name; unknown ones are all null."""
        return names.join(self.read("consensus", **options), "ticker", "left")

    def append(self, df: DataFrame, name: str, by: list[str] | None = None) -> None:
        w = df.write.mode("append")
        (w.partitionBy(*by) if by else w).parquet(self.path(name))

    def snapshots(self, snapshot_date: str | None = None, strategy: str | None = None) -> DataFrame:
        """Snapshots of any age: columns added since are null in older files. Date and strategy prune partitions."""
        df = self.spark.read.option("mergeSchema", "true").parquet(self.path("snapshots"))
        for k, v in (("snapshot_date", snapshot_date), ("strategy", strategy)):
            df = df if v is None else df.where(F.col(k) == v)
        return df

    def freeze(self, tables: dict[str, DataFrame], run_id: str) -> None:
        """Writes the inputs of a run for a later replay."""
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.root}/runs/{run_id}/{name}")

    def frozen(self, run_id: str) -> Catalog:
        return Catalog(self.spark, f"{self.root}/runs/{run_id}")


def upgraded(old: DataFrame, schema: T.StructType) -> DataFrame:
    """Old rows under a wider schema; what they lack is null, what they have keeps its value."""
    return old.select(*[F.col(f.name).cast(f.dataType) if f.name in old.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def static_dimension(spark: SparkSession, path: str) -> DataFrame:
    """The fund dimension of a CSV with # comments; short rows pad to null."""
    return spark.read.csv(path, header=True, comment="#", schema=schemas.ETF_STATIC, mode="PERMISSIVE").withColumn("ticker", F.upper(F.trim("ticker")))


def schema_marker(df: DataFrame) -> str:
    """A token of the fields' names and types: a cache entry under another token is a miss."""
    import hashlib

    return hashlib.sha1(",".join(sorted(f"{n}:{t}" for n, t in df.dtypes)).encode()).hexdigest()[:12]
