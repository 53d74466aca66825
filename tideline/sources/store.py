"""Content-addressed tables: data beside a one-row manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.ledger import content_hash


def manifest(df: DataFrame, event: str, created_at: str) -> DataFrame:
    """rows, time bounds of both clocks and content hash, and how many rows are later than ``created_at``."""
    made = F.lit(created_at).cast("timestamp")
    g = df.agg(F.min(event).alias("first_event"), F.max(event).alias("last_event"), F.min("available_at").alias("first_known"), F.max("available_at").alias("last_known"), F.count_if(F.col("available_at") > made).alias("later"))
    return g.join(content_hash(df)).withColumn("created_at", made)  # one row each


def _read_manifest(spark: SparkSession, path: str):
    try:
        return spark.read.parquet(f"{path}/manifest").first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_snapshot(df: DataFrame, path: str, event: str, created_at: str) -> str:
    """Writes data and manifest; 'unchanged' where equal content is there. Refuses rows later than the
    creation time and any other content in the same place."""
    m = manifest(df, event, created_at)
    new = m.first()
    if new["later"]:
        raise ValueError(f"{new['later']} rows are later than {created_at}")
    old = _read_manifest(df.sparkSession, path)
    if old is not None:
        if old["content_sha"] != new["content_sha"]:
            raise ValueError(f"{path} holds other content")
        return "unchanged"
    df.write.parquet(f"{path}/data")
    m.write.parquet(f"{path}/manifest")
    return "written"


def read_snapshot(spark: SparkSession, path: str, event: str) -> DataFrame:
    """The data after its content has been checked against the manifest."""
    m = _read_manifest(spark, path)
    df = spark.read.parquet(f"{path}/data")
    if m is None or content_hash(df).first()["content_sha"] != m["content_sha"]:
        raise ValueError(f"{path} differs from its manifest")
    return df


def write_bound(df: DataFrame, path: str, bound_to: dict[str, str]) -> None:
    """Writes a table with a manifest that names what it was made from (hashes, revisions)."""
    df.write.parquet(f"{path}/data")
    names = [F.lit(v).alias(k) for k, v in sorted(bound_to.items())]
    content_hash(df).select("content_sha", "rows", *names).write.parquet(f"{path}/manifest")


def read_bound(spark: SparkSession, path: str, bound_to: dict[str, str], as_of: str | None = None, at: str = "available_at") -> DataFrame:
    """Reads such a table if it was made from the same things and holds no row later than ``as_of``."""
    m = _read_manifest(spark, path)
    if m is None or any(m[k] != v for k, v in bound_to.items()):
        raise ValueError(f"{path} was made from something else")
    df = spark.read.parquet(f"{path}/data")
    if content_hash(df).first()["content_sha"] != m["content_sha"]:
        raise ValueError(f"{path} differs from its manifest")
    if as_of is not None and df.where(F.col(at) > F.lit(as_of).cast("timestamp")).limit(1).count():
        raise ValueError(f"{path} holds rows later than {as_of}")
    return df
