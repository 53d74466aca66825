"""Backward as-of joins on availability, as one union, one sort and one window over time buckets of a panel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def asof(left: DataFrame, right: DataFrame, columns: list[str], tolerance_s: float | None = None, keys: list[str] | None = None, at: str = "available_at", suffix: str = "__available_at", bucket_s: int = 86_400) -> DataFrame:
    """``left`` with the latest ``right`` row known at its ``at``, exact matches included.

    Each column comes with its provenance ``<column><suffix>``; both are null when the match
    is older than the tolerance. Right rows sort before left rows of the same time. No ``keys`` at all means one right
    side for all left rows, which is not copied for each of them.

    Time buckets are the second key, so one long series is dealt over many tasks. With a tolerance, buckets are at least as long and each
    right row also stands in the next one. Without, each bucket with left rows gets the last right row before it (:func:`carried`).
    """
    keys = ["series_id"] if keys is None else keys
    clash = set(left.columns) & {x for c in columns for x in (c, c + suffix)}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    us = max(bucket_s, math.ceil(tolerance_s or 0)) * 1_000_000
    bucket = F.floor(F.unix_micros(F.col(at)) / us)
    hit = F.struct(F.col(at).alias("at"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    own = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*keys, bucket.alias("_tl_b"), F.col(at).alias("_tl_at"), F.lit(1).alias("_tl_side"), own.alias("_tl_left"))
    r = right.where(F.col(at).isNotNull()).select(*keys, bucket.alias("_tl_b"), F.col(at).alias("_tl_at"), F.lit(0).alias("_tl_side"), hit.alias("_tl_hit"))
    if tolerance_s is None:
        r = r.unionByName(carried(l, r, keys))
    else:
        r = r.withColumn("_tl_b", F.explode(F.array("_tl_b", F.col("_tl_b") + 1)))
    w = W.Window.partitionBy(*keys, "_tl_b").orderBy("_tl_at", "_tl_side").rowsBetween(W.Window.unboundedPreceding, 0)
    d = l.unionByName(r, allowMissingColumns=True).withColumn("_tl_hit", F.last("_tl_hit", ignorenulls=True).over(w)).where("_tl_side = 1")
    fresh = F.lit(True) if tolerance_s is None else (F.unix_micros("_tl_at") - F.unix_micros("_tl_hit.at")) <= int(tolerance_s * 1_000_000)
    out = [F.when(fresh, F.col(f"_tl_hit.v{i}")).alias(c) for i, c in enumerate(columns)] + [F.when(fresh, F.col("_tl_hit.at")).alias(c + suffix) for c in columns]
    return d.select("_tl_left.*", *out)


def carried(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each bucket of ``left`` the last row of ``right`` in a bucket before it; only bucket ends, a row per bucket, meet in one task."""
    ends = right.groupBy(*keys, "_tl_b").agg(F.max_by("_tl_hit", "_tl_at").alias("_tl_hit")).withColumn("_tl_side", F.lit(1))
    starts = left.select(*keys, "_tl_b").distinct().withColumn("_tl_side", F.lit(0))
    w = W.Window.partitionBy(*keys).orderBy("_tl_b", "_tl_side").rowsBetween(W.Window.unboundedPreceding, 0)
    d = starts.unionByName(ends, allowMissingColumns=True).withColumn("_tl_hit", F.last("_tl_hit", ignorenulls=True).over(w)).where("_tl_side = 0 AND _tl_hit IS NOT NULL")
    return d.select(*keys, "_tl_b", F.col("_tl_hit.at").alias("_tl_at"), "_tl_side", "_tl_hit")


def on_venues(left: DataFrame, venues: DataFrame, name: str = "venue") -> DataFrame:
    """A ``left`` row for each of the distinct ``venues`` (a declared list's length): one row with their list goes to all tasks."""
    listed = venues.agg(F.collect_set(name).alias("_tl_venues"))
    return left.crossJoin(listed).withColumn(name, F.explode("_tl_venues")).drop("_tl_venues")


def ambiguous(right: DataFrame, keys: list[str], at: str = "available_at") -> DataFrame:
    """Keys and times that more than one right row claims, and null times: contract violations."""
    return right.groupBy(*keys, at).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | F.col(at).isNull())


def spread_bps(close: Column, other: Column) -> Column:
    return (F.try_divide(close, other) - 1) * 10_000


def premium(local: Column, global_: Column, stable: Column) -> Column:
    """local / (global * stable) - 1, null where that is not finite."""
    return F.try_divide(local, global_ * stable) - 1


def first_available(candidates: DataFrame, order: list[str], venue: str = "venue", keys: list[str] | None = None) -> DataFrame:
    """The rows of each key's first venue, in the declared order, that has any."""
    keys = keys or ["series_id"]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(venue))
    best = candidates.where(rank > 0).groupBy(*keys).agg(F.min(rank).alias("_tl_best"))
    return candidates.join(best, keys).where(rank == F.col("_tl_best")).drop("_tl_best")


def with_cache(left: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Feature columns of ``cache`` on equal keys; the row becomes known when all its parts are."""
    clash = (set(left.columns) & set(cache.columns)) - {*keys, "available_at"}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    c = cache.withColumnRenamed("available_at", "_tl_cache_at")
    d = left.join(c, keys, "left")
    return d.withColumn("available_at", F.greatest("available_at", "_tl_cache_at")).drop("_tl_cache_at")
