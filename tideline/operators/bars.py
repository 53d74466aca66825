"""Bars with two clocks: when a bar begins and when it can be known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def timeframe_seconds(value: Column) -> Column:
    """Seconds of ``<n><s|m|h|d|w>``; null for anything else."""
    n = F.regexp_extract(value, "^([1-9][0-9]*)[smhdw]$", 1)
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.substring(value, -1, 1))
    return F.when(n != "", n.try_cast("long") * unit)


def bars(ticks: DataFrame, seconds: int, series: Column | str, price: Column | str, at: Column | str = "ts", order: Column | str | None = None) -> DataFrame:
    """series_id, ts, open, high, low, close, volume of each series and bucket; ``order`` picks open and close."""
    t = F.col(at).cast("timestamp") if isinstance(at, str) else at
    start = F.timestamp_seconds(F.floor(F.unix_micros(t) / F.lit(seconds * 1_000_000)) * seconds)
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    p, o = as_col(price), t if order is None else as_col(order)
    rows = ticks.select(as_col(series).alias("series_id"), start.alias("ts"), p.alias("p"), o.alias("o"))
    return rows.groupBy("series_id", "ts").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.count("*").cast("double").alias("volume"))


def shifted(at: Column, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + F.lit(seconds * 1_000_000))


def add_availability(df: DataFrame, seconds: int, latency_s: int) -> DataFrame:
    """A bar's open is known ``latency_s`` after it begins, the bar itself that much after it ends."""
    return df.withColumns({"open_available_at": shifted(F.col("ts"), latency_s), "available_at": shifted(F.col("ts"), seconds + latency_s)})


def closed_as_of(df: DataFrame, as_of: Column) -> DataFrame:
    return df.where(F.col("available_at") <= as_of)


def between(df: DataFrame, start: Column, end: Column, as_of: Column, event: str = "event_time") -> DataFrame:
    """Rows whose event lies in [start, end] and that are known by ``as_of``."""
    return df.where(F.col(event).between(start, end) & (F.col("available_at") <= as_of))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order``."""
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_tl_row")).select(*keys, "_tl_row.*").select(*df.columns)
