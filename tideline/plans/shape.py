"""One way to shape query outputs and their DuckDB twins.

A spec lists columns as ``name`` (as it is), ``name:d`` (double, rounded to 6 places), ``name:t``
(timestamp as epoch seconds) or ``name:i`` (64-bit integer).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans import catalog


def columns(spec: str) -> list[tuple[str, str]]:
    return [(x.partition(":")[0], x.partition(":")[2]) for x in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    kinds = {"d": lambda c: F.round(c.cast("double") + F.lit(1.3e-10), 6) + F.lit(0.0), "t": lambda c: F.floor(F.unix_micros(c) / 1_000_000).cast("long"), "i": lambda c: c.cast("long"), "": lambda c: c}
    return df.select(*[kinds[k](F.col(n)).alias(n) for n, k in columns(spec)])


def shape_sql(body: str, spec: str) -> str:
    kinds = {"d": "round({0}::DOUBLE + 1.3e-10::DOUBLE, 6) + 0.0::DOUBLE AS {0}", "t": "floor(epoch({0}))::BIGINT AS {0}", "i": "{0}::BIGINT AS {0}", "": "{0}"}
    return f"SELECT {', '.join(kinds[k].format(f'"{n}"') for n, k in columns(spec))} FROM ({body})"


def register(name: str, run: Callable, spec: str, sql: str | None = None) -> None:
    """``run(spark, sf_dir)`` and its twin, both shaped by ``spec``."""
    catalog.QUERIES[name] = lambda spark, sf_dir: shape(run(spark, sf_dir), spec)
    if sql is not None:
        catalog.ORACLES[name] = shape_sql(sql, spec)
