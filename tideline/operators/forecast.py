"""Forecast contexts, pluggable forecast columns and their alignment to rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tideline.operators.features import ordered

FORECAST = T.StructType([T.StructField("point", T.ArrayType(T.DoubleType())), T.StructField("q", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])


def contexts(df: DataFrame, column: str, length: int, stride: int, least: int) -> DataFrame:
    """Rows (series_id, ts, available_at, pos, n, context): the trailing values at every stride-th origin
    that has ``least`` rows; contexts that hold a null are left out."""
    d = df.withColumns({"pos": (F.row_number().over(ordered()) - 1).cast("long"), "n": F.count("*").over(W.Window.partitionBy("series_id"))})
    frame = ordered().rowsBetween(-length + 1, 0)
    d = d.withColumn("context", F.collect_list(column).over(frame)).withColumn("_tl_all", F.count("*").over(frame))
    return d.where((F.col("pos") >= least - 1) & ((F.col("pos") - (least - 1)) % stride == 0) & (F.size("context") == F.col("_tl_all"))).select("series_id", "ts", "available_at", "pos", "n", "context")


def zero(horizon: int) -> Column:
    return F.struct(F.array_repeat(F.lit(0.0), horizon).alias("point"), F.create_map(F.lit("0.5"), F.array_repeat(F.lit(0.0), horizon)).alias("q"))


def mean(horizon: int) -> Column:
    m = F.aggregate("context", F.lit(0.0), lambda a, x: a + x) / F.size("context")
    return F.struct(F.array_repeat(m, horizon).alias("point"), F.create_map(F.lit("0.5"), F.array_repeat(m, horizon)).alias("q"))


def plugin(predict: Callable[[list, int], list], horizon: int) -> Callable[[Column], Column]:
    """A forecast column from ``predict(contexts, horizon)``, which returns (point, quantiles) per context; it
    runs on Arrow batches."""

    @F.pandas_udf(FORECAST)
    def run(x: pd.Series) -> pd.DataFrame:
        got = predict([list(v) for v in x], horizon)
        return pd.DataFrame({"point": [list(p) for p, _ in got], "q": [{str(k): list(v) for k, v in q.items()} for _, q in got]})

    return run


def origin_features(forecasts: DataFrame) -> DataFrame:
    """First, last and summed point of each origin's forecast, and of its median."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    p, q = F.col("forecast.point"), F.col("forecast.q")["0.5"]
    return forecasts.select("series_id", "ts", p[0].alias("point_1"), F.element_at(p, -1).alias("point_last"), total(p).alias("point_sum"), q[0].alias("q50_1"), total(q).alias("q50_sum"))


def aligned_features(rows: DataFrame, forecasts: DataFrame, stride: int, horizon: int) -> DataFrame:
    """Step k of an origin serves the row k - 1 places after it, until the next origin: the step's
    value, the sum of the remaining horizon and the forecast's age in bars. Rows become known when both the row and the origin are."""
    last = F.least(F.lit(stride), F.lit(horizon), F.col("n") - F.col("pos"))
    f = forecasts.select("series_id", F.col("ts").alias("forecast_origin_at"), F.col("available_at").alias("forecast_origin_available_at"), "pos", "n", F.col("forecast.point").alias("p"))
    f = f.select("*", F.posexplode("p").alias("k", "point_1")).where(F.col("k") < last)
    rest = F.aggregate(F.slice("p", F.col("k") + 1, F.lit(horizon)), F.lit(0.0), lambda a, x: a + x)
    f = f.select("series_id", (F.col("pos") + F.col("k")).alias("pos"), "forecast_origin_at", "forecast_origin_available_at", (F.col("k") + 1).alias("forecast_step"), "point_1", rest.alias("point_sum"), F.col("k").alias("forecast_age_bars"))
    own = rows.withColumn("pos", (F.row_number().over(ordered()) - 1).cast("long")).select("series_id", "ts", "available_at", "pos")
    return own.join(f, ["series_id", "pos"]).withColumn("available_at", F.greatest("available_at", "forecast_origin_available_at"))


def timing_rules(horizon: int) -> dict[str, Column]:
    c = F.col
    return {
        "origin_after_row": c("forecast_origin_at") > c("ts"), "origin_known_early": c("forecast_origin_available_at") < c("forecast_origin_at"),
        "known_before_origin": c("available_at") < c("forecast_origin_available_at"), "step_range": ~c("forecast_step").between(1, horizon),
    }
