"""From exposures to turnover, cost, equity and metrics, in one window pass per key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tideline.operators.features import ordered, vol_target
from tideline.settings import Market


def running(keys: list[str]) -> W.WindowSpec:
    return ordered(keys).rowsBetween(W.Window.unboundedPreceding, 0)


def backtest(df: DataFrame, m: Market = Market()) -> DataFrame:
    """Decisions at the close earn the next bar's close-to-close return and pay for their changes."""
    w, c = ordered(), F.col
    d = df.withColumns({"asset_return": F.coalesce(c("close") / F.lag("close").over(w) - 1, F.lit(0.0)), "executed_exposure": F.coalesce(F.lag("desired_exposure").over(w), F.lit(0.0))})
    d = d.withColumn("turnover", F.abs(c("executed_exposure") - F.coalesce(F.lag("executed_exposure").over(w), F.lit(0.0))))
    d = d.withColumn("gross_return", c("executed_exposure") * c("asset_return")).withColumn("trading_cost", c("turnover") * m.one_way)
    d = d.withColumn("net_return", c("gross_return") - c("trading_cost"))
    return d.withColumn("equity", m.initial_cash * F.product(1 + c("net_return")).over(running(["series_id"])))


def entries(exposure: Column, before: Column) -> Column:
    return F.count_if((exposure > 0) & (F.coalesce(before, F.lit(0.0)) == 0))


def metrics(df: DataFrame, keys: list[str], exposure: str, periods: int) -> DataFrame:
    """Total and annualised return, risk, drawdown and activity of rows (ts, net_return, turnover, close, exposure)."""
    c, w = F.col, ordered(keys)
    d = df.withColumn("_tl_e", F.product(1 + F.coalesce("net_return", F.lit(0.0))).over(running(keys))).withColumn("_tl_x", F.lag(exposure).over(w))
    d = d.withColumn("_tl_d", c("_tl_e") / F.max("_tl_e").over(running(keys)) - 1)
    r = F.coalesce("net_return", F.lit(0.0))
    g = d.groupBy(*keys).agg(
        (F.product(1 + r) - 1).alias("total_return"), F.stddev_pop(r).alias("_tl_s"), F.avg(r).alias("_tl_m"), F.min("_tl_d").alias("max_drawdown"),
        (F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("buy_hold_return"), F.avg(exposure).alias("average_exposure"),
        F.sum("turnover").alias("turnover"), entries(c(exposure), c("_tl_x")).alias("entries"), F.count("*").alias("observations"),
    )
    annual = F.when(c("total_return") > -1, F.pow(1 + c("total_return"), periods / c("observations")) - 1).otherwise(0.0)
    sharpe = F.when(c("_tl_s") > 0, c("_tl_m") / c("_tl_s") * math.sqrt(periods)).otherwise(0.0)
    return g.withColumns({"annualized_return": annual, "annualized_volatility": c("_tl_s") * math.sqrt(periods), "sharpe": sharpe}).drop("_tl_s", "_tl_m")


def sealed_pnl(df: DataFrame, keys: list[str], m: Market = Market()) -> DataFrame:
    """P&L of (target_return, exposure, cost_multiplier) rows; every key ends flat and pays for it.

    Adds the passive comparator, which pays on its first and on its last row."""
    w, c = ordered(keys), F.col
    d = df.withColumn("_tl_last", F.lead("ts").over(w).isNull().cast("double")).withColumn("_tl_before", F.lag("exposure").over(w))
    first = c("_tl_before").isNull().cast("double")
    rate = m.one_way * c("cost_multiplier")
    d = d.withColumn("turnover", F.abs(c("exposure") - F.coalesce(c("_tl_before"), F.lit(0.0))) + c("_tl_last") * c("exposure"))
    d = d.withColumns({"trading_cost": c("turnover") * rate, "gross_return": c("exposure") * c("target_return"), "passive_net": c("target_return") - rate * first - rate * c("_tl_last")})
    d = d.withColumn("net_return", c("gross_return") - c("trading_cost"))
    return d.withColumn("equity", F.product(1 + c("net_return")).over(running(keys))).drop("_tl_last")


def sealed_metrics(pnl: DataFrame, keys: list[str], m: Market = Market()) -> DataFrame:
    c = F.col
    d = pnl.withColumn("_tl_d", c("equity") / F.max("equity").over(running(keys)) - 1)
    g = d.groupBy(*keys).agg(
        (F.product(1 + c("net_return")) - 1).alias("net_return"), (F.product(1 + c("passive_net")) - 1).alias("passive_return"), (F.product(1 + c("target_return")) - 1).alias("passive_gross_return"),
        F.stddev_pop("net_return").alias("_tl_s"), F.avg("net_return").alias("_tl_m"), F.min("_tl_d").alias("max_drawdown"), F.sum("turnover").alias("turnover"),
        F.sum("trading_cost").alias("trading_cost"), F.avg("exposure").alias("average_exposure"), entries(c("exposure"), c("_tl_before")).alias("entries"), F.count("*").alias("rows"),
    )
    root = math.sqrt(m.periods_per_year)
    return g.withColumns({"annualized_volatility": c("_tl_s") * root, "sharpe": F.when(c("_tl_s") > 0, c("_tl_m") / c("_tl_s") * root).otherwise(0.0)}).drop("_tl_s", "_tl_m")


def probability_exposure(m: Market, p: Column, threshold: Column, volatility: Column) -> Column:
    return F.when(p >= threshold, F.greatest(vol_target(m, volatility), F.lit(0.0))).otherwise(0.0)


def choose_threshold(table: DataFrame, keys: list[str], min_entries: int, penalty: float) -> DataFrame:
    """The threshold of each key with the best net return less drawdown penalty; those with enough
    entries first, ties to the higher one. ``table`` has net_return, max_drawdown, entries and threshold."""
    utility = F.col("net_return") - penalty * F.abs(F.col("max_drawdown"))
    best = F.max_by(F.struct("threshold", "utility"), F.struct((F.col("entries") >= min_entries).cast("int"), "utility", "threshold"))
    return table.withColumn("utility", utility).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.threshold").alias("threshold"), F.col("b.utility").alias("utility"))
