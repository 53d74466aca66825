"""Sharpe statistics, bootstrap, concentration and regimes of many candidates at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tideline.functions import normal

EULER = 0.5772156649015329


def moments(df: DataFrame, keys: list[str], r: str, periods: int) -> DataFrame:
    """n, sharpe (annual, ddof 1), bias-corrected skewness and Pearson kurtosis."""
    c = F.col
    g = df.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    n = c("n").cast("double")
    skew = F.when(c("sd") == 0, 0.0).otherwise(c("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(c("sd") == 0, 3.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * c("g2") + 6) + 3)
    return g.select(*keys, "n", F.try_divide("mean", "sd").alias("per_period"), (F.try_divide("mean", "sd") * math.sqrt(periods)).alias("sharpe"), skew.alias("skewness"), kurt.alias("kurtosis"))


def psr_statistic(benchmark: Column) -> Column:
    """The z value of the probability that the true Sharpe exceeds ``benchmark`` (per period)."""
    c = F.col
    under = 1 - c("skewness") * c("per_period") + (c("kurtosis") - 1) / 4 * c("per_period") * c("per_period")
    z = (c("per_period") - benchmark) * F.sqrt(c("n") - 1) / F.sqrt(F.when(under > 0, under))
    return F.coalesce(z, F.when(c("per_period") > benchmark, 40.0).otherwise(-40.0))


def sharpe_diagnostics(df: DataFrame, keys: list[str], r: str, trials: DataFrame, declared: int, periods: int) -> DataFrame:
    """moments with psr, dsr and the deflated benchmark; ``trials`` has one column sharpe (annual)."""
    spread = trials.agg((F.stddev_samp("sharpe") / math.sqrt(periods)).alias("spread"))
    bench = spread.withColumns({"p0": F.lit(1 - 1 / declared), "p1": F.lit(1 - 1 / (declared * math.e))})
    bench = bench.select((F.col("spread") * ((1 - EULER) * normal.inverse("p0") + EULER * normal.inverse("p1"))).alias("bench"))
    d = moments(df, keys, r, periods).crossJoin(bench)  # one row
    d = d.withColumns({"z0": psr_statistic(F.lit(0.0)), "z1": psr_statistic(F.col("bench"))})
    return d.withColumns({"psr": normal.cdf("z0"), "dsr": normal.cdf("z1"), "deflated_benchmark": F.col("bench") * math.sqrt(periods)}).drop("bench", "z0", "z1")


def aligned(df: DataFrame, keys: list[str], model: str, benchmark: str, r: str) -> DataFrame:
    """Each model's rows beside the benchmark's on equal keys: model, keys, candidate, benchmark."""
    b = df.where(F.col(model) == benchmark).select(*keys, F.col(r).alias("benchmark"))
    return df.where(F.col(model) != benchmark).withColumnRenamed(r, "candidate").join(b, keys)


#: Prefix sums of all keys together that go to all tasks; beyond, draws are joined with them.
MOST_SUMS = 2_000_000


def block_bootstrap(df: DataFrame, key: str, samples: int, block: int, seed: int, most: int = MOST_SUMS) -> DataFrame:
    """Circular block bootstrap of the mean of ``d`` per key: rows (key, pos, d) with pos from 0.

    A block's sum is the difference of two prefix sums; starts come from an MD5 of key, sample and block. Where all prefix sums
    are few (counted first) they travel as an array per key, and a sample is one row that looks its blocks up: no draw is shuffled."""
    c = F.col
    w = W.Window.partitionBy(key).orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0)
    sums = df.withColumn("s", F.sum("d").over(w))
    total = df.groupBy(key).agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.avg("d").alias("observed"))
    means = (_looked_up if df.count() <= most else _joined)(sums, total, key, samples, block, seed)
    return means.groupBy(key).agg(
        F.max("n").alias("observations"), F.max("observed").alias("observed_mean"), ((1 + F.count_if(c("mean") - c("observed") >= c("observed"))) / (samples + 1)).alias("pvalue"),
        F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"),
    )


def _start(seed: int, key: str, sample: Column, number: Column) -> Column:
    word = F.concat_ws(":", F.lit(seed), F.col(key), sample.cast("string"), number.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 12), 16, 10).cast("long"), F.col("n"))


def _looked_up(sums: DataFrame, total: DataFrame, key: str, samples: int, block: int, seed: int) -> DataFrame:
    c = F.col
    arrays = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("sums")).join(total, key)
    rows = sums.sparkSession.range(0, samples, 1, 2 * sums.sparkSession.sparkContext.defaultParallelism).withColumnRenamed("id", "sample").crossJoin(F.broadcast(arrays))  # at most MOST_SUMS numbers
    upto = lambda i: F.when(i < 0, F.lit(0.0)).otherwise(F.element_at("sums", (i + 1).cast("int")))

    def part(acc: Column, number: Column) -> Column:
        drawn = F.array(F.struct(_start(seed, key, c("sample"), number).alias("at"), F.least(F.lit(block).cast("long"), c("n") - number * block).alias("len")))
        one = F.transform(drawn, lambda x: upto(F.pmod(x["at"] + x["len"] - 1, c("n"))) - upto(x["at"] - 1) + F.when(x["at"] + x["len"] > c("n"), c("total")).otherwise(0.0))
        return acc + one[0]

    drawn = F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(c("n") / block) - 1), F.lit(0.0), part)
    return rows.select(key, "sample", "n", "observed", (drawn / c("n")).alias("mean"))


def _joined(sums: DataFrame, total: DataFrame, key: str, samples: int, block: int, seed: int) -> DataFrame:
    c = F.col
    draws = total.select(key, "n", "total", "observed", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    draws = draws.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(c("n") / block) - 1)))
    start = _start(seed, key, c("sample"), c("block"))
    length = F.least(F.lit(block).cast("long"), c("n") - c("block") * block)
    draws = draws.withColumns({"a": start - 1, "z": start + length - 1})
    draws = draws.withColumns({"wraps": (c("z") >= c("n")).cast("int"), "z": F.pmod("z", "n")})
    left = sums.select(F.col(key).alias("k1"), F.col("pos").alias("p1"), F.col("s").alias("s1"))
    right = sums.select(F.col(key).alias("k2"), F.col("pos").alias("p2"), F.col("s").alias("s2"))
    d = draws.join(right, (c(key) == c("k2")) & (c("z") == c("p2"))).join(left, (c(key) == c("k1")) & (c("a") == c("p1")), "left")
    d = d.withColumn("part", c("s2") - F.coalesce("s1", F.lit(0.0)) + c("wraps") * c("total"))
    return d.groupBy(key, "sample", "n", "observed").agg((F.sum("part") / F.first("n")).alias("mean"))


def fold_concentration(folds: DataFrame, keys: list[str], r: str) -> DataFrame:
    """How far a few folds carry all profit; 1 everywhere if none makes any."""
    c = F.col
    w = W.Window.partitionBy(*keys)
    d = folds.withColumn("gain", F.greatest(c(r), F.lit(0.0))).withColumn("all", F.sum("gain").over(w)).withColumn("share", F.try_divide("gain", "all")).withColumn("rank", F.row_number().over(w.orderBy(c("gain").desc())))
    g = d.groupBy(*keys).agg(F.count("*").alias("folds"), F.avg((c(r) > 0).cast("double")).alias("positive_fold_ratio"), (F.product(1 + c(r)) - 1).alias("total_return"), F.max("all").alias("total_profit"),
                             F.sum(F.when(c("rank") == 1, c("share"))).alias("t1"), F.sum(F.when(c("rank") <= 3, c("share"))).alias("t3"), F.sum(c("share") * c("share")).alias("h"))
    some = c("total_profit") > 0
    return g.select(*keys, "folds", "positive_fold_ratio", "total_return", "total_profit", *[F.when(some, c(x)).otherwise(1.0).alias(n) for x, n in (("t1", "top_share"), ("t3", "top_three_share"), ("h", "hhi"))])


def regime(vol: Column, trend: Column, low: float, high: float, band: float) -> Column:
    v = F.when(vol < low, "low_vol").when(vol >= high, "high_vol").otherwise("mid_vol")
    return F.concat_ws("_", v, F.when(trend > band, "up").when(trend < -band, "down").otherwise("flat"))


def regime_performance(df: DataFrame, keys: list[str], r: str, periods: int) -> DataFrame:
    c = F.col
    g = df.groupBy(*keys).agg(F.count("*").alias("observations"), (F.product(1 + c(r)) - 1).alias("compounded_return"), F.avg(r).alias("mean_return"), F.stddev_samp(r).alias("sd"), F.avg((c(r) > 0).cast("double")).alias("positive_return_ratio"))
    return g.withColumn("annualized_sharpe", F.when(c("sd") > 0, c("mean_return") / c("sd") * math.sqrt(periods)).otherwise(0.0)).drop("sd")


#: Names of the rules.
RULES = {
    "minimum_observations": "observations >= 500", "positive_total_return": "total_return > 0", "psr": "psr >= 0.95", "dsr": "dsr >= 0.95", "mean_improvement": "observed_mean > 0",
    "bootstrap_significance": "pvalue <= 0.05 AND ci_low > 0", "positive_fold_ratio": "positive_fold_ratio >= 0.6", "top_fold_concentration": "top_share <= 0.5",
    "top_three_fold_concentration": "top_three_share <= 0.8", "positive_two_x_cost_return": "two_x_return > 0",
}


def candidate_gate(joined: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Passed rules, failed rules by name and eligibility of rows that hold all statistics."""
    rules = rules or RULES
    failed = F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(e), F.lit(False)), n) for n, e in rules.items()])))
    return joined.withColumn("_tl_f", failed).withColumns({"passed_rules": F.lit(len(rules)) - F.size("_tl_f"), "failed_rules": F.array_join("_tl_f", ","), "eligible": F.size("_tl_f") == 0}).drop("_tl_f")


def ranked(gated: DataFrame, model: str = "model") -> DataFrame:
    """``gated`` with each candidate's rank: eligible ones first, then by deflated Sharpe probability, then by total return."""
    order = W.Window.orderBy(F.col("eligible").desc(), F.col("dsr").desc_nulls_last(), F.col("total_return").desc_nulls_last(), model)
    return gated.withColumn("rank", F.row_number().over(order).cast("long"))  # a row per candidate


def verdict(gated: DataFrame, model: str = "model") -> DataFrame:
    """One row: verdict, recommended action, number of candidates and passing candidates in their rank's order."""
    passing = F.array_sort(F.collect_list(F.when(F.col("eligible"), F.struct("rank", F.col(model).alias("model")))))
    d = ranked(gated, model).agg(F.count("*").alias("candidate_count"), F.count_if("eligible").alias("passing_candidate_count"), F.array_join(F.transform(passing, lambda x: x["model"]), ",").alias("passing_candidates"))
    some = F.col("passing_candidate_count") > 0
    return d.withColumns({"verdict": F.when(some, "candidate_requires_human_freeze_review").otherwise("no_candidate_passed"), "recommended_action": F.when(some, "human_review_before_new_experiment").otherwise("retain_research_only")})
