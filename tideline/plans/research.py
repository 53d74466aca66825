"""Probability metrics, statistical screening, ablation and report tables."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import normal, scratch
from tideline.operators import features as N
from tideline.operators import pnl as P
from tideline.operators import prob as R
from tideline.operators import stats as T
from tideline.operators.features import ordered
from tideline.plans.market import K, KEYS, M, SCORED, SEALED, assigned, bars_1h, read, stressed
from tideline.plans.shape import register

ANN = M.periods_per_year


def truth(s: SparkSession, f: str) -> DataFrame:
    return assigned(s, f).where("part = 'test'").select("series_id", "fold", "ts", F.col("target_positive").alias("y"), "p")


def doc_scores(s: SparkSession, f: str) -> DataFrame:
    d = read(s, f, "labels").join(read(s, f, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("toxic", F.col("quality").cast("double").alias("y"), F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("p"))


Y = f"{SCORED}, t AS (SELECT series_id, fold, ts, target_positive AS y, p FROM purged WHERE part = 'test')"
DY = "WITH t AS (SELECT toxic, quality::DOUBLE AS y, least(n_chars / 20000.0::DOUBLE, 1.0) AS p FROM labels JOIN documents USING (doc_id))"
EDGE = str(R.EDGES)


def auc_sql(keys: str) -> str:
    return f"SELECT {keys}, sum(w) / nullif(sum(pos) * sum(n - pos), 0) AS roc_auc FROM (SELECT {keys}, pos, n, pos * (coalesce(sum(n - pos) OVER (PARTITION BY {keys} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n - pos) / 2.0) AS w FROM (SELECT {keys}, p, sum(y) AS pos, count(*) AS n FROM t GROUP BY {keys}, p)) GROUP BY {keys}"


def ece_cte(keys: str) -> str:
    return f"(SELECT {keys}, sum(n * abs(pm - ym)) / sum(n) AS ece FROM (SELECT {keys}, b, count(*) AS n, avg(p) AS pm, avg(y) AS ym FROM (SELECT *, len(list_filter({EDGE}::DOUBLE[], lambda e: e <= p)) AS b FROM t) GROUP BY {keys}, b) GROUP BY {keys})"


PM = "accuracy:d brier:d log_loss:d roc_auc:d ece:d realized_positive_rate:d predicted_positive_rate:d"


def pm_sql(base: str, keys: str) -> str:
    q = "least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"
    return f"{base} SELECT * FROM (SELECT {keys}, avg(((p >= 0.5)::INT = y)::INT) AS accuracy, avg((p - y) * (p - y)) AS brier, avg(-(y * ln({q}) + (1 - y) * ln(1 - {q}))) AS log_loss, avg(y) AS realized_positive_rate, avg(p) AS predicted_positive_rate FROM t GROUP BY {keys}) JOIN ({auc_sql(keys)}) USING ({keys}) JOIN {ece_cte(keys)} USING ({keys})"


register("e6_probability_metrics", lambda s, f: R.probability_metrics(truth(s, f), ["series_id", "fold"]), f"series_id fold:i {PM}", pm_sql(Y, "series_id, fold"))
register("e6_e7_document_scores", lambda s, f: R.probability_metrics(doc_scores(s, f), ["toxic"]), f"toxic:i {PM}", pm_sql(DY, "toxic"))
register("e7_calibration_error", lambda s, f: R.calibration_error(truth(s, f), ["series_id"]), "series_id ece:d", f"{Y} SELECT * FROM {ece_cte('series_id')}")
register("c18_platt_logit", lambda s, f: truth(s, f).withColumn("z", R.logit(F.col("p"))), "series_id fold:i ts:t z:d", f"{Y} SELECT *, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS z FROM t")
register("i9_i13_prior", lambda s, f: R.prior(assigned(s, f).where("part = 'train'").withColumn("y", F.col("target_positive")), ["series_id", "fold"]), "series_id fold:i p:d one_class", f"{SCORED} SELECT series_id, fold, least(greatest(avg(target_positive), 1e-6), 1 - 1e-6) AS p, count(DISTINCT target_positive) < 2 AS one_class FROM purged WHERE part = 'train' GROUP BY ALL")


def fitted(s: SparkSession, f: str) -> DataFrame:
    rows = assigned(s, f).withColumn("y", F.col("target_positive"))
    return R.platt(R.ridge_logistic(rows, ["series_id", "fold"], ["log_return", "realized_volatility", "z"]), ["series_id", "fold"])


register("i10_i12_ridge_platt", fitted, "series_id fold:i part ts:t y:d p:d")


WIDE = ["log_return", "realized_volatility", "z"]
register("i10_gram_table", lambda s, f: R.gram(assigned(s, f).where("part = 'train'"), ["series_id", "fold"], WIDE, "target_positive"), "series_id fold:i n:i " + " ".join(f"xx_{i}_{j}:d" for i in range(4) for j in range(i, 4)) + " " + " ".join(f"xy_{i}:d" for i in range(4)),
         f"{SCORED} SELECT series_id, fold, count(*) AS n, " + ", ".join(f"sum({a}::DOUBLE * {b}) AS xx_{i}_{j + i}" for i, a in enumerate(["1", *WIDE]) for j, b in enumerate(["1", *WIDE][i:])) + ", " + ", ".join(f"sum({a}::DOUBLE * target_positive) AS xy_{i}" for i, a in enumerate(["1", *WIDE])) + " FROM purged WHERE part = 'train' GROUP BY ALL")
MODELS = {"prior": R.prior_model, "ridge_logistic": R.ridge_logistic, "boosted_trees": R.boosted_trees}


def sealed_inputs(s: SparkSession, f: str) -> tuple[DataFrame, DataFrame]:
    """Hourly bars and their assigned rows as tables: a sealed run reads the events once, however many models, parts and scores use them."""
    bars = scratch.table(bars_1h(s, f), "bars")
    return bars, scratch.table(assigned(s, f, bars), "assigned")


def sealed_runs(bars: DataFrame, rows: DataFrame, keys: list[str], columns: list[str], models: tuple[str, ...] = ("ridge_logistic",)) -> tuple[DataFrame, DataFrame]:
    """The sealed protocol per key and model: fit, calibrate, choose a threshold on the validation part, trade the test part.

    Returns the test P&L of models and trend under the costs 1.0, 1.5 and 2.0, and the models' probability metrics."""
    group = ["series_id", "fold", *keys]
    own = [*group, "model"]
    base = rows.withColumn("y", F.col("target_positive"))
    fits = [MODELS[m](base, group, columns).withColumn("model", F.lit(m)) for m in models]
    scored = R.platt(functools.reduce(DataFrame.unionByName, fits), own).select(*own, "part", "ts", F.col("p").alias("fit_p"))
    d = rows.join(scored, [*group, "part", "ts"]).withColumn("cost_multiplier", F.lit(1.0))
    size = lambda x: x.withColumn("exposure", P.probability_exposure(M, F.col("fit_p"), F.col("threshold"), F.col("realized_volatility")))
    val = size(d.where("part = 'validation'").withColumn("threshold", F.explode(F.array(*map(F.lit, (0.5, 0.55, 0.6, 0.65))))))
    by = [*own, "threshold"]
    chosen = P.choose_threshold(P.sealed_metrics(P.sealed_pnl(val, by, M), by, M), own, 3, 0.5).drop("utility")
    test = size(d.where("part = 'test'").join(chosen, own))
    trend = N.trend_exposure(N.features(bars, M), M).select("series_id", "ts", F.col("desired_exposure").alias("_tl_trend"))
    once = test.where(F.col("model") == models[0])
    rule = once.join(trend, ["series_id", "ts"], "left").withColumns({"model": F.lit("trend"), "threshold": F.lit(None).cast("double"), "exposure": F.coalesce("_tl_trend", F.lit(0.0))}).drop("_tl_trend")
    both = test.unionByName(rule).withColumn("cost_multiplier", F.explode(F.array(F.lit(1.0), F.lit(1.5), F.lit(2.0))))
    scores = R.probability_metrics(test.select(*own, F.col("target_positive").alias("y"), F.col("fit_p").alias("p")), own)
    return P.sealed_pnl(both, [*own, "cost_multiplier"], M), scores


def sealed_table(bars: DataFrame, rows: DataFrame, keys: list[str], columns: list[str], models: tuple[str, ...] = ("ridge_logistic",)) -> DataFrame:
    """One row per series, fold, key, model and cost multiplier with the rows of each part; the rule's threshold and probability metrics are null."""
    pnl, scores = sealed_runs(bars, rows, keys, columns, models)
    parts = rows.groupBy("series_id", "fold", *keys).agg(*[F.count_if(F.col("part") == x).alias(f"{x}_rows") for x in PARTS])
    own = ["series_id", "fold", *keys, "model"]
    chosen = pnl.groupBy(*own).agg(F.max("threshold").alias("threshold"))
    return P.sealed_metrics(pnl, [*own, "cost_multiplier"], M).join(chosen, own).join(scores, own, "left").join(parts, ["series_id", "fold", *keys])


def benchmark(s: SparkSession, f: str) -> DataFrame:
    return sealed_table(*sealed_inputs(s, f), [], ["log_return", "realized_volatility", "z"], tuple(MODELS))


RUN = f"cost_multiplier:d threshold:d net_return:d sharpe:d max_drawdown:d turnover:d entries:i {PM}"
PARTS = ("train", "calibration", "validation", "test")
register("i14_sealed_benchmark", benchmark, f"series_id fold:i model {' '.join(f'{x}_rows:i' for x in PARTS)} {RUN}")
register("i14_sealed_predictions", lambda s, f: sealed_runs(*sealed_inputs(s, f), [], ["log_return", "realized_volatility", "z"], tuple(MODELS))[0].where("cost_multiplier = 1.0").withColumn("probability", F.when(F.col("model") != "trend", F.col("fit_p"))), "series_id fold:i model ts:t probability:d exposure:d net_return:d")


# statistics over the sealed predictions of all models
def predictions(s: SparkSession, f: str) -> DataFrame:
    return stressed(s, f).where("cost_multiplier = 1.0")


def trials(s: SparkSession, f: str) -> DataFrame:
    return P.sealed_metrics(stressed(s, f), KEYS, M).groupBy("model").agg(F.avg("sharpe").alias("sharpe"))


PRED = f"{SEALED}, pred AS (SELECT * FROM pnl WHERE cost_multiplier = 1.0)"
MOM = """m0 AS (SELECT model, count(*)::DOUBLE AS n, avg(net_return) AS mu, stddev_samp(net_return) AS sd, var_pop(net_return) AS v FROM pred GROUP BY 1),
m1 AS (SELECT m0.model, any_value(n) AS n, any_value(mu / sd) AS pp, avg(pow(net_return - mu, 3)) / pow(any_value(v), 1.5) AS g1, avg(pow(net_return - mu, 4)) / pow(any_value(v), 2) - 3 AS g2 FROM pred JOIN m0 USING (model) GROUP BY m0.model)"""
TRIALS = 20


def z_sql(benchmark: str) -> str:
    under = "1 - skewness * per_period + (kurtosis - 1) / 4 * per_period * per_period"
    return f"coalesce((per_period - {benchmark}) * sqrt(n - 1) / CASE WHEN {under} > 0 THEN sqrt({under}) END, CASE WHEN per_period > {benchmark} THEN 40e0 ELSE -40e0 END)"


SHARPE = f"""{MOM}, mm AS (SELECT model, m0.n, CASE WHEN sd > 0 THEN mu / sd END AS per_period, CASE WHEN sd = 0 THEN 0 ELSE g1 * sqrt(m0.n * (m0.n - 1)) / (m0.n - 2) END AS skewness,
  CASE WHEN sd = 0 THEN 3 ELSE (m0.n - 1) / ((m0.n - 2) * (m0.n - 3)) * ((m0.n + 1) * g2 + 6) + 3 END AS kurtosis FROM m0 JOIN m1 USING (model)),
sp AS (SELECT stddev_samp(sharpe) / sqrt({ANN}) AS spread, {1 - 1 / TRIALS!r}::DOUBLE AS p0, {1 - 1 / (TRIALS * math.e)!r}::DOUBLE AS p1 FROM (SELECT avg(sharpe) AS sharpe FROM met GROUP BY model)),
bench AS (SELECT spread * ({1 - T.EULER!r} * {normal.inverse_sql('p0')} + {T.EULER!r} * {normal.inverse_sql('p1')}) AS bench FROM sp),
zz AS (SELECT *, {z_sql('0')} AS z0, {z_sql('bench')} AS z1 FROM mm, bench),
diagnosed AS (SELECT model, n, per_period * sqrt({ANN}) AS sharpe, {normal.cdf_sql('z0')} AS psr, {normal.cdf_sql('z1')} AS dsr, bench * sqrt({ANN}) AS deflated_benchmark FROM zz)"""
register("e18_e19_moments", lambda s, f: T.moments(predictions(s, f), ["model"], "net_return", ANN), "model n:i sharpe:d skewness:d kurtosis:d", f"{PRED}, {MOM} SELECT model, n, pp * sqrt({ANN}) AS sharpe, g1 * sqrt(n * (n - 1)) / (n - 2) AS skewness, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3 AS kurtosis FROM m1")
register("e20_sharpe_diagnostics", lambda s, f: T.sharpe_diagnostics(predictions(s, f), ["model"], "net_return", trials(s, f), TRIALS, ANN), "model n:i sharpe:d psr:d dsr:d deflated_benchmark:d", f"{PRED}, {SHARPE} SELECT * FROM diagnosed")


def against(s: SparkSession, f: str) -> DataFrame:
    return T.aligned(predictions(s, f).select("series_id", "fold", "ts", "model", "net_return", "realized_volatility", "log_return"), ["series_id", "fold", "ts"], "model", "flat", "net_return")


AL = f"{PRED}, al AS (SELECT c.model, c.series_id, c.fold, c.ts, c.net_return AS candidate, b.net_return AS benchmark, c.realized_volatility, c.log_return FROM pred c JOIN pred b ON b.series_id = c.series_id AND b.fold = c.fold AND b.ts = c.ts AND b.model = 'flat' WHERE c.model <> 'flat')"
register("d8_aligned_returns", against, "model series_id fold:i ts:t candidate:d benchmark:d", f"{AL} SELECT * FROM al")


SAMPLES = 5000


def bootstrap(s: SparkSession, f: str) -> DataFrame:
    d = against(s, f).select("model", "ts", (F.col("candidate") - F.col("benchmark")).alias("d"))
    return T.block_bootstrap(d.withColumn("pos", (F.row_number().over(ordered(["model"])) - 1).cast("long")), "model", SAMPLES, 6, 42)


BOOT = f"""{AL}, bd AS (SELECT model, candidate - benchmark AS d, row_number() OVER (PARTITION BY model ORDER BY ts) - 1 AS pos FROM al),
bs AS (SELECT *, sum(d) OVER (PARTITION BY model ORDER BY pos) AS s FROM bd), bt0 AS (SELECT model, count(*) AS n, sum(d) AS total, avg(d) AS observed FROM bd GROUP BY 1),
bdraw AS (SELECT *, unnest(range(0, ceil(n / 6.0)::BIGINT)) AS block FROM (SELECT *, unnest(range(0, {SAMPLES})) AS sample FROM bt0)),
bdr2 AS (SELECT *, ('0x' || substr(md5('42:' || model || ':' || sample || ':' || block), 1, 12))::BIGINT % n AS st, least(6, n - block * 6) AS len FROM bdraw),
bpart AS (SELECT r.model, sample, r.n, observed, z.s - coalesce(a.s, 0) + CASE WHEN st + len - 1 >= r.n THEN total ELSE 0 END AS part FROM bdr2 r JOIN bs z ON z.model = r.model AND z.pos = (st + len - 1) % r.n LEFT JOIN bs a ON a.model = r.model AND a.pos = st - 1),
bm AS (SELECT model, sample, any_value(n) AS n, any_value(observed) AS observed, sum(part) / any_value(n) AS mean FROM bpart GROUP BY ALL),
boot AS (SELECT model, any_value(n) AS observations, any_value(observed) AS observed_mean, (1 + count(*) FILTER (mean - observed >= observed)) / {SAMPLES + 1}.0 AS pvalue, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM bm GROUP BY 1)"""
register("e21_block_bootstrap", bootstrap, "model observations:i observed_mean:d pvalue:d ci_low:d ci_high:d", f"{BOOT} SELECT * FROM boot")


def fold_returns(s: SparkSession, f: str) -> DataFrame:
    return predictions(s, f).groupBy("model", "fold").agg((F.product(1 + F.col("net_return")) - 1).alias("r"))


FR = f"{PRED}, fr AS (SELECT model, fold, product(1 + net_return) - 1 AS r FROM pred GROUP BY ALL)"
register("e14_fold_returns", fold_returns, "model fold:i r:d", f"{FR} SELECT * FROM fr")
CONC = "fc0 AS (SELECT *, greatest(r, 0) AS gain, sum(greatest(r, 0)) OVER (PARTITION BY model) AS tot, row_number() OVER (PARTITION BY model ORDER BY greatest(r, 0) DESC) AS rk FROM fr), fc AS (SELECT model, count(*) AS folds, avg((r > 0)::INT) AS positive_fold_ratio, product(1 + r) - 1 AS total_return, any_value(tot) AS total_profit, coalesce(sum(gain / nullif(tot, 0)) FILTER (rk = 1), 1) AS top_share, coalesce(sum(gain / nullif(tot, 0)) FILTER (rk <= 3), 1) AS top_three_share, coalesce(sum(pow(gain / nullif(tot, 0), 2)), 1) AS hhi FROM fc0 GROUP BY 1)"
register("e13_fold_concentration", lambda s, f: T.fold_concentration(fold_returns(s, f), ["model"], "r"), "model folds:i positive_fold_ratio:d total_return:d total_profit:d top_share:d top_three_share:d hhi:d", f"{FR}, {CONC} SELECT * FROM fc")
register("c16_e17_regimes", lambda s, f: T.regime_performance(against(s, f).withColumn("candidate", F.col("candidate") / 100).withColumn("regime", T.regime(F.col("realized_volatility"), F.col("log_return"), 40.0, 55.0, 0.1)), ["model", "regime"], "candidate", ANN), "model regime observations:i compounded_return:d mean_return:d annualized_sharpe:d positive_return_ratio:d",
         f"{AL}, rg AS (SELECT model, candidate / 100 AS candidate, CASE WHEN realized_volatility < 40 THEN 'low_vol' WHEN realized_volatility >= 55 THEN 'high_vol' ELSE 'mid_vol' END || '_' || CASE WHEN log_return > 0.1 THEN 'up' WHEN log_return < -0.1 THEN 'down' ELSE 'flat' END AS regime FROM al) SELECT model, regime, count(*) AS observations, product(1 + candidate) - 1 AS compounded_return, avg(candidate) AS mean_return, CASE WHEN stddev_samp(candidate) > 0 THEN avg(candidate) / stddev_samp(candidate) * sqrt({ANN}) ELSE 0 END AS annualized_sharpe, avg((candidate > 0)::INT) AS positive_return_ratio FROM rg GROUP BY ALL")
register("e15_trial_sharpes", trials, "model sharpe:d", f"{SEALED} SELECT model, avg(sharpe) AS sharpe FROM met GROUP BY 1")


def two_x(s: SparkSession, f: str) -> DataFrame:
    return P.sealed_metrics(stressed(s, f), KEYS, M).where("cost_multiplier = 2.0").groupBy("model").agg(F.avg("net_return").alias("two_x_return"))


register("e16_two_x_cost", two_x, "model two_x_return:d", f"{SEALED} SELECT model, avg(net_return) AS two_x_return FROM met WHERE cost_multiplier = 2.0 GROUP BY 1")


def gate(s: SparkSession, f: str) -> DataFrame:
    sharpe = T.sharpe_diagnostics(predictions(s, f), ["model"], "net_return", trials(s, f), TRIALS, ANN).select("model", "psr", "dsr")
    d = bootstrap(s, f).join(sharpe, "model").join(T.fold_concentration(fold_returns(s, f), ["model"], "r"), "model").join(two_x(s, f), "model")
    return T.candidate_gate(d)


FAILED = ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{name}' END" for name, rule in T.RULES.items())
GATE = f"""{BOOT}, {SHARPE}, fr AS (SELECT model, fold, product(1 + net_return) - 1 AS r FROM pred GROUP BY ALL), {CONC},
tw AS (SELECT model, avg(net_return) AS two_x_return FROM met WHERE cost_multiplier = 2.0 GROUP BY 1),
ga AS (SELECT *, list_sort(list_filter([{FAILED}], lambda x: x IS NOT NULL)) AS failed FROM boot JOIN diagnosed USING (model) JOIN fc USING (model) JOIN tw USING (model)),
gated AS (SELECT *, {len(T.RULES)} - len(failed) AS passed_rules, array_to_string(failed, ',') AS failed_rules, len(failed) = 0 AS eligible,
  row_number() OVER (ORDER BY len(failed) = 0 DESC, dsr DESC NULLS LAST, total_return DESC NULLS LAST, model) AS rank FROM ga)"""
register("e33_candidate_gate", lambda s, f: T.ranked(gate(s, f)), "model rank:i observations:i total_return:d psr:d dsr:d pvalue:d passed_rules:i failed_rules eligible", f"{GATE} SELECT * FROM gated")
register("e33_verdict", lambda s, f: T.verdict(gate(s, f)), "verdict recommended_action candidate_count:i passing_candidate_count:i passing_candidates", f"""{GATE} SELECT count(*) AS candidate_count, count(*) FILTER (eligible) AS passing_candidate_count,
  coalesce(string_agg(model, ',' ORDER BY rank) FILTER (eligible), '') AS passing_candidates,
  CASE WHEN passing_candidate_count > 0 THEN 'candidate_requires_human_freeze_review' ELSE 'no_candidate_passed' END AS verdict,
  CASE WHEN passing_candidate_count > 0 THEN 'human_review_before_new_experiment' ELSE 'retain_research_only' END AS recommended_action FROM gated""")


# report tables
def met(s: SparkSession, f: str) -> DataFrame:
    return P.sealed_metrics(stressed(s, f), KEYS, M)


def one_x(s: SparkSession, f: str) -> DataFrame:
    return met(s, f).where("cost_multiplier = 1.0")


register("e8_g7_ablation_summary", lambda s, f: met(s, f).groupBy(F.col("cost_multiplier").alias("ablation"), "model").agg(F.count("*").alias("folds"), F.avg("net_return").alias("mean_net"), F.median("net_return").alias("median_net"), F.avg((F.col("net_return") > 0).cast("double")).alias("positive_rate"), F.avg("sharpe").alias("mean_sharpe"), F.min("max_drawdown").alias("worst_drawdown")).orderBy(F.col("mean_net").desc()), "ablation:d model folds:i mean_net:d median_net:d positive_rate:d mean_sharpe:d worst_drawdown:d",
         f"{SEALED} SELECT cost_multiplier AS ablation, model, count(*) AS folds, avg(net_return) AS mean_net, median(net_return) AS median_net, avg((net_return > 0)::INT) AS positive_rate, avg(sharpe) AS mean_sharpe, min(max_drawdown) AS worst_drawdown FROM met GROUP BY ALL")
NUM = ["net_return", "passive_return", "annualized_volatility", "sharpe", "max_drawdown", "turnover", "trading_cost", "average_exposure"]
register("e9_model_means", lambda s, f: one_x(s, f).groupBy("model").agg(*[F.avg(c).alias(c) for c in NUM]), "model " + " ".join(f"{c}:d" for c in NUM), f"{SEALED} SELECT model, {', '.join(f'avg({c}) AS {c}' for c in NUM)} FROM met WHERE cost_multiplier = 1.0 GROUP BY 1")
register("e10_stress_summary", lambda s, f: met(s, f).groupBy("model", "cost_multiplier").agg(F.avg("net_return").alias("net_return"), F.avg("sharpe").alias("sharpe")), "model cost_multiplier:d net_return:d sharpe:d", f"{SEALED} SELECT model, cost_multiplier, avg(net_return) AS net_return, avg(sharpe) AS sharpe FROM met GROUP BY ALL")


def conditional(s: SparkSession, f: str) -> DataFrame:
    d = predictions(s, f)
    cut = d.groupBy("model", "fold").agg(F.percentile(F.abs("target_return"), F.lit(0.9)).alias("cutoff"))
    big = d.join(cut, ["model", "fold"]).where(F.abs("target_return") >= F.col("cutoff"))
    return big.groupBy("model", "fold").agg(F.max("cutoff").alias("large_move_threshold"), F.count("*").alias("rows"), F.avg(((F.col("p") >= 0.5) == (F.col("target_return") > 0)).cast("double")).alias("directional_accuracy"), F.sum("net_return").alias("net_return_sum"))


register("e11_large_moves", conditional, "model fold:i large_move_threshold:d rows:i directional_accuracy:d net_return_sum:d", f"{PRED}, ct AS (SELECT model, fold, quantile_cont(abs(target_return), 0.9) AS cutoff FROM pred GROUP BY ALL) SELECT model, fold, any_value(cutoff) AS large_move_threshold, count(*) AS rows, avg(((p >= 0.5) = (target_return > 0))::INT) AS directional_accuracy, sum(net_return) AS net_return_sum FROM pred JOIN ct USING (model, fold) WHERE abs(target_return) >= cutoff GROUP BY ALL")
register("e12_concentration", lambda s, f: one_x(s, f).groupBy("model").agg(F.count("*").alias("folds"), F.avg("net_return").alias("mean_fold"), F.max("net_return").alias("best_fold"), F.min("net_return").alias("worst_fold"), F.avg((F.col("net_return") > 0).cast("double")).alias("positive_ratio"), F.try_divide(F.max(F.greatest("net_return", F.lit(0.0))), F.sum(F.greatest("net_return", F.lit(0.0)))).alias("best_share")), "model folds:i mean_fold:d best_fold:d worst_fold:d positive_ratio:d best_share:d",
         f"{SEALED} SELECT model, count(*) AS folds, avg(net_return) AS mean_fold, max(net_return) AS best_fold, min(net_return) AS worst_fold, avg((net_return > 0)::INT) AS positive_ratio, max(greatest(net_return, 0)) / nullif(sum(greatest(net_return, 0)), 0) AS best_share FROM met WHERE cost_multiplier = 1.0 GROUP BY 1")


def deltas(s: SparkSession, f: str) -> DataFrame:
    """Scenarios (here: cost multipliers) against their baseline, per model."""
    g = met(s, f).groupBy(F.col("cost_multiplier").alias("scenario"), "model").agg(F.avg("net_return").alias("net_return"), F.avg("sharpe").alias("sharpe"))
    base = g.where("scenario = 1.0").select("model", F.col("net_return").alias("n0"), F.col("sharpe").alias("s0"))
    return g.join(base, "model", "left").withColumns({"delta_net_return": F.col("net_return") - F.col("n0"), "delta_sharpe": F.col("sharpe") - F.col("s0")})


DELTA = f"{SEALED}, sc AS (SELECT cost_multiplier AS scenario, model, avg(net_return) AS net_return, avg(sharpe) AS sharpe FROM met GROUP BY ALL), dl AS (SELECT sc.*, sc.net_return - b.net_return AS delta_net_return, sc.sharpe - b.sharpe AS delta_sharpe FROM sc LEFT JOIN sc b ON b.model = sc.model AND b.scenario = 1.0)"
register("d9_scenario_deltas", deltas, "scenario:d model net_return:d delta_net_return:d delta_sharpe:d", f"{DELTA} SELECT * FROM dl")
FLAGS = {"positive_net": "net_return > 0", "beats_baseline": "delta_net_return >= 0", "sharpe_kept": "delta_sharpe > -0.5"}
register("e30_screening", lambda s, f: deltas(s, f).withColumns({n: F.expr(e) for n, e in FLAGS.items()}).withColumn("passes", F.expr(" AND ".join(FLAGS))), f"scenario:d model {' '.join(FLAGS)} passes", f"{DELTA} SELECT *, {', '.join(f'{e} AS {n}' for n, e in FLAGS.items())}, {' AND '.join(f'({e})' for e in FLAGS.values())} AS passes FROM dl")
register("e31_contributions", lambda s, f: deltas(s, f).alias("a").join(deltas(s, f).where("scenario = 2.0").alias("b"), "model").where("a.scenario = 1.0").select("model", (F.col("a.net_return") - F.col("b.net_return")).alias("net_contribution"), (F.col("a.sharpe") - F.col("b.sharpe")).alias("sharpe_contribution")), "model net_contribution:d sharpe_contribution:d", f"{DELTA} SELECT a.model, a.net_return - b.net_return AS net_contribution, a.sharpe - b.sharpe AS sharpe_contribution FROM dl a JOIN dl b ON b.model = a.model AND b.scenario = 2.0 WHERE a.scenario = 1.0")
register("e32_failed_flags", lambda s, f: deltas(s, f).select("scenario", "model", *[F.expr(e).alias(n) for n, e in FLAGS.items()]).unpivot(["scenario", "model"], list(FLAGS), "flag", "ok").groupBy("flag").agg(F.count_if(~F.col("ok")).alias("failed")), "flag failed:i", " UNION ALL ".join(f"({DELTA} SELECT '{n}' AS flag, count(*) FILTER (NOT ({e})) AS failed FROM dl)" for n, e in FLAGS.items()))
register("h1_tagged_union", lambda s, f: one_x(s, f).withColumn("tag", F.lit("base")).unionByName(met(s, f).where("cost_multiplier = 2.0").withColumn("tag", F.lit("stress"))).groupBy("tag", "model").agg(F.count("*").alias("rows")), "tag model rows:i", f"{SEALED} SELECT CASE cost_multiplier WHEN 1.0 THEN 'base' ELSE 'stress' END AS tag, model, count(*) AS rows FROM met WHERE cost_multiplier IN (1.0, 2.0) GROUP BY ALL")


GROUPS = {"trend": ["ema_ratio", "atr_pct"], "volatility": ["realized_vol_6"], "volume": ["volume_zscore"]}


def plan_sets() -> dict[str, list[str]]:
    """Columns by ablation: all groups, growing prefixes and leave-one-out."""
    names = list(GROUPS)
    sets = {"all": names} | {f"with_{n}": names[: i + 1] for i, n in enumerate(names)} | {f"without_{n}": [x for x in names if x != n] for n in names}
    return {n: [c for g in groups for c in GROUPS[g]] for n, groups in sets.items()}


def ablation_plan(s: SparkSession, f: str) -> DataFrame:
    """All groups, growing prefixes and leave-one-out sets as rows (ablation, columns), for each series."""
    rows = F.array(*[F.struct(F.lit(n).alias("ablation"), F.array(*map(F.lit, columns)).alias("columns")) for n, columns in plan_sets().items()])
    return read(s, f, "events").select(F.col("event_type").alias("series_id")).distinct().select("series_id", F.inline(rows)).withColumn("columns", F.array_join("columns", ","))


register("i15_ablation_plan", ablation_plan, "series_id ablation columns", "SELECT DISTINCT event_type AS series_id, ablation, columns FROM events, (VALUES ('all', 'ema_ratio,atr_pct,realized_vol_6,volume_zscore'), ('with_trend', 'ema_ratio,atr_pct'), ('with_volatility', 'ema_ratio,atr_pct,realized_vol_6'), ('with_volume', 'ema_ratio,atr_pct,realized_vol_6,volume_zscore'), ('without_trend', 'realized_vol_6,volume_zscore'), ('without_volatility', 'ema_ratio,atr_pct,volume_zscore'), ('without_volume', 'ema_ratio,atr_pct,realized_vol_6')) v(ablation, columns)")
DECL = [(m, x) for m in ("flat", "momentum", "trend", "absent") for x in (1.0, 2.0)]
register("e36_completeness", lambda s, f: s.createDataFrame(DECL, "model string, cost_multiplier double").join(met(s, f).select("model", "cost_multiplier").distinct(), ["model", "cost_multiplier"], "left_anti"), "model cost_multiplier:d", f"{SEALED} SELECT * FROM (VALUES {', '.join(f'({m!r}, {x}::DOUBLE)' for m, x in DECL)}) v(model, cost_multiplier) ANTI JOIN met USING (model, cost_multiplier)")
