"""Probability metrics, simple models fitted per group, and calibration."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tideline.functions import scratch

#: The inner edges of ten equal bins as doubles.
EDGES = np.linspace(0.0, 1.0, 11)[1:-1].tolist()


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(p / (1 - p))


def bin_of(p: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= p))


def calibration_error(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    g = df.groupBy(*keys, bin_of(F.col(p), EDGES).alias("_tl_bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(y).alias("y"))
    return g.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def roc_auc(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """The rank-sum form: rows are counted per distinct score first, so ties cost nothing and
    the running sum goes over distinct scores only."""
    t = df.groupBy(*keys, p).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(W.Window.partitionBy(*keys).orderBy(p).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("wins", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    g = t.groupBy(*keys).agg(F.sum("wins").alias("w"), F.sum("pos").alias("a"), F.sum(F.col("n") - F.col("pos")).alias("b"))
    return g.select(*keys, F.try_divide("w", F.col("a") * F.col("b")).alias("roc_auc"))


def probability_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, brier, log_loss, roc_auc (null for one class), ece and both rates of rows (y, p)."""
    y, p = F.col("y"), F.col("p")
    eps = float(np.finfo(np.float64).eps)
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    g = df.groupBy(*keys).agg(
        F.avg(((p >= 0.5).cast("double") == y).cast("double")).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
        F.avg(y).alias("realized_positive_rate"), F.avg(p).alias("predicted_positive_rate"),
    )
    return g.join(roc_auc(df, keys), keys).join(calibration_error(df, keys), keys)


def prior(train: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """The clipped mean of the target, as probability; ``one_class`` tells that nothing else can be fitted."""
    eps = 1e-6
    g = train.groupBy(*keys).agg(F.avg(y).alias("m"), F.countDistinct(y).alias("k"))
    return g.select(*keys, F.least(F.greatest("m", F.lit(eps)), F.lit(1 - eps)).alias("p"), (F.col("k") < 2).alias("one_class"))


def newton_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 50) -> np.ndarray:
    """Weights (bias first) that minimise log loss plus penalty / 2 of the squared slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.r_[1e-12, np.full(x.shape[1] - 1, penalty)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-12 * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def prior_model(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, part, ts, y, p of all rows with the clipped mean of the key's train part."""
    share = rows.where("part = 'train'").groupBy(*keys).agg(_share("y").alias("p"))
    return rows.select(*keys, "part", "ts", "y").join(share, keys, "left").withColumn("p", F.coalesce("p", F.lit(0.5)))


def gram(rows: DataFrame, keys: list[str], columns: list[str], y: str, weight: Column | None = None) -> DataFrame:
    """Sums of products per key, in one pass with partial sums: xx_i_j of the columns (0 is the constant 1), times ``weight``, and xy_i.

    Sums of a set of columns are those of its i and j."""
    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    wide = weight if weight is not None else F.lit(1.0)
    products = [F.sum(wide * x[i] * x[j]).alias(f"xx_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return rows.groupBy(*keys).agg(*products, *[F.sum(x[i] * F.col(y)).alias(f"xy_{i}") for i in range(len(x))], F.count("*").alias("n"))


def newton_summed(rows: DataFrame, keys: list[str], columns: list[str], y: str, penalty: float, steps: int = 50) -> DataFrame:
    """(keys, w): the weights of :func:`newton_logistic` for every key at once.

    A step is one aggregate: Spark sums each key's gradient and second derivatives over its rows, wherever they lie, and one small
    system per key is solved from the sums. The state between steps, a row per key, is a table."""
    spark, k = rows.sparkSession, len(columns) + 1
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{x} {kinds[x]}" for x in keys) + ", w array<double>, step double"
    ridge = np.r_[1e-12, np.full(k - 1, penalty)]

    def solved(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                r = row._asdict()
                w, h = np.array(r["w"], float), np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        h[i, j] = h[j, i] = r[f"xx_{i}_{j}"]
                step = np.linalg.solve(h + np.diag(ridge) + 1e-12 * np.eye(k), np.array([r[f"xy_{i}"] for i in range(k)]) + ridge * w)
                out.append((*[r[x] for x in keys], (w - step).tolist(), float(np.abs(step).max())))
            yield pd.DataFrame(out, columns=[*keys, "w", "step"])

    state = rows.select(*keys).distinct().withColumn("w", F.array_repeat(F.lit(0.0), k))
    for _ in range(steps):
        d = rows.join(state.select(*keys, "w"), keys)
        z = functools.reduce(lambda a, i: a + F.col(columns[i]) * F.col("w")[i + 1], range(k - 1), F.col("w")[0])
        d = d.withColumn("_tl_p", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0)))))
        sums = gram(d.withColumn("_tl_d", F.col("_tl_p") - F.col(y)), keys, columns, "_tl_d", F.col("_tl_p") * (1 - F.col("_tl_p")))
        state = scratch.table(sums.join(state.select(*keys, "w"), keys).mapInPandas(solved, schema), "newton")
        if (state.agg(F.max("step")).first()[0] or 0.0) < 1e-10:  # one number
            break
    return state.select(*keys, "w")


def _share(y: str) -> Column:
    """The target's mean, away from 0 and 1; a half without rows."""
    return F.least(F.greatest(F.coalesce(F.avg(y), F.lit(0.5)), F.lit(1e-6)), F.lit(1 - 1e-6))


def ridge_logistic(rows: DataFrame, keys: list[str], columns: list[str], c: float = 1.0) -> DataFrame:
    """keys, part, ts, y, p of all rows (part, ts, y, *columns), fitted on each key's train part.

    Missing values take the train median, columns are standardised; a train part with one class
    gives its prior. All keys are fitted together from sums (:func:`newton_summed`), so neither their number nor the rows of one
    must fit into a task."""
    col = F.col
    x = [f"_tl_x{i}" for i in range(len(columns))]
    d = rows.select(*keys, "part", "ts", "y", *[F.when(~F.isnan(col(n).cast("double")), col(n).cast("double")).alias(v) for n, v in zip(columns, x)])
    d = scratch.table(d, "fit-rows")
    own = lambda df: df.where("part = 'train'").groupBy(*keys)
    middle = own(d).agg(*[F.percentile(v, F.lit(0.5)).alias(f"{v}m") for v in x], _share("y").alias("_tl_prior"), (F.countDistinct("y") > 1).alias("_tl_two"))
    d = d.join(middle, keys, "left").withColumns({v: F.coalesce(v, f"{v}m", F.lit(0.0)) for v in x})
    spread = own(d).agg(*[F.avg(v).alias(f"{v}a") for v in x], *[F.stddev_pop(v).alias(f"{v}s") for v in x])
    d = d.join(spread, keys, "left").withColumns({v: (col(v) - col(f"{v}a")) / F.when(col(f"{v}s") == 0, 1.0).otherwise(col(f"{v}s")) for v in x})
    d = scratch.table(d.select(*keys, "part", "ts", "y", *x, F.coalesce("_tl_prior", F.lit(0.5)).alias("_tl_prior"), F.coalesce("_tl_two", F.lit(False)).alias("_tl_two")), "fit-rows")
    w = newton_summed(d.where("part = 'train' AND _tl_two").select(*keys, *x, col("y").cast("double").alias("y")), keys, x, "y", 1.0 / c)
    z = functools.reduce(lambda a, i: a + col(x[i]) * col("w")[i + 1], range(len(x)), col("w")[0])
    return d.join(w, keys, "left").select(*keys, "part", "ts", "y", F.coalesce(1 / (1 + F.exp(-z)), "_tl_prior").alias("p"))


def platt(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``scored`` (keys, part, ts, y, p) with p calibrated by a logistic of its logit, fitted on the
    calibration part, all keys together; a constant where that has one class or one score."""
    d = scratch.table(scored.withColumn("_tl_z", logit(F.col("p"))), "fit-rows")
    own = d.where("part = 'calibration'")
    flat = own.groupBy(*keys).agg(_share("y").alias("_tl_prior"), ((F.countDistinct("y") > 1) & (F.max("_tl_z") - F.min("_tl_z") >= 1e-12)).alias("_tl_two"))
    fit = scratch.table(own.join(flat.where("_tl_two").select(*keys), keys).select(*keys, "_tl_z", F.col("y").cast("double").alias("y")), "fit-rows")
    w = newton_summed(fit, keys, ["_tl_z"], "y", 1e-6)
    z = F.col("w")[0] + F.col("w")[1] * F.col("_tl_z")
    out = d.join(w, keys, "left").join(flat.select(*keys, "_tl_prior"), keys, "left")
    return out.withColumn("p", F.coalesce(1 / (1 + F.exp(-z)), "_tl_prior", F.lit(0.5))).select(*scored.columns)


def fit_groups(rows: DataFrame, keys: list[str], columns: list[str], fit) -> DataFrame:
    """keys, part, ts, y, p with any model: ``fit(x, y)`` takes the train part's arrays and returns a
    function from features to probabilities. All groups are fitted in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        train = pdf[pdf["part"] == "train"]
        predict = fit(train[columns].to_numpy(float), train["y"].to_numpy(float))
        out = pdf[[*keys, "part", "ts", "y"]].copy()
        out["p"] = np.clip(predict(pdf[columns].to_numpy(float)), 0.0, 1.0)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "part", "ts", "y"]) + ", p double"
    return rows.select(*keys, "part", "ts", "y", *columns).groupBy(*keys).applyInPandas(run, schema)


#: Keys whose trees are fitted at the same time.
AT_ONCE = 8
#: Rows of a key that a task takes at most; a fit runs some sixty jobs over its key's tasks.
TASK_ROWS = 100_000


def boosted_trees(rows: DataFrame, keys: list[str], columns: list[str], trees: int = 20, depth: int = 3, step: float = 0.05, seed: int = 42) -> DataFrame:
    """keys, part, ts, y, p of all rows by Spark ML's gradient-boosted trees, fitted on each key's train part.

    Missing values take the train median; a train part with one class gives its prior. Each fit is a distributed job over its rows; the
    keys (a series' declared folds) are submitted ``AT_ONCE`` at a time. Rows lie in the order of the keys, so that a fit finds its own
    without reading the others', and each fit's scores are written by itself, so that the plan doesn't grow with the keys."""
    col = F.col
    x = [f"_tl_x{i}" for i in range(len(columns))]
    d = scratch.table(rows.select(*keys, "part", "ts", "y", *[F.when(~F.isnan(col(n).cast("double")), col(n).cast("double")).alias(v) for n, v in zip(columns, x)]), "fit-rows")
    train = d.where("part = 'train'").groupBy(*keys).agg(*[F.coalesce(F.percentile(v, F.lit(0.5)), F.lit(0.0)).alias(f"{v}m") for v in x], _share("y").alias("_tl_prior"), (F.countDistinct("y") > 1).alias("_tl_two"))
    train = scratch.table(train, "fit-keys")
    d = scratch.table(d.join(train, keys, "left").withColumns({v: F.coalesce(v, f"{v}m", F.lit(0.0)) for v in x}).drop(*[f"{v}m" for v in x]).sort(*keys, "ts"), "fit-rows")
    gather = VectorAssembler(inputCols=x, outputCol="_tl_v")
    out = d.where("NOT coalesce(_tl_two, false)").select(*keys, "part", "ts", "y", F.coalesce("_tl_prior", F.lit(0.5)).alias("p"))

    path = scratch.folder(rows.sparkSession, "tree-scores")

    def fitted(i: int, key) -> None:
        of_key = d.where(functools.reduce(lambda a, k: a & (col(k) == F.lit(key[k])), keys, F.lit(True))).coalesce(-(-key["_tl_n"] // TASK_ROWS))
        own = gather.transform(of_key.withColumn("_tl_y", col("y").cast("double")))
        model = GBTClassifier(labelCol="_tl_y", featuresCol="_tl_v", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed).fit(own.where("part = 'train'"))
        model.transform(own).select(*out.columns[:-1], vector_to_array("probability")[1].alias("p")).write.parquet(f"{path}/tl_fit={i}")

    two = d.where("_tl_two").groupBy(*keys).agg(F.count("*").alias("_tl_n")).collect()  # a row per fold
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(fitted, range(len(two)), two))
    return out.unionByName(rows.sparkSession.read.schema(out.schema).parquet(path).select(*out.columns)) if two else out
