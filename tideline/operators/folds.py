"""Walk-forward folds by arithmetic on row counts, assignment and purging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.features import ordered
from tideline.settings import Split


def positions(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.withColumn("pos", (F.row_number().over(ordered(keys)) - 1).cast("long"))


def sealed_folds(counts: DataFrame, s: Split = Split()) -> DataFrame:
    """(series_id, fold, part, start, stop) of every fold that fits in ``counts`` (series_id, n)."""
    whole = s.train + s.calibration + s.validation + s.test + 2 * s.embargo
    k = F.floor((F.col("n") - whole) / s.step)
    d = counts.where(F.col("n") >= whole).select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), k.cast("long"))).alias("fold"))
    end = F.lit(s.train) + F.col("fold") * s.step
    cal, val = end + s.embargo, end + s.embargo + s.calibration
    test = val + s.validation + s.embargo
    part = lambda name, a, b: F.struct(F.lit(name).alias("part"), a.cast("long").alias("start"), b.cast("long").alias("stop"))
    parts = F.array(part("train", F.lit(0), end), part("calibration", cal, cal + s.calibration), part("validation", val, val + s.validation), part("test", test, test + s.test))
    return d.select("series_id", "fold", F.inline(parts))


def expanding_folds(counts: DataFrame, train: int, test: int, step: int | None = None, gap: int = 1) -> DataFrame:
    """(series_id, fold, train_end, test_start, test_end), folds numbered from 1."""
    step = step or test
    whole = train + gap + test
    d = counts.where(F.col("n") >= whole).select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - whole) / step).cast("long"))).alias("k"))
    end = (F.lit(train) + F.col("k") * step).cast("long")
    return d.select("series_id", (F.col("k") + 1).alias("fold"), end.alias("train_end"), (end + gap).alias("test_start"), (end + gap + test).alias("test_end"))


def assign(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row (series_id, pos, ...) once per fold part [start, stop) that holds it.

    Folds of a series are few; they meet its rows on series_id, with the range as the join's condition."""
    f = folds.withColumnRenamed("series_id", "_tl_s")
    on = (rows["series_id"] == f["_tl_s"]) & (rows["pos"] >= f["start"]) & (rows["pos"] < f["stop"])
    return rows.join(f, on).drop("_tl_s")


def purge(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Assigned rows whose label is known when the next part makes its first decision; test rows
    need a label only. ``rows`` has decision_time, label_available_at and target_positive."""
    following = F.element_at(F.create_map(*[F.lit(x) for x in ("train", "calibration", "calibration", "validation", "validation", "test")]), F.col("part"))
    assigned = assign(rows, folds).withColumn("_tl_next", following)
    first = assigned.where("pos = start").select("series_id", "fold", F.col("part").alias("_tl_next"), F.col("decision_time").alias("known_by"))
    d = assigned.join(first, ["series_id", "fold", "_tl_next"], "left").drop("_tl_next")
    known = F.col("target_positive").isNotNull() & ((F.col("part") == "test") | (F.col("label_available_at") <= F.col("known_by")))
    return d.where(known)
