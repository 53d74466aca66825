"""Structured extraction by a plug-in: a callable answers a prompt and a text with JSON, which is parsed, checked and kept or set aside."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNAL = "asset string, direction string, severity double, novelty double, confidence double"


def rules(signal: str = "signal") -> dict[str, Column]:
    """What a signal must hold, by the name of the rule."""
    c = lambda x: F.col(f"{signal}.{x}")
    share = lambda x: c(x).between(0, 1)
    return {"asset_form": (c("asset") == F.upper(F.trim(c("asset")))) & (c("asset") != ""), "direction_name": c("direction").isin("bullish", "bearish", "neutral"), "severity_range": share("severity"), "novelty_range": share("novelty"), "confidence_range": share("confidence")}


def extracted(docs: DataFrame, text: str, call: Callable[[str, pd.Series], pd.Series], prompt: str, schema: str = SIGNAL, checks: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with ``reply``, the parsed ``signal`` and ``problems``, the names of what is wrong with it in order.

    ``call`` gets a batch of texts (a null is an empty one) and returns a reply for each; it may answer differently when asked again, so a filter on
    its replies doesn't ask it a second time. A reply that isn't a JSON object of the
    schema's types is ``malformed``, one without a field (or with a null) has a ``missing_field``; a rule is only asked of complete signals."""
    answer = F.pandas_udf(lambda t: call(prompt, t), T.StringType()).asNondeterministic()
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    d = docs.withColumn("reply", answer(F.coalesce(F.col(text), F.lit(""))))
    d = d.withColumn("signal", F.from_json("reply", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    broken = F.col("signal").isNull() | F.col("signal._corrupt_record").isNotNull()
    missing = ~broken & F.greatest(*[F.col(f"signal.{x}").isNull() for x in fields])
    found = [F.when(broken, "malformed"), F.when(missing, "missing_field")] + [F.when(~broken & ~missing & ~F.coalesce(ok, F.lit(False)), n) for n, ok in (checks or rules()).items()]
    return d.withColumns({"problems": F.array_compact(F.array(*found)), "signal": F.struct(*[F.col(f"signal.{x}").alias(x) for x in fields])})


def accepted(rows: DataFrame) -> DataFrame:
    """Signals that hold all rules."""
    return rows.where(F.size("problems") == 0).select(*[x for x in rows.columns if x not in ("reply", "signal", "problems")], "signal.*")


def set_aside(rows: DataFrame) -> DataFrame:
    """The other replies as they came, with what is wrong with them."""
    return rows.where(F.size("problems") > 0).drop("signal")
