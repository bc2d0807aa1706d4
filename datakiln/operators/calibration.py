"""Temperature calibration of logits: the scalar that gives the least binary cross entropy, fitted on validation rows only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datakiln.functions.expressions import apply_temperature, sigmoid, stable_bce
from datakiln.operators.evaluation import brier, ece_multilabel, macro_f1, predicted


def nll_grid(scores: DataFrame, temperatures: Sequence[float]) -> DataFrame:
    """temperature, nll: the mean loss at every temperature in one pass."""
    grid = F.array(*(F.lit(float(t)) for t in temperatures))
    each = scores.select("logit", "y", F.explode(grid).alias("temperature"))
    return each.groupBy("temperature").agg(
        F.avg(stable_bce(apply_temperature(F.col("logit"), F.col("temperature")), F.col("y"))).alias("nll")
    )


def fit_temperature(scores: DataFrame, low: float = 0.05, high: float = 20.0, points: int = 17, rounds: int = 5) -> tuple[float, float]:
    """Temperature and loss: a log-spaced grid in one pass, then finer ones around its best point."""
    a, b = math.log(low), math.log(high)
    best = (1.0, math.inf)
    for _ in range(rounds):
        grid = [math.exp(a + (b - a) * i / (points - 1)) for i in range(points)]
        rows = nll_grid(scores, grid).collect()  # as many as grid points
        if not rows or rows[0].nll is None:
            return 1.0, math.nan
        found = min(rows, key=lambda r: (r.nll, r.temperature))
        best = (found.temperature, found.nll)
        step = (b - a) / (points - 1)
        a, b = math.log(best[0]) - step, math.log(best[0]) + step
    return best


def calibration_report(scores: DataFrame, temperature: float) -> DataFrame:
    """Before and after: ECE, Brier score and macro F1 at one half, which a temperature does not change."""
    out = None
    for name, logit in (("before", F.col("logit")), ("after", apply_temperature(F.col("logit"), temperature))):
        probs = scores.withColumn("prob", sigmoid(logit))
        row = ece_multilabel(probs).crossJoin(brier(probs)).crossJoin(macro_f1(predicted(probs))).select(
            F.lit(name).alias("stage"), "ece_multilabel", "brier", "macro_f1"
        )
        out = row if out is None else out.unionByName(row)
    return out
