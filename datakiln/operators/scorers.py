"""Scorers: functions from samples to long scores. The built-in one is a logistic regression per class; others plug in alike."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datakiln.functions.expressions import labels_to_multihot
from datakiln.operators.evaluation import pos_weight, with_probs
from datakiln.operators.sampling import sample_without_replacement
from datakiln.operators.tables import active, of_source, of_split

Scorer = Callable[[DataFrame], DataFrame]


def samples(
    df: DataFrame,
    classes: Sequence[str],
    split: str | None = None,
    keep: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    limit: int | None = None,
    seed: int = 42,
    key: str = "file",
) -> DataFrame:
    """Active samples of a split and sources with their targets, in class order; a limited number in hash order."""
    rows = of_source(active(df), keep, exclude)
    rows = of_split(rows, split) if split else rows
    rows = sample_without_replacement(rows, limit, key, seed) if limit is not None else rows
    return rows.withColumn("truth", labels_to_multihot(F.coalesce("labels", F.array().cast("array<string>")), classes))


def train(
    rows: DataFrame, classes: Sequence[str], features: str = "features", iterations: int = 50, l2: float = 1e-3
) -> dict[str, LogisticRegressionModel]:
    """A weighted logistic regression per class; a class of one value only has none."""
    vectors = rows.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    targets = rows.select(
        F.explode(F.arrays_zip(F.array(*(F.lit(c) for c in classes)).alias("class"), F.col("truth").alias("y"))).alias("t")
    ).select("t.*")
    weights = {r["class"]: r.pos_weight for r in pos_weight(targets).collect()}
    seen = {r["class"]: (r.lo, r.hi) for r in targets.groupBy("class").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).collect()}
    out = {}
    for i, c in enumerate(classes):
        if seen.get(c) == (0, 1):
            y = F.col("truth")[i]
            data = vectors.select("_v", y.cast("double").alias("label"), F.when(y == 1, weights[c]).otherwise(1.0).alias("w"))
            out[c] = LogisticRegression(featuresCol="_v", labelCol="label", weightCol="w", maxIter=iterations, regParam=l2).fit(data)
    return out


def linear_scorer(
    models: dict[str, LogisticRegressionModel], classes: Sequence[str], features: str = "features", keys: Sequence[str] = ("file",)
) -> Scorer:
    """Long scores (keys, class, logit, prob, y) from fitted models; a class without a model has logit 0."""

    def score(rows: DataFrame) -> DataFrame:
        x = F.col(features).cast("array<double>")
        logits = []
        for c in classes:
            m = models.get(c)
            if m is None:
                logits.append(F.lit(0.0))
                continue
            w = F.array(*(F.lit(float(v)) for v in m.coefficients))
            logits.append(F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(m.intercept)), lambda a, b: a + b))
        zipped = F.arrays_zip(
            F.array(*(F.lit(c) for c in classes)).alias("class"), F.array(*logits).alias("logit"), F.col("truth").alias("y")
        )
        return with_probs(rows.select(*keys, F.explode(zipped).alias("_z")).select(*keys, "_z.class", "_z.logit", "_z.y"))

    return score


def throughput(scorer: Scorer, rows: DataFrame) -> float:
    """Samples a second of a scorer over all rows."""
    n = rows.count()
    began = time.perf_counter()
    scorer(rows).write.format("noop").mode("overwrite").save()
    return n / (time.perf_counter() - began)


__all__ = ["Scorer", "linear_scorer", "samples", "throughput", "train"]
