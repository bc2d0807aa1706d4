"""Audit of pre-labels against labels: rule thresholds from clean samples, predictions, report and review queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datakiln.functions import constants as C
from datakiln.functions.expressions import known_labels, label_iou, same_labels, sigmoid
from datakiln.operators.selection import percentiles


def first_clean(df: DataFrame, n: int = 300, seq: str = "seq", labels: str = "labels") -> DataFrame:
    """The first n clean samples in manifest order."""
    return df.where(F.coalesce(F.size(labels), F.lit(0)) <= 0).orderBy(seq).limit(n)


def calibrate_rules(clean: DataFrame, indicators: Sequence[str], low_side: Sequence[str], percentile: float = 3.0) -> DataFrame:
    """indicator, threshold, scale: tails of the indicators over clean samples.

    low_side indicators mean a defect when small. Indicators with fewer than two values are left out.
    """
    p = percentile / 100
    long = clean.select(
        F.explode(F.array(*(F.struct(F.lit(i).alias("indicator"), F.col(i).cast("double").alias("x")) for i in indicators))).alias("v")
    ).select("v.*").where("x is not null")
    q = percentiles(long, "indicator", "x", (p, 0.5, 1 - p)).where("n >= 2")
    threshold = F.when(F.col("indicator").isin(*low_side), F.col("q")[0]).otherwise(F.col("q")[2])
    span = F.abs(F.col("q")[1] - threshold)
    return q.select(
        "indicator", threshold.alias("threshold"), F.when(span <= 1e-9, F.abs(F.col("q")[1]) * 0.1 + 1e-6).otherwise(span).alias("scale")
    )


def rule_predict(df: DataFrame, rules: DataFrame, class_of: dict[str, str], low_side: Sequence[str]) -> DataFrame:
    """df with labels_pred and scores: the logistic of how far each indicator is past its threshold, in scales.

    rules has a few rows; an indicator without a threshold gives no label.
    """
    found = rules.agg(F.map_from_entries(F.collect_list(F.struct("indicator", F.struct("threshold", "scale")))).alias("_rules"))
    joined = df.crossJoin(F.broadcast(found))

    def score(indicator: str) -> Column:
        rule = F.col("_rules")[indicator]
        scale = F.coalesce(rule["scale"], F.abs(rule["threshold"]) * 0.5 + 1e-6)
        z = F.try_divide(F.col(indicator) - rule["threshold"], scale) * (-1 if indicator in low_side else 1)
        return F.coalesce(sigmoid(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))), F.lit(0.0))

    scores = {c: score(i) for i, c in class_of.items()}
    labels = F.filter(F.array(*(F.when(s > 0.5, c) for c, s in scores.items())), lambda x: x.isNotNull())
    return joined.withColumn("labels_pred", labels).withColumn(
        "scores", F.create_map(*(x for c, s in scores.items() for x in (F.lit(c), s)))
    ).drop("_rules")


def consistency_report(pred: DataFrame, labels: str = "labels", guessed: str = "labels_pred") -> DataFrame:
    """One row: n, exact rate, mean IoU, review size, consistency, false alarms on clean, missed defects, mean label counts."""
    a, b = F.col(labels), F.col(guessed)
    same, clean = same_labels(a, b), F.size(a) == 0
    n = F.count("*")
    agg = pred.agg(
        n.alias("n"),
        F.avg(same.cast("double")).alias("exact_rate"),
        F.avg(label_iou(a, b)).alias("mean_iou"),
        F.count_if(~same).alias("review_size"),
        F.count_if(clean).alias("n_clean"),
        F.count_if(clean & (F.size(b) > 0)).alias("_alarm"),
        F.count_if(~clean & (F.size(b) == 0)).alias("_missed"),
        F.avg(F.size(a).cast("double")).alias("mean_labels"),
        F.avg(F.size(b).cast("double")).alias("mean_labels_pred"),
    )
    return agg.select(
        "n",
        "exact_rate",
        "mean_iou",
        "review_size",
        (1 - F.try_divide("review_size", "n")).alias("consistency"),
        F.try_divide("_alarm", "n_clean").alias("clean_false_alarm"),
        F.try_divide("_missed", F.col("n") - F.col("n_clean")).alias("defect_missed"),
        "mean_labels",
        "mean_labels_pred",
    )


def consistency_recall(
    pred: DataFrame, classes: Sequence[str] = C.CLASSES, labels: str = "labels", guessed: str = "labels_pred"
) -> DataFrame:
    """class, support, recall."""
    long = pred.select(F.explode(labels).alias("class"), F.col(guessed).alias("g")).where(F.col("class").isin(*classes))
    return long.groupBy("class").agg(
        F.count("*").alias("support"), F.avg(F.array_contains("g", F.col("class")).cast("double")).alias("recall")
    )


def review_queue(pred: DataFrame, labels: str = "labels", guessed: str = "labels_pred", scores: str = "scores") -> DataFrame:
    """Samples whose labels differ, as the sheet for reviewers."""
    shown = F.array_join(F.transform(F.map_entries(scores), lambda e: F.format_string("%s:%.2f", e["key"], e["value"])), "|")
    return pred.where(~same_labels(F.col(labels), F.col(guessed))).select(
        "file",
        "origin_id",
        "source",
        F.array_join(labels, "|").alias("rule_labels"),
        F.array_join(guessed, "|").alias("vlm_labels"),
        shown.alias("scores"),
        F.lit("pending").alias("status"),
    )


def prototype_decision(similar: DataFrame, keys: Sequence[str], scale: float = 100.0, least: float = 0.18, most: int = 3) -> DataFrame:
    """keys, labels_pred, probs from (keys, class, similarity) rows, one per class and template, with the class normal.

    A class has its best template's similarity; a softmax makes probabilities. If normal is as likely as any class there is
    no label, else those over the limit, at most three, most likely first.
    """
    best = similar.groupBy(*keys, "class").agg(F.max("similarity").alias("s"))
    top = best.groupBy(*keys).agg(F.collect_list(F.struct("class", "s")).alias("c"))
    peak = F.array_max(F.transform("c", lambda x: x["s"]))
    raw = top.withColumn("_peak", peak).withColumn(
        "e", F.transform("c", lambda x: F.struct(x["class"].alias("class"), F.exp((x["s"] - F.col("_peak")) * scale).alias("p")))
    )
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["p"])
    probs = raw.withColumn("_total", total).withColumn(
        "e", F.transform("e", lambda x: F.struct(x["class"].alias("class"), (x["p"] / F.col("_total")).alias("p")))
    )
    normal = F.coalesce(F.array_max(F.transform(F.filter("e", lambda x: x["class"] == C.NORMAL), lambda x: x["p"])), F.lit(-1.0))
    others = F.filter("e", lambda x: x["class"] != C.NORMAL)
    ordered = F.array_sort(
        F.transform(F.filter(others, lambda x: x["p"] > least), lambda x: F.struct((-x["p"]).alias("p"), x["class"].alias("class")))
    )
    highest = F.array_max(F.transform(others, lambda x: x["p"]))
    chosen = F.when(
        F.coalesce(normal >= highest, F.lit(True)), F.array().cast("array<string>")
    ).otherwise(F.transform(F.slice(ordered, 1, most), lambda x: x["class"]))
    return probs.select(*keys, chosen.alias("labels_pred"), F.map_from_entries("e").alias("probs"))


#: name: a transform that adds labels_pred (ARRAY) and scores (MAP); model-backed ones are registered by their users.
BACKENDS: dict = {}


def register_backend(name: str, transform) -> None:
    BACKENDS[name] = transform


def run_backend(name: str, df: DataFrame, **options) -> DataFrame:
    if name not in BACKENDS:
        raise KeyError(f"no backend {name!r}; there are {sorted(BACKENDS)}")
    return BACKENDS[name](df, **options)


register_backend("rule", rule_predict)
register_backend("answers", lambda df, answer="answer": df.withColumn("labels_pred", known_labels(F.col(answer))))
