"""Multi-label evaluation over long scores: a row per sample and class with logit or prob, and y.

Predictions are prob > threshold. Ratios without a denominator are null, and means skip nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datakiln.functions.expressions import sigmoid

GRID = 81


def to_long(
    df: DataFrame, values: str, truth: str, classes: Sequence[str], keys: Sequence[str] = ("sample_id",), value_name: str = "logit"
) -> DataFrame:
    """A row per class of rows with an array of scores and one of targets, both in class order."""
    zipped = F.arrays_zip(F.array(*(F.lit(c) for c in classes)).alias("class"), F.col(values).alias("v"), F.col(truth).alias("y"))
    return df.select(*keys, F.explode(zipped).alias("_z")).select(
        *keys, F.col("_z.class").alias("class"), F.col("_z.v").cast("double").alias(value_name), F.col("_z.y").cast("int").alias("y")
    )


def with_probs(scores: DataFrame) -> DataFrame:
    return scores.withColumn("prob", sigmoid(F.col("logit")))


def with_auto_probs(scores: DataFrame, value: str = "prob") -> DataFrame:
    """Scores that hold a negative anywhere are logits and go through the sigmoid; one scalar decides for all."""
    low = scores.agg((F.min(value) < 0).alias("_logits"))
    return scores.crossJoin(F.broadcast(low)).withColumn(
        value, F.when(F.col("_logits"), sigmoid(F.col(value))).otherwise(F.col(value))
    ).drop("_logits")


def predicted(scores: DataFrame, thresholds: DataFrame | float = 0.5) -> DataFrame:
    """Adds pred; thresholds are one number or a (class, threshold) table."""
    if isinstance(thresholds, DataFrame):
        return scores.join(
            F.broadcast(thresholds.select("class", "threshold")), "class"
        ).withColumn("pred", (F.col("prob") > F.col("threshold")).cast("int")).drop("threshold")
    return scores.withColumn("pred", (F.col("prob") > float(thresholds)).cast("int"))


def confusion(pred: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """tp, fp, fn, tn of each class."""
    yes, truth = F.col("pred") == 1, F.col("y") == 1
    return pred.groupBy(*by).agg(
        F.count_if(yes & truth).alias("tp"),
        F.count_if(yes & ~truth).alias("fp"),
        F.count_if(~yes & truth).alias("fn"),
        F.count_if(~yes & ~truth).alias("tn"),
    )


def f1_of(precision: Column, recall: Column, tp: Column, fp: Column, fn: Column) -> Column:
    both = (precision > 0) & (recall > 0)
    return F.when(both, 2 * precision * recall / (precision + recall)).when(tp + fp + fn > 0, F.lit(0.0))


def prf(pred: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """Precision, recall and F1 of each class with its confusion counts."""
    return prf_of(confusion(pred, by))


def prf_of(c: DataFrame) -> DataFrame:
    """Precision, recall and F1 of rows of confusion counts."""
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    with_pr = c.withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn))
    return with_pr.withColumn("f1", f1_of(F.col("precision"), F.col("recall"), tp, fp, fn))


def macro_f1(pred: DataFrame) -> DataFrame:
    return prf(pred).agg(F.avg("f1").alias("macro_f1"))


def slice_metrics(pred: DataFrame, keys: Sequence[str] = ("scene", "difficulty", "source"), sample: str = "sample_id") -> DataFrame:
    """key, bucket, n, macro_f1, macro_recall: grouping sets of each key with the class, in one pass."""
    pairs = F.explode(
        F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("bucket")) for k in keys))
    )
    long = pred.select("*", pairs.alias("_s")).select("_s.key", "_s.bucket", "class", "pred", "y", sample)
    return slices_of(confusion(long, ("key", "bucket", "class")))


def slices_of(counts: DataFrame, by: Sequence[str] = ("key", "bucket")) -> DataFrame:
    """n, macro_f1 and macro_recall of slices from the confusion counts of their classes."""
    return prf_of(counts).groupBy(*by).agg(
        F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
        F.avg("f1").alias("macro_f1"),
        F.avg("recall").alias("macro_recall"),
    )


def bin_edges(spark: SparkSession, bins: int = 10) -> DataFrame:
    """bin, lo, hi of even bins over 0 to 1, closed above; edges are products, as an even grid of doubles gives them."""
    step = 1.0 / bins
    edges = [i * step for i in range(bins)] + [1.0]
    return spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, lo double, hi double")


def _step_of(x: Column, low: float, step: float, last: int, closed_below: bool) -> Column:
    """Index of the grid interval that holds x, exactly as comparisons with low + index * step would give it.

    The quotient can be off by one where doubles round, so it is checked against the two edges. Intervals are closed below
    or above; what lies outside goes to -1 or last (closed below), or to the first or last interval (closed above).
    """
    at = F.floor((x - low) / step) if closed_below else F.ceil((x - low) / step) - 1
    edge, following = F.lit(low) + at * F.lit(step), F.lit(low) + (at + 1) * F.lit(step)
    if closed_below:
        exact = F.when(x >= following, at + 1).when(x < edge, at - 1).otherwise(at)
        return F.greatest(F.lit(-1), F.least(F.lit(last), exact)).cast("int")
    exact = F.when(x > following, at + 1).when(x <= edge, at - 1).otherwise(at)
    return F.greatest(F.lit(0), F.least(F.lit(last), exact)).cast("int")


def bin_of(conf: Column, bins: int = 10) -> Column:
    """The even bin over 0 to 1 that holds a confidence."""
    return _step_of(conf, 0.0, 1.0 / bins, bins - 1, False)


def reliability_bins(pairs: DataFrame, bins: int = 10, conf: str = "prob", correct: str = "correct") -> DataFrame:
    """bin, lo, hi, n, confidence, accuracy; empty bins are there with nulls. The first bin is closed below too."""
    edges = bin_edges(pairs.sparkSession, bins)
    inside = pairs.where(F.col(conf).between(0.0, 1.0)).withColumn("bin", bin_of(F.col(conf), bins))
    stats = inside.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(conf).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    )
    return edges.join(stats, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def _ece(stats: DataFrame, name: str) -> DataFrame:
    weight = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return stats.agg(F.coalesce(F.try_divide(F.sum(weight), F.sum("n")), F.lit(0.0)).alias(name))


def multilabel_pairs(scores: DataFrame, standard: bool = False) -> DataFrame:
    """prob and correct of every sample and class: whether the decision at one half is right.

    The confidence is the probability itself, so a sure negative counts as unsure; with standard it is that of the decision.
    """
    correct = ((F.col("prob") >= 0.5).cast("int") == F.col("y")).alias("correct")
    prob = F.greatest(F.col("prob"), 1 - F.col("prob")).alias("prob") if standard else F.col("prob")
    return scores.select(prob, correct)


def ece_multilabel(scores: DataFrame, bins: int = 10, standard: bool = False) -> DataFrame:
    return _ece(reliability_bins(multilabel_pairs(scores, standard), bins), "ece_multilabel")


def singlelabel_pairs(scores: DataFrame, classes: Sequence[str], sample: str = "sample_id", by: Sequence[str] = ()) -> DataFrame:
    """The greatest probability of each sample and whether its class (the first if tied) is the first target."""
    place = F.create_map(*(F.lit(x) for i, c in enumerate(classes) for x in (c, i)))[F.col("class")]
    best = scores.groupBy(sample, *by).agg(
        F.max(F.struct(F.col("prob"), (-place).alias("i"))).alias("p"), F.max(F.struct(F.col("y"), (-place).alias("i"))).alias("t")
    )
    return best.select(*by, F.col("p.prob").alias("prob"), (F.col("p.i") == F.col("t.i")).alias("correct"))


def ece_singlelabel(scores: DataFrame, classes: Sequence[str], bins: int = 10, sample: str = "sample_id") -> DataFrame:
    return _ece(reliability_bins(singlelabel_pairs(scores, classes, sample), bins), "ece_singlelabel")


def brier(scores: DataFrame) -> DataFrame:
    """Mean over classes of the mean squared error."""
    return scores.groupBy("class").agg(F.avg((F.col("prob") - F.col("y")) ** 2).alias("b")).agg(F.avg("b").alias("brier"))


def threshold_grid(spark: SparkSession, n: int = GRID, low: float = 0.05, high: float = 0.95) -> DataFrame:
    step = (high - low) / (n - 1)
    return spark.range(n).select(F.col("id").cast("int").alias("step"), (F.lit(low) + F.col("id") * F.lit(step)).alias("threshold"))


def threshold_curve(scores: DataFrame, n: int = GRID, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """class, threshold, precision, recall at each grid point; predictions here are prob >= threshold.

    One pass makes a histogram over the grid per class; the counts above each point are running sums of it.
    """
    truth = F.col("y") == 1
    reached = _step_of(F.col("prob"), low, (high - low) / (n - 1), n - 1, True)
    hist = scores.where(F.col("prob").isNotNull()).groupBy("class", reached.alias("step")).agg(
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg")
    )
    totals = hist.groupBy("class").agg(F.sum("pos").alias("all_pos"))
    points = totals.crossJoin(F.broadcast(threshold_grid(scores.sparkSession, n, low, high))).join(hist, ["class", "step"], "left")
    above = Window.partitionBy("class").orderBy(F.desc("step"))
    tp, fp = (F.sum(F.coalesce(c, F.lit(0))).over(above) for c in ("pos", "neg"))
    zero = F.lit(0.0)
    return points.select("class", "threshold", "all_pos", tp.alias("tp"), fp.alias("fp")).select(
        "class",
        "threshold",
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "all_pos"), zero).alias("recall"),
    )


def search_thresholds(scores: DataFrame, recall_floor: float = 0.95, n: int = GRID) -> DataFrame:
    """Per class the threshold of the best precision with enough recall (ties: the lowest); without one, of the best recall."""
    curve = threshold_curve(scores, n).withColumn("meets_recall_floor", F.col("recall") >= recall_floor)
    value = F.when(F.col("meets_recall_floor"), F.col("precision")).otherwise(F.bround("recall", 4))
    order = Window.partitionBy("class").orderBy(F.desc("meets_recall_floor"), F.desc(value), "threshold")
    return curve.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def pos_weight(targets: DataFrame) -> DataFrame:
    """Negatives over positives of each class, with at least one positive assumed."""
    pos = F.count_if(F.col("y") == 1)
    return targets.groupBy("class").agg(((F.count("*") - pos) / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def evaluate(scores: DataFrame, classes: Sequence[str], thresholds: DataFrame | float = 0.5, sample: str = "sample_id") -> DataFrame:
    """One row with all metrics of long scores with prob: nested per class, bins and confusion."""
    pred = predicted(scores, thresholds)
    per = prf(pred)
    table = per.agg(
        F.avg("f1").alias("macro_f1"),
        F.map_from_entries(F.collect_list(F.struct("class", F.struct("precision", "recall", "f1")))).alias("per_class"),
        F.map_from_entries(F.collect_list(F.struct("class", F.struct("tp", "fp", "fn", "tn")))).alias("confusion"),
    )
    stats = reliability_bins(multilabel_pairs(scores))
    bins = stats.agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "n", "confidence", "accuracy"))).alias("reliability_bins"))
    out = table.crossJoin(_ece(stats, "ece_multilabel")).crossJoin(
        ece_singlelabel(scores, classes, sample=sample).withColumnRenamed("ece_singlelabel", "ece_singlelabel_ref")
    )
    return out.crossJoin(brier(scores)).crossJoin(bins).crossJoin(scores.agg(F.countDistinct(sample).alias("n")))


def best_epoch(log: DataFrame, by: Sequence[str], score: str = "macro_f1", epoch: str = "epoch") -> DataFrame:
    """The first epoch of the greatest score of each run."""
    return log.groupBy(*by).agg(
        F.max(F.struct(F.col(score), (-F.col(epoch)).alias("_e"))).alias("_b")
    ).select(*by, (-F.col("_b._e")).alias(epoch), F.col(f"_b.{score}").alias(score))
