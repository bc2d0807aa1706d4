"""Evaluation as mergeable state: counts and sums that new scores are folded into, with all metrics read from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.operators import evaluation as E
from datakiln.sources import scratch

KEYS = ("run", "kind", "key", "bucket", "class")
COUNTS = ("tp", "fp", "fn", "tn", "n", "correct")
SCHEMA = ", ".join([*(f"{c} string" for c in KEYS), *(f"{c} long" for c in COUNTS), "total decimal(38,18)"])


def _exact(x: Column) -> Column:
    """A number of 0 to 1 as a decimal: sums are then the same in any order."""
    return x.cast("decimal(20,18)")


def state_of(
    pred: DataFrame, names: Sequence[str], slices: Sequence[str] = (), run: str | None = None, sample: str = "sample_id", bins: int = 10
) -> DataFrame:
    """State of long scores (class, prob, pred, y, a column for each slice and one for the run, if named); names: the classes.

    kind 'slice' has the confusion counts of a class in a bucket (key 'all': of all rows), 'multi' the rows, right decisions
    and sum of confidences of a reliability bin, 'brier' the squared errors of a class, and 'single' what 'multi' has for the
    best class of each sample, ties to the first of names. A sample's rows must be in one state. Null scores are counted in
    slices as evaluation does and are left out elsewhere; no rows, no state.
    """
    of_run = F.coalesce(F.col(run).cast("string"), F.lit("unknown")) if run else F.lit("all")
    rows = pred.withColumn("_run", of_run)
    yes, truth, prob = F.col("pred") == 1, F.col("y") == 1, F.col("prob")

    def part(kind: str, key: str = "all", bucket: Column | None = None, **values: Column) -> Column:
        counts = (F.coalesce(values.get(c, F.lit(0)).cast("long"), F.lit(0)).alias(c) for c in COUNTS)
        group = F.lit(kind).alias("kind"), F.lit(key).alias("key"), (F.lit("all") if bucket is None else bucket).alias("bucket")
        return F.struct(*group, *counts, _exact(values.get("total", F.lit(0))).cast("decimal(38,18)").alias("total"))

    cells = {"tp": yes & truth, "fp": yes & ~truth, "fn": ~yes & truth, "tn": ~yes & ~truth}
    inside = prob.between(0.0, 1.0)
    parts = [part("slice", **cells)]
    parts += [part("slice", k, F.coalesce(F.col(k).cast("string"), F.lit("unknown")), **cells) for k in slices]
    right = (prob >= 0.5).cast("int") == F.col("y")
    parts.append(F.when(inside, part("multi", "bin", E.bin_of(prob, bins).cast("string"), n=F.lit(1), correct=right, total=prob)))
    parts.append(F.when(prob.isNotNull(), part("brier", n=F.lit(1), total=(prob - F.col("y")) ** 2)))
    long = rows.select("_run", "class", F.explode(F.array(*parts)).alias("p")).where("p is not null")
    # bins are of all classes
    own = F.when(F.col("p.kind") == "multi", F.lit("all")).otherwise(F.col("class"))
    per_row = long.select(F.col("_run").alias("run"), own.alias("class"), "p.*")
    best = E.singlelabel_pairs(rows, names, sample, ("_run",))
    single = part("single", "bin", F.when(inside, E.bin_of(prob, bins).cast("string")).otherwise("none"),
                  n=F.lit(1), correct=F.col("correct"), total=F.when(inside, prob))
    per_sample = best.select(F.col("_run").alias("run"), F.lit("all").alias("class"), single.alias("p")).select("run", "class", "p.*")
    return merged(per_row.unionByName(per_sample))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several: groups are added up."""
    rows = reduce(DataFrame.unionByName, states)
    sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in COUNTS), F.sum("total").cast("decimal(38,18)").alias("total"))
    return sums.select(*KEYS, *COUNTS, "total")


def slices(state: DataFrame) -> DataFrame:
    """run, key, bucket, n, macro_f1, macro_recall."""
    return E.slices_of(state.where("kind = 'slice'"), ("run", "key", "bucket"))


def classes(state: DataFrame) -> DataFrame:
    """run, class, confusion counts, precision, recall, f1 over all rows."""
    counts = state.where("kind = 'slice' and key = 'all'").select("run", "class", "tp", "fp", "fn", "tn")
    return E.prf_of(counts)


def calibration(state: DataFrame) -> DataFrame:
    """run, ece_multilabel, ece_singlelabel, brier, n (samples)."""
    gap = F.abs(F.col("correct") - F.col("total").cast("double"))
    kind, binned = F.col("kind"), F.col("bucket") != "none"

    def ece(k: str) -> Column:
        this = (kind == k) & binned
        return F.coalesce(F.try_divide(F.sum(F.when(this, gap)), F.sum(F.when(this, F.col("n")))), F.lit(0.0))

    error = F.when(kind == "brier", F.col("total").cast("double") / F.col("n"))
    samples = F.coalesce(F.sum(F.when(kind == "single", F.col("n"))), F.lit(0))
    return state.groupBy("run").agg(
        ece("multi").alias("ece_multilabel"), ece("single").alias("ece_singlelabel"), F.avg(error).alias("brier"), samples.alias("n")
    )


class EvaluationStore:
    """State kept in a shared folder. Each batch writes the state of all so far and then an empty file DONE; a batch that is
    already done changes nothing and one that failed starts over. Batches are numbered from 0 and come in order."""

    def __init__(
        self, spark: SparkSession, path: str, names: Sequence[str], slices: Sequence[str] = (), run: str | None = None,
        sample: str = "sample_id",
    ) -> None:
        self.spark, self.path, self.names, self.by, self.run, self.sample = spark, path, names, slices, run, sample

    def done(self) -> int:
        n = 0
        while scratch.is_there(self.spark, f"{self.path}/batch={n}/DONE"):
            n += 1
        return n

    def state(self) -> DataFrame:
        n = self.done()
        if not n:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/batch={n - 1}/state")

    def fold(self, pred: DataFrame, batch: int) -> None:
        n = self.done()
        if batch < n:
            return
        if batch > n:
            raise ValueError(f"batch {batch} comes before batch {n}")
        new = merged(self.state(), state_of(pred, self.names, self.by, self.run, self.sample))
        new.write.mode("overwrite").parquet(f"{self.path}/batch={batch}/state")
        scratch.mark(self.spark, f"{self.path}/batch={batch}/DONE")

    def slices(self) -> DataFrame:
        return slices(self.state())

    def classes(self) -> DataFrame:
        return classes(self.state())

    def calibration(self) -> DataFrame:
        return calibration(self.state())
