"""Agreement of annotators: merging sheets and Cohen's kappa."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datakiln.functions import constants as C

_NONE = "array<string>"


def merge_annotations(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, annotator1, annotator2 for every row of a; files that b lacks have no labels there, files of b only are dropped."""
    other = b.select("file", F.col("labels").alias("annotator2"))
    met = a.select("file", F.col("labels").alias("annotator1")).join(other, "file", "left")
    return met.select("file", "annotator1", F.coalesce("annotator2", F.array().cast(_NONE)).alias("annotator2"))


def long_pairs(merged: DataFrame, classes: Sequence[str] = C.CLASSES) -> DataFrame:
    """file, class, y1, y2."""
    return merged.select("file", "annotator1", "annotator2", F.explode(F.array(*(F.lit(c) for c in classes))).alias("class")).select(
        "file",
        "class",
        *(F.coalesce(F.array_contains(f"annotator{i}", F.col("class")), F.lit(False)).cast("int").alias(f"y{i}") for i in (1, 2)),
    )


def kappa_per_class(pairs: DataFrame) -> DataFrame:
    """class, n, po, pe, kappa of (class, y1, y2) rows; where chance explains all, kappa is 1 if they always agree, else 0."""
    s = pairs.groupBy("class").agg(
        F.count("*").alias("n"),
        F.avg((F.col("y1") == F.col("y2")).cast("double")).alias("po"),
        F.avg(F.col("y1").cast("double")).alias("p1"),
        F.avg(F.col("y2").cast("double")).alias("p2"),
    )
    s = s.withColumn("pe", F.col("p1") * F.col("p2") + (1 - F.col("p1")) * (1 - F.col("p2")))
    sure = F.when(F.col("po") >= 1 - 1e-12, 1.0).otherwise(0.0)
    return s.select(
        "class",
        "n",
        "po",
        "pe",
        F.when(F.col("pe") >= 1 - 1e-12, sure).otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe"))).alias("kappa"),
    )


def macro_kappa(pairs: DataFrame) -> DataFrame:
    """Mean of the class values after rounding each to four places; 0 without any pair."""
    return kappa_per_class(pairs).agg(F.coalesce(F.avg(F.bround("kappa", 4)), F.lit(0.0)).alias("macro_kappa"))
