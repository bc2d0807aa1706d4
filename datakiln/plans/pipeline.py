"""Entry points: the data pipeline, an experiment's evaluation, and the annotation loop, as composed DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datakiln.functions.expressions import stratum
from datakiln.functions.image import with_phash
from datakiln.operators import dedup, evaluation, sampling, split, tables
from datakiln.operators.generators import build_edits, build_longtail, build_procedural
from datakiln.sources.scratch import written


class LeakError(RuntimeError):
    """An origin is in more than one split."""


@dataclass
class Dataset:
    manifest: DataFrame
    eval_set: DataFrame


def curate(
    real: DataFrame,
    procedural: int = 6000,
    edits: int = 2000,
    eval_target: int = 1400,
    picked: int = 1200,
    longtail: int = 200,
    threshold: int = 4,
    seed: int = 42,
) -> Dataset:
    """real (manifest columns with phash, seq and image) to a split manifest and the frozen eval set.

    Variants are rendered and hashed once and written; all decisions are made on keys, and pixels join the results.
    """
    top = (real.agg(F.max("seq")).first()[0] or 0) + 1
    first = build_procedural(real, procedural, seed).withColumn("seq", F.col("i") + top)
    second = build_edits(real, edits, seed, offset=procedural).withColumn("seq", F.col("i") + top + procedural)
    made = with_phash(first.unionByName(second)).drop("i")
    rows = written(tables.manifest_union(real, made), "rendered")
    pixels, keys = rows.select("file", "image"), rows.drop("image")
    live = tables.active(dedup.dedup(keys, threshold))
    live = written(live, "live")
    done = written(split.with_split(live, split.assign_splits(live, eval_target, seed)), "split")
    if not split.check_leakage(done).first().passed:
        raise LeakError("an origin is in more than one split")
    cell = stratum(F.col("labels"), F.lit(None).cast("array<string>"), F.col("scene"), F.col("difficulty"))
    parts = ("_c.defect", F.col("_c.scene").alias("cell_scene"), F.col("_c.difficulty").alias("cell_difficulty"))
    cells = tables.eval_pool(done).withColumn("_c", cell).select("*", *parts)
    by = ["defect", "cell_scene", "cell_difficulty"]
    chosen = sampling.stratified_sample(cells, by, picked, "file", "seq", seed).drop("_c", *by)
    pool = tables.longtail_pool(done).join(pixels, "file")
    tail = build_longtail(pool, longtail, seed).drop("i").withColumn("seq", F.lit(None).cast("long"))
    frozen = tables.eval_rows(tables.manifest_union(chosen.join(pixels, "file"), tail))
    return Dataset(done.join(pixels, "file"), written(frozen, "eval"))


def experiment(
    val: DataFrame, test: DataFrame, classes: tuple[str, ...], keys: tuple[str, ...] = ("scene", "difficulty", "source")
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Thresholds found on val only, and the metrics and slices of test at them; both hold long scores with prob."""
    thresholds = evaluation.search_thresholds(val)
    pred = evaluation.predicted(test, thresholds)
    return thresholds, evaluation.evaluate(test, classes, thresholds), evaluation.slice_metrics(pred, keys)
