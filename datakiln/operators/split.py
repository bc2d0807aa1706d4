"""Leak-free grouped splits: all samples of an origin share a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datakiln.functions.expressions import order_key
from datakiln.operators.ranking import hash_ranked


def group_by_origin(df: DataFrame, origin: str = "origin_id") -> DataFrame:
    """origin and its number of samples; the samples stay where they are."""
    return df.groupBy(origin).agg(F.count("*").alias("n"))


def assign_splits(
    df: DataFrame, eval_target: int, seed: int = 42, origin: str = "origin_id", train: float = 0.7, val: float = 0.2
) -> DataFrame:
    """origin, n, split: origins in hash order go to eval while the samples before them are under the target; of the rest the first parts go to train and val, what is left to test."""
    origins = group_by_origin(df, origin).withColumn("_order", order_key(seed, F.col(origin)))
    ranked = hash_ranked(origins, [], "_order", origin, "n").drop("rank").withColumn("_eval", F.col("before") < eval_target).drop("before")
    rest = hash_ranked(ranked.where(~F.col("_eval")), [], "_order", origin)
    size = ranked.where(~F.col("_eval")).agg(F.count("*").alias("_rest"))
    n_train, n_val = F.floor(F.col("_rest") * train), F.floor(F.col("_rest") * val)
    named = rest.crossJoin(F.broadcast(size)).withColumn(
        "split", F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    )
    return named.select(origin, "n", "split").unionByName(ranked.where("_eval").select(origin, "n", F.lit("eval").alias("split")))


def with_split(df: DataFrame, splits: DataFrame, origin: str = "origin_id") -> DataFrame:
    return df.drop("split").join(splits.select(origin, "split"), origin)


def split_stats(
    df: DataFrame, origin: str = "origin_id", source: str = "source", sources: tuple[str, ...] = ("real", "procedural", "aigc")
) -> DataFrame:
    """Per split: origins, samples, and samples of each source."""
    return df.groupBy("split").agg(
        F.countDistinct(origin).alias("origins"),
        F.count("*").alias("samples"),
        *(F.count_if(F.col(source) == s).alias(f"n_{s}") for s in sources),
    )


def leaked_origins(df: DataFrame, origin: str = "origin_id") -> DataFrame:
    """Origins in more than one split, with the splits."""
    return df.groupBy(origin).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def check_leakage(df: DataFrame, origin: str = "origin_id", examples: int = 10) -> DataFrame:
    """One row: passed, total_origins, leaked, and the first leaked origins in order."""
    counts = df.groupBy(origin).agg(F.countDistinct("split").alias("n")).agg(
        F.count("*").alias("total_origins"), F.count_if(F.col("n") > 1).alias("leaked")
    )
    shown = leaked_origins(df, origin).orderBy(origin).limit(examples).agg(F.array_sort(F.collect_list(origin)).alias("examples"))
    return counts.crossJoin(shown).select((F.col("leaked") == 0).alias("passed"), "total_origins", "leaked", "examples")
