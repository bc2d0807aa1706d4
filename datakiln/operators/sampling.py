"""Quotas, strata, training mixes and work sheets. Random order is the order of an MD5 of seed and key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datakiln.functions.expressions import order_key
from datakiln.operators.selection import group_key, hash_keys, heads

#: Refused frames that the log of a collection holds.
MOST_REJECTS = 5000


def quota_scan(df: DataFrame, num: int, night_quota: int, seq: str = "seq") -> DataFrame:
    """Accepted frames with idx and kind, as a scan in seq order would take them.

    df has boolean night_ok and normal_ok. A frame counts as night while that quota is open, else as normal while that one
    is. The first night_quota night frames do not depend on the others, so each class is the head of an ordered filter.
    """
    nights = df.where(F.coalesce("night_ok", F.lit(False))).orderBy(seq).limit(night_quota).withColumn("kind", F.lit("night"))
    others = df.where(
        F.coalesce("normal_ok", F.lit(False))
    ).join(nights.select(seq), seq, "left_anti").orderBy(seq).limit(num).withColumn("kind", F.lit("normal"))
    both = nights.unionByName(others)
    return both.withColumn("idx", F.row_number().over(Window.orderBy(seq)) - 1)  # as many rows as the quotas


def quota_rejects(df: DataFrame, accepted: DataFrame, num: int, night_quota: int, seq: str = "seq", most: int = MOST_REJECTS) -> DataFrame:
    """Frames the scan saw and did not take, up to where both quotas were full; the first most of them, as a log holds."""
    ends = accepted.agg(
        F.max(seq).alias("_end"),
        (F.count_if(F.col("kind") == "night") >= night_quota).alias("_nights"),
        (F.count_if(F.col("kind") == "normal") >= num).alias("_normals"),
    )
    seen = df.crossJoin(F.broadcast(ends)).where(~(F.col("_nights") & F.col("_normals")) | (F.col(seq) <= F.col("_end")))
    return seen.drop("_end", "_nights", "_normals").join(accepted.select(seq), seq, "left_anti").orderBy(seq).limit(most)


def stratum_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("available"))


def allocate_quotas(cells: DataFrame, target: int, first: str = "first_seen") -> DataFrame:
    """Adds quota to (available, first_seen) cells: as even as the cells allow, what is left over to unsaturated cells in order of appearance.

    Closed form of filling all cells at the same level: sorted by size, the level is the first even share that its cell can
    take. There are as many rows as strata.
    """
    w = Window.orderBy("available", first)
    before = F.coalesce(F.sum("available").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cells.select(
        "*", F.row_number().over(w).alias("_k"), before.alias("_cum"), F.count("*").over(Window.partitionBy()).alias("_n")
    )
    share = F.floor((F.lit(target) - F.col("_cum")) / (F.col("_n") - F.col("_k") + 1))
    every = Window.partitionBy()
    level = F.coalesce(
        F.min(F.when(share < F.col("available"), F.struct("_k", share.alias("v")))).over(every)["v"], F.max("available").over(every)
    )
    filled = ranked.withColumn("_level", level).withColumn("_quota", F.greatest(F.lit(0), F.least("available", "_level")))
    left = F.lit(target) - F.sum("_quota").over(every)
    turn = F.row_number().over(Window.partitionBy(F.col("available") > F.col("_level")).orderBy(first))
    extra = ((F.col("available") > F.col("_level")) & (turn <= left)).cast("long")
    return filled.withColumn("quota", (F.col("_quota") + extra).cast("long")).drop("_k", "_cum", "_n", "_level", "_quota")


def stratified_sample(df: DataFrame, by: list[str], target: int, key: str, seq: str, seed: int = 42) -> DataFrame:
    """About target rows, spread over strata by allocate_quotas, in hash order within each."""
    cells = df.groupBy(*by).agg(F.count("*").alias("available"), F.min(seq).alias("first_seen"))
    quotas = allocate_quotas(cells, target).select(group_key(by).alias("g"), "quota")
    return heads(df, by, quotas, hash_keys(order_key(seed, F.col(key))))


def stratified_report(df: DataFrame, picked: DataFrame, by: list[str], target: int, seq: str) -> DataFrame:
    """Per stratum: available, quota, taken, underfilled."""
    cells = allocate_quotas(df.groupBy(*by).agg(F.count("*").alias("available"), F.min(seq).alias("first_seen")), target)
    taken = picked.groupBy(*by).agg(F.count("*").alias("taken"))
    return cells.join(taken, by, "left").select(
        *by,
        "available",
        "quota",
        F.coalesce("taken", F.lit(0)).alias("taken"),
        (F.coalesce("taken", F.lit(0)) < F.col("quota")).alias("underfilled"),
    )


def sample_without_replacement(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in hash order (all if fewer). The last one's hash is found by counting, so no task sorts or holds all n rows."""
    quota = df.sparkSession.range(1).select(group_key([]).alias("g"), F.lit(n).cast("long").alias("quota"))
    return heads(df, [], quota, hash_keys(order_key(seed, F.col(key))))


def mix_sizes(n_real: int, n_synthetic: int, ratio: float) -> tuple[int, int]:
    """Real and synthetic samples for a synthetic share of ratio: all real ones, and as many synthetic as there are and fit."""
    if ratio >= 1:
        return 0, min(4 * n_real, n_synthetic)
    return n_real, min(round(n_real * ratio / max(1e-9, 1 - ratio)), n_synthetic)


def make_train_mix(df: DataFrame, ratio: float, key: str = "file", source: str = "source", seed: int = 42) -> DataFrame:
    """The training rows of a mix."""
    n_real, n_synthetic = df.agg(F.count_if(F.col(source) == "real"), F.count_if(F.col(source).isin("procedural", "aigc"))).first()
    real, synthetic = mix_sizes(n_real, n_synthetic, ratio)
    chosen = sample_without_replacement(df.where(F.col(source).isin("procedural", "aigc")), synthetic, key, seed)
    return chosen if real == 0 else df.where(F.col(source) == "real").unionByName(chosen)


def make_train_mixes(
    df: DataFrame, wanted: dict[str, tuple[float, int]], key: str = "file", source: str = "source"
) -> DataFrame:
    """The rows that any mix takes, with mixes, the names of those that do. wanted: ratio and seed of each name, a few by construction.

    Each mix has the rows of make_train_mix; all are made in the same passes. Rows of one key go together.
    """
    n_real, n_synthetic = df.agg(F.count_if(F.col(source) == "real"), F.count_if(F.col(source).isin("procedural", "aigc"))).first()
    sizes = {name: mix_sizes(n_real, n_synthetic, ratio) for name, (ratio, _) in wanted.items()}
    spark, kinds = df.sparkSession, "mix string, seed int, quota long, whole boolean"
    plan = spark.createDataFrame([(n, wanted[n][1], s[1], s[0] > 0) for n, s in sorted(sizes.items())], kinds)
    named = F.array(*(F.struct(F.lit(n).alias("mix"), F.lit(seed).alias("seed")) for n, (_, seed) in sorted(wanted.items())))
    pairs = df.where(F.col(source).isin("procedural", "aigc")).select(F.col(key).alias("_key"), F.explode(named).alias("_m")).select("_key", "_m.*")
    order = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("_key").cast("string")).cast("binary"))
    taken = heads(pairs, ["mix"], plan.select(group_key(["mix"]).alias("g"), "quota"), hash_keys(order))
    synthetic = taken.groupBy("_key").agg(F.array_sort(F.collect_set("mix")).alias("mixes"))
    whole = F.array(*(F.lit(n) for n, s in sorted(sizes.items()) if s[0] > 0)).cast("array<string>")
    real = df.where((F.col(source) == "real") & (F.size(whole) > 0)).withColumn("mixes", whole)
    chosen = df.where(F.col(source).isin("procedural", "aigc")).join(synthetic, F.col(key) == F.col("_key")).drop("_key")
    return real.unionByName(chosen)


def mix_report(mix: DataFrame, ratio: float, source: str = "source") -> DataFrame:
    """One row: ratio_target, n_real, n_synthetic, ratio_actual, n_total."""
    n = F.count("*")
    return mix.agg(F.count_if(F.col(source) == "real").alias("n_real"), F.count_if(F.col(source) != "real").alias("n_synthetic"), n.alias("n_total")).select(
        F.lit(float(ratio)).alias("ratio_target"),
        "n_real",
        "n_synthetic",
        F.coalesce(F.try_divide("n_synthetic", "n_total"), F.lit(0.0)).alias("ratio_actual"),
        "n_total",
    )


def export_task(df: DataFrame, n: int, seed: int = 42, file: str = "file", labels: str = "labels") -> tuple[DataFrame, DataFrame]:
    """A blank sheet for annotators and the ground truth kept apart from it."""
    picked = sample_without_replacement(df, n, file, seed)
    return picked.select(file, F.lit("").alias("labels")), picked.select(file, F.array_join(labels, "|").alias("labels"))
