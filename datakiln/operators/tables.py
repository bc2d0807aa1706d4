"""Filters, semi and anti joins, diffs, schedules and experiment logs over manifest tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datakiln.functions import constants as C


def active(df: DataFrame) -> DataFrame:
    """Samples that dedup did not remove; a missing mark means none."""
    return df.where(~F.coalesce("dedup_removed", F.lit(False))) if "dedup_removed" in df.columns else df


def of_source(df: DataFrame, keep: Sequence[str] | None = None, exclude: Sequence[str] | None = None, source: str = "source") -> DataFrame:
    if keep is not None:
        df = df.where(F.col(source).isin(*keep))
    return df if exclude is None else df.where(~F.coalesce(F.col(source).isin(*exclude), F.lit(False)))


def of_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def eval_pool(df: DataFrame) -> DataFrame:
    """Active samples of the eval split that are no long-tail variants."""
    pool = of_split(active(df), "eval")
    return pool.where(~F.coalesce("eval_longtail", F.lit(False))) if "eval_longtail" in df.columns else pool


def longtail_pool(df: DataFrame) -> DataFrame:
    """Active real samples whose origin is in the eval split; all real samples if there is none."""
    real = active(of_source(df, keep=["real"]))
    pool = real.join(of_split(df, "eval").select("origin_id").distinct(), "origin_id", "left_semi")
    return real if pool.isEmpty() else pool


def eval_records(df: DataFrame, files: DataFrame | None, key: str = "file") -> DataFrame:
    """Samples named in a frozen list; those of the eval split if the list is absent or names none."""
    if files is not None:
        named = df.join(files.select(key), key, "left_semi")
        if not named.isEmpty():
            return named
    return of_split(df, "eval")


def new_rows(df: DataFrame, known: DataFrame, key: str = "file") -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def load_index(df: DataFrame, key: str = "file", value: str = "sha1", seq: str = "seq") -> DataFrame:
    """The last value of each key in seq order."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, seq).alias(value))


def compare(base: DataFrame, current: DataFrame, key: str = "file", value: str = "sha1") -> DataFrame:
    """key, status (missing, extra, mismatch, matched) over both indexes; an empty value matches any."""
    b, c = base.select(
        key, F.col(value).alias("_b"), F.lit(1).alias("_in_b")
    ), current.select(key, F.col(value).alias("_c"), F.lit(1).alias("_in_c"))
    filled = (F.coalesce("_b", F.lit("")) != "") & (F.coalesce("_c", F.lit("")) != "")
    status = F.when(F.col("_in_c").isNull(), "missing").when(F.col("_in_b").isNull(), "extra").when(
        filled & (F.col("_b") != F.col("_c")), "mismatch"
    ).otherwise("matched")
    return b.join(c, key, "full_outer").select(key, status.alias("status"))


def compare_report(diff: DataFrame, key: str = "file", examples: int = 10) -> DataFrame:
    """One row of counts, ok (nothing missing or different; extra files are fine) and the first names of each kind."""
    counts = diff.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("matched", "missing", "extra", "mismatch")))
    ranked = diff.where("status in ('missing', 'extra', 'mismatch')").withColumn(
        "_n", F.row_number().over(Window.partitionBy("status").orderBy(key))
    ).where(F.col("_n") <= examples)
    shown = ranked.agg(
        *(
            F.array_sort(
                F.collect_list(F.when(F.col("status") == s, F.col(key)))
            ).alias(f"{s}_examples") for s in ("missing", "extra", "mismatch")
        )
    )
    return counts.crossJoin(shown).withColumn("ok", (F.col("missing") == 0) & (F.col("mismatch") == 0))


def round_robin(df: DataFrame, num: int, seq: str = "seq", offset: int = 0) -> DataFrame:
    """i from 0 to num - 1 with the source row (i + offset) mod n in seq order. df is a pool of real frames, which is small."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.orderBy(seq)) - 1)
    size = df.agg(F.count("*").alias("_n"))
    turns = df.sparkSession.range(num).withColumnRenamed("id", "i").crossJoin(F.broadcast(size)).withColumn(
        "_rn", F.pmod(F.col("i") + offset, "_n")
    )
    return turns.join(ranked, "_rn").drop("_rn", "_n")


def manifest_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def eval_rows(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The frozen projection, one row per file (the first)."""
    from datakiln.functions.expressions import stratum
    from datakiln.operators.dedup import keep_first

    first = keep_first(df, "file", seq)
    order = F.col("order") if "order" in df.columns else F.lit(None).cast("array<string>")
    cell = stratum(F.col("labels"), order, F.col("scene"), F.col("difficulty"))
    out = first.withColumn(
        "defect_type", F.coalesce("defect_override", cell["defect"]) if "defect_override" in df.columns else cell["defect"]
    )
    out = out.withColumn("longtail", F.coalesce("eval_longtail", F.lit(False)) if "eval_longtail" in df.columns else F.lit(False))
    out = out.withColumn("review_status", F.coalesce("review_status", F.lit("auto")) if "review_status" in df.columns else F.lit("auto"))
    return out.select(*C.EVAL_COLUMNS)


def eval_csv_rows(df: DataFrame) -> DataFrame:
    """The same columns as text for CSV; repeats stay."""
    return df.withColumn("labels", F.array_join("labels", "|")).withColumn("longtail", F.col("longtail").cast("int").cast("string"))


def completed(log: DataFrame) -> DataFrame:
    return log.where("error is null").select("exp_id").distinct()


def experiment_grid(spark, models: Sequence[str], ratios: Sequence[float], seeds: Sequence[int]) -> DataFrame:
    """exp_id, model, ratio, seed of the whole grid; a few rows by construction."""
    m, r, s = (
        spark.createDataFrame([(x,) for x in xs], f"{n} {t}") for xs, n, t in (
            (models, "model", "string"), (ratios, "ratio", "double"), (seeds, "seed", "int")
        )
    )
    grid = m.crossJoin(r).crossJoin(s)
    return grid.select(
        F.format_string("%s_r%s_s%d", "model", F.col("ratio").cast("string"), "seed").alias("exp_id"), "model", "ratio", "seed"
    )


def worklist(grid: DataFrame, log: DataFrame) -> DataFrame:
    """Runs without a result that is no error."""
    return grid.join(completed(log), "exp_id", "left_anti")


def tune_variants(defaults: dict[str, str], variants: DataFrame) -> DataFrame:
    """variants (name, options MAP) with the defaults below their own options."""
    base = F.create_map(
        *(F.lit(x) for kv in sorted(defaults.items()) for x in kv)
    ) if defaults else F.create_map().cast("map<string,string>")
    own = F.col("options")
    return variants.withColumn(
        "options",
        F.map_concat(
            F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(own, k), F.lit(False))),
            F.coalesce(own, F.create_map().cast("map<string,string>")),
        ),
    )


def extrapolated_hours(bench: DataFrame, samples: int = 6400, epochs: int = 10, runs: int = 3) -> DataFrame:
    """Hours of a grid at the measured images per second."""
    return bench.withColumn("hours", F.try_divide(F.lit(float(samples)), "images_per_second") * epochs * runs / 3600)


def summarize(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """Per model and ratio: seeds, training samples of the first run, means and population deviations, mean seconds."""
    good = runs.where("error is null") if "error" in runs.columns else runs
    return good.groupBy("model", "ratio").agg(
        F.count("*").alias("n_seeds"),
        F.min_by("n_total", seq).alias("n_train"),
        F.avg("macro_f1").alias("macro_f1_mean"),
        F.stddev_pop("macro_f1").alias("macro_f1_std"),
        F.avg("ece_multilabel").alias("ece_mean"),
        F.avg(F.coalesce("brier", F.lit(0.0))).alias("brier_mean"),
        F.avg("train_seconds").alias("seconds_mean"),
    )


def recall_summary(runs: DataFrame) -> DataFrame:
    """Per model, ratio and class the mean recall; nulls are skipped. runs.per_class maps class to a struct with recall."""
    long = runs.select("model", "ratio", F.explode("per_class").alias("class", "v"))
    return long.groupBy("model", "ratio", "class").agg(F.avg("v.recall").alias("recall_mean"))


def best_group(summary: DataFrame) -> DataFrame:
    """The group of the best mean, rounded to four places (ties: the first model and ratio)."""
    return summary.withColumn("_r", F.bround("macro_f1_mean", 4)).orderBy(F.desc("_r"), "model", "ratio").limit(1).drop("_r")


def acceptance(summary: DataFrame, recalls: DataFrame) -> DataFrame:
    """check, value, target, passed for the best group."""
    best = best_group(summary)
    f1 = best.select(F.lit("macro_f1").alias("check"), F.col("macro_f1_mean").alias("value"), F.lit(C.ACCEPT_MACRO_F1).alias("target"))
    targets = F.create_map(*(F.lit(x) for kv in C.ACCEPT_RECALL.items() for x in kv))
    rec = recalls.join(best.select("model", "ratio"), ["model", "ratio"]).where(F.col("class").isin(*C.ACCEPT_RECALL)).select(
        F.concat(F.lit("recall_"), "class").alias("check"), F.col("recall_mean").alias("value"), targets[F.col("class")].alias("target")
    )
    return f1.unionByName(rec).withColumn("passed", F.coalesce(F.col("value") >= F.col("target"), F.lit(False)))


def to_markdown(df: DataFrame) -> str:
    """A report table (a few rows) as markdown."""
    rows = [
        df.columns,
        ["---"] * len(df.columns),
        *([("n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in df.collect()),
    ]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def tune_ranking(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("macro_f1"), "name")
