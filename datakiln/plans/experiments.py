"""Experiments over a split manifest with features: single runs, the grid with resume, tuning and the benchmark.

The loops here only say which Spark jobs run next; samples, scores and metrics stay DataFrames. A log is a folder of JSON lines
with a row per run; a run that fails leaves a row with its error and is taken up again the next time.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.operators import eval_state, evaluation, scorers, tables, training
from datakiln.operators.sampling import make_train_mix, make_train_mixes, mix_report
from datakiln.sources.manifest import exists
from datakiln.sources.scratch import written

KEYS = ("file", "scene", "difficulty", "source")
LOG = (
    "seq long, exp_id string, model string, ratio double, seed int, train_seconds double, n_total long, n_real long, n_synthetic long,"
    "ratio_actual double, macro_f1 double, ece_multilabel double, brier double,"
    "per_class map<string,struct<precision:double,recall:double,f1:double>>, error string"
)
#: Options of a model by name; a run may override them.
MODELS: dict[str, dict[str, str]] = {"logistic": {"iterations": "50", "l2": "0.001"}, "ridge": {"iterations": "50", "l2": "0.1"}}
#: Options of a network by name.
NETWORKS: dict[str, dict[str, str]] = {
    "network": {"hidden": "16", "epochs": "10", "rate": "0.02", "decay": "0.0001", "batches": "8"},
    "linear": {"hidden": "0", "epochs": "10", "rate": "0.05", "decay": "0.0001", "batches": "8"},
}


def run_single(data: DataFrame, run: dict, classes: Sequence[str], out: str, options: dict[str, str] | None = None) -> DataFrame:
    """One row of LOG: trains on the mix, finds thresholds on val only, and evaluates the eval split at them.

    Scores and thresholds of the run are written below out, so that metrics can be made again without the model.
    """
    if run["model"] in NETWORKS:
        row = networks_run(data, [run], classes, out, options)
        if (error := row.first().error) is not None:
            raise ValueError(error)
        return row
    chosen = MODELS[run["model"]] | (options or {})
    mix = make_train_mix(tables.of_split(tables.active(data), "train"), run["ratio"], seed=run["seed"])
    mix = written(mix, "mix")
    began = time.perf_counter()
    models = scorers.train(scorers.samples(mix, classes), classes, iterations=int(chosen["iterations"]), l2=float(chosen["l2"]))
    seconds = time.perf_counter() - began
    score = scorers.linear_scorer(models, classes, keys=KEYS)
    path = f"{out}/runs/{run['exp_id']}"
    for part in ("val", "eval"):
        score(scorers.samples(data, classes, part)).write.mode("overwrite").parquet(f"{path}/{part}")
    spark = data.sparkSession
    val, test = (spark.read.parquet(f"{path}/{part}") for part in ("val", "eval"))
    evaluation.search_thresholds(val).write.mode("overwrite").parquet(f"{path}/thresholds")
    found = evaluation.evaluate(test, classes, spark.read.parquet(f"{path}/thresholds"), sample="file")
    sizes = mix_report(mix, run["ratio"]).select("n_real", "n_synthetic", "ratio_actual", "n_total")
    named = [F.lit(run[k]).alias(k) for k in ("exp_id", "model", "ratio", "seed")]
    row = found.select(
        "macro_f1", "ece_multilabel", "brier", "per_class"
    ).crossJoin(sizes).select(*named, "*", F.lit(seconds).alias("train_seconds"))
    return row.withColumn("error", F.lit(None).cast("string"))


def load_runs(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG).json(log) if exists(spark, log) else spark.createDataFrame([], LOG)


def run_grid(data: DataFrame, grid: DataFrame, classes: Sequence[str], out: str, options: dict[str, str] | None = None) -> DataFrame:
    """Runs what the log has no result of and appends a row for each; gives the log."""
    spark, log = data.sparkSession, f"{out}/log"
    left = tables.worklist(grid, load_runs(spark, log)).orderBy("model", "ratio", "seed").collect()  # a row per run
    for run in left:
        try:
            row = run_single(data, run.asDict(), classes, out, options)
            row = row.withColumn("seq", F.lit(time.time_ns()))
            row.coalesce(1).write.mode("append").json(log)
        except Exception as failure:  # the grid goes on; the run is tried again next time
            failed = [(time.time_ns(), run.exp_id, run.model, run.ratio, run.seed, str(failure)[:500])]
            spark.createDataFrame(
                failed, "seq long, exp_id string, model string, ratio double, seed int, error string"
            ).write.mode("append").json(log)
    return load_runs(spark, log)


def networks_run(data: DataFrame, runs: list[dict], classes: Sequence[str], out: str, options: dict[str, str] | None = None) -> DataFrame:
    """A row of LOG for each run of a network, all made in the same jobs: mixes, training, scores, thresholds and metrics.

    Scores, thresholds and the state of training are kept in a folder below out/networks, scores parted by run. Runs of one
    number of batches train together. A run that fails has an error in place of metrics; train_seconds is a run's share.
    """
    spark, home = data.sparkSession, f"{out}/networks/{time.time_ns()}"
    names = {r["exp_id"]: f"{r['ratio']!r}-{r['seed']}" for r in runs}
    chosen = {r["exp_id"]: NETWORKS[r["model"]] | (options or {}) for r in runs}
    wanted = {names[r["exp_id"]]: (r["ratio"], r["seed"]) for r in runs}
    mix = written(make_train_mixes(tables.of_split(tables.active(data), "train"), wanted), "mix")
    train, val, test = scorers.samples(mix, classes), *(scorers.samples(data, classes, p) for p in ("val", "eval"))
    found: dict[str, training.Run] = {}
    began = time.perf_counter()
    for batches in sorted({int(c["batches"]) for c in chosen.values()}):
        settings = {
            r["exp_id"]: training.Settings(
                int(c["hidden"]), int(c["epochs"]), float(c["rate"]), float(c["decay"]), r["seed"], names[r["exp_id"]]
            )
            for r in runs if int((c := chosen[r["exp_id"]])["batches"]) == batches
        }
        found |= training.train_runs(train, val, classes, settings, f"{home}/state-{batches}", batches)
    seconds = (time.perf_counter() - began) / len(runs)
    for part, rows in (("val", val), ("eval", test)):
        training.network_scores(rows, found, classes, KEYS).write.partitionBy("run").parquet(f"{home}/{part}")
    kind = training.network_scores(val, found, classes, KEYS).schema
    val, test = (spark.read.schema(kind).parquet(f"{home}/{part}") for part in ("val", "eval"))
    both = evaluation.search_thresholds(val.withColumn("class", F.struct("run", "class")))
    cuts = both.withColumn("_of", F.col("class")).withColumns({"run": F.col("_of.run"), "class": F.col("_of.class")}).drop("_of")
    cuts.write.parquet(f"{home}/thresholds")
    cuts = spark.read.schema(cuts.schema).parquet(f"{home}/thresholds").select("run", "class", "threshold")  # a row per run and class
    pred = test.join(F.broadcast(cuts), ["run", "class"]).withColumn("pred", (F.col("prob") > F.col("threshold")).cast("int"))
    state = written(eval_state.state_of(pred, classes, run="run", sample="file"), "state")
    f1 = eval_state.classes(state).groupBy("run").agg(
        F.avg("f1").alias("macro_f1"),
        F.map_from_entries(F.collect_list(F.struct("class", F.struct("precision", "recall", "f1")))).alias("per_class"),
    )
    metrics = f1.join(eval_state.calibration(state).select("run", "ece_multilabel", "brier"), "run")
    sizes = mix.select(F.explode("mixes").alias("_mix"), "source").groupBy("_mix").agg(
        F.count_if(F.col("source") == "real").alias("n_real"), F.count_if(F.col("source") != "real").alias("n_synthetic"), F.count("*").alias("n_total")
    )
    sizes = sizes.withColumn("ratio_actual", F.coalesce(F.try_divide("n_synthetic", "n_total"), F.lit(0.0)))
    rows = [(r["exp_id"], r["model"], r["ratio"], r["seed"], names[r["exp_id"]], found[r["exp_id"]].error) for r in runs]
    listed = spark.createDataFrame(rows, "exp_id string, model string, ratio double, seed int, _mix string, error string")
    met = listed.join(metrics, F.col("exp_id") == F.col("run"), "left").join(sizes, "_mix", "left")
    error = F.when(F.col("error").isNull() & F.col("run").isNull(), "no samples to evaluate").otherwise(F.col("error")).alias("error")
    row = met.select("macro_f1", "ece_multilabel", "brier", "per_class", "n_real", "n_synthetic", "ratio_actual", "n_total", "exp_id", "model",
                     "ratio", "seed", F.when(F.col("error").isNull(), seconds).alias("train_seconds"), error)
    return written(row, "rows")


def run_grid_together(data: DataFrame, grid: DataFrame, classes: Sequence[str], out: str, options: dict[str, str] | None = None) -> DataFrame:
    """Runs of networks that the log has no result of, all in the same jobs; appends a row for each and gives the log.

    A model that is no network leaves a row with an error.
    """
    spark, log = data.sparkSession, f"{out}/log"
    left = [r.asDict() for r in tables.worklist(grid, load_runs(spark, log)).orderBy("model", "ratio", "seed").collect()]  # a row per run
    known = [r for r in left if r["model"] in NETWORKS]
    strange = [(r["exp_id"], r["model"], r["ratio"], r["seed"], "no such network") for r in left if r["model"] not in NETWORKS]
    rows = spark.createDataFrame(strange, "exp_id string, model string, ratio double, seed int, error string")
    if known:
        rows = networks_run(data, known, classes, out, options).unionByName(rows, allowMissingColumns=True)
    if left:
        rows.withColumn("seq", F.lit(time.time_ns())).coalesce(1).write.mode("append").json(log)  # a row per run
    return load_runs(spark, log)


def tune(
    data: DataFrame, variants: dict[str, dict[str, str]], classes: Sequence[str], out: str, ratio: float = 0.5, seed: int = 42
) -> DataFrame:
    """name and metrics of each variant of options, the best first."""
    rows = None
    for name, options in sorted(variants.items()):
        run = {"exp_id": f"tune_{name}", "model": options.get("model", "logistic"), "ratio": ratio, "seed": seed}
        row = run_single(data, run, classes, out, {k: v for k, v in options.items() if k != "model"}).withColumn("name", F.lit(name))
        rows = row if rows is None else rows.unionByName(row)
    return tables.tune_ranking(rows)


def benchmark(data: DataFrame, classes: Sequence[str], samples: int = 6400, epochs: int = 10, runs: int = 3) -> DataFrame:
    """model, images_per_second of scoring, and the hours that a grid would take at that rate."""
    rate = []
    for name, options in sorted(MODELS.items()):
        models = scorers.train(
            scorers.samples(data, classes, "train"), classes, iterations=int(options["iterations"]), l2=float(options["l2"])
        )
        rate.append((name, scorers.throughput(scorers.linear_scorer(models, classes, keys=KEYS), scorers.samples(data, classes))))
    return tables.extrapolated_hours(
        data.sparkSession.createDataFrame(rate, "model string, images_per_second double"), samples, epochs, runs
    )


def unique_files(rows: DataFrame, key: str = "file") -> int:
    """How many files a list names."""
    return rows.select(key).distinct().count()


def reported(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The summary by model and ratio, and the acceptance checks of its best group."""
    good = log.where("error is null")
    summary = tables.summarize(good)
    return summary, tables.acceptance(summary, tables.recall_summary(good))
