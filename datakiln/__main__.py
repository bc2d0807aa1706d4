"""Command line: python -m datakiln COMMAND ...

list                             names of the registered queries
run NAME SF_DIR OUT              a query's result as Parquet
dedup MANIFEST OUT               manifest (Parquet with phash) with dedup marks; report as JSON in OUT/report
split MANIFEST OUT EVAL          manifest with splits, leak check (exit code 2 if an origin leaks)
eval-set MANIFEST OUT TARGET     stratified eval set of a split manifest
grid DATA OUT                    all models, ratios and seeds over a split manifest with features; resumes
networks DATA OUT                all networks, ratios and seeds, trained in the same jobs; resumes
summarize OUT                    summary and acceptance checks of a grid's log, as markdown
verify BASE CURRENT              compares two manifests by file and sha1 (exit code 1 if files are missing or differ)
"""

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _run(spark: SparkSession, name: str, sf_dir: str, out: str) -> int:
    from datakiln.plans.catalog import QUERIES

    if name not in QUERIES:
        print(f"no query {name}", file=sys.stderr)
        return 2
    QUERIES[name](spark, sf_dir).write.mode("overwrite").parquet(out)
    return 0


def _list(spark: SparkSession) -> int:
    from datakiln.plans.catalog import QUERIES

    print("\n".join(sorted(QUERIES)))
    return 0


def _dedup(spark: SparkSession, manifest: str, out: str) -> int:
    from datakiln.operators.dedup import dedup, dedup_report
    from datakiln.sources.manifest import write_report

    rows = spark.read.parquet(manifest)
    dedup(rows).write.mode("overwrite").parquet(f"{out}/manifest")
    write_report(dedup_report(rows, spark.read.parquet(f"{out}/manifest")), f"{out}/report")
    return 0


def _split(spark: SparkSession, manifest: str, out: str, eval_target: str) -> int:
    from datakiln.operators.split import assign_splits, check_leakage, with_split
    from datakiln.operators.tables import active

    rows = active(spark.read.parquet(manifest))
    with_split(rows, assign_splits(rows, int(eval_target))).write.mode("overwrite").parquet(out)
    return 0 if check_leakage(spark.read.parquet(out)).first().passed else 2


def _eval_set(spark: SparkSession, manifest: str, out: str, target: str) -> int:
    from datakiln.functions.expressions import stratum
    from datakiln.operators import sampling, tables
    from datakiln.sources.manifest import write_eval_set

    cell = stratum(F.col("labels"), F.lit(None).cast("array<string>"), F.col("scene"), F.col("difficulty"))
    cells = tables.eval_pool(spark.read.parquet(manifest)).withColumn("_c", cell)
    cells = cells.select("*", "_c.defect", F.col("_c.scene").alias("cell_scene"), F.col("_c.difficulty").alias("cell_difficulty"))
    picked = sampling.stratified_sample(cells, ["defect", "cell_scene", "cell_difficulty"], int(target), "file", "seq")
    write_eval_set(tables.eval_rows(picked.drop("_c", "defect", "cell_scene", "cell_difficulty")), f"{out}/json", f"{out}/csv")
    return 0


def _grid(spark: SparkSession, data: str, out: str) -> int:
    from datakiln.functions.constants import CLASSES
    from datakiln.operators.tables import experiment_grid
    from datakiln.plans.experiments import MODELS, run_grid

    grid = experiment_grid(spark, sorted(MODELS), (0.0, 0.25, 0.5, 0.75, 1.0), (42, 43, 44))
    log = run_grid(spark.read.parquet(data), grid, CLASSES, out)
    return int(not log.where("error is not null").join(log.where("error is null").select("exp_id"), "exp_id", "left_anti").isEmpty())


def _networks(spark: SparkSession, data: str, out: str) -> int:
    from datakiln.functions.constants import CLASSES
    from datakiln.operators.tables import completed, experiment_grid
    from datakiln.plans.experiments import NETWORKS, run_grid_together

    grid = experiment_grid(spark, sorted(NETWORKS), (0.0, 0.25, 0.5, 0.75, 1.0), (42, 43, 44))
    log = run_grid_together(spark.read.parquet(data), grid, CLASSES, out)
    return int(not grid.join(completed(log), "exp_id", "left_anti").isEmpty())


def _summarize(spark: SparkSession, out: str) -> int:
    from datakiln.operators.tables import to_markdown
    from datakiln.plans.experiments import load_runs, reported

    parts: tuple[DataFrame, ...] = reported(load_runs(spark, f"{out}/log"))
    print("\n\n".join(to_markdown(x) for x in parts))
    return 0


def _verify(spark: SparkSession, base: str, current: str) -> int:
    from datakiln.operators.tables import compare, compare_report

    report = compare_report(compare(*(spark.read.parquet(p).select("file", "sha1") for p in (base, current)))).first()
    print(report)
    return 0 if report.ok else 1


COMMANDS = {
    "list": (_list, 0),
    "run": (_run, 3),
    "dedup": (_dedup, 2),
    "split": (_split, 3),
    "eval-set": (_eval_set, 3),
    "grid": (_grid, 2),
    "networks": (_networks, 2),
    "summarize": (_summarize, 1),
    "verify": (_verify, 2),
}


def main(args: list[str]) -> int:
    command, wanted = COMMANDS.get(args[0], (None, 0)) if args else (None, 0)
    if command is None or len(args) - 1 != wanted:
        print(__doc__, file=sys.stderr)
        return 2
    return command(SparkSession.builder.getOrCreate(), *args[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
