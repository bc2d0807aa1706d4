import random

import numpy as np
from pyspark.sql import functions as F

from datakiln.__main__ import main
from datakiln.operators import evaluation, scorers, tables
from datakiln.plans import collect, experiments, pipeline


def test_scorer_to_metrics(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        x = [r.gauss(0, 1), r.gauss(0, 1)]
        labels = [c for c, v in zip(("blur", "dark"), x) if v + r.gauss(0, 0.3) > 0.5]
        rows.append((f"f{i}", "real", "train" if i % 4 else "val", labels, x, i % 7 == 0))
    df = spark.createDataFrame(
        rows, "file string, source string, split string, labels array<string>, features array<double>, dedup_removed boolean"
    )
    classes = ("blur", "dark", "noise")
    models = scorers.train(scorers.samples(df, classes, "train"), classes)
    assert set(models) == {"blur", "dark"}
    score = scorers.linear_scorer(models, classes)
    val = score(scorers.samples(df, classes, "val")).withColumnRenamed("file", "sample_id")
    per = {x["class"]: x.f1 for x in evaluation.prf(evaluation.predicted(val)).collect()}
    assert per["blur"] > 0.7 and per["dark"] > 0.7 and per["noise"] is None
    _, metrics, slices = pipeline.experiment(
        val.withColumn("source", F.lit("real")), val.withColumn("source", F.lit("real")), classes, ("source",)
    )
    assert metrics.first().macro_f1 > 0.5 and slices.count() == 1
    assert scorers.samples(df, classes, limit=5).count() == 5 and scorers.throughput(score, scorers.samples(df, classes, "val")) > 0


def test_collect_quota(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(8):
        level = (20, 60) if i % 4 == 0 else (60, 200)
        img = rng.integers(*level, (340, 330, 3)).astype(np.uint8)
        rows.append((i, (None, 340, 330, 3, 16, bytearray(img.tobytes()))))
    rows.append((8, (None, 10, 10, 3, 16, bytearray(300))))
    df = spark.createDataFrame(rows, "seq long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    taken, refused = collect.collect_quota(df, 3, 1)
    got = {r.seq: (r.file, r.scene) for r in taken.select("seq", "file", "scene").collect()}
    assert got[0] == ("real/real_000000.png", "night") and len(got) == 4 and sorted(got) == [0, 1, 2, 3]
    assert refused.count() == 0
    _, refused = collect.collect_quota(df, 30, 1)
    assert {r.seq: r.reason for r in refused.collect()}[8] == "分辨率过小"


def _manifest(spark, n=240):
    r = random.Random(5)
    rows = []
    for i in range(n):
        x = [r.gauss(0, 1), r.gauss(0, 1)]
        labels = [c for c, v in zip(("blur", "dark"), x) if v + r.gauss(0, 0.3) > 0.5]
        split = ("train", "train", "val", "eval")[i // 2 % 4]
        source = ("real", "procedural", "aigc")[i % 3]
        rows.append((i, f"f{i}", f"s{i}", f"o{i // 2}", source, split, labels, "indoor", "mid" if labels else "none", x, i * 7919 << 20))
    kinds = "seq long, file string, sha1 string, origin_id string, source string, split string, labels array<string>, scene string"
    return spark.createDataFrame(rows, f"{kinds}, difficulty string, features array<double>, phash long")


def test_grid_resumes_and_logs_errors(spark, tmp_path, monkeypatch):
    data, classes, out = _manifest(spark), ("blur", "dark"), f"file://{tmp_path}/grid"
    grid = tables.experiment_grid(spark, ["logistic", "absent"], [0.0, 0.5], [1])
    log = experiments.run_grid(data, grid, classes, out)
    rows = {r.exp_id: r for r in log.collect()}
    assert len(rows) == 4 and sum(r.error is not None for r in rows.values()) == 2
    good = next(r for r in rows.values() if r.error is None and r.ratio == 0.5)
    assert good.n_real > 0 and good.n_synthetic == good.n_real and good.macro_f1 > 0.5 and set(good.per_class) == set(classes)
    assert spark.read.parquet(f"{out}/runs/{good.exp_id}/eval").count() == 2 * data.where("split = 'eval'").count()
    assert spark.read.parquet(f"{out}/runs/{good.exp_id}/thresholds").count() == 2
    monkeypatch.setitem(experiments.MODELS, "absent", {"iterations": "5", "l2": "0.5"})
    again = experiments.run_grid(data, grid, classes, out)
    assert again.count() == 6 and again.where("error is null").select("exp_id").distinct().count() == 4
    summary, checks = experiments.reported(again)
    assert summary.count() == 4 and checks.where("check = 'macro_f1'").count() == 1
    best = experiments.tune(data, {"a": {"l2": "0.01"}, "b": {"l2": "100.0"}}, classes, out).collect()
    assert {r.name for r in best} == {"a", "b"} and best[0].macro_f1 >= best[1].macro_f1
    assert experiments.benchmark(data, classes).where("hours > 0").count() >= 2 and experiments.unique_files(data) == 240


def test_command_line(spark, tmp_path, capsys):
    base = f"{tmp_path}/m"
    _manifest(spark).drop("split").write.parquet(base)
    assert main([]) == 2 and main(["run", "x"]) == 2 and main(["run", "absent", "x", "y"]) == 2 and main(["list"]) == 0
    assert main(["dedup", base, f"{tmp_path}/d"]) == 0 and spark.read.parquet(f"{tmp_path}/d/manifest").count() == 240
    assert main(["split", f"{tmp_path}/d/manifest", f"{tmp_path}/s", "40"]) == 0
    assert main(["verify", base, f"{tmp_path}/d/manifest"]) == 0
    gone = f"{tmp_path}/gone"
    spark.read.parquet(base).where("seq > 3").write.parquet(gone)
    assert main(["verify", base, gone]) == 1
    assert "image_phash" in capsys.readouterr().out
