"""Distributed training against one machine, numbers of jobs, restarts, and runs that fail."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datakiln.operators import evaluation, scorers, tables, training
from datakiln.operators.sampling import make_train_mix, make_train_mixes
from datakiln.operators.training import Settings
from datakiln.plans import experiments

CLASSES = ("ring", "right")


def _points(n, seed):
    """Points of which no line parts the outer ones from the inner ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 30.0] + [0.0, 500.0]
    unit = (x - [0.0, 500.0]) / [1.0, 30.0]
    return x, np.stack([(unit**2).sum(1) > 1.5, unit[:, 0] > 0], 1).astype(int)


def _table(spark, n, seed, parts=3):
    x, y = _points(n, seed)
    rows = [(f"f{seed}-{i}", x[i].tolist(), y[i].tolist(), ["even"] if i % 2 == 0 else None) for i in range(n)]
    return spark.createDataFrame(rows, "file string, features array<double>, truth array<int>, mixes array<string>").repartition(parts)


@pytest.mark.parametrize("hidden", [0, 5])
def test_gradient_is_the_slope_of_the_loss(hidden):
    rng = np.random.default_rng(3)
    x, y, pw = rng.normal(size=(20, 4)), rng.integers(0, 2, (20, 3)).astype(float), np.array([1.0, 2.5, 0.3])
    w = training.initial(4, hidden, 3, 1)
    _, gradient = training.loss_and_gradient(w, x, y, pw, hidden)
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-5
        up, down = (training.loss_and_gradient(w + s, x, y, pw, hidden)[0] for s in (step, -step))
        assert math.isclose((up - down) / 2e-5, gradient[i], rel_tol=1e-5, abs_tol=1e-6)


def _plain(x, y, batch_of, batches, s):
    """The same training in one place, sample by sample."""
    mean, sd = x.mean(0), x.std(0)
    u, pw = (x - mean) / sd, (len(y) - y.sum(0)) / np.maximum(y.sum(0), 1)
    w = training.initial(x.shape[1], s.hidden, y.shape[1], s.seed)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for e in range(s.epochs):
        for b in np.random.default_rng([17, e]).permutation(batches):
            at = np.flatnonzero(batch_of == b)
            if not len(at):
                continue
            g = sum(training.loss_and_gradient(w, u[i : i + 1], y[i : i + 1], pw, s.hidden)[1] for i in at) / (len(at) * y.shape[1])
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            rate = s.rate * (1 + math.cos(math.pi * e / s.epochs)) / 2
            w = w - rate * s.decay * w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def test_runs_together_equal_one_machine_and_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "FEW_TASKS", 2)  # sums go through the second level
    rows, val = _table(spark, 300, 1), _table(spark, 200, 2)
    odd = spark.createDataFrame(
        [("a", None, [0, 1], None), ("b", [1.0], [0, 1], None), ("c", [1.0, None], [0, 1], None), ("d", [1.0, 2.0], None, None),
         ("e", [float("nan"), 2.0], [0, 1], None), ("f", [1.0, 2.0], [0, 1, 1], None)], rows.schema
    )
    settings = {"all": Settings(4, 3, 0.05, 0.01, 7), "even": Settings(0, 2, 0.05, 0.01, 8, "even"), "none": Settings(4, 3, mix="absent"),
                "bad": Settings(4, 3, -1.0), "wild": Settings(4, 3, 1e308, 1e308)}
    out = f"file://{tmp_path}/state"
    got = training.train_runs(rows.unionByName(odd), val, CLASSES, settings, out, batches=4)
    assert got["none"].error == "no samples" and got["bad"].error == "settings out of range" and got["wild"].error
    batch = {r.file: r.b for r in rows.select("file", F.pmod(F.xxhash64("file"), F.lit(4)).alias("b")).collect()}
    x, y = _points(300, 1)
    b = np.array([batch[f"f1-{i}"] for i in range(300)])
    assert np.allclose(got["all"].w, _plain(x, y, b, 4, settings["all"]), atol=1e-8)
    assert np.allclose(got["even"].w, _plain(x[::2], y[::2], b[::2], 4, settings["even"]), atol=1e-8)
    assert got["all"].epochs == [0, 1, 2] and got["even"].epochs == [0, 1]
    log = training.history(spark, got)
    best = {r.run: r.epoch for r in evaluation.best_epoch(log, ["run"], "val_macro_f1").collect()}
    assert best == {"all": got["all"].best_epoch, "even": got["even"].best_epoch}
    long = training.network_scores(val, got, CLASSES).where("run = 'all'")
    pred = evaluation.predicted(long.withColumnRenamed("file", "sample_id"))
    assert math.isclose(evaluation.macro_f1(pred).first()[0], got["all"].best_f1, rel_tol=1e-9)
    cut = f"file://{tmp_path}/cut"  # stopped in the last epoch
    with monkeypatch.context() as patch:
        patch.setattr(training, "_keep", lambda s, o, e, r, f=training._keep: f(s, o, e, r) if e < 3 else (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            training.train_runs(rows, val, CLASSES, settings, cut, batches=4)
    again = training.train_runs(rows, val, CLASSES, settings, cut, batches=4)
    assert np.allclose(again["all"].w, got["all"].w, atol=1e-8) and again["all"].epochs == [0, 1, 2] and again["none"].error == "no samples"
    assert np.allclose(again["even"].best, got["even"].best, atol=1e-8)
    with pytest.raises(ValueError):
        training.train_runs(rows, val, CLASSES, {"all": Settings()}, cut)


def test_empty_tables(spark):
    none = _table(spark, 3, 1).where("false")
    assert training.train_runs(none, none, CLASSES, {"a": Settings()})["a"].error == "no samples"
    got = training.train_runs(_table(spark, 30, 1), none, CLASSES, {"a": Settings(2, 2)}, batches=2)
    assert got["a"].error is None and got["a"].scores == [None, None] and got["a"].best_epoch == 1
    assert training.network_scores(none, got, CLASSES).count() == 0 and training.network_scores(none, {}, CLASSES).count() == 0


def test_beats_the_logistic_stand_in(spark):
    rows, val, test = (_table(spark, n, s) for n, s in ((800, 4), (300, 5), (400, 6)))
    got = training.train_runs(rows, val, CLASSES, {"net": Settings(12, 12, 0.08)}, batches=5)
    lines = scorers.linear_scorer(scorers.train(rows, CLASSES), CLASSES)(test)
    both = training.network_scores(test, got, CLASSES).drop("run"), lines
    ours, theirs = (evaluation.macro_f1(evaluation.predicted(s)).first()[0] for s in both)
    assert ours > 0.9 and ours > theirs + 0.1


def _manifest(spark, n=360):
    r = random.Random(5)
    rows = []
    for i in range(n):
        x = [r.gauss(0, 1), r.gauss(0, 1)]
        labels = [c for c, v in zip(CLASSES, (x[0] ** 2 + x[1] ** 2 - 1.5, x[0])) if v > 0]
        split, source = ("train", "train", "val", "eval")[i // 2 % 4], ("real", "procedural", "aigc", None)[i % 4]
        rows.append((i, f"f{i}", source, split, labels, "indoor", "mid", x))
    return spark.createDataFrame(
        rows, "seq long, file string, source string, split string, labels array<string>, scene string, difficulty string, features array<double>"
    )


def test_mixes_equal_those_made_one_by_one(spark):
    rows = _manifest(spark)
    wanted = {f"{r}-{s}": (r, s) for r in (0.0, 0.5, 0.8, 1.0) for s in (1, 2)}
    got = make_train_mixes(rows, wanted).select(F.explode("mixes").alias("mix"), "file").collect()
    for name, (ratio, seed) in wanted.items():
        assert sorted(f for m, f in got if m == name) == sorted(r.file for r in make_train_mix(rows, ratio, seed=seed).collect())
    assert make_train_mixes(rows.where("false"), wanted).count() == 0


def test_grid_together_equals_the_runner(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(experiments.NETWORKS, "network", {"hidden": "4", "epochs": "2", "rate": "0.05", "decay": "0.01", "batches": "2"})
    data, grid = _manifest(spark), tables.experiment_grid(spark, ["network", "absent"], [0.5, 1.0], [1])
    jobs = spark.sparkContext.statusTracker()

    def counted(name, work):
        spark.sparkContext.setJobGroup(name, name)
        rows = work().collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(jobs.getJobIdsForGroup(name))

    one = experiments.run_grid(data, grid, CLASSES, f"file://{tmp_path}/one").collect()
    both, n = counted("both", lambda: experiments.run_grid_together(data, grid, CLASSES, f"file://{tmp_path}/both"))
    columns = ("n_total", "n_real", "n_synthetic", "ratio_actual", "macro_f1", "ece_multilabel", "brier")
    ours, theirs = ({r.exp_id: r for r in rows} for rows in (both, one))
    assert set(ours) == set(theirs) and len(ours) == 4
    for name, r in ours.items():
        assert (r.error is None) == (theirs[name].error is None) == name.startswith("network")
        if r.error is None:
            assert np.allclose([r[c] for c in columns], [theirs[name][c] for c in columns], atol=1e-9)
            assert set(r.per_class) == set(CLASSES) and r.macro_f1 > 0.3
    wide = tables.experiment_grid(spark, ["network"], [0.25, 0.5, 1.0], [1, 2, 3])
    more, m = counted("wide", lambda: experiments.run_grid_together(data, wide, CLASSES, f"file://{tmp_path}/wide"))
    assert len(more) == 9 and all(r.error is None for r in more) and m <= n
    again = experiments.run_grid_together(data, wide, CLASSES, f"file://{tmp_path}/wide")
    assert again.count() == 9
