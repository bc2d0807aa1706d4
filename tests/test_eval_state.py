"""Folded evaluation against evaluation of all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from datakiln.operators import evaluation
from datakiln.operators import eval_state as S

CLASSES = ("blur", "dark", "noise")
SCHEMA = "sample_id string, run string, source string, class string, prob double, y int"


def _rows(seed=1):
    r = random.Random(seed)
    return [
        (f"s{i}", "ab"[i % 2], r.choice(["x", "y", None]), c, r.choice([0.0, 0.1, 0.5, 1.0, r.random(), r.random()]), int(r.random() < 0.4))
        for i in range(90)
        for c in CLASSES
    ]


def test_folds_equal_the_whole(spark, tmp_path):
    rows = _rows()
    cuts = [0, 60, 60, 150, len(rows)]  # the second batch is empty; samples are not divided
    kept = S.EvaluationStore(spark, f"file://{tmp_path}/s", CLASSES, ("source",), "run")
    assert kept.slices().isEmpty()
    for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
        kept.fold(evaluation.predicted(spark.createDataFrame(rows[x:y], SCHEMA)), i)
    kept.fold(evaluation.predicted(spark.createDataFrame(rows, SCHEMA)), 2)  # done already
    with pytest.raises(ValueError):
        kept.fold(evaluation.predicted(spark.createDataFrame(rows, SCHEMA)), 9)
    at_once = S.state_of(evaluation.predicted(spark.createDataFrame(rows, SCHEMA)), CLASSES, ("source",), "run")
    assert sorted(map(str, kept.state().collect())) == sorted(map(str, at_once.collect()))
    for run in "ab":
        pred = evaluation.predicted(spark.createDataFrame([r for r in rows if r[1] == run], SCHEMA))
        sliced = kept.slices().where((F.col("run") == run) & (F.col("key") == "source"))
        mine = {r.bucket: pytest.approx((r.n, r.macro_f1, r.macro_recall)) for r in sliced.collect()}
        assert {r.bucket: (r.n, r.macro_f1, r.macro_recall) for r in evaluation.slice_metrics(pred, ("source",)).collect()} == mine
        per = {r["class"]: (r.tp, r.tn, r.f1) for r in kept.classes().where(F.col("run") == run).collect()}
        assert per == {r["class"]: (r.tp, r.tn, r.f1) for r in evaluation.prf(pred).collect()}
        got = kept.calibration().where(F.col("run") == run).first()
        assert got.n == 45
        assert got.brier == pytest.approx(evaluation.brier(pred).first().brier, abs=1e-12)
        assert got.ece_multilabel == pytest.approx(evaluation.ece_multilabel(pred).first()[0], abs=1e-12)
        assert got.ece_singlelabel == pytest.approx(evaluation.ece_singlelabel(pred, CLASSES).first()[0], abs=1e-12)
