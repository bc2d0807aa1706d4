"""Order statistics, percentiles and heads against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datakiln.operators import sampling, selection


@pytest.fixture(params=[20_000, 0], ids=["one small sort", "to the last bit"])
def small(request, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", request.param)


def test_order_statistics(spark, small):
    r = random.Random(1)
    values = [r.choice([-(1 << 63), (1 << 63) - 1, 0, -1, 7, r.getrandbits(63), -r.getrandbits(40)]) for _ in range(300)]
    rows = [("a", v) for v in values] + [("b", 5)] * 50
    ranks = [("a", k) for k in (0, 1, 149, 299, 300)] + [("b", 0), ("b", 49), ("c", 0)]
    got = selection.order_statistics(spark.createDataFrame(rows, "g string, k long"), spark.createDataFrame(ranks, "g string, rank long"))
    want = {("b", 0, 5, 0, 50), ("b", 49, 5, 0, 50)}
    for k in (0, 1, 149, 299):
        x = sorted(values)[k]
        want.add(("a", k, x, sum(v < x for v in values), values.count(x)))
    assert {tuple(x) for x in got.collect()} == want


def test_percentiles(spark, small):
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(size=501),
        "equal": np.full(400, 0.1),
        "signs": np.array([-0.0, 0.0, -1e-300, 1e300, -np.inf]),
        "one": np.array([3.5]),
        "steps": rng.integers(0, 4, 200).astype(float),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), (None, 1.0), ("empty", None)]
    shares = (0.03, 0.5, 0.97, 1.0)
    got = {r.g: (r.n, r.q) for r in selection.percentiles(spark.createDataFrame(rows, "g string, x double").repartition(3), "g", "x", shares).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g][0] == len(xs)
        if g != "signs":
            assert np.allclose(got[g][1], np.percentile(xs, [100 * s for s in shares]), rtol=1e-12, atol=0)
    assert got["signs"][1][1] == 0.0 and math.copysign(1, got["equal"][1][0]) == 1


def test_not_a_number_is_last(spark):
    df = spark.createDataFrame([(x,) for x in (math.nan, math.inf, 1.0, -math.inf)], "x double")
    order = [r.x for r in df.withColumn("k", selection.ordered_bits(F.col("x"))).orderBy("k").collect()]
    assert order[:3] == [-math.inf, 1.0, math.inf] and math.isnan(order[3])
    back = df.select(selection.from_ordered_bits(selection.ordered_bits(F.col("x")))).collect()
    assert [r[0] for r in back][1:] == [math.inf, 1.0, -math.inf]


def test_heads_with_ties(spark, small):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randrange(5), r.randrange(3), i) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, x long, y long, i long").repartition(4)
    quota = {"a": 17, "b": 1000, None: 60}
    keyed = spark.createDataFrame([(k, v) for k, v in quota.items()], "s string, quota long")
    quotas = keyed.select(selection.group_key(["s"]).alias("g"), "quota")
    got = [tuple(x) for x in selection.heads(df, ["s"], quotas, [F.col("x"), F.col("y")]).collect()]
    assert len({x[3] for x in got}) == len(got)
    for s, n in quota.items():
        mine = sorted((x, y) for a, x, y, _ in rows if a == s)[:n]
        assert sorted((x, y) for a, x, y, _ in got if a == s) == mine


def test_sample_of_equal_keys(spark, small):
    df = spark.range(5000).select(F.lit("same").alias("file"), "id").repartition(4)
    got = sampling.sample_without_replacement(df, 1234, "file").collect()
    assert len(got) == 1234 == len({r.id for r in got})
    assert sampling.sample_without_replacement(df, 0, "file").count() == 0
    assert sampling.sample_without_replacement(df.limit(0), 5, "file").count() == 0
    assert sampling.sample_without_replacement(df, 10**9, "file").count() == 5000
