"""Operators against plain Python on small rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from datakiln.functions import expressions as X
from datakiln.operators import agreement, calibration, consistency, dedup, evaluation, sampling, split, tables


def test_banded_pairs_equal_brute_force(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(6)]
    values = []
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(r.randrange(12)):
                x ^= 1 << r.randrange(64)
            values.append(x)
    rows = [(f"f{i:03d}", x - (1 << 64) if x >> 63 else x) for i, x in enumerate(values)] + [("null", None)]
    df = spark.createDataFrame(rows, "file string, phash long")
    for t in (0, 1, 4, 8, 12, 16):
        got = {(p.file_a, p.file_b, p.distance) for p in dedup.pairwise_hamming_le(df, t).collect()}
        want = {
            (
                f"f{i:03d}", f"f{j:03d}", (values[i] ^ values[j]).bit_count()
            ) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= t
        }
        assert got == want


@pytest.mark.parametrize("n", [10, 10**4, 10**6, 10**9])
def test_wide_pairs_however_bits_are_cut(spark, monkeypatch, n):
    """The cut of a large table loses nothing on a small one."""
    subs = dedup.substrings(n, 12)
    assert sum(w for _, w, _ in subs) <= 64 and len(dedup.substrings(10**9, 12)) < len(dedup.substrings(10, 12))
    if sum(math.comb(w, k) for _, w, r in subs for k in range(r + 1)) > 20_000:
        return
    monkeypatch.setattr(dedup, "substrings", lambda *_: subs)
    r = random.Random(n)
    base = [r.getrandbits(63) for _ in range(5)]
    values = sorted({b ^ sum(1 << k for k in r.sample(range(63), r.randrange(10))) for b in base for _ in range(15)})
    got = {tuple(p) for p in dedup.hash_pairs(spark.createDataFrame([(v,) for v in values], "h long"), 12).collect()}
    assert got == {(a, b, (a ^ b).bit_count()) for a in values for b in values if a < b and (a ^ b).bit_count() <= 12}


@pytest.mark.parametrize("threshold,bounds", [(16, (64, 1 << 17)), (12, (500, 100)), (30, (2048, 1 << 17))])
def test_wide_pairs_are_compared_in_blocks(spark, monkeypatch, threshold, bounds):
    """No hash is looked up under thousands of keys where comparing blocks costs less."""
    monkeypatch.setattr(dedup, "probes", lambda *_: pytest.fail("looked up under keys"))
    monkeypatch.setattr(dedup, "LEAST_BLOCK", bounds[0])
    monkeypatch.setattr(dedup, "MOST_BLOCK", bounds[1])
    r = random.Random(threshold)
    values = [r.getrandbits(64) for _ in range(700)]
    values += [v ^ sum(1 << k for k in r.sample(range(64), r.randrange(1, 20))) for v in values[:300]] + [0, 1 << 63, (1 << 64) - 1]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    got = [tuple(p) for p in dedup.hash_pairs(spark.createDataFrame([(v,) for v in values], "h long"), threshold).collect()]
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {(a, b, apart(a, b)) for i, a in enumerate(values) for b in values[i + 1 :] if apart(a, b) <= threshold}
    assert set(got) == want and len(got) == len(want)


def test_cross_origin_pairs_of_wide_hashes(spark, monkeypatch):
    monkeypatch.setattr(dedup, "probes", lambda *_: pytest.fail("looked up under keys"))
    r = random.Random(2)
    values = [r.getrandbits(63) for _ in range(80)] + [0, 0, 7]
    values += [v ^ sum(1 << k for k in r.sample(range(63), 9)) for v in values]
    rows = [(i, [None, "a", "b"][i % 3], v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "file long, origin_id string, phash long")
    found = dedup.with_origins(dedup.pairwise_hamming_le(df, 16), df).where("cross").collect()
    near = {(a, b, (x ^ y).bit_count()) for a, o, x in rows for b, p, y in rows if a < b and o != p and (x ^ y).bit_count() <= 16}
    assert {(p.file_a, p.file_b, p.distance) for p in found} == near and len(found) == len(near) > 40


@pytest.mark.parametrize("n,threshold", [(10, 4), (10**6, 4), (10, 12)])
def test_keys_and_blocks_find_the_same(spark, monkeypatch, n, threshold):
    """Small tables are compared in blocks; what large ones do is run here too."""
    subs = dedup.substrings(n, threshold)
    monkeypatch.setattr(dedup, "substrings", lambda *_: subs)
    r = random.Random(n)
    base = [r.getrandbits(63) for _ in range(5)]
    values = sorted({b ^ sum(1 << k for k in r.sample(range(63), r.randrange(8))) for b in base for _ in range(15)})
    df = spark.createDataFrame([(v,) for v in values], "h long")
    blocks = {tuple(p) for p in dedup.hash_pairs(df, threshold).collect()}
    monkeypatch.setattr(dedup, "COMPARE_COST", float("inf"))
    assert {tuple(p) for p in dedup.hash_pairs(df, threshold).collect()} == blocks and blocks


def test_narrow_pairs_of_large_tables_are_looked_up():
    for n, threshold, blocks in ((600_000, 16, True), (600_000, 4, False), (10**9, 4, False)):
        compared = dedup.COMPARE_COST * n * n / 2 < dedup._probing_cost(n, dedup.substrings(n, threshold))
        assert compared == blocks


def test_dedup_chain_keeps_the_first_source(spark):
    rows = [
        ("a", "o1", "aigc", 0b0000, "x"),
        ("b", "o2", "real", 0b1111, "x"),
        ("c", "o1", "procedural", 0b11111111, "y"),
        ("d", "o4", "real", 1 << 40 | 0xFFFF0000, ""),
        ("e", "o5", "real", None, "z"),
    ]
    df = spark.createDataFrame(rows, "file string, origin_id string, source string, phash long, sha1 string")
    marked = dedup.dedup(df)
    assert {r.file for r in marked.where("dedup_removed").collect()} == {"a", "c"}
    report = dedup.dedup_report(df, marked).first()
    assert (report.removed, report.kept, report.cross_origin_dup_pairs, report.exact_sha1_groups) == (2, 3, 2, 1)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in dedup.components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert dedup.components(edges.limit(0), "a", "b").count() == 0


def _water(available, target):
    quota, left = [0] * len(available), min(target, sum(available))
    while left:
        open_cells = [i for i, a in enumerate(available) if quota[i] < a]
        share = left // len(open_cells)
        if not share:
            for i in open_cells[:left]:
                quota[i] += 1
            return quota
        for i in open_cells:
            add = min(share, available[i] - quota[i])
            quota[i] += add
            left -= add
    return quota


def test_quota_waterfill(spark):
    r = random.Random(1)
    for _ in range(12):
        available = [r.randrange(1, 40) for _ in range(r.randrange(1, 9))]
        target = r.randrange(1, 120)
        cells = spark.createDataFrame(list(enumerate(available)), "first_seen long, available long")
        got = [x.quota for x in sampling.allocate_quotas(cells, target).orderBy("first_seen").collect()]
        assert sum(got) == min(target, sum(available))
        assert got == _water(available, target)


def test_quota_scan_equals_a_loop(spark):
    r = random.Random(2)
    for _ in range(6):
        frames = [(i, r.random() < 0.3, r.random() < 0.5) for i in range(60)]
        num, nights = r.randrange(1, 25), r.randrange(0, 12)
        taken, rejected, a, b = [], [], 0, 0
        for seq, night, normal in frames:
            if a >= nights and b >= num:
                break
            if night and a < nights:
                taken.append((seq, "night", len(taken)))
                a += 1
            elif normal and b < num:
                taken.append((seq, "normal", len(taken)))
                b += 1
            else:
                rejected.append(seq)
        df = spark.createDataFrame(frames, "seq long, night_ok boolean, normal_ok boolean")
        got = sampling.quota_scan(df, num, nights)
        assert [(x.seq, x.kind, x.idx) for x in got.orderBy("seq").collect()] == taken
        assert sorted(x.seq for x in sampling.quota_rejects(df, got, num, nights).collect()) == rejected


@pytest.mark.parametrize("seed", [1, 42])
def test_split_never_leaks(spark, seed):
    df = spark.range(500).select(F.concat(F.lit("o"), (F.col("id") % 77).cast("string")).alias("origin_id"), F.lit("real").alias("source"))
    done = split.with_split(df, split.assign_splits(df, 100, seed))
    assert split.check_leakage(done).first().passed
    stats = {r.split: r.origins for r in split.split_stats(done).collect()}
    rest = 77 - stats["eval"]
    assert (stats["train"], stats["val"]) == (int(rest * 0.7), int(rest * 0.2))


def test_mix_sizes():
    assert [sampling.mix_sizes(895, 5000, r)[1] for r in (0, 0.25, 0.5, 0.75, 1)] == [0, 298, 895, 2685, 3580]
    assert sampling.mix_sizes(10, 5, 0.5) == (10, 5)


def test_f1_nulls(spark):
    rows = [("none", 0, 0), ("none", 0, 0), ("wrong", 1, 0), ("right", 1, 1)]
    df = spark.createDataFrame(rows, "class string, pred int, y int")
    got = {r["class"]: (r.precision, r.recall, r.f1) for r in evaluation.prf(df).collect()}
    assert got == {"none": (None, None, None), "wrong": (0.0, None, 0.0), "right": (1.0, 1.0, 1.0)}
    assert evaluation.macro_f1(df).first().macro_f1 == 0.5


def test_bins_are_closed_above(spark):
    edges = [i * 0.1 for i in range(10)] + [1.0]
    df = spark.createDataFrame([(e, True) for e in edges], "prob double, correct boolean")
    got = [r.n for r in evaluation.reliability_bins(df).orderBy("bin").collect()]
    assert got == [2, 1, 1, 1, 1, 1, 1, 1, 1, 1]


def test_thresholds(spark):
    rows = [("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.7, 1), ("a", 0.1, 0), ("b", 0.4, 0)]
    df = spark.createDataFrame(rows, "class string, prob double, y int")
    got = {r["class"]: r for r in evaluation.search_thresholds(df).collect()}
    assert got["a"].meets_recall_floor and 0.1 < got["a"].threshold <= 0.7 and abs(got["a"].precision - 2 / 3) < 1e-9
    assert not got["b"].meets_recall_floor and got["b"].threshold == 0.05


def test_temperature_does_not_change_f1(spark):
    r = random.Random(3)
    rows = [(i, "a", z, int(r.random() < 1 / (1 + math.exp(-z / 3)))) for i, z in enumerate(r.gauss(0, 6) for _ in range(300))]
    df = spark.createDataFrame(rows, "sample_id long, class string, logit double, y int")
    t, nll = calibration.fit_temperature(df)
    losses = {x.temperature: x.nll for x in calibration.nll_grid(df, [t * 0.97, t, t * 1.03]).collect()}
    assert min(losses, key=losses.get) == t and abs(losses[t] - nll) < 1e-9
    before, after = calibration.calibration_report(df, t).orderBy(F.desc("stage")).collect()
    assert before.macro_f1 == after.macro_f1


def test_kappa_edges(spark):
    rows = [("sure", 0, 0), ("sure", 0, 0), ("half", 1, 0), ("half", 0, 1)]
    df = spark.createDataFrame(rows, "class string, y1 int, y2 int")
    got = {r["class"]: r.kappa for r in agreement.kappa_per_class(df).collect()}
    assert got == {"sure": 1.0, "half": -1.0}


def test_answers_and_labels(spark):
    df = spark.createDataFrame([('ok {"labels": ["dark", "x", "dark"]}',), ("{bad",), (None,), ('{"labels": "dark"}',)], "a string")
    assert [r[0] for r in df.select(X.answer_labels(F.col("a"))).collect()] == [["dark", "dark"], [], [], []]
    one = df.limit(1).select(
        X.label_iou(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("e"),
        X.split_labels(F.lit(" a| b,,c ")).alias("s"),
    ).first()
    assert one.e == 1.0 and one.s == ["a", "b", "c"]


def test_compare_tolerates_extra(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "")], "file string, sha1 string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, sha1 string")
    assert tables.compare_report(tables.compare(base, now)).first().ok
    assert not tables.compare_report(tables.compare(now, base)).first().ok


def test_rules_and_report(spark):
    clean = spark.createDataFrame([(float(i), 5.0) for i in range(101)], "a double, b double")
    rules = {r.indicator: r for r in consistency.calibrate_rules(clean, ("a", "b"), ("b",)).collect()}
    assert rules["a"].threshold == 97.0 and rules["a"].scale == 47.0
    assert rules["b"].threshold == 5.0 and abs(rules["b"].scale - (0.5 + 1e-6)) < 1e-12
