"""Components kept as a manifest grows, against one run over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from datakiln.operators import dedup
from datakiln.operators.incremental import DedupStore
from datakiln.sources import scratch

SCHEMA = "file string, source string, origin_id string, phash long, origin_x int"


def _rows(seed, n=160):
    """Chains that drift a few bits, shared hashes under several origins, null hashes and origins, repeated rows."""
    r, rows, h = random.Random(seed), [], 0
    for i in range(n):
        h = r.getrandbits(63) if i % 12 == 0 else h ^ sum(1 << b for b in r.sample(range(63), r.randrange(0, 5)))
        origin = r.choice([None, "a", "a", "b", "c"]) if i % 3 else "a"
        rows.append((f"f{i:03}", r.choice(["real", "aigc", "web"]), origin, None if i % 31 == 5 else h, i))
    return rows + rows[:5]


def _whole(df):
    marks = {(x.file, x.dedup_removed) for x in dedup.dedup(df).collect()}
    roots = {(x.node, x.root) for x in dedup.sample_components(df).collect()}
    return marks, roots


@pytest.mark.parametrize("seed", [1])
def test_every_batch_equals_a_full_run(spark, tmp_path, seed):
    rows = _rows(seed)
    random.Random(seed).shuffle(rows)
    kept = DedupStore(spark, f"file://{tmp_path}/store", expected=100)
    cuts = [0, 40, 40, 100, len(rows)]  # the second batch is empty
    for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
        kept.add(spark.createDataFrame(rows[x:y], SCHEMA), i)
        if i in (2, 3):
            df = spark.createDataFrame(rows[:y], SCHEMA)
            marks, roots = _whole(df)
            assert {(r.file, r.dedup_removed) for r in kept.marked(df).collect()} == marks
            found = {(r.node, r.root) for r in dedup.sample_roots(df, kept.roots()).collect()}
            assert found == roots and any(removed for _, removed in marks)
    units = kept.n_units()
    kept.add(spark.createDataFrame(rows, SCHEMA), 3)  # done already
    kept.add(spark.createDataFrame(rows, SCHEMA), 4)  # nothing new
    assert kept.n_units() == units and kept.done() == 5
    assert {(r.file, r.dedup_removed) for r in kept.marked(df).collect()} == marks
    with pytest.raises(ValueError):
        kept.add(df, 9)


def test_an_unfinished_batch_starts_over(spark, tmp_path):
    rows, kept = _rows(3, 60), DedupStore(spark, f"file://{tmp_path}/store")
    kept.add(spark.createDataFrame(rows[:30], SCHEMA), 0)
    kept.add(spark.createDataFrame(rows[20:], SCHEMA), 1)
    (tmp_path / "store/batch=1/DONE").unlink()  # as if the driver had been lost before the end
    again = DedupStore(spark, f"file://{tmp_path}/store")
    assert again.done() == 1
    again.add(spark.createDataFrame(rows[30:], SCHEMA), 1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.file, r.dedup_removed) for r in again.marked(df).collect()} == _whole(df)[0]


def test_a_stream_of_files(spark, tmp_path):
    rows = _rows(4, 60)
    for i in range(2):
        spark.createDataFrame(rows[i::3], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def follow():
        lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        DedupStore(spark, f"file://{tmp_path}/store").follow(lines, f"{tmp_path}/checkpoint").awaitTermination()

    follow()
    spark.createDataFrame(rows[2::3], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    follow()
    kept, df = DedupStore(spark, f"file://{tmp_path}/store"), spark.createDataFrame(rows, SCHEMA)
    assert kept.done() == 3
    assert {(r.file, r.dedup_removed) for r in kept.marked(df).collect()} == _whole(df)[0]


def test_an_empty_store(spark, tmp_path):
    kept = DedupStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame(_rows(5, 10), SCHEMA)
    assert kept.roots().isEmpty() and not kept.marked(df).where(F.col("dedup_removed")).count()


def test_large_batches_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    """What is broadcast passes the driver, in each of many joins: only small batches may be."""
    monkeypatch.setattr(dedup, "SMALL", 0, raising=False)
    plans, written = [], scratch.written

    def recorded(df, *name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *name)

    monkeypatch.setattr(dedup, "written", recorded)
    monkeypatch.setattr(scratch, "written", recorded)
    rows, kept = _rows(6, 40), DedupStore(spark, f"file://{tmp_path}/store")
    for i in range(2):
        kept.add(spark.createDataFrame(rows[i::2], SCHEMA), i)
    df = spark.createDataFrame(rows, SCHEMA)
    marked = kept.marked(df)
    plans.append(marked._jdf.queryExecution().executedPlan().toString())
    joins = [p for p in plans if "Join" in p and "flip" not in p]  # the flips are a bounded table
    assert len(joins) > 5 and not [p for p in joins if "Broadcast" in p]
    assert {(r.file, r.dedup_removed) for r in marked.collect()} == _whole(df)[0]
