"""Scans that stop and streams that keep their state, against whole-table operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datakiln.operators import sampling
from datakiln.plans import collect
from datakiln.sources import images
from datakiln.streaming import stateful

IMAGE = "origin:string,height:int,width:int,nChannels:int,mode:int,data:binary"


def _frame(i, rng, big=True):
    if not big:
        return rng.integers(0, 255, (10, 10, 3)).astype(np.uint8)
    return rng.integers(*((20, 60) if i % 3 == 0 else (60, 200)), (330, 324, 3)).astype(np.uint8)


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    """Frames in a table, in shards of four, and in files, by the same order."""
    rng = np.random.default_rng(1)
    arrays = [_frame(i, rng, i % 5 != 4) for i in range(24)]
    rows = [(i, (None, *a.shape[:2], 3, 16, bytearray(a.tobytes()))) for i, a in enumerate(arrays)]
    top = tmp_path_factory.mktemp("frames")
    (top / "files").mkdir()
    for i, a in enumerate(arrays):
        (top / "files" / f"f {i:02d}.png").write_bytes(images.png_bytes(a))
    for s in range(6):
        part = [(images.png_bytes(a),) for a in arrays[4 * s : 4 * s + 4]]
        spark.createDataFrame(part, "image binary").coalesce(1).write.parquet(str(top / f"s{s}"))
        next((top / f"s{s}").glob("part*.parquet")).rename(top / f"shard{s}.parquet")
    return spark.createDataFrame(rows, f"seq long, image struct<{IMAGE}>"), str(top)


@pytest.mark.parametrize("num,nights", [(3, 1), (5, 2), (100, 3), (0, 2), (4, 0)])
def test_ranges_equal_one_scan_and_stop(spark, frames, num, nights):
    df, _ = frames
    asked = []

    def ranges():
        for a in range(0, 24, 5):
            asked.append(a)
            yield df.where(F.col("seq").between(a, a + 4))

    taken, refused = collect.scan_in_ranges(ranges(), num, nights)
    want, log = collect.collect_quota(df, num, nights)
    columns = ["seq", "file", "scene", "origin_id", "sha1"]
    assert sorted(map(tuple, taken.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert sorted(map(tuple, refused.collect())) == sorted(map(tuple, log.collect()))
    last = max((r.seq for r in want.select("seq").collect()), default=0)
    if want.count() == num + nights:
        assert asked[-1] <= last  # the range that filled the quotas, and none after it


def test_shards_are_read_until_the_quotas_are_full(spark, frames, monkeypatch):
    df, top = frames
    read = []
    decoded = images.decoded
    monkeypatch.setattr(images, "decoded", lambda rows, *a: (read.extend(rows.inputFiles()), decoded(rows, *a))[1])
    taken, _ = collect.scan_in_ranges(collect.shard_ranges(spark, f"{top}/shard*.parquet"), 3, 1)
    want, _ = collect.collect_quota(df, 3, 1)
    assert sorted(r.sha1 for r in taken.collect()) == sorted(r.sha1 for r in want.collect())
    assert 1 <= len(read) <= 3 and all("shard5" not in f for f in read)


def test_folder_is_read_until_there_are_enough(spark, frames, monkeypatch):
    _, top = frames
    monkeypatch.setattr(images, "FIRST_FILES", 3)
    monkeypatch.setattr(images, "MOST_FILES", 6)
    opened = []
    read = images.read_files
    monkeypatch.setattr(images, "read_files", lambda s, paths: (opened.extend(paths), read(s, paths))[1])
    got = images.collect_from_dir(spark, f"{top}/files", 5).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(5)) and [r.origin for r in got] == sorted(r.origin for r in got)
    few = len(opened)
    assert few <= 9
    opened.clear()
    every = images.collect_from_dir(spark, f"{top}/files", 1000).orderBy("idx").collect()
    assert len(opened) == 24 and len(every) == 20 and [r.origin for r in every[:5]] == [r.origin for r in got]
    assert images.collect_from_dir(spark, f"{top}/files", 0).count() == 0


def _lines(path, rows):
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")


def test_names_are_known_after_a_restart(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    old = str(tmp_path / "old")
    spark.createDataFrame([("known",)], "file string").write.parquet(old)
    _lines(src / "1.json", [{"seq": 2, "file": "a"}, {"seq": 1, "file": "a", "labels": ["dark"]}, "no json", {"seq": 9}, {"seq": 3, "file": "known"}])
    stateful.ingest_lines(spark, str(src), out, check, manifest=old, files=1).awaitTermination()
    _lines(src / "2.json", [{"seq": 4, "file": "b"}, {"seq": 5, "file": "a"}, {"file": "c"}])
    _lines(src / "3.json", [{"seq": 7, "file": "c"}, {"seq": 8, "file": "b"}, {"seq": 9, "file": "d"}])
    stateful.ingest_lines(spark, str(src), out, check, manifest=old, files=1).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.file, r.seq or 0) for r in rows) == [("a", 1), ("b", 4), ("c", 0), ("d", 9)]
    assert [r.labels for r in rows if r.file == "a"] == [["dark"]]


def test_quotas_go_on_after_a_restart(spark, tmp_path):
    r = random.Random(4)
    rows = [(c, i, r.random() < 0.3, r.random() < 0.6) for c in ("x", "y") for i in range(120)]
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "collection string, seq long, night_ok boolean, normal_ok boolean"
    session = stateful.stateful_session(spark)

    def batch(a, b):
        part = [x for x in rows if a <= x[1] < b]
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        found = stateful.collect_stream(stream, 25, 9)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    batch(0, 20), run()
    batch(20, 33), run()
    batch(33, 120), run()
    got = {(x.collection, x.seq, x.kind, x.idx) for x in spark.read.parquet(out).collect()}
    want = set()
    for c in ("x", "y"):
        df = spark.createDataFrame([x for x in rows if x[0] == c], schema)
        want |= {(c, x.seq, x.kind, x.idx) for x in sampling.quota_scan(df, 25, 9).collect()}
    assert got == want and len(got) == 68


def test_quotas_take_rows_without_data_frames():
    """A collection's batch is a plain scan of rows: equal numbers once, more rows than are kept, those without a number last."""
    from pyspark.sql import Row

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    quotas = stateful.Quotas(3, 2)
    quotas.taken = State()
    row = lambda seq, night, normal: Row(collection="c", seq=seq, night_ok=night, normal_ok=normal)
    many = [row(i, i % 2 == 0, None) for i in range(5000, 9, -1)] + [row(4, None, True), row(3, True, True), row(3, None, True), row(None, True, True)]
    got = [tuple(r) for r in quotas.handleInputRows(("c",), iter(many), None)]
    assert got == [("c", 3, "night", 0), ("c", 4, "normal", 1), ("c", 10, "night", 2), ("c", None, "normal", 3)]
    assert quotas.taken.value == (2, 2)
    more = [row(6000, True, False), row(6001, False, True), row(6002, False, True)]
    assert [tuple(r) for r in quotas.handleInputRows(("c",), iter(more), None)] == [("c", 6001, "normal", 4)]
    assert [*quotas.handleInputRows(("c",), iter(more), None)] == []
