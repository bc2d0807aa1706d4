"""Collection of clean frames under quotas, and their manifest rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.functions.expressions import clean_frame_reason, scene_of
from datakiln.functions.image import assess_quality, with_scene_stats
from datakiln.operators.sampling import MOST_REJECTS, quota_rejects, quota_scan
from datakiln.sources import images
from datakiln.sources.scratch import written

#: Shards that a scan reads at first and at most at once; a scan reads at most about twice what it needs.
FIRST_SHARDS, MOST_SHARDS = 1, 64


def judged(frames: DataFrame) -> DataFrame:
    """frames (seq, image) with measures, scene, and the reasons against it by day and by night (null if none)."""
    m = with_scene_stats(assess_quality(frames)).withColumn("width", F.col("image.width")).withColumn("height", F.col("image.height"))
    m = m.withColumn(
        "scene", scene_of(*(F.col(c) for c in ("mean", "b", "g", "r", "sky", "green")))
    ).drop("mean", "b", "g", "r", "sky", "green")

    def reason(night: bool) -> Column:
        return clean_frame_reason(F.col("width"), F.col("height"), F.col("lap_var"), F.col("mean_lum"), F.lit(night))

    return m.withColumn("normal_reason", reason(False)).withColumn("night_reason", reason(True)).withColumn("normal_ok", F.col("normal_reason").isNull()).withColumn(
        "night_ok", F.col("night_reason").isNull() & (F.col("scene") == "night")
    )


def collect_quota(frames: DataFrame, num: int, night_quota: int) -> tuple[DataFrame, DataFrame]:
    """Manifest rows of the frames taken, and (seq, reason) of those refused. Pixels join last: the quotas are dealt on keys."""
    rows = judged(frames)
    keys = rows.drop("image")
    taken = quota_scan(keys, num, night_quota)
    refused = quota_rejects(keys, taken, num, night_quota).select("seq", F.coalesce("normal_reason", "night_reason").alias("reason"))
    return real_rows(taken.join(frames.select("seq", "image"), "seq")), refused


def scan_in_ranges(ranges: Iterable[DataFrame], num: int, night_quota: int, most: int = MOST_REJECTS) -> tuple[DataFrame | None, DataFrame | None]:
    """As collect_quota over all ranges, reading no range after the one that fills both quotas.

    ranges: frames (seq, image), each range after the last in seq order; they are asked for one by one. Quotas are dealt in order, so what
    a range takes follows from how many the ranges before it took. None without any range.
    """
    nights, normals, seen, logged = night_quota, num, 0, 0
    taken, refused = [], []
    for frames in ranges:
        rows = written(judged(frames), "judged")  # decoded and measured once
        keys = rows.drop("image")
        got = written(quota_scan(keys, normals, nights), "taken")
        counts = {r.kind: r["count"] for r in got.groupBy("kind").count().collect()}
        if logged < most:
            why = F.coalesce("normal_reason", "night_reason").alias("reason")
            against = written(quota_rejects(keys, got, normals, nights, most=most - logged).select("seq", why), "refused")
            logged += against.count()
            refused.append(against)
        taken.append(got.withColumn("idx", F.col("idx") + seen).join(rows.select("seq", "image"), "seq"))
        nights, normals, seen = nights - counts.get("night", 0), normals - counts.get("normal", 0), seen + sum(counts.values())
        if nights <= 0 and normals <= 0:
            break
    if not taken:
        return None, None
    return real_rows(reduce(DataFrame.unionByName, taken)), reduce(DataFrame.unionByName, refused)


def shard_ranges(spark: SparkSession, pattern: str, skip: int = 0, shards: int | None = None) -> Iterator[DataFrame]:
    """Frames (seq, image) of Parquet shards in path order, a few shards at a time; a range is read only when it is asked for.

    seq is the shard's number and the row's place in it. Rows that can't be decoded are left out.
    """
    paths = images.list_shards(spark, pattern)[skip:][:shards]
    at, n = 0, FIRST_SHARDS
    while at < len(paths):
        parts = []
        for i, path in enumerate(paths[at : at + n], at):
            df = spark.read.parquet(path)
            seq = F.shiftleft(F.lit(skip + i).cast("long"), 40) + F.col("_metadata.row_index")
            parts.append(df.select(seq.alias("seq"), images.image_bytes(df).alias("content")))
        yield images.decoded(reduce(DataFrame.unionByName, parts)).select("seq", "image")
        at, n = at + n, min(2 * n, MOST_SHARDS)


def real_rows(taken: DataFrame) -> DataFrame:
    """Manifest rows of clean frames, named by their running number; frames taken for the night quota are night scenes."""
    name = F.format_string("real_%06d", F.col("idx"))
    return taken.select(
        "seq",
        F.concat(F.lit("real/"), name, F.lit(".png")).alias("file"),
        F.sha1("image.data").alias("sha1"),
        F.lit("real").alias("source"),
        name.alias("origin_id"),
        F.array().cast("array<string>").alias("labels"),
        F.when(F.col("kind") == "night", "night").otherwise(F.col("scene")).alias("scene"),
        F.lit("none").alias("difficulty"),
        "width",
        "height",
        "mean_lum",
        "lap_var",
        F.lit("unassigned").alias("split"),
        "image",
    )
