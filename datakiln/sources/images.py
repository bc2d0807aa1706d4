"""Images: files, Parquet shards of encoded images and frame stacks in; PNG files out. The JVM decodes, to BGR order."""

from __future__ import annotations

import io
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from datakiln.functions.image import pixels
from datakiln.sources.scratch import new_folder, written

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")
IMAGE_GLOB = "*.{" + ",".join(e for x in EXTENSIONS for e in (x, x.upper())) + "}"
#: Files that an ordered scan of a folder reads at first and at most at once.
FIRST_FILES, MOST_FILES = 64, 4096
#: Partitions of a folder's scan that one task reads: Spark counts a file as 4 MB at least, which makes a partition of 32 small ones.
TOGETHER = 16


def read_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """origin, image; files that cannot be decoded are dropped."""
    found = spark.read.format("image").option("dropInvalid", True).option(
        "recursiveFileLookup", str(recursive).lower()
    ).option("pathGlobFilter", IMAGE_GLOB).load(path)
    parts, least = found.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism
    return found.coalesce(max(least, parts // TOGETHER)).select(F.col("image.origin").alias("origin"), "image")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-1 of the bytes of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "length", F.sha1("content").alias("sha1")
    )


def path_ranges(spark: SparkSession, path: str) -> Iterator[list[str]]:
    """The image files of a folder in path order, FIRST_FILES at first and up to MOST_FILES at a time. Nothing is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB).load(path)
    names, last, n = listed.select("path"), None, FIRST_FILES
    while True:
        rest = names if last is None else names.where(F.col("path") > last)
        found = [r.path for r in rest.orderBy("path").limit(n).collect()]
        if found:
            yield found
        if len(found) < n:
            return
        last, n = found[-1], min(2 * n, MOST_FILES)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """origin, image of the named files that can be decoded."""
    escaped = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]  # names, not patterns
    found = spark.read.format("image").option("dropInvalid", True).load(escaped)
    return found.select(F.col("image.origin").alias("origin"), "image")


def collect_from_dir(spark: SparkSession, path: str, num: int) -> DataFrame:
    """The first num clean images of a folder in path order, with measures, scene and the running number idx.

    Files are read range by range until there are enough; later ones are never opened.
    """
    from datakiln.functions.expressions import clean_frame_reason, scene_of
    from datakiln.functions.image import assess_quality, with_scene_stats

    def clean(frames: DataFrame) -> DataFrame:
        m = with_scene_stats(assess_quality(frames))
        scene = scene_of(*(F.col(c) for c in ("mean", "b", "g", "r", "sky", "green")))
        rows = m.withColumn("scene", scene).withColumn("width", F.col("image.width")).withColumn("height", F.col("image.height"))
        reason = clean_frame_reason(F.col("width"), F.col("height"), F.col("lap_var"), F.col("mean_lum"), F.col("scene") == "night")
        return rows.where(reason.isNull()).drop("mean", "b", "g", "r", "sky", "green")

    parts, left = [], num
    for paths in path_ranges(spark, path):
        found = written(clean(read_files(spark, paths)).orderBy("origin").limit(left), "clean-frames")
        n = found.count()
        if n or not parts:
            nth = F.row_number().over(Window.orderBy("origin"))  # at most MOST_FILES rows
            parts.append(found.withColumn("idx", nth + (num - left - 1)))
        left -= n
        if left <= 0:
            break
    if not parts:
        empty = spark.createDataFrame([], f"origin string, image struct<{IMAGE.replace(' ', ':')}>".replace(",:", ","))
        return clean(empty).withColumn("idx", F.lit(0))
    return reduce(DataFrame.unionByName, parts)


def list_shards(spark: SparkSession, pattern: str) -> list[str]:
    """Parquet shards that a glob names, in path order, from any store that Hadoop reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(str(x.getPath()) for x in found if str(x.getPath()).endswith(".parquet"))


def find_image_column(schema: StructType) -> str:
    """The first struct column with bytes, else the first whose name has image in it."""
    for f in schema.fields:
        if isinstance(f.dataType, StructType) and {"bytes", "content"} & set(f.dataType.names):
            return f.name
    for f in schema.fields:
        if "image" in f.name.lower():
            return f.name
    raise ValueError("no image column in the shard")


def image_bytes(df: DataFrame, name: str | None = None) -> Column:
    """The encoded bytes of a shard's image column; only that member is read."""
    name = name or find_image_column(df.schema)
    kind = df.schema[name].dataType
    if not isinstance(kind, StructType):
        return F.col(name)
    members = [m for m in ("bytes", "content") if m in kind.names] or [f.name for f in kind.fields if f.dataType.typeName() == "binary"][:1]
    return F.coalesce(*(F.col(f"{name}.{m}") for m in members))


def read_shards(spark: SparkSession, pattern: str) -> DataFrame:
    df = spark.read.parquet(*list_shards(spark, pattern))
    return df.select(image_bytes(df).alias("content"))


def png_bytes(img: np.ndarray) -> bytes:
    """A PNG of a BGR array."""
    h, w = img.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(img[:, :, ::-1]).reshape(h, w * 3)], axis=1)

    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + part(
        b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    ) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"


def decoded(df: DataFrame, content: str = "content", drop_invalid: bool = True) -> DataFrame:
    """df with an image struct of the encoded bytes (JPEG, PNG and whatever else the JVM reads).

    The JVM's image reader takes files only, so each distinct content is written once to the shared folder, named by its
    digest, and read back by that reader. Rows that cannot be decoded are dropped, or kept with a null image for counting.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "encoded")
    digest = F.sha2(content, 256)
    once = df.where(F.col(content).isNotNull()).select(digest.alias("digest"), F.col(content).alias("content")).dropDuplicates(["digest"])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, data in zip(b.column("digest").to_pylist(), b.column("content")):
                fs.create_dir(f"{base}/{name[:2]}", recursive=True)
                with fs.open_output_stream(f"{base}/{name[:2]}/{name}.img", compression=None) as out:
                    out.write(data.as_buffer())  # a repeated task writes the same bytes
            yield pa.RecordBatch.from_arrays([b.column("digest")], names=["digest"])

    staged = written(once.mapInArrow(stage, "digest string"), "staged")
    if staged.isEmpty():
        found = spark.createDataFrame([], f"_digest string, image struct<{IMAGE.replace(' ', ':')}>".replace(",:", ","))
    else:
        read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(folder)
        found = read.select(F.regexp_extract("image.origin", r"([0-9a-f]{64})\.img$", 1).alias("_digest"), "image")
    rows = df.withColumn("_key", digest).join(found, F.col("_key") == F.col("_digest"), "inner" if drop_invalid else "left")
    return rows.select(*df.columns, "image")


def decode_report(rows: DataFrame) -> DataFrame:
    """total, decoded, undecodable of rows decoded with drop_invalid=False."""
    bad = F.count_if(F.col("image").isNull())
    return rows.agg(F.count("*").alias("total"), (F.count("*") - bad).alias("decoded"), bad.alias("undecodable"))


class _Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]) -> None:
        self.moves = moves


class _PngWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(self.path)
        moves = []
        for row in rows:
            img = pixels(row.image.asDict())
            if img is None:
                continue
            final = f"{base}/{row.file}"
            temp = f"{os.path.dirname(final)}/.{os.path.basename(final)}.{TaskContext.get().taskAttemptId()}"
            fs.create_dir(os.path.dirname(final), recursive=True)
            with fs.open_output_stream(temp) as out:
                out.write(png_bytes(img))
            moves.append((temp, final))
        return _Written(moves)

    def commit(self, messages) -> None:
        fs = pafs.FileSystem.from_uri(self.path)[0]
        for m in messages:
            for temp, final in m.moves:
                fs.move(temp, final)

    def abort(self, messages) -> None:
        fs = pafs.FileSystem.from_uri(self.path)[0]
        for m in messages:
            for temp, _ in m.moves if m else []:
                fs.delete_file(temp)


class PngSink(DataSource):
    """df.write.format("png_files"): rows (file, image) as PNG files below path; names appear when the job commits."""

    @classmethod
    def name(cls) -> str:
        return "png_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PngWriter(self.options["path"])


class _Stack(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.every = options["path"], int(options.get("every", 30))

    def _open(self) -> np.ndarray:
        fs, inside = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(inside) as f:
            return np.load(io.BytesIO(f.read()), allow_pickle=False)

    def partitions(self) -> list[_Stack]:
        n = len(self._open())
        return [_Stack(i, min(n, i + 256)) for i in range(0, n, 256)] or [_Stack(0, 0)]

    def read(self, part: _Stack):
        frames = self._open()
        for i in range(part.first, part.last):
            if i % self.every == 0:
                img = np.ascontiguousarray(frames[i])
                yield i, (self.path, img.shape[0], img.shape[1], 3, 16, img.tobytes())


class FrameSource(DataSource):
    """spark.read.format("frames"): every n-th frame of a NumPy stack (n x height x width x 3, BGR) at path."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "fid long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FrameReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PngSink)
    spark.dataSource.register(FrameSource)
