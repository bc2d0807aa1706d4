"""Annotation sheets: JSON lines, CSV, or text with a header, in tabs or commas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.functions.expressions import split_labels

#: Files that a protection tool has encrypted begin so.
PROTECTED = b"%TSD-Header"
BOM = "﻿"


def check_readable(spark: SparkSession, path: str) -> None:
    """Looks at the first bytes of each file; sheets are files that people fill in, so there are few, but they may be long."""
    for row in spark.read.format("binaryFile").load(path).select("path").toLocalIterator():  # contents are not read
        file = spark._jvm.org.apache.hadoop.fs.Path(row.path)
        stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
        head = bytes(stream.readNBytes(len(PROTECTED)))
        stream.close()
        if head == PROTECTED:
            raise ValueError(f"{row.path} is encrypted by a protection tool")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings (lists stay lists in JSON) with seq, which orders rows by file name and place in the file."""
    check_readable(spark, path)
    lower = path.lower()
    if lower.endswith(".jsonl"):
        rows = spark.read.json(path)
    else:
        separator = ","
        if lower.endswith(".txt"):
            first = spark.read.text(path).limit(1).collect()
            separator = "\t" if first and "\t" in first[0].value else ","
        rows = spark.read.option("header", True).option("sep", separator).csv(path)
    # splits are packed by size, so ids follow the order of rows in one split alone
    seq = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("seq")
    return rows.select(*(F.col(f"`{c}`").alias(c.lstrip(BOM).strip()) for c in rows.columns), seq)


def _labels(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.array().cast("array<string>")
    if df.schema[name].dataType.typeName() == "array":
        return F.coalesce(
            F.filter(F.transform(F.col(name).cast("array<string>"), lambda x: F.trim(x)), lambda x: x != ""),
            F.array().cast("array<string>"),
        )
    return split_labels(F.col(name))


def single_rows(df: DataFrame, name: str = "labels") -> DataFrame:
    """seq, file, labels; file is trimmed, rows without one are skipped, repeats stay."""
    return df.select("seq", F.trim("file").alias("file"), _labels(df, name).alias("labels")).where(F.coalesce("file", F.lit("")) != "")


def read_single(spark: SparkSession, path: str) -> DataFrame:
    """file, labels: the last row of each file wins."""
    return single_rows(read_rows(spark, path)).groupBy("file").agg(F.max_by("labels", "seq").alias("labels"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """file, annotator1, annotator2 of a merged sheet."""
    rows = read_rows(spark, path)
    return rows.select(
        F.trim("file").alias("file"), *(_labels(rows, f"annotator{i}").alias(f"annotator{i}") for i in (1, 2))
    ).where(F.coalesce("file", F.lit("")) != "")
