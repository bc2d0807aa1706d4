"""The manifest (one row per sample) and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = (
    "seq long, file string, sha1 string, source string, origin_id string, labels array<string>, params string, scene string, difficulty "
    "string,"
    "width int, height int, mean_lum double, lap_var double, parent_sha1 string, split string, phash string, dedup_removed boolean, "
    "dedup_reason string,"
    "aigc_backend string, eval_longtail boolean, review_status string, defect_override string"
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def load_manifest(spark: SparkSession, path: str, schema: StructType | str = MANIFEST) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the read, an absent path is an empty manifest."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_defaults(df: DataFrame) -> DataFrame:
    """Nulls that stand for a default, and params as VARIANT with the applied order typed."""
    out = df.fillna({"dedup_removed": False, "eval_longtail": False, "review_status": "auto", "scene": "indoor", "split": "unassigned"})
    params = F.try_parse_json("params")
    return out.withColumn("order", F.try_variant_get(params, "$._order", "array<string>")).withColumn("params_variant", params)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def reset_manifest(spark: SparkSession, path: str, schema: StructType | str = MANIFEST) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def write_version(df: DataFrame, path: str, by: str = "split") -> None:
    """A manifest checkpoint as Parquet, parted by split so that readers of one split scan it alone."""
    df.write.mode("errorifexists").partitionBy(by).parquet(path)


def export_manifest_json(df: DataFrame, path: str, one_array: bool = False) -> None:
    """The manifest as JSON lines; with one_array one JSON array in one text file for people, which one task writes."""
    if not one_array:
        df.write.mode("overwrite").json(path)
        return
    last = df.count()
    rows = df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))
    numbered = rows.coalesce(1).withColumn("_n", F.monotonically_increasing_id())
    comma = F.when(F.col("_n") < last - 1, ",").otherwise("")
    opening = F.when(F.col("_n") == 0, "[\n").otherwise("")
    closing = F.when(F.col("_n") == last - 1, "\n]").otherwise("")
    none = df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)
    body = numbered.select(F.concat(opening, "value", comma, closing).alias("value")) if last else none
    body.write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as pretty JSON."""
    df.select(
        F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")
    ).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_eval_set(rows: DataFrame, json_path: str, csv_path: str) -> None:
    """The frozen eval set: JSON lines with a row per file, and the CSV sheet."""
    from datakiln.operators.tables import eval_csv_rows

    rows.write.mode("overwrite").json(json_path)
    eval_csv_rows(rows).write.mode("overwrite").option("header", True).csv(csv_path)


def append_changelog(spark: SparkSession, path: str, version: str, note: str, samples: int, stamp: str) -> None:
    line = f"## {version} ({stamp})\n\n- {note}\n- 样本数: {samples}\n"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def load_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Experiment log: malformed lines and error rows are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where("error is null") if "error" in rows.columns else rows
