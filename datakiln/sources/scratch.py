"""Written intermediate tables: in the folder that all executors share, spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; in local runs without the setting, in a temporary one that goes when Python ends."""
    app = spark.sparkContext.applicationId
    top = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(app)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="datakiln-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        top = _OWN[app] = f"file://{top}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{name}-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet and read back: it cuts lineage, is computed once and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def _path(spark: SparkSession, path: str):
    """The path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        p, system = _path(table.sparkSession, table.written_path)
        system.delete(p, True)


def is_there(spark: SparkSession, path: str) -> bool:
    p, system = _path(spark, path)
    return system.exists(p)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    p, system = _path(spark, path)
    system.create(p, True).close()
