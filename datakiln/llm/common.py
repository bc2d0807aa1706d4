"""Shared plumbing of the corpus operators: tables, the shared folder, written checkpoints, running totals."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts handed to one vectorised step; keeps working memory flat whatever the Arrow batch holds.
STEP_BYTES = 8 << 20
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, cut to the columns an operator needs, so extra columns never clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir); a temporary one only where the setting is absent, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='datakiln-')}"
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        _OWN[spark.sparkContext.applicationId] = found
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return f"file://{full[5:]}" if re.match("file:/[^/]", full) else full


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_path = path
    return back


def numbered(df: DataFrame) -> DataFrame:
    """df with row, a name that stays the same however often and in whatever parts df is read.

    Rows read from files are named by a 64-bit hash of the file's path, of which there are at most some millions, and the
    place in the file, so no two rows share a name; other rows are numbered and written first.
    """
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    if any(hidden.apply(i).name() == "_metadata" for i in range(hidden.size())):
        file, at = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
        return df.select("*", F.struct(file.alias("file"), at.alias("at")).alias("row"))
    here = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return saved(df.withColumn("row", here), "numbered", compression="zstd")


def in_pieces(members: DataFrame, sizes: DataFrame, at: list[str], key: str, limit: int) -> DataFrame:
    """members joined with sizes (at, size) and repeated so that two members of a group meet whatever its size.

    A group of more than limit members is cut into pieces of about limit by a hash of key. Adds pieces, own (the row's
    piece) and other (each piece it is to meet).
    """
    pieces = F.ceil(F.col("size") / limit).cast("int").alias("pieces")
    own = F.pmod(F.xxhash64(key, F.lit(7)), F.col("pieces")).cast("int").alias("own")
    met = members.join(sizes.select(*at, pieces), at).select(*members.columns, "pieces", own)
    return met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing will read again."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch of about limit bytes in the column; one longer value makes a slice of its own."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist() if batch.num_rows else []
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if i > first and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if lengths:
        yield batch.slice(first)
