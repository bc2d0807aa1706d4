"""Sharding by extendible hashing, with DataFrame operations only.

A row's key is hashed to a string of bits; a directory entry is a prefix of it. All rows begin in the bucket of the empty
prefix, and only a bucket over the byte limit splits on its next bit, until every bucket fits. Which buckets split follows
from the bytes below each prefix, so rows are read once to sum bytes by a prefix of `step` bits, and the directory is
worked out on those sums; a bucket that still does not fit there is taken on by another round over its own rows alone.

The bits are 60 of the key's MD5, then 60 of the MD5 of key and row number, so that a key with many rows can be split too.
A bucket of a single row is never split, however long the row: it is the one kind of shard that can be over the limit. A
shard is named p and its bits, so that no reader takes the name for a number or for nothing.

Defined results: a null key is a key of its own, null and empty texts have no bytes, repeated rows share all key bits and
are told apart by their number. Other columns are not read. An empty table gives no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.llm.common import new_folder, numbered, saved, table

LIMIT_BYTES = 64 << 20
#: The limit of the registered query: small, so that buckets split on small tables too.
QUERY_LIMIT = 512 << 10
#: Prefixes in a directory that is small enough to be sent to every task, at about 60 bytes each; a larger one is joined.
FEW_CELLS = 500_000
_DEPTH = 120


def _bits(text: Column) -> Column:
    """60 bits of the MD5 as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(text), 1, 15), 16, 2), 60, "0")


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, bool]:
    """_cell, depth, shard_bytes of the cells (prefixes of high bits) in buckets that fit, and whether all cells are.

    A bucket is a prefix of low bits or more that fits and whose parent does not.
    """
    cells = rows.groupBy(F.substring("_bits", 1, high).alias("_cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    cells = saved(cells, "cells")
    levels = cells.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high))))
    levels = levels.withColumn("p", F.substring("_cell", F.lit(1), F.col("d")))
    sums = saved(levels.groupBy("d", "p").agg(F.sum("b").alias("bytes"), F.sum("n").alias("rows")), "prefixes")
    fits = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("d") == _DEPTH)
    split = sums.where(~fits).select((F.col("d") + 1).alias("d"), F.col("p").alias("parent"))
    below = sums.where(fits & (F.col("d") > low)).withColumn("parent", F.substring("p", F.lit(1), F.col("d") - 1))
    leaves = below.join(split, ["d", "parent"], "left_semi").select("d", "p", "bytes")
    leaves = saved(leaves.union(sums.where(fits & (F.col("d") == low)).select("d", "p", "bytes")), "leaves")
    directory = levels.join(leaves, ["d", "p"]).select("_cell", F.col("d").alias("depth"), F.col("bytes").alias("shard_bytes"))
    directory = saved(directory, "directory")
    return directory, cells.count() == directory.count()


def shards(df: DataFrame, key: Column, size: Column, keep: tuple[str, ...], limit: int = LIMIT_BYTES) -> DataFrame:
    """The kept columns, n_bytes, shard (p and its prefix of bits), depth and shard_bytes.

    df is read twice, for the sums and for the result; what is kept is not written in between.
    """
    name = F.coalesce(key.cast("string"), F.lit("null")).alias("_key")
    own = numbered(df.select(*keep, name, F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes")))
    bits = F.concat(_bits(F.encode("_key", "utf-8")), _bits(F.encode(F.concat_ws(":", "_key", "row.file", "row.at"), "utf-8")))
    rows = own.select(*keep, "n_bytes", "row", bits.alias("_bits"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    step = max(4, (total // limit).bit_length() + 4)
    shard = F.concat(F.lit("p"), F.substring("_bits", F.lit(1), F.col("depth"))).alias("shard")
    found = [shard, "depth", "shard_bytes"]

    directory, whole = _directory(rows, 0, step, limit)
    few = directory.count() <= FEW_CELLS
    met = rows.withColumn("_cell", F.substring("_bits", 1, step)).join(F.broadcast(directory) if few else directory, "_cell", "left")
    out = met.where("depth is not null").select(*keep, "n_bytes", *found)
    if whole:
        return out
    # buckets deeper than that, as of keys with very many rows: rounds over their rows without what is kept
    deep = met.where("depth is null").drop("depth", "shard_bytes")
    pending, low, rest = saved(deep.select("row", "n_bytes", "_bits"), "pending"), step, None
    while not whole:
        high = min(low + step, _DEPTH)
        directory, whole = _directory(pending, low, high, limit)
        cut = pending.withColumn("_cell", F.substring("_bits", 1, high)).join(directory, "_cell", "left")
        done = cut.where("depth is not null").select("row", *found)
        rest = done if rest is None else rest.unionByName(done)
        if not whole:
            pending, low = saved(cut.where("depth is null").select(*pending.columns), "pending"), high
    return out.unionByName(deep.join(rest, "row").select(*keep, "n_bytes", "shard", "depth", "shard_bytes"))


def write_shards(df: DataFrame, key: Column, path: str, limit: int = LIMIT_BYTES) -> None:
    """Writes (doc_id, text) rows below path, a folder per shard, each from one task."""
    docs = shards(df, key, F.octet_length("text"), ("doc_id", "text"), limit)
    docs.select("doc_id", "text", "shard").repartition("shard").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, shard as written."""
    return spark.read.schema("doc_id long, text string, shard string").parquet(path)


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of documents, reads them back and gives each document's, with the bytes read from it."""
    path = new_folder(spark, "shards")
    write_shards(table(spark, sf_dir, "documents", "doc_id", "text"), F.col("doc_id"), path, QUERY_LIMIT)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    docs = read_shards(spark, path).select("doc_id", size, "shard", (F.length("shard") - 1).alias("depth"))
    sums = docs.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return docs.join(sums, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::UBIGINT AS h FROM documents),
l AS (SELECT *, unnest(range(0, 31))::INTEGER AS depth FROM d),
p AS (SELECT *, substr(lpad(bin(h), 60, '0'), 1, depth) AS prefix FROM l),
s AS (SELECT *, sum(n_bytes) OVER w AS b, count(*) OVER w AS c FROM p WINDOW w AS (PARTITION BY depth, prefix)),
f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY depth) AS rn FROM s WHERE b <= 524288 OR c = 1)
SELECT doc_id, n_bytes, 'p' || prefix AS shard, depth, b::BIGINT AS shard_bytes FROM f WHERE rn = 1
"""
