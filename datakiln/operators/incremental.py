"""Near duplicates of a manifest that grows: kept components, to which a batch adds only what it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from datakiln.operators import dedup as D
from datakiln.sources import scratch


class DedupStore:
    """Components of near samples of different origins, kept in a folder that all executors share.

    Every batch has a folder of its own, which counts from the moment its empty file DONE is there:

        units/  h, o, root: the units (hash and origin, see dedup.unit_links) that the batch brought, with their roots then;
                null if nothing was near
        index/  b, i, key: the hashes that it brought, under the substrings of their bits
        moves/  old, root: the roots and single units of earlier batches that were linked since, with their root now

    A batch looks its own keys up in the index, links the units of the hashes it met, and finds components among the new
    units and the roots of the old ones. Labels of old units are never written again: moves redirects their roots, and the
    one table that is copied from batch to batch has a row for a component that grew. A root is the least unit
    of its component, so the classes and roots are those of a single run over all rows, whatever the batches.

    Defined results: rows with a null hash take no part; a null origin is an origin like others; repeated rows, and batches
    whose number is already done, change nothing; empty batches are fine. Other columns are not read. Batches are numbered
    from 0 and added in order by one writer; one that failed is added again under its number and starts over.
    """

    def __init__(
        self, spark: SparkSession, path: str, threshold: int = 4, expected: int = 10**7, origin: str = "origin_id",
        value: str = "phash", origin_type: DataType | None = None,
    ) -> None:
        """expected is about how many hashes the store will hold; the substrings follow it, any number is right."""
        self.spark, self.path, self.threshold, self.origin, self.value = spark, path, threshold, origin, value
        self.subs = D.substrings(expected, threshold)
        inner = StructType.fromDDL("none boolean").add(StructField("origin", origin_type or StringType()))
        unit = StructType.fromDDL("h long").add("o", inner)
        self.schemas = {
            "units": unit.add("root", StructType(unit.fields[:2])),
            "index": StructType.fromDDL("b long, i int, key long"),
            "moves": StructType().add("old", StructType(unit.fields[:2])).add("root", StructType(unit.fields[:2])),
        }

    def _read(self, name: str, batches: list[int] | range) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*(f"{self.path}/batch={i}/{name}" for i in batches))

    def done(self) -> int:
        """How many batches are in the store."""
        n = 0
        while scratch.is_there(self.spark, f"{self.path}/batch={n}/DONE"):
            n += 1
        return n

    def _moved(self, units: DataFrame, done: int) -> DataFrame:
        """Units with their present roots."""
        moves = self._read("moves", [done - 1] if done else []).withColumnRenamed("root", "now")
        found = units.join(D.shuffled(moves), F.coalesce("root", F.struct("h", "o")) == F.col("old"), "left")
        return found.select("h", "o", F.coalesce("now", "root").alias("root"))

    def roots(self) -> DataFrame:
        """h, o, root of the units that are linked with others."""
        done = self.done()
        return self._moved(self._read("units", range(done)), done).where("root is not null")

    def n_units(self) -> int:
        return self._read("units", range(self.done())).count()

    def add(self, rows: DataFrame, batch: int) -> None:
        done = self.done()
        if batch < done:
            return
        if batch > done:
            raise ValueError(f"batch {batch} comes before batch {done}")
        folder, stored = f"{self.path}/batch={batch}", self._read("units", range(done))
        own = rows.where(F.col(self.value).isNotNull()).select(*D.unit_of(self.value, self.origin))
        own = scratch.written(own.distinct().select(*(F.col(f.name).cast(f.dataType) for f in self.schemas["units"].fields[:2])))
        hashes = scratch.written(own.select("h").distinct())
        # written tables have known sizes: small batches are broadcast by the planner; large ones never, as they would pass the driver
        n = own.count()
        apart = lambda df: D.shuffled(df, n)
        old = scratch.written(stored.join(apart(hashes), "h", "left_semi"))
        new = scratch.written(own.join(apart(old.select("h", "o")), ["h", "o"], "left_anti"))
        touched = scratch.written(new.select("h").distinct())
        fresh = touched.join(apart(old.select("h").distinct()), "h", "left_anti")
        D.indexed(fresh, self.subs).write.mode("overwrite").parquet(f"{folder}/index")
        index = self._read("index", range(batch + 1))
        probing = scratch.written(D.probes(touched, self.subs))
        met = D.met_pairs(probing, index, self.subs, self.threshold, n)
        pairs = scratch.written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        # the units of touched hashes and of those that they met, with their present roots
        partners = pairs.select(F.explode(F.array("a", "b")).alias("h")).union(touched).distinct()
        before = self._moved(stored.join(apart(partners), "h", "left_semi"), done)
        units = before.unionByName(new.select("h", "o", F.lit(None).alias("root")))
        units = scratch.written(units.withColumn("root", F.coalesce("root", F.struct("h", "o"))))
        firsts = units.groupBy("h").agg(F.min("o").alias("first"), F.max("o").alias("last"))
        inside = units.join(apart(touched), "h", "left_semi").select("h", "o")
        links = D.links_of(inside, firsts, pairs)
        root = units.select(F.struct("h", "o").alias("unit"), "root")
        left, right = (apart(root.select(F.col("unit").alias(x), F.col("root").alias(f"r{x}"))) for x in "uv")
        classes = scratch.written(D.components(links.join(left, "u").join(right, "v"), "ru", "rv"))
        moved = classes.where(F.col("node") != F.col("root"))
        labelled = new.join(apart(classes), F.struct("h", "o") == F.col("node"), "left")
        labelled.select("h", "o", "root").write.mode("overwrite").parquet(f"{folder}/units")
        earlier = self._read("moves", [done - 1] if done else []).withColumnRenamed("root", "via")
        redirected = earlier.join(apart(moved), F.col("via") == F.col("node"), "left").select("old", F.coalesce("root", "via").alias("root"))
        merged = classes.join(apart(new), F.col("node") == F.struct("h", "o"), "left_anti").select(F.col("node").alias("old"), "root")
        merged = merged.join(D.shuffled(earlier.select("old")), "old", "left_anti")
        redirected.unionByName(merged).write.mode("overwrite").parquet(f"{folder}/moves")
        scratch.mark(self.spark, f"{folder}/DONE")
        scratch.removed(own, hashes, old, new, touched, probing, pairs, units, classes)

    def marked(self, df: DataFrame, key: str = "file", source: str = "source") -> DataFrame:
        """df with dedup_removed and dedup_reason by the components in the store, which must hold its rows."""
        return D.keepers(df, D.sample_roots(df, self.roots(), key, self.origin, self.value), key, source)

    def follow(self, stream: DataFrame, checkpoint: str):
        """A query that adds what a stream of rows has and stops; a restart goes on from the checkpoint."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
