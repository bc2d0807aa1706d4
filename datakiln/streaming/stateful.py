"""Ingestion and collection as stateful streams: what is known and how far the quotas are filled lives in the state store.

Each batch touches the state of its own keys only; no batch reads the manifest. State is versioned with the checkpoint and
the file sink commits by batch, so a query that is stopped anywhere and started again on the same checkpoint goes on as if
it had not been stopped. The state store is RocksDB: state may be larger than memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from datakiln.sources.manifest import MANIFEST

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINE = "file string, seq long, line string"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return session


class FirstOfName(StatefulProcessor):
    """The first line of a name, once: by seq within a batch, by arrival between batches."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            best = part.sort_values("seq", kind="stable", na_position="last").iloc[:1]
            if first is None or best.seq.iloc[0] < first.seq.iloc[0] or pd.isna(first.seq.iloc[0]) and not pd.isna(best.seq.iloc[0]):
                first = best
        if first is not None and not self.known.exists():
            self.known.update((0 if pd.isna(first.seq.iloc[0]) else int(first.seq.iloc[0]),))
            yield first[["file", "seq", "line"]]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if not self.known.exists():
            self.known.update((0,))

    def close(self) -> None:
        pass


def first_lines(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The stream of (file, seq, line) with one line for each file name; names in known (file) have had theirs."""
    start = known.select("file").distinct().groupBy("file") if known is not None else None
    return lines.groupBy("file").transformWithStateInPandas(FirstOfName(), LINE, "Append", "None", start)


def ingest_lines(
    spark: SparkSession, incoming: str, out: str, checkpoint: str, schema: StructType = MANIFEST, manifest: str | None = None, files: int = 1000
):
    """A query that appends what has come in, each file name once, to the folder out, and stops.

    manifest: a Parquet manifest whose names count as known when the query starts for the first time. Lines that are not
    JSON or name no file are left out.
    """
    session = stateful_session(spark)
    text = session.readStream.option("maxFilesPerTrigger", files).text(incoming)
    named = text.select(F.get_json_object("value", "$.file").alias("file"), F.get_json_object("value", "$.seq").cast("long").alias("seq"), F.col("value").alias("line"))
    known = session.read.schema("file string").parquet(manifest) if manifest else None
    rows = first_lines(named.where("file IS NOT NULL"), known).select(F.from_json("line", schema).alias("row")).select("row.*")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Quotas(StatefulProcessor):
    """Takes frames of a collection in order while the quota for nights or the other one is open."""

    def __init__(self, num: int, night_quota: int) -> None:
        self.num, self.night_quota = num, night_quota

    def init(self, handle) -> None:
        self.taken = handle.getValueState("taken", "nights long, normals long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        nights, normals = self.taken.get() or (0, 0)
        open_nights, open_normals = self.night_quota - nights, self.num - normals
        if open_nights <= 0 and open_normals <= 0:
            return
        # of each kind no more rows can count than the quotas still take
        most = open_nights, open_nights + open_normals
        heads = [], []
        for row in rows:
            found = row.seq, bool(row.night_ok), bool(row.normal_ok)
            for head, wanted, n in zip(heads, found[1:], most):
                if wanted:
                    head.append(found)
                    if len(head) > 4 * n + 1000:
                        head[:] = _first(head, n)
        once = {}
        for head, n in zip(heads, most):
            for found in _first(head, n):
                once.setdefault(found[0], found)
        before = nights, normals
        for seq, night, normal in _first(once.values(), len(once)):
            idx = nights + normals
            if night and nights < self.night_quota:
                nights += 1
                yield Row(collection=key[0], seq=seq, kind="night", idx=idx)
            elif normal and normals < self.num:
                normals += 1
                yield Row(collection=key[0], seq=seq, kind="normal", idx=idx)
        if (nights, normals) != before:
            self.taken.update((nights, normals))

    def close(self) -> None:
        pass


def _first(found: Iterable[tuple], n: int) -> list[tuple]:
    """The n of (seq, night, normal) that come first by seq, those without one last."""
    return sorted(found, key=lambda x: (x[0] is None, x[0]))[: max(n, 0)]


def collect_stream(frames: DataFrame, num: int, night_quota: int) -> DataFrame:
    """collection, seq, kind, idx of the frames that a scan in order takes, as they come in.

    frames: a stream of (collection, seq, night_ok, normal_ok); batches come in seq order, within a batch any order will do.
    Only keys pass the state, and those that no quota could take don't reach it.
    """
    wanted = frames.where(F.coalesce("night_ok", F.lit(False)) | F.coalesce("normal_ok", F.lit(False)))
    keys = wanted.select("collection", "seq", "night_ok", "normal_ok").groupBy("collection")
    # rows, not data frames: a collection has a few rows in a batch, and building frames costs more than they do
    return keys.transformWithState(Quotas(num, night_quota), "collection string, seq long, kind string, idx long", "Append", "None")
