"""Ranked lexical search: an inverted index in document shards, searched with WAND.

One pass over the texts writes the index. A shard holds the documents that one task read in a row, up to SHARD_DOCUMENTS of
them or SHARD_POSTINGS entries, in order of doc_id; of each term it has the documents and frequencies and, for each
frequency, the least length of a document with it. From these the greatest impact of a term in a shard follows exactly,
whatever the corpus counts are. So the index depends on nothing but the texts, and no text is read twice.

Items are searched in blocks of about BLOCK_TERMS terms. Only postings of terms that items hold leave the index, once for each block
that asks for them. A task has one shard and one block and goes through each item's documents in order. A document is a pivot
if the greatest impacts of the terms that hold it add up to more than the least score of the item's heap; pivots are
scored, the rest is skipped (pivots are selected for a window of documents at once, see wand). Heaps hold ten rows; the last
step merges those of all shards.

Defined results: null texts and texts without a term are no documents; an item without a term, or whose terms no document holds,
has no row. Rows with a null doc_id are documents and rank behind equal scores. Repeated documents each rank, repeated
items are each ranked by themselves. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datakiln.llm.common import numbered, saved, steps, table

K = 10
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents and postings a shard has at most (a longer document is a shard of its own), terms of a block of items.
SHARD_DOCUMENTS, SHARD_POSTINGS, BLOCK_TERMS = 65_536, 1 << 21, 50_000
#: Terms of items that are broadcast at most; above, the index is joined by a shuffle.
FEW_TERMS = 200_000
#: Terms of the index written in one batch.
BATCH = 1 << 14
INDEX = "shard long, term string, df long, total long, at binary, tf binary, peaks binary"
#: Within a term, letters stay and A-Z are lower-cased; what parts terms is a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Documents in the first and the widest window.
FIRST_WINDOW, LAST_WINDOW = 256, 8192


def term_counts(text: str | None) -> Counter:
    """The terms of a text, as bytes, with how often each occurs."""
    return Counter((text or "").encode().translate(_BYTES).split())


def _binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """An array of binaries: values cut at starts."""
    ends = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


class Shard:
    """Documents that are collected for a shard of the index."""

    def __init__(self) -> None:
        self.ids, self.known, self.lengths, self.numbers = [], [], [], {}
        self.terms, self.counts, self.sizes = [], [], []
        self.postings = 0

    def add(self, doc_id: int | None, counts: Counter) -> None:
        numbers = self.numbers
        self.terms.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), dtype=np.int64, count=len(counts)))
        self.counts.append(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))
        self.lengths.append(int(self.counts[-1].sum()))
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.postings += len(counts)

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's row of documents (without a term), then a row for each term."""
        ids, known, n = np.array(self.ids, dtype=np.int64), np.array(self.known), np.array(self.lengths, dtype=np.int64)
        order = np.lexsort((ids, ~known))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        row = [[shard], pa.nulls(1, pa.string()), [len(n)], [int(n.sum())], one(ids[order]), one(n[order]), one(known[order].astype(np.int64))]
        names = [x.split()[0] for x in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in row], names=names)
        term, tf = np.concatenate(self.terms), np.concatenate(self.counts)
        at = np.repeat(place, [len(t) for t in self.terms])
        length = np.repeat(n, [len(t) for t in self.terms])
        by_place, by_peak = np.lexsort((at, term)), np.lexsort((length, tf, term))
        starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.numbers)))))
        at, tf_at = at[by_place].astype("<i4"), tf[by_place].astype("<i4")
        term, tf, length = term[by_peak], tf[by_peak], length[by_peak]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))))
        peaks = np.stack([tf[first], length[first]], axis=1).ravel().astype("<i8")
        peak_starts = 2 * np.concatenate(([0], np.cumsum(np.bincount(term[first], minlength=len(self.numbers)))))
        words = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        for a in range(0, len(words), BATCH):
            b = min(a + BATCH, len(words))
            s, p = starts[a : b + 1], peak_starts[a : b + 1]
            columns = [
                pa.array(np.full(b - a, shard)), words[a:b], pa.array(np.diff(s)), pa.nulls(b - a, pa.int64()),
                _binaries(at[s[0] : s[-1]], s - s[0]), _binaries(tf_at[s[0] : s[-1]], s - s[0]), _binaries(peaks[p[0] : p[-1]], p - p[0]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def index(docs: DataFrame) -> DataFrame:
    """The index of (doc_id, text), written: shard, term, df and its postings.

    at: places of documents in the shard; tf: how often each has the term; peaks: pairs of a frequency and the least length
    of a document with it. A row without a term has the shard's documents: df and total, how many and their length; at,
    tf, peaks: their ids, lengths, and 0 where the id is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in steps(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    counts = term_counts(text)
                    if not counts:
                        continue
                    if shard.ids and (len(shard.ids) >= SHARD_DOCUMENTS or shard.postings + len(counts) > SHARD_POSTINGS):
                        yield from shard.batches(number)
                        shard, number = Shard(), number + 1
                    shard.add(doc_id, counts)
        if shard.ids:
            yield from shard.batches(number)

    return saved(docs.select("doc_id", "text").mapInArrow(run, INDEX), "term-index", compression="zstd")


def item_terms(items: DataFrame) -> DataFrame:
    """row, item_id, term, qtf of the items (item_id, text)."""
    words = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term")
    return numbered(items.select("item_id", "text")).select("row", "item_id", words).groupBy("row", "item_id", "term").agg(
        F.count("*").alias("qtf")
    )


@dataclass
class Postings:
    """A term of an item in a shard: its documents in ascending order, frequencies, weight and greatest score."""

    docs: np.ndarray
    tf: np.ndarray
    weight: int
    most: int


def _found(docs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are among docs, and where."""
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    hit = docs[at] == wanted if len(docs) else np.zeros(len(wanted), dtype=bool)
    return hit, at[hit]


def wand(lists: list[Postings], m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores over 0 and documents of the k best, and how many documents were scored. m: each document's length norm.

    Documents come in ascending order, in windows that grow; pivots are selected for a window at once. With the terms by
    falling greatest score, those whose sums with all that follow don't beat the heap's least score can't bring a document in
    by themselves: only the documents of the terms before them are looked at. The other terms are then looked up one by
    one, and a document goes as soon as the greatest scores of the terms it holds and of those left don't beat the heap.
    What is left are the pivots, which are scored. One that only equals the least score of a full heap is behind it.
    """
    lists = sorted(lists, key=lambda x: -x.most)
    most = np.array([x.most for x in lists])
    left = np.concatenate((np.cumsum(most[::-1])[::-1], [0]))
    best, at, least, scored, low, wide = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, 0, FIRST_WINDOW
    starts = [0] * len(lists)
    while low < len(m):
        few = int((left[:-1] > least).sum())
        if not few:
            break
        high = min(low + wide, len(m))
        ends = [s + int(np.searchsorted(x.docs[s : s + wide], high)) for s, x in zip(starts, lists)]
        bound = np.zeros(high - low, dtype=np.int64)
        for x, a, b in zip(lists[:few], starts, ends):
            bound[x.docs[a:b] - low] += x.most
        pivots = np.flatnonzero(bound)
        pivots = pivots[bound[pivots] + left[few] > least]
        for i in range(few, len(lists)):
            hit, _ = _found(lists[i].docs[starts[i] : ends[i]], pivots + low)
            bound[pivots[hit]] += lists[i].most
            pivots = pivots[bound[pivots] + left[i + 1] > least]
        scores, places = np.zeros(len(pivots), dtype=np.int64), pivots + low
        for x, a, b in zip(lists, starts, ends):
            hit, where = _found(x.docs[a:b], places)
            tf = x.tf[a:b][where].astype(np.int64)
            scores[hit] += x.weight * (1_000_000_000 * tf // (1000 * tf + 8 * m[places[hit]]))
        scored += len(pivots)
        beats = scores > least
        best, at = np.concatenate((best, scores[beats])), np.concatenate((at, places[beats]))
        order = np.lexsort((at, -best))[:k]
        best, at = best[order], at[order]
        least = int(best[-1]) if len(best) == k else 0
        low, wide, starts = high, min(2 * wide, LAST_WINDOW), ends
    return best, at, scored


def length_norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A document's m, from its length and the corpus counts."""
    return 25 + 75 * n * documents // terms


def shard_heaps(rows: pd.DataFrame, documents: int, terms: int, k: int) -> pd.DataFrame:
    """item, doc_id, score of each item's best documents in a shard.

    rows: the shard's row of documents and rows of terms, with weight, the term's w, and asked: (item, qtf) of its items.
    """
    plain = rows.term.isna()
    about = rows[plain].iloc[0]
    ids, n, known = (np.frombuffer(about[c], "<i8") for c in ("at", "tf", "peaks"))
    m = length_norms(n, documents, terms)
    items: dict[int, list[Postings]] = {}
    for r in rows[~plain].itertuples():
        peaks = np.frombuffer(r.peaks, "<i8").reshape(-1, 2)
        most = int((1_000_000_000 * peaks[:, 0] // (1000 * peaks[:, 0] + 8 * length_norms(peaks[:, 1], documents, terms))).max())
        docs, tf = (np.frombuffer(x, "<i4") for x in (r.at, r.tf))
        for a in r.asked:
            w = int(r.weight) * int(a["qtf"])
            if w:
                items.setdefault(a["item"], []).append(Postings(docs, tf, w, w * most))
    heaps = [wand(lists, m, k)[:2] for lists in items.values()]
    none = np.zeros(0, np.int64)
    score, place = (np.concatenate([none, *c]) for c in zip(*heaps)) if heaps else (none, none)
    item = np.repeat(np.array(list(items), dtype=np.int64), [len(h[0]) for h in heaps])
    doc_id = pd.array(ids[place], dtype="Int64")
    doc_id[known[place] == 0] = pd.NA
    return pd.DataFrame({"item": item, "doc_id": doc_id, "score": score})


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    built = index(docs)
    documents, terms = built.where("term IS NULL").agg(F.sum("df"), F.sum("total")).first()
    asked = saved(item_terms(items), "item-terms")
    n = asked.count()
    items = saved(asked.select("row", "item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    block = F.pmod(F.xxhash64("row"), F.lit(-(-n // BLOCK_TERMS) or 1)).alias("block")
    of_item = asked.join(items.select("row", "item"), "row")
    wanted = saved(of_item.groupBy(block, "term").agg(F.collect_list(F.struct("item", "qtf")).alias("asked")), "wanted")
    hint = F.broadcast if n <= FEW_TERMS else (lambda df: df)
    postings = built.where("term IS NOT NULL").join(hint(wanted.select("term").distinct()), "term", "left_semi")
    df = postings.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents or 0) + 2) / (2 * F.col("df") + 1))).alias("weight")
    weighed = saved(wanted.join(df.select("term", weight), "term"), "weights")
    found = built.where("term IS NOT NULL").join(hint(weighed), "term").select(*built.columns, "block", "weight", "asked")
    shards = built.where("term IS NULL").crossJoin(F.broadcast(weighed.select("block").distinct()))
    none = F.lit(None)
    kinds = weighed.schema
    shards = shards.select(*built.columns, "block", none.cast("long").alias("weight"), none.cast(kinds["asked"].dataType).alias("asked"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return shard_heaps(pdf, documents, terms, k)

    heaps = shards.union(found).groupBy("shard", "block").applyInPandas(run, "item long, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    merged = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return search(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


OP11_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
      unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents),
p AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
d AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
q AS (SELECT i, item_id, term, count(*)::BIGINT AS qtf FROM (SELECT row_number() OVER () AS i, item_id,
      unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(qtf * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (r) CROSS JOIN c GROUP BY ALL),
k AS (SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST))::INT AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {K}
"""
