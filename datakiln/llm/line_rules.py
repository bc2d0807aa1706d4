"""Quality rules with cross-document line frequency.

Each text gets base measures (words, symbols, repeated lines and 3-word windows). Its lines are normalised (white space
collapsed, A-Z lower-cased, digits made equal) and hashed; for every host the distinct documents that hold a line are
counted over the whole corpus. A line that MIN_DOCUMENTS of them hold is boilerplate: it is removed, and a document that
loses more than half of its words is depleted and rejected, as is one that fails the base rules.

Documents are distinct if their sequences of normalised lines differ. So copies of a text, also those that differ in white
space, case or digits only, are one document to the count, however many there are: they neither make a line boilerplate nor
save one from it. Near copies that differ in words are documents of their own.

Defined results: a null or empty text has no words, fails the base rules and is not kept. A null host is a host. Rows with
equal or null doc_id are judged apart and each gives a result. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from datakiln.llm.common import DOCUMENT_COLUMNS, numbered, saved, steps, table

MIN_DOCUMENTS = 10
MIN_WORDS, MOST_REPEATED, MOST_REMOVED = 50, 50, 50
_SYMBOLS = b"#*$%&|<>"
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
#: What a text gives, after row, doc_id and host.
FACTS = {
    "copy": pa.int64(),
    **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), pa.int64()),
    "lines": pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())])),
}


def signed(h: int) -> int:
    """An unsigned 64-bit hash moved to the signed range."""
    return h - (1 << 63)


def normalised(line: bytes) -> bytes:
    return b" ".join(line.translate(_NORMAL).split())


def line_hash(line: bytes) -> int | None:
    """Signed 64-bit hash of a normalised line; None if it has no word."""
    normal = normalised(line)
    return signed(xxhash.xxh64_intdigest(normal)) if normal else None


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def measures(text: str | None) -> tuple:
    """The values of FACTS for a text."""
    raw = (text or "").encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    found: dict[int, int] = {}
    exact, order = set(), []
    for line in raw.split(b"\n"):
        normal = normalised(line)
        if normal:
            order.append(normal)
            exact.add(line)
            h = signed(xxhash.xxh64_intdigest(normal))
            found[h] = found.get(h, 0) + normal.count(b" ") + 1
    copy = signed(xxhash.xxh64_intdigest(b"\n".join(order)))
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [{"hash": h, "n": n} for h, n in found.items()]
    return copy, len(words), len(text or "") - spaces, n_symbols, len(order) - len(exact), repeated_words(words), lines


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """row, doc_id, host and FACTS per document, written so that later passes read a few bytes a line.

    docs: row, doc_id, text and the column of the host.
    """
    rows = docs.select("row", "doc_id", F.col(host).cast("string").alias("host"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                columns = zip(*map(measures, part.column("text").to_pylist()))
                values = [pa.array(c, kind) for c, kind in zip(columns, FACTS.values())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *values], names=["row", "doc_id", "host", *FACTS])

    schema = StructType([*rows.schema.fields[:3], *from_arrow_schema(pa.schema(list(FACTS.items()))).fields])
    return saved(rows.mapInArrow(run, schema), "line-facts")


def frequent_lines(facts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """host, hash, n_documents of the lines above the limit. Copies and hot lines shrink before each shuffle."""
    lines = facts.select("host", "copy", F.explode("lines").alias("line")).select("host", "copy", "line.hash")
    counts = lines.groupBy("host", "hash").agg(F.count_distinct("copy").alias("n_documents"))
    return counts.where(F.col("n_documents") >= min_documents)


def judged(facts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """facts with removed_words, the hashes of boilerplate lines, base_failed and kept."""
    # written, so that a hot line can be split in the join
    above = saved(frequent_lines(facts, min_documents).select(F.col("host").alias("h"), "hash"), "frequent")
    lines = facts.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.hash", "line.n")
    met = lines.join(above, lines.host.eqNullSafe(above.h) & (lines.hash == above.hash))
    hit = met.groupBy("row").agg(F.sum("n").alias("removed_words"), F.collect_set(lines.hash).alias("boilerplate"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = facts.drop("lines").join(hit, "row", "left").fillna(0, ["removed_words"]).withColumn("base_failed", base_failed)
    depleted = 100 * F.col("removed_words") > MOST_REMOVED * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_lines(docs: DataFrame, hashed: Callable[[bytes], int | None]) -> DataFrame:
    """docs without the lines whose hash is in the row's array drop; n_chars, if there, follows a changed text. Adds n_dropped."""
    rows = docs.select(*(c for c in docs.columns if c != "drop"), "drop")
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                texts, counts = [], []
                for text, drop in zip(part.column("text").to_pylist(), part.column("drop").to_pylist()):
                    dropped = 0
                    if text is not None and drop:
                        gone, lines = set(drop), text.encode().split(b"\n")
                        left = [x for x in lines if hashed(x) not in gone]
                        dropped = len(lines) - len(left)
                        text = b"\n".join(left).decode()
                    texts.append(text)
                    counts.append(dropped)
                out = {c: part.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in out:
                    old = out["n_chars"].to_pylist()
                    out["n_chars"] = pa.array([len(t) if n else k for t, n, k in zip(texts, counts, old)], pa.int64())
                yield pa.RecordBatch.from_arrays([*out.values(), pa.array(counts, pa.int64())], names=[*names, "n_dropped"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("n_dropped", LongType())]))


def apply_rules(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The kept documents without their boilerplate lines."""
    rows = numbered(docs.select(*DOCUMENT_COLUMNS))
    kept = judged(measured(rows), min_documents).where("kept").select("row", F.col("boilerplate").alias("drop"))
    return without_lines(rows.join(kept, "row"), line_hash).select(*DOCUMENT_COLUMNS)


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source").withColumn("row", F.monotonically_increasing_id())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
    return judged(measured(docs)).select("doc_id", *names)


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 4),
win2 AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM win),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win2) WHERE c > 1),
repw AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
l0 AS (SELECT r, source, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w),
l1 AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lws FROM l0),
l AS (SELECT r, source, line, i, len(lws) AS n, translate(array_to_string(lws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
      'abcdefghijklmnopqrstuvwxyz000000000') AS k FROM l1 WHERE len(lws) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
copies AS (SELECT r, string_agg(k, chr(10) ORDER BY i) AS copy FROM l GROUP BY r),
freq AS (SELECT source, k FROM l JOIN copies USING (r) GROUP BY source, k HAVING count(DISTINCT copy) >= 10),
gone AS (SELECT l.r, sum(n)::BIGINT AS removed_words FROM l JOIN freq ON l.source IS NOT DISTINCT FROM freq.source AND l.k = freq.k GROUP BY l.r),
j AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
      (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN repw USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed_words <= 50 * n_words AS kept
FROM j
"""
