"""Sparse multinomial logistic regression on hashed TF-IDF features, shared by language identification and mixing.

Features are hashed with array arithmetic over whole texts. Document frequencies come from all texts that may be learned
from, summed in a tree of tasks. The model is fitted on a bounded sample with the follow-the-regularised-leader update
(FTRL-proximal) and an elastic net, and a temperature is fitted on a part of the sample that the weights have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datakiln.llm.common import saved, steps

Features = Callable[[str], tuple[np.ndarray, np.ndarray]]
#: Labels up to which weights are kept as a whole matrix; above, as sparse rows, as the elastic net leaves most at zero.
DENSE = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def counted(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots in ascending order and how often each is hit, of 64-bit values hashed to 2**bits slots."""
    slots = (hashes * _MIX >> np.uint64(64 - bits)).astype(np.int64)
    if len(slots) * 4 < 1 << bits:
        return np.unique(slots, return_counts=True)
    tally = np.bincount(slots, minlength=1 << bits)
    at = np.flatnonzero(tally)
    return at, tally[at]


class _Letters:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        return cls.table


def char_ngrams(text: str, bits: int, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Character n-grams of 1 to longest of the lower-cased text; what is no letter is one space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _Letters.get()[cp]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.where(letter, cp, 32)
    cp = cp[letter | np.concatenate(([False], letter[:-1]))].astype(np.uint64)
    gram, out = cp, [cp]
    for n in range(2, longest + 1):
        gram = gram[:-1] * np.uint64(0x100000001B3) + cp[n - 1 :] + np.uint64(n << 32)
        out.append(gram)
    return counted(np.concatenate(out), bits)


#: Byte classes: 0 white space, 1 ASCII punctuation, 2 anything else; powers of an odd multiplier for the hash of a run.
_CLASS = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if b < 128 and not chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)
_POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))


def word_features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, the first five bytes of longer words, runs of punctuation of the lower-cased text, and its share of capitals."""
    raw = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    kind = _CLASS[raw]
    starts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))) if len(raw) else np.zeros(0, np.int64)
    if not len(starts) or not kind.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate((starts, [len(raw)])))
    within = np.arange(len(raw)) - np.repeat(starts, lengths)
    terms = (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[within & 63]
    hashes = np.add.reduceat(terms, starts)[kind[starts] > 0]
    stems = np.add.reduceat(np.where(within < 5, terms, np.uint64(0)), starts)[lengths > 5] ^ np.uint64(1 << 63)
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    share = min(9, 10 * capitals // len(text))
    return counted(np.concatenate((hashes, stems, np.full(8, share + 7, dtype=np.uint64))), bits)


def weighted(slots: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length: sublinear counts."""
    x = (1 + np.log(tf)) * idf[slots]
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


def document_frequencies(texts: DataFrame, features: Features, bits: int, fan: int = 64) -> tuple[np.ndarray, int]:
    """In how many of the non-null texts each slot occurs, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, dtype=np.int64), 0
        for batch in batches:
            for part in steps(batch, "text"):
                for text in part.column("text").to_pylist():
                    total[features(text)[0]] += 1
                    n += 1
        yield pa.RecordBatch.from_pydict({"df": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, dtype=np.int64), 0
        for batch in batches:
            for df, k in zip(batch.column("df"), batch.column("n").to_pylist()):
                total += np.frombuffer(df.as_py(), dtype=np.int64)
                n += k
        yield pa.RecordBatch.from_pydict({"df": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    schema = "df binary, n long"
    sums = texts.select("text").where("text is not null").mapInArrow(count, schema)
    parts = sums.rdd.getNumPartitions()
    while parts > fan:
        parts = -(-parts // fan)
        sums = sums.repartition(parts).mapInArrow(add, schema)
    total, n = np.zeros(1 << bits, dtype=np.int64), 0
    for row in sums.collect():  # at most fan rows
        total += np.frombuffer(row.df, dtype=np.int64)
        n += row.n
    return total, n


@dataclass
class Sparse:
    """The weights other than zero by slot."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of(cls, weights: np.ndarray) -> Sparse:
        at, columns = np.nonzero(weights)
        starts = np.searchsorted(at, np.arange(len(weights) + 1))
        return cls(starts, columns.astype(np.int32), weights[at, columns], weights.shape[1])

    def sums(self, slots: np.ndarray, x: np.ndarray) -> np.ndarray:
        """x times the rows of the slots."""
        low, n = self.starts[slots], self.starts[slots + 1] - self.starts[slots]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.columns[at], weights=np.repeat(x, n) * self.values[at], minlength=self.width)


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray | Sparse  # slots x classes
    temperature: float = 1.0

    def logits(self, slots: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = weighted(slots, tf, self.idf)
        return self.weights.sums(slots, x) if isinstance(self.weights, Sparse) else x @ self.weights[slots]

    def posterior(self, slots: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return softmax(self.logits(slots, tf) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def sample_rows(rows: DataFrame, label: str, features: Features, bound: int) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """(label, held back for the temperature, slots, counts) of about bound rows, as many of each label as there are.

    rows: doc_id, text, label. Rows are taken by a hash of doc_id and text, at a rate per label that follows from the label's
    count. The bound is on the rows: a model is as wide as the labels they have.
    """
    rows = rows.select("doc_id", "text", F.col(label).alias("label")).where("text is not null and label is not null")
    counts = saved(rows.groupBy("label").agg(F.count("*").alias("n")), "label-counts")
    labels = counts.count()
    if not labels:
        return []
    rates = counts.select(F.col("label").alias("of"), F.least(F.lit(1.0), F.lit(bound / labels) / F.col("n")).alias("rate"))
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(rates, F.col("label") == F.col("of")).where(u < F.col("rate")).select("doc_id", "text", "label")
    return featured(drawn.dropDuplicates(["doc_id", "text"]), features)


def featured(rows: DataFrame, features: Features) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """(label, held back for the temperature, slots, counts) of a bounded set of (doc_id, text, label) rows."""
    taken = rows.select("label", "text", F.xxhash64("text", "doc_id", F.lit(5)).alias("order"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                got = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label"),
                        part.column("order"),
                        pa.array([s.astype("<i4").tobytes() for s, _ in got], pa.binary()),
                        pa.array([c.astype("<i4").tobytes() for _, c in got], pa.binary()),
                    ],
                    names=["label", "order", "slots", "counts"],
                )

    found = sorted(
        taken.mapInArrow(run, "label string, order long, slots binary, counts binary").collect(), key=lambda r: (r.order, r.label)
    )
    return [(r.label, r.order % 5 == 0, np.frombuffer(r.slots, "<i4").astype(np.int64), np.frombuffer(r.counts, "<i4")) for r in found]


def inverse_frequencies(df: np.ndarray, n_texts: int) -> np.ndarray:
    return np.log((1 + n_texts) / (1 + df)) + 1


def fitted(
    sample: list[tuple[str, bool, np.ndarray, np.ndarray]],
    idf: np.ndarray,
    epochs: int = 4,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.001,
) -> Model:
    """FTRL-proximal with an elastic net, then the temperature with the least log loss on the rows held back."""
    classes = sorted({y for y, *_ in sample})
    z, n = np.zeros((len(idf), len(classes))), np.zeros((len(idf), len(classes)))

    def at(slots: np.ndarray) -> np.ndarray:
        zs = z[slots]
        return -np.sign(zs) * np.maximum(np.abs(zs) - l1, 0) / ((beta + np.sqrt(n[slots])) / alpha + l2)

    rows = [(classes.index(y), held, s, weighted(s, tf, idf)) for y, held, s, tf in sample if len(s)]
    for _ in range(epochs):
        for y, held, slots, x in rows:
            if held:
                continue
            w = at(slots)
            g = softmax(x @ w)
            g[y] -= 1
            grad = x[:, None] * g
            root = np.sqrt(n[slots])
            n[slots] += grad * grad
            z[slots] += grad - (np.sqrt(n[slots]) - root) / alpha * w
    weights = at(np.arange(len(idf))).astype(np.float64)
    held = [(y, x @ weights[s]) for y, h, s, x in rows if h]
    model = Model(classes, idf, weights if len(classes) <= DENSE else Sparse.of(weights))
    if held and len(classes) > 1:
        ys, logits = np.array([y for y, _ in held]), np.array([v for _, v in held])

        def loss(log_t: float) -> float:
            v = logits / math.exp(log_t)
            top = v.max(axis=1, keepdims=True)
            return float((np.log(np.exp(v - top).sum(axis=1)) + top[:, 0] - v[np.arange(len(ys)), ys]).mean())

        low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
        for _ in range(60):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        model.temperature = math.exp((low + high) / 2)
    return model
