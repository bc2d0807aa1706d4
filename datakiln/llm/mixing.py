"""Soft-membership mixing of documents to target domain weights.

Domains come from a labelled table: toxic (toxic is 1), low (quality is 0) and high. A classifier fitted on a bounded
sample of labelled documents (about SAMPLE, the documented bound) gives every document its posterior over the domains, in
steps of 1 / GRAIN. Each document then gets a rate between zero and MOST such that the expected tokens of a domain, the sum
of rate times tokens times posterior over all documents, match the targets: given shares of a given number of tokens, by
default as many as the corpus has.

The rates are found by projected-gradient least squares from rate one. Misses are weighed by the inverse Gram matrix of the
posteriors, so that small domains count as much as large ones, and RIDGE times the squared distance of the rates from one,
by token, is added: of all rates that come as near to the targets it picks those that change the corpus least, and where no
rates can meet the targets (each clean text has a little posterior of every domain) it keeps them from putting all on a few
texts. A step moves all rates along the gradient, scaled by the curvature of the documents that are between the bounds, and
projects them onto the bounds; it is halved until it helps. So a rate is always one minus the posterior times a vector of a
number a domain, cut off at the bounds. The corpus is summed up once by posterior, and every step is a pass over these sums,
whose number doesn't grow with the corpus. The solver stops when the gradient is below CLOSE, which is at the optimum; the
miss that is left is returned.

Defined results: a null or empty text has no tokens, the prior as its posterior, and the rate that its posterior gives. A
doc_id labelled more than once takes its worst labels, and of texts that share it the least one is learned from; null labels
and labels of absent documents are left out. Without any usable label every document is high. Rows that share a doc_id are
rated by their own texts. An empty table gives no rates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from datakiln.llm.common import DOCUMENT_COLUMNS, numbered, saved, steps, table
from datakiln.llm.text_models import Model, featured, fitted, word_features

BITS, SAMPLE, GRAIN = 17, 12_000, 1024
DOMAINS = ("high", "low", "toxic")
#: Default target shares of tokens, the highest rate (so many passes over a document at most), and the pull to rate one.
WEIGHTS, MOST, RIDGE = {"high": 0.95, "low": 0.05, "toxic": 0.0}, 4.0, 0.03
#: Steps and halvings of a step at most, and the gradient at which the solver stops.
ROUNDS, HALVINGS, CLOSE = 50, 16, 1e-9


def words(text: str) -> tuple[np.ndarray, np.ndarray]:
    return word_features(text, BITS)


def drawn(labels: DataFrame, bound: int = SAMPLE) -> DataFrame | None:
    """About bound labelled doc_ids with their domain as label, as many of each domain as there are; drawn by a hash of doc_id."""
    known = labels.select("doc_id", "quality", "toxic").dropna()
    worst = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("high")
    rows = worst.select("doc_id", domain.alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return None
    rate = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, bound / len(counts) / n))))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30) < rate[F.col("label")])


def trained(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model | None:
    """A model of the domains from (doc_id, text) rows and their labels; None without any labelled text that has a word."""
    ids = drawn(labels, bound)
    if ids is None:
        return None
    rows = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = [x for x in featured(rows, words) if len(x[2])]
    return fitted(sample, np.ones(1 << BITS), epochs=8, alpha=20.0, l1=0.2) if sample else None


def rounded(p: np.ndarray) -> np.ndarray:
    """A posterior in whole steps of 1 / GRAIN; the first domain takes what is left."""
    out = np.round(p * GRAIN) / GRAIN
    out[0] = 1.0 - out[1:].sum()
    return np.maximum(out, 0.0)


def memberships(docs: DataFrame, model: Model | None, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, n_tokens and p, the posterior over DOMAINS, of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = [DOMAINS.index(c) for c in m.classes] if m else []
        prior = np.array([1.0, 0.0, 0.0])
        for batch in batches:
            for part in steps(batch, "text"):
                counts, ps = [], []
                for text in part.column("text").to_pylist():
                    p = prior
                    if m is not None and text:
                        slots, tf = words(text)
                        p = np.zeros(len(DOMAINS))
                        p[place] = m.posterior(slots, tf)
                        p = rounded(p)
                    counts.append(len((text or "").split()))
                    ps.append(p.tolist())
                values = [pa.array(counts, pa.int64()), pa.array(ps, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *values], names=[*keep, "n_tokens", "p"])

    return rows.mapInArrow(run, rows.select(*keep).schema.add("n_tokens", "long").add("p", ArrayType(DoubleType())))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(DOMAINS))


def rates(p: np.ndarray, pull: np.ndarray, most: float = MOST) -> np.ndarray:
    """Rates of posteriors: one minus the pulls of the domains, cut off at the bounds."""
    return np.clip(1.0 - p @ pull, 0.0, most)


def by_posterior(members: DataFrame) -> DataFrame:
    """p, n_tokens: the tokens of all documents with a posterior, of which there are at most some GRAIN squared.

    The sums are made in the partitions of the aggregation; only their small result is dealt again.
    """
    return saved(members.groupBy("p").agg(F.sum("n_tokens").alias("n_tokens")).repartition(8), "by-posterior")


def _totals(cells: DataFrame, pulls: list[np.ndarray], most: float) -> np.ndarray:
    """For each pull, the expected tokens by domain and the Gram matrix of the documents between the bounds, in a row."""
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(pulls), k + k * k))
        for b in batches:
            p, t = _matrix(b.column("p")), b.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
            for row, pull in zip(sums, pulls):
                r = rates(p, pull, most)
                row[:k] += (r * t) @ p
                row[k:] += ((p * (t * ((r > 0) & (r < most)))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()])], names=["sums"])

    found = [r.sums for r in cells.mapInArrow(run, "sums array<double>").collect()]
    return np.array(found).reshape(-1, len(pulls), k + k * k).sum(axis=0)


@dataclass
class Mix:
    """The pulls that give the rates, the targets, the expected totals reached, and the gradient left."""

    pull: np.ndarray
    goal: np.ndarray
    total: np.ndarray
    gradient: float


def solved(
    members: DataFrame,
    weights: dict[str, float] = WEIGHTS,
    budget: float | None = None,
    ridge: float = RIDGE,
    most: float = MOST,
    in_reach: bool = False,
) -> Mix:
    """The mix whose expected totals are nearest to the domains' shares (weights) of budget tokens (None: the corpus's own).

    Rates go up to most. in_reach cuts the budget to what the domain with the largest share can fill at that rate; a domain that
    has less than its share is then taken whole.
    """
    cells, k = by_posterior(members), len(DOMAINS)
    pull = np.zeros(k)
    sums = _totals(cells, [pull], most)[0]
    tokens = float(sums[:k].sum())
    shares = np.array([weights.get(d, 0.0) for d in DOMAINS])
    shares = shares / max(shares.sum(), 1e-12)
    main = int(shares.argmax())
    reach = most * float(sums[main]) / shares[main] if in_reach and shares[main] > 0 else np.inf
    goal = shares * min(tokens if budget is None else budget, reach)
    scale = max(1.0, tokens)
    inverse = np.linalg.inv(sums[k:].reshape(k, k) / scale + 1e-9 * np.eye(k)) / scale

    def gradient(sums: np.ndarray, pull: np.ndarray) -> np.ndarray:
        """By domain: of a document between the bounds it is a token's worth of the posterior times this."""
        return inverse @ (sums[:k] - goal) - ridge * pull

    for _ in range(ROUNDS):
        now = gradient(sums, pull)
        if np.abs(now).max() <= CLOSE:
            break
        step = np.linalg.solve(ridge * np.eye(k) + inverse @ sums[k:].reshape(k, k), now)
        tried = [pull + step * 0.5**i for i in range(HALVINGS)]
        found = _totals(cells, tried, most)
        left = [np.abs(gradient(x, v)).max() for x, v in zip(found, tried)]
        best = next((i for i, x in enumerate(left) if x < (1 - 0.1 * 0.5**i) * np.abs(now).max()), int(np.argmin(left)))
        pull, sums = tried[best], found[best]
    return Mix(pull, goal, sums[:k], float(np.abs(gradient(sums, pull)).max()))


def rated(members: DataFrame, pull: np.ndarray, most: float = MOST) -> DataFrame:
    """members with their rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(rates(_matrix(b.column("p")), pull, most))
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "rate"])

    return members.mapInArrow(run, StructType([*members.schema.fields, StructField("rate", DoubleType())]))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float | None = None) -> DataFrame:
    """The documents that a pass over the mix takes, each at most once: with its rate, which goes up to one, as its chance.

    So what is taken is expected to be what the solver reaches, and the budget is one that single passes can fill.
    """
    rows = numbered(docs.select(*DOCUMENT_COLUMNS))
    members = saved(memberships(rows, trained(rows, labels), ("row", "doc_id")), "members")
    chance = F.pmod(F.xxhash64("doc_id", "row", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    pull = solved(members, weights, budget, most=1.0, in_reach=True).pull
    chosen = rated(members, pull, 1.0).where(chance < F.col("rate")).select("row")
    return rows.join(chosen, "row").select(*DOCUMENT_COLUMNS)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    members = saved(memberships(docs, model, ("doc_id",)), "members")
    p = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return rated(members, solved(members).pull).select("doc_id", "n_tokens", *p, "rate")
