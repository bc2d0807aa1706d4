import numpy as np
import pytest
from pyspark.sql import functions as F

from datakiln.llm import lexical_search, whitening


def _plain_search(docs, items, k):
    """Every score of every document, by the definition."""
    counts = {i: c for i, (_, x) in enumerate(docs) if (c := {t.decode(): n for t, n in lexical_search.term_counts(x).items()})}
    n, terms = len(counts), sum(sum(c.values()) for c in counts.values())
    df = {}
    for c in counts.values():
        for t in c:
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in items:
        scored = []
        for i, c in counts.items():
            m = 25 + 75 * sum(c.values()) * n // terms
            score = 0
            for t, q in lexical_search.term_counts(text).items():
                tf = c.get(t.decode(), 0)
                if tf:
                    w = int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t.decode()] + 1))))
                    score += q * w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, docs[i][0]))
        out += [(item_id, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("limits", [(65_536, 1 << 21, 50_000, 200_000), (7, 40, 5, 0)])
def test_wand_equals_every_score(spark, monkeypatch, limits):
    for name, value in zip(("SHARD_DOCUMENTS", "SHARD_POSTINGS", "BLOCK_TERMS", "FEW_TERMS"), limits):
        monkeypatch.setattr(lexical_search, name, value)
    monkeypatch.setattr(lexical_search, "FIRST_WINDOW", 3)
    monkeypatch.setattr(lexical_search, "LAST_WINDOW", 5)
    rng = np.random.default_rng(3)
    word = lambda: f"W{int(rng.zipf(1.4)) % 60}"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 30))))) for i in range(150)] + [(150, None), (151, "w1 " * 400)]
    items = [(i, " ".join(word() for _ in range(int(rng.integers(0, 9))))) for i in range(25)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in lexical_search.search(*frames, k=6).collect())
    assert got == _plain_search(docs, items, 6)


def test_wand_skips_documents_that_cannot_beat_the_heap():
    m = np.full(20_000, 100, dtype=np.int64)
    every = np.arange(20_000, dtype=np.int32)
    common = lexical_search.Postings(every, np.ones_like(every), 10, 10 * (10**9 // 1800))
    rare = lexical_search.Postings(every[:300:10], np.ones(30, dtype=np.int32), 5000, 5000 * (10**9 // 1800))
    scores, at, scored = lexical_search.wand([common, rare], m, 10)
    assert at.tolist() == list(range(0, 100, 10)) and len(set(scores.tolist())) == 1
    assert scored < 300


def _embeddings(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


def _plain_whitening(x):
    x = np.floor(1024 * x) + 100_000
    c = x - x.mean(axis=0)
    v = c.T @ c / len(c)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    s = x.sum(axis=0)
    return c @ u / np.sqrt(e), e / np.trace(v), ((len(x) * x.astype(np.int64) - s.astype(np.int64)) ** 2).sum(axis=1)


@pytest.mark.parametrize("kind", ["flat", "narrow"])
def test_whitening_equals_eigenvectors(spark, kind):
    rng = np.random.default_rng(4)
    d = 5 if kind == "narrow" else 40
    x = 50 * rng.standard_normal((700, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + rng.standard_normal(d)
    z, explained, deviation = _plain_whitening(x)
    got = whitening.whitened(_embeddings(spark, [*x, None, [1.0, float("nan")]]).repartition(3)).toPandas()
    table = got.pivot_table(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((table * z).sum(axis=0))
    assert np.abs(table * signs - z).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-12)
    assert got.groupby("vec_id").deviation.first().tolist() == deviation.tolist() and set(got.n) == {700}
    assert got.identity_error.max() < 1e-4


def test_power_passes_suffice_for_steep_spectra(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((500, 12)) * 1.5 ** -np.arange(12)) @ np.linalg.qr(rng.standard_normal((60, 60)))[0][:12] * 1e5
    rows = whitening.quantised(_embeddings(spark, x))
    widths = []
    applied = whitening.applied
    monkeypatch.setattr(whitening, "applied", lambda r, f: (widths.extend(y.basis is None for y in f.values()), applied(r, f)))
    fit = whitening.fitted(rows)[60]
    assert not any(widths) and len(widths) <= whitening.POWER and fit.residual <= whitening.TOLERANCE
    c = np.array([r.x for r in rows.orderBy("vec_id").collect()], dtype=float)
    exact = np.linalg.eigvalsh(np.cov(c.T, bias=True))[::-1][:8]
    assert np.allclose(fit.values, exact, rtol=1e-9)
    flat = whitening.quantised(_embeddings(spark, rng.standard_normal((500, 60))))
    whitening.fitted(flat)
    assert widths[-1]  # the full space, after residuals failed


def test_whitening_of_equal_and_huge_vectors(spark):
    assert whitening.whitened(_embeddings(spark, [[1.0, 2.0]] * 5)).count() == 0
    got = whitening.whitened(_embeddings(spark, [[1e30, 0.0], [-1e30, 1.0], [0.5, 3.0]]))
    assert got.where(F.col("deviation").isNull()).count() > 0 and got.agg(F.max("identity_error")).first()[0] < 1e-4
