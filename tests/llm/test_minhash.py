import random

import numpy as np
import pytest

from datakiln.llm import minhash
from tests.llm.conftest import SF


def _plain(docs):
    """doc_id, n_shingles, component_id, kept from all pairs of full sets."""
    sets = []
    for _, x in docs:
        words = [w.translate(str.maketrans(minhash_upper, minhash_lower)) for w in (x or "").encode().decode().replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        sets.append({tuple(words)} - {()} if len(words) < 2 else set(zip(words, words[1:])))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(i)
    shared = {}
    for group in holders.values():
        for k, i in enumerate(group):
            for j in group[:k]:
                shared[i, j] = shared.get((i, j), 0) + 1
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs))


minhash_upper, minhash_lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _families(seed, size, n_families):
    """Families of texts whose members are edited again and again, so that similarities are around the limit."""
    r = random.Random(seed)
    docs = []
    for f in range(n_families):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([1, 3, 8, 40, 150]))]
        for _ in range(size):
            words = list(base)
            for _ in range(max(1, int(len(words) * r.choice([0.0, 0.02, 0.05, 0.09, 0.15])))):
                words[r.randrange(len(words))] = f"x{r.randrange(5000)}"
            docs.append((r.randrange(10**9), " ".join(words)))
            base = words if r.random() < 0.4 else base
    r.shuffle(docs)
    return docs + [(-1, None), (-2, ""), (-3, " \n"), (-4, "One"), (-5, "one")]


@pytest.mark.parametrize("group", [2048, 5])
def test_minhash_equals_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(minhash, "GROUP", group)
    docs = _families(7, 24, 25)
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in minhash.near_duplicates(rows).collect()) == _plain(docs)


def test_op13_equals_all_pairs(spark, texts):
    assert sorted(tuple(r) for r in minhash.op13_minhash(spark, SF).collect()) == _plain(texts)


def test_minima_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (800, 100, 100))
    family = minhash.Family()
    x, y = (family.minima(np.concatenate((both, c))) for c in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.08
    assert family.minima(both).tolist() == [min(int(h) for h in (both >> np.uint64(32)) * p + q >> np.uint64(32)) for p, q in zip(family.a, family.b)]
