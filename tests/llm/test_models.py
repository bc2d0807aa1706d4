import numpy as np
import pytest
from pyspark.sql import functions as F

from datakiln.llm import language_id, line_rules, line_templates, mixing, sharding, simhash, text_models, topk_search
from datakiln.llm.common import DOCUMENT_COLUMNS, table
from tests.llm.conftest import SF

FR, EN = "le chat est sur la table avec une souris", "the cat is on the table with a mouse"


def test_language_held_out_accuracy(spark, edge):
    sf = "/root/testdata/sf0.01"
    got = language_id.op3_language_id(spark, sf).join(table(spark, sf, "documents", "doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.avg("score").alias("score")
    ).first()
    assert held.right > 0.98 and abs(held.right - held.score) < 0.03
    by_id = {}
    for r in language_id.op3_language_id(spark, edge).collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.lang_pred for d in (1, 2, 5, 6) for r in by_id[d]} == {"und"} and all(0 <= r.score <= 1 for rs in by_id.values() for r in rs)


def test_hundreds_of_labels_are_told_apart(spark):
    """300 labels of which each has words of its own: none is left out, and sparse weights give what the matrix gives."""
    rows = [(10 * i + k, f"{_word(i * 37 + 1)} {_word(i * 37 + 2)} {_word(i * 37 + 3)}", f"l{i:03d}") for i in range(300) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    features = lambda x: text_models.word_features(x, 15)
    sample = text_models.sample_rows(df, "label", features, 4000)
    assert len(sample) == 1200
    model = text_models.fitted(sample, np.ones(1 << 15), epochs=10)
    assert len(model.classes) == 300 and isinstance(model.weights, text_models.Sparse)
    right = sum(model.classes[int(np.argmax(model.posterior(*features(x))))] == y for _, x, y in rows[::4])
    assert right > 270
    rng = np.random.default_rng(0)
    matrix = rng.standard_normal((50, 70)) * (rng.random((50, 70)) < 0.2)
    slots, x = np.array([0, 3, 3, 49]), np.array([1.0, 2.0, -1.0, 0.5])
    assert np.allclose(text_models.Sparse.of(matrix).sums(slots, x), x @ matrix[slots])
    assert len(text_models.sample_rows(df, "label", features, 300)) < 450


def _plain_fit(sample, n_slots, l1, l2, alpha, beta, epochs):
    """The update of the follow-the-regularised-leader rule, number by number."""
    classes = sorted({y for y, *_ in sample})
    z, n = ([[0.0] * len(classes) for _ in range(n_slots)] for _ in range(2))

    def weight(i, c):
        return 0.0 if abs(z[i][c]) <= l1 else -(z[i][c] - np.sign(z[i][c]) * l1) / ((beta + n[i][c] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for y, held, slots, tf in sample:
            if held:
                continue
            x = 1 + np.log(tf)
            x = x / np.sqrt((x * x).sum())
            w = [[weight(i, c) for c in range(len(classes))] for i in slots]
            logit = [sum(x[k] * w[k][c] for k in range(len(slots))) for c in range(len(classes))]
            e = np.exp(np.array(logit) - max(logit))
            for c in range(len(classes)):
                g = e[c] / e.sum() - (classes[c] == y)
                for k, i in enumerate(slots):
                    d = x[k] * g
                    sigma = ((n[i][c] + d * d) ** 0.5 - n[i][c] ** 0.5) / alpha
                    n[i][c] += d * d
                    z[i][c] += d - sigma * w[k][c]
    return np.array([[weight(i, c) for c in range(len(classes))] for i in range(n_slots)])


def test_fit_equals_plain_rule():
    rng = np.random.default_rng(6)
    sample = []
    for i in range(80):
        slots = np.sort(rng.choice(20, 4, replace=False))
        sample.append((("a", "b", "c")[int(slots[0]) % 3], i % 5 == 0, slots, rng.integers(1, 4, 4)))
    model = text_models.fitted(sample, np.ones(20), epochs=3, alpha=2.0, beta=1.0, l1=0.02, l2=0.001)
    assert np.allclose(model.weights, _plain_fit(sample, 20, 0.02, 0.001, 2.0, 1.0, 3), atol=1e-9)


def test_char_ngrams_count_every_gram():
    slots, tf = text_models.char_ngrams("Ab, ab!", 15)
    assert tf.sum() == 6 + 5 + 4  # "ab ab " without what is no letter, as single spaces
    assert len(text_models.char_ngrams("123", 15)[0]) == 0


def test_ftrl_and_temperature():
    rng = np.random.default_rng(0)
    sample = []
    for i in range(600):
        y = int(rng.random() < 0.5)
        noisy = y if rng.random() < 0.8 else 1 - y
        sample.append((f"c{noisy}", i % 5 == 0, np.array([y, 2 + int(rng.integers(20))]), np.array([1, 1])))
    model = text_models.fitted(sample, np.ones(32))
    p = [model.posterior(s, c)[int(y[1])] for y, _, s, c in sample]
    assert 0.62 < float(np.mean(p)) < 0.74  # calibrated: 0.8 * 0.8 + 0.2 * 0.2
    assert (text_models.fitted(sample, np.ones(32), l1=1e4).weights == 0).all()


def test_repeated_words_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = [bytes([97 + x]) for x in rng.integers(0, 3, rng.integers(0, 14))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert line_rules.repeated_words(words) == len(covered)


def _docs(spark, rows):
    return spark.createDataFrame(
        [(d, x, "en", "h", len(x)) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )


def _word(x):
    return "".join(chr(97 + x // 26**k % 26) for k in range(4))


def _body(i, n=70):
    return " ".join(_word((i * 7919 + k * 104729) % 99991) for k in range(n))


def test_boilerplate_goes_and_copies_stay(spark):
    rows = [(i, f"Cookie notice {i % 10}: accept all\n{_body(i)}") for i in range(12)]
    rows += [(100 + i, _body(500) + "\n" + _body(501)) for i in range(40)]  # copies of one text
    rows += [(200 + i, "\n".join(["Cookie notice 5: accept all " * 12, _body(900 + i, 51)])) for i in range(11)]  # mostly boilerplate
    kept = {r.doc_id: r.text for r in line_rules.apply_rules(_docs(spark, rows)).collect()}
    assert all(kept[i] == _body(i) for i in range(12))
    assert all(kept[100 + i] == rows[12][1] for i in range(40))


def test_templates(spark):
    names = ["anna", "bob", "carl", "dora", "emil", "fritz"]
    rows = [(i, f"session of user {names[i % 6]} was closed by the server\n{_body(i)}\nshort") for i in range(30)]
    rows += [(100 + i, _body(500) + "\n" + _body(501)) for i in range(9)]
    got = {r.doc_id: r.text for r in line_templates.apply_templates(_docs(spark, rows)).collect()}
    assert all(got[i] == _body(i) for i in range(30)) and all(got[100 + i] == rows[30][1] for i in range(9))


def test_near_copies_stay_whole(spark):
    """Documents of which most would go are copies: they are left to near deduplication."""
    text = [_body(700 + k) for k in range(8)]
    rows = [(i, "\n".join(t if k != i else _body(3000 + i) for k, t in enumerate(text))) for i in range(8)]
    got = {r.doc_id: r.text for r in line_templates.apply_templates(_docs(spark, rows)).collect()}
    assert got == dict(rows)


def _tree(lines):
    """Brute force: the least key of each line's template, by comparing all pairs of a leaf."""
    leaves, out = {}, {}
    for x in set(lines):
        tokens = line_templates.masked(x)
        leaves.setdefault((len(tokens), *tokens[:3]), []).append(tokens)
    for leaf in leaves.values():
        parent = list(range(len(leaf)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, a in enumerate(leaf):
            for j, b in enumerate(leaf[:i]):
                if 10 * sum(x == y for x, y in zip(a[3:], b[3:])) >= 7 * (len(a) - 3):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
        keys = [line_templates.line_key(b" ".join(t)) for t in leaf]
        groups = {}
        for i in range(len(leaf)):
            groups.setdefault(root(i), []).append(i)
        for group in groups.values():
            columns = [[leaf[i][p] for i in group] for p in range(3, len(leaf[0]))]
            need = -(-7 * len(columns) // 10)
            if sum(len(set(c)) == 1 for c in columns) >= need:
                parts = [group]
            else:  # parted by the positions that vary least
                by = sorted(range(len(columns)), key=lambda p: (-max(map(columns[p].count, columns[p])), p))[:need]
                parts = {}
                for k, i in enumerate(group):
                    parts.setdefault(tuple(columns[p][k] for p in by), []).append(i)
                parts = parts.values()
            for part in parts:
                for i in part:
                    out[keys[i]] = min(keys[j] for j in part)
    return out


def test_unlike_lines_are_no_template(spark):
    """Short lines that only begin alike, and a chain of lines each of which is similar to the next."""
    ends = ["school", "bed", "war", "Paris", "work", "church"]
    chain = [[_word(k if k >= i * 2 else k + 500) for k in range(12)] for i in range(6)]
    rows = [(i, f"He went to {ends[i]}\nOne two three {' '.join(chain[i])}\n{_body(i)}") for i in range(6)]
    got = {r.doc_id: r.text for r in line_templates.apply_templates(_docs(spark, rows)).collect()}
    assert got == dict(rows)


def test_every_template_keeps_its_positions(spark):
    """Chains of edited lines: what stays a template has 0.7 of its free positions in common."""
    rng = np.random.default_rng(8)
    rows = []
    for f in range(6):
        line = [_word(int(x)) for x in rng.integers(0, 9999, 12)]
        for i in range(40):
            line = list(line)
            line[int(rng.integers(0, 12))] = _word(int(rng.integers(0, 9999)))
            rows.append((f * 40 + i, " ".join(["common", "three", "words", *line])))
    docs = spark.createDataFrame(rows, "row long, text string")
    template = {r.key: r.template for r in line_templates.parsed(docs, line_templates._facts(docs)).collect()}
    groups = {}
    for _, x in rows:
        key = line_templates.line_key(x.encode())
        groups.setdefault(template.get(key, key), []).append(x.split()[3:])
    assert max(map(len, groups.values())) > 1
    assert all(sum(len(set(c)) == 1 for c in zip(*g)) >= 9 for g in groups.values())


def _leaf_lines(rng):
    """One leaf with 150 templates of five lines each, leaves of every short length, and unlike lines."""
    fields = [[_word(int(x)) for x in rng.integers(0, 9999, 9)] for _ in range(150)]
    lines = [["job", "on", "host", *f[:4], _word(int(rng.integers(9999))), *f[4:]] for f in fields for _ in range(5)]
    for n in range(4, 14):
        for _ in range(60):
            lines.append(["a", "b", "c", *(_word(int(x)) for x in rng.integers(0, 4, n - 3))])
    return [" ".join(x) for x in lines]


@pytest.mark.parametrize("few", [500_000, 0])
def test_templates_are_those_of_all_pairs_whatever_the_group(spark, monkeypatch, few):
    monkeypatch.setattr(line_templates, "FEW_LEAVES", few)
    lines = _leaf_lines(np.random.default_rng(2))
    docs = spark.createDataFrame([(i, "\n".join(lines[i::40])) for i in range(40)], "row long, text string")
    want = _tree([x.encode() for x in lines])
    facts = line_templates._facts(docs)
    for group in (20, 50, 2000) if few else (2000,):
        monkeypatch.setattr(line_templates, "GROUP", group)
        got = {r.key: r.template for r in line_templates.parsed(docs, facts).collect()}
        assert {k: got.get(k, k) for k in want} == want


def test_patterns(spark):
    rows = [(1, bytearray(b"a b c d")), (1, bytearray(b"a b x d")), (2, bytearray(b"q <*> r"))]
    got = {tuple(r) for r in line_templates.patterns(spark.createDataFrame(rows, "template long, body binary")).collect()}
    assert got == {(1, "a b <*> d"), (2, "q <*> r")}


@pytest.mark.parametrize("n_links", [4, 20])
def test_shared_lines_with_the_longest_words_go(spark, n_links):
    """Each of 400 documents of a host holds a cookie line and a footer of long addresses."""
    footer = " ".join(f"https://example.org/sections/{_word(k)}/{_word(k + 50)}/page" for k in range(n_links))
    rows = [(i, f"We use cookies to give you the best experience\n{_body(i, 120)}\n{footer}") for i in range(400)]
    rows += [(1000 + i, _body(9000, 200) + "\n" + _body(9001, 90)) for i in range(50)]  # copies of one text
    want = {d: _body(d, 120) if d < 1000 else x for d, x in rows}
    for apply in (line_rules.apply_rules, line_templates.apply_templates):
        assert {r.doc_id: r.text for r in apply(_docs(spark, rows)).collect()} == want


def test_nulls_and_repeated_rows_of_lines(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (None, "one two"), (3, "x"), (3, "x")]
    df = spark.createDataFrame(
        [(d, x, None, None, None) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    got = sorted(((r.doc_id, r.text) for r in line_templates.apply_templates(df).collect()), key=str)
    assert got == sorted(rows, key=str)
    assert line_rules.apply_rules(df).count() == 0


def test_copies_do_not_save_a_shared_line(spark):
    notice = "All rights reserved under the terms of the licence"
    rows = [(i, f"{notice}\n{_body(i)}") for i in range(30)]
    rows += [(100 + i, f"{notice}\n{_body(500)}\n{_body(501)}") for i in range(90)]  # copies of one text
    want = {d: x.split("\n", 1)[1] for d, x in rows}
    for apply in (line_rules.apply_rules, line_templates.apply_templates):
        assert {r.doc_id: r.text for r in apply(_docs(spark, rows)).collect()} == want


def _bounded_least_squares(p, t, goal, ridge):
    """Brute force: plain projected gradient with momentum over all documents until no rate moves any more."""
    inverse = np.linalg.inv((p * t[:, None]).T @ p + 1e-9 * t.sum() * np.eye(p.shape[1]))
    r = y = np.ones(len(p))
    momentum = (1 - np.sqrt(ridge)) / (1 + np.sqrt(ridge))
    for _ in range(5000):
        slope = p @ (inverse @ ((y * t) @ p - goal)) + ridge * (y - 1)
        new = np.clip(y - slope / (1 + ridge), 0.0, mixing.MOST)
        if np.abs(new - r).max() < 1e-12:
            break
        r, y = new, new + momentum * (new - r)
    return r


@pytest.mark.parametrize(
    "weights, budget", [({"high": 0.8, "low": 0.15, "toxic": 0.05}, None), (mixing.WEIGHTS, None), ({"low": 1.0}, 3e6)]
)
def test_mixing_equals_bounded_least_squares(spark, weights, budget):
    docs = table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels", "doc_id", "quality", "toxic")
    members = mixing.memberships(docs, mixing.trained(docs, labels), ("doc_id",)).cache()
    mix = mixing.solved(members, weights, budget)
    rows = mixing.rated(members, mix.pull).toPandas()
    p, t = np.array(rows.p.tolist()), rows.n_tokens.to_numpy().astype(float)
    share = np.array([weights.get(d, 0.0) for d in mixing.DOMAINS])
    assert np.allclose(mix.goal, share * (t.sum() if budget is None else budget)) and mix.gradient <= mixing.CLOSE
    assert rows.rate.between(0, mixing.MOST).all() and np.allclose((rows.rate.to_numpy() * t) @ p, mix.total)
    assert np.abs(_bounded_least_squares(p, t, mix.goal, mixing.RIDGE) - rows.rate).max() < 1e-6
    if budget is None:  # within three hundredths of all tokens
        assert np.abs(mix.total - mix.goal).max() < 0.03 * t.sum()
        truth = labels.toPandas().merge(rows, on="doc_id")
        assert truth[truth.toxic == 1].rate.mean() < 0.5 < 0.9 < truth[(truth.toxic == 0) & (truth.quality == 1)].rate.mean()


def test_rates_of_exact_posteriors():
    p = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1]])
    assert mixing.rates(p, np.array([-0.25, 0.5, 2.0])).tolist() == [1.25, 0.5, 0.0]
    assert mixing.rates(p, np.array([-9.0, 0, 0])).tolist() == [mixing.MOST, 1.0, 1.0]


def test_mixing_of_nulls_and_repeated_rows(spark):
    rows = [(1, "good text about cats"), (1, "good text about cats"), (2, None), (None, ""), (3, "bad words here"), (4, "junk junk junk")]
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (4, 0, 0), (4, 1, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = mixing.memberships(docs, mixing.trained(docs, labels), ("doc_id",))
    got = mixing.rated(members, mixing.solved(members).pull).toPandas()
    assert len(got) == 6 and (got.n_tokens[got.doc_id.isin([2]) | got.doc_id.isna()] == 0).all()
    assert got[got.doc_id == 1].rate.nunique() == 1
    alone = mixing.memberships(docs, mixing.trained(docs, labels.where("false")), ("doc_id",))
    assert {tuple(r.p) for r in alone.collect()} == {(1.0, 0.0, 0.0)}


def _check_shards(got, limit):
    sums = got.groupby("shard").agg(total=("n_bytes", "sum"), said=("shard_bytes", "max"), n=("n_bytes", "size"))
    assert (sums.total == sums.said).all() and ((sums.total <= limit) | (sums.n == 1)).all()
    names = sorted(sums.index)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    if len(names) > 1:  # only buckets over the limit have split
        for s in names:
            assert got[got.shard.str.startswith(s[:-1])].n_bytes.sum() > limit


@pytest.mark.parametrize("few", [500_000, 0])
def test_shards_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(sharding, "FEW_CELLS", few)
    rng = np.random.default_rng(3)
    rows = [(int(k), int(b)) for k, b in zip(rng.integers(0, 120, 400), rng.integers(0, 90, 400))]
    df = spark.createDataFrame(rows, "k long, b long")
    for limit in (60, 500, 10**6) if few else (500,):
        got = sharding.shards(df, F.col("k"), F.col("b"), ("k",), limit).toPandas()
        assert len(got) == 400
        _check_shards(got, limit)


def test_written_shards_of_a_hot_key(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(7 if i % 3 == 0 else i, _body(i, int(n))) for i, n in enumerate(rng.integers(0, 60, 300))] + [(None, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(df, F.col("doc_id"), path, 2000)
    back = sharding.read_shards(spark, path).toPandas()
    inferred = spark.read.parquet(path)  # names are strings to a reader that guesses types as well
    assert dict(inferred.dtypes)["shard"] == "string" and set(inferred.select("shard").toPandas().shard) == set(back.shard)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    got = [(None if d != d else int(d), t) for d, t in zip(back.doc_id, back.text)]
    assert sorted(got, key=key) == sorted(rows, key=key)
    back["n_bytes"] = [len((t or "").encode()) for t in back.text]
    back["shard_bytes"] = back.groupby("shard").n_bytes.transform("sum")
    _check_shards(back, 2000)
    assert back[back.doc_id == 7].shard.nunique() > 1
    sharding.write_shards(df.where("false"), F.col("doc_id"), f"file://{tmp_path}/none", 2000)


def _components(values, radius):
    k = np.array(values, dtype=np.uint64)
    parent = np.arange(len(k))
    for i in range(len(k)):
        near = np.flatnonzero(np.bitwise_count(k ^ k[i]) <= radius)
        simhash.joined_up(parent, np.full(len(near), i), near)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent.tolist()


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_bk_forest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 40)
    rng = np.random.default_rng(5)
    values = set()
    for base in [0, *rng.integers(0, 1 << 63, 15).tolist()]:
        for _ in range(60):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(bit)
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(i, _signed(x)) for i, x in enumerate(values)], "doc_id long, fp long")
    for radius in (0, 2, 3):
        got = {r.doc_id: r.component_id for r in simhash.with_component(df, radius, F.col("doc_id")).collect()}
        assert [got[i] for i in range(len(values))] == _components(values, radius)


def test_simhash_query(spark, texts, edge):
    import xxhash

    def plain(text):
        words = (text or "").encode().translate(simhash._LOWER).split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    values = [plain(x) for _, x in sorted(texts)]
    roots = _components(values, 2)
    got = {r.doc_id: r for r in simhash.op10_simhash(spark, SF).collect()}
    for i, (d, _) in enumerate(sorted(texts)):
        assert got[d].fingerprint == f"{values[i]:016x}" and got[d].component_id == sorted(texts)[roots[i]][0]
    empty = {r.doc_id: r.component_id for r in simhash.op10_simhash(spark, edge).where("fingerprint = '0000000000000000'").collect()}
    assert set(empty) == {None, 1, 2, 5} and set(empty.values()) == {1}


def test_near_duplicates_recall_and_precision(spark):
    rng = np.random.default_rng(6)
    rows, clean = [], []
    for g in range(40):
        words = _body(g * 31, 150).split()
        rows.append((g * 100, " ".join(words)))
        for c in range(1, 6):
            w = list(words)
            for at in rng.integers(0, 150, 3):  # three edits touch at most 15 of 146 shingles: similarity over 0.8
                w[at] = f"e{g}x{c}y{at}"
            rows.append((g * 100 + c, " ".join(w)))
    for i in range(60):
        clean.append((100_000 + i, _body(5000 + i * 17, 120)))
    kept = {r.doc_id for r in simhash.without_near_duplicates(_docs(spark, rows + clean)).collect()}
    assert {d for d, _ in clean} <= kept and {g * 100 for g in range(40)} <= kept
    assert len(kept) - 60 - 40 <= 16  # recall over 0.92 of 200 copies at a similarity of 0.81; above it is higher


def test_chance_links_displace_no_true_ones(spark):
    """Unlike fingerprints that share a least hash and connect by chance, and near copies of some of them."""
    rng = np.random.default_rng(8)
    rows, pairs = [], 300
    for i in range(2000):
        fp, sketch = int(rng.integers(0, 1 << 22)), [7, *sorted(rng.integers(8, 1 << 60, 47).tolist())]
        rows.append((i, _signed(fp << 13), sketch))
        if i < pairs:  # 12 bits apart, 44 of 48 hashes shared
            other = fp ^ sum(1 << int(b) for b in rng.choice(22, 12, replace=False))
            rows.append((10_000 + i, _signed(other << 13), sorted(sketch[:44] + rng.integers(8, 1 << 60, 4).tolist())))
    df = spark.createDataFrame(rows, "doc_id long, fp long, sketch array<long>")
    got = simhash.with_component(
        df, simhash.WIDE_RADIUS, F.col("doc_id"), "first", lambda nodes: simhash.sketched_links(nodes, simhash.WIDE_RADIUS)
    )
    first = {r.doc_id: r["first"] for r in got.collect()}
    assert first == {d: d % 10_000 for d, *_ in rows}


def test_hot_group_is_dealt_to_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 100)
    monkeypatch.setattr(simhash, "SHARD", 5000)
    df = spark.range(2000).select(F.col("id").alias("fp"), F.lit(1).cast("long").alias("value"))
    dealt, n = simhash.dealt_groups(df, ["value"])
    assert dealt.count() == n == 2000 * 20
    shards = max(1, -(-n // simhash.SHARD))
    sizes = [r["count"] for r in dealt.groupBy(F.pmod("grp", F.lit(shards))).count().collect()]
    assert len(sizes) == shards and max(sizes) < 2 * simhash.SHARD
    met = dealt.where("in_tree").alias("a").join(dealt.where("as_query").alias("b"), "grp").select(
        F.least("a.fp", "b.fp"), F.greatest("a.fp", "b.fp")
    )
    assert met.distinct().count() == 2000 * 2001 // 2


def _similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_duplicates_recall_against_all_pairs(spark):
    """Pairs of the small table that share 0.8 of their five-word shingles: nine in ten at least get one component."""
    docs = table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text", "lang", "source", "n_chars")
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in docs.collect()}
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs).collect()}
    ids = sorted(sets)
    alike = {d: [o for o in ids if o < d and _similarity(sets[d], sets[o]) >= 0.8] for d in ids}
    copies = [d for d in ids if alike[d]]
    assert len(copies) > 30 and sum(d not in kept for d in copies) >= 0.9 * len(copies)
    loose = [d for d in ids if d not in kept and not any(_similarity(sets[d], sets[o]) >= 0.6 for o in ids if o != d)]
    assert not loose


def test_sketches_equal_brute_force():
    rng = np.random.default_rng(9)
    values = rng.integers(0, 1 << 32, 60).astype("<u4")
    sets = [rng.choice(values, rng.integers(0, 49), replace=False) for _ in range(80)]
    found = simhash.Sketches([x.tobytes() for x in sets])
    u, v = (x.ravel() for x in np.meshgrid(np.arange(80), np.arange(80)))
    want = [len(set(sets[i]) & set(sets[j])) >= simhash.AGREE * min(len(sets[i]), len(sets[j])) for i, j in zip(u, v)]
    assert found.agree(u, v).tolist() == want


def test_topk_bounds_are_bounds():
    """The bounds that run, where their error is largest: near the limit of norms and on nearly one axis."""
    rng = np.random.default_rng(7)
    for spread, offset in ((64, 0), (64, 2**24), (2**22, 2**23)):
        x = rng.integers(-spread, spread, (300, 16)).astype(float)
        x[:, 0] += offset
        assert topk_search._norms(x).max() < topk_search.EXACT
        d = topk_search.pivot_distances(x, topk_search.farthest_first(x, 12))
        n = topk_search._norms(x)
        assert (topk_search.upper_bounds(n, d, n, d) >= x @ x.T).all()


def _plain_topk(vectors, k):
    """Brute force in whole numbers of any size."""
    whole = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in v]) for i, v in vectors]
    out = []
    for a, (q, u) in enumerate(whole):
        if q % 20 == 0:
            scores = sorted((-sum(s * t for s, t in zip(u, v)), i) for b, (i, v) in enumerate(whole) if b != a)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("far", [6e7 / 64, 3e4, 1e12])
def test_topk_with_a_far_vector_and_rows_on_one_axis(spark, monkeypatch, far):
    """One far row makes a pivot; the others lie nearly on one axis, in clusters that bounds tell apart."""
    monkeypatch.setattr(topk_search, "SLICE_ROWS", 100)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk_search, "BOUNDS", 3)
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(4 + i % 5 * 3 + rng.normal() * 0.2), *(rng.normal(size=3) * 0.05).tolist()]) for i in range(900)]
    rows.append((900, [far, 1.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_search.search(df, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == _plain_topk(rows, 20)


def test_topk_leaves_pairs_out(spark, monkeypatch):
    """Tight clusters that point apart: most pairs of groups and slices are never sent."""
    monkeypatch.setattr(topk_search, "SLICE_ROWS", 60)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 6)
    rng = np.random.default_rng(12)
    rows = [(i, (8 * np.eye(10)[i % 10] + rng.normal(size=10) * 0.02).tolist()) for i in range(1200)]
    found, pairs, held = topk_search.searched(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in found.collect()) == _plain_topk(rows, 20)
    assert pairs.count() < 0.2 * held.count() * held.select("cell").distinct().count()


def test_near_duplicates_of_nulls_and_repeated_rows(spark):
    same = _body(1, 40)
    rows = [(None, same), (7, same), (7, same), (8, same + " end"), (2, None), (3, ""), (None, " \n"), (9, "one two")]
    got = simhash.without_near_duplicates(spark.createDataFrame(
        [(d, x, None, None, None) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(7, same), (2, None), (9, "one two")], key=str)


@pytest.mark.parametrize("weights", [mixing.WEIGHTS, {"high": 0.7, "low": 0.3}])
def test_mixed_takes_what_the_solver_reaches(spark, weights):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents", *DOCUMENT_COLUMNS), table(spark, sf, "labels", "doc_id", "quality", "toxic")
    members = mixing.memberships(docs, mixing.trained(docs, labels), ("doc_id",)).cache()
    mix = mixing.solved(members, weights, most=1.0, in_reach=True)
    rows = mixing.rated(members, mix.pull, 1.0).toPandas()
    p, t, rate = np.stack(rows.p), rows.n_tokens.to_numpy(), rows.rate.to_numpy()
    assert rate.max() <= 1 and mix.goal.sum() <= t.sum() * 1.000001
    assert np.allclose((np.minimum(rate, 1.0) * t) @ p, mix.total, rtol=0.01)
    assert mix.goal[0] <= (t @ p)[0] * 1.000001
    taken = {r.doc_id for r in mixing.mixed(docs, labels, weights).collect()}
    got = t[rows.doc_id.isin(taken)] @ p[rows.doc_id.isin(taken)]
    # what a draw can miss: the spread of the documents that are taken by chance
    spread = np.sqrt(((rate * (1 - rate) * t**2) @ p**2))
    assert (np.abs(got - mix.total) <= 5 * spread + 1).all()


def test_mixed_takes_each_repeated_row_by_itself(spark):
    rows = [(1, "good text about cats")] * 3 + [(None, None), (4, "")]
    docs = spark.createDataFrame(
        [(d, x, None, None, None) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.text) for r in mixing.mixed(docs, labels, {"high": 1.0}).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)  # all are high: every rate is one
    assert mixing.mixed(docs, labels, {"high": 1.0}, budget=0.0).count() < len(rows)
