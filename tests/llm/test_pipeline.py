"""Each stage of the pipeline against a plain version of it on the small tables, on what its predecessor really kept."""

import sentencepiece
from public_tokenizers import path as tokenizer

import corpus_pipeline
from datakiln.llm import line_rules, line_templates, simhash
from datakiln.llm.common import DOCUMENT_COLUMNS, saved, table
from tests.llm.conftest import SF
from tests.llm.test_models import _similarity, _tree


def _plain_rules(rows):
    """doc_id: the text left, of the documents that stay."""
    lines = {r.doc_id: [(x, line_rules.normalised(x)) for x in (r.text or "").encode().split(b"\n")] for r in rows}
    holders = {}
    for r in rows:
        copy = tuple(k for _, k in lines[r.doc_id] if k)
        for k in set(copy):
            holders.setdefault((r.source, k), set()).add(copy)
    out = {}
    for r in rows:
        words = (r.text or "").encode().split()
        gone = [x for x, k in lines[r.doc_id] if k and len(holders[r.source, k]) >= line_rules.MIN_DOCUMENTS]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        if not failed and 2 * sum(len(x.split()) for x in gone) <= len(words):
            out[r.doc_id] = b"\n".join(x for x, _ in lines[r.doc_id] if x not in gone).decode()
    return out


def _plain_templates(texts):
    lines = {d: t.encode().split(b"\n") for d, t in texts.items()}
    template = _tree([x for some in lines.values() for x in some if len(line_templates.masked(x)) > line_templates.DEPTH])
    keys = {d: [line_templates.line_key(x) for x in some] for d, some in lines.items()}
    holders = {}
    for d, some in keys.items():
        copy = tuple(k for k in some if k is not None)
        for k in copy:
            holders.setdefault(template.get(k, k), set()).add(copy)
    out = {}
    for d, some in lines.items():
        gone = [k is not None and len(holders[template.get(k, k)]) >= line_templates.MIN_DOCUMENTS for k in keys[d]]
        n_words, dropped = sum(len(x.split()) for x in some), sum(len(x.split()) for x, g in zip(some, gone) if g)
        whole = 100 * dropped > line_templates.MOST_DROPPED * n_words
        out[d] = texts[d] if whole else b"\n".join(x for x, g in zip(some, gone) if not g).decode()
    return out


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents", *DOCUMENT_COLUMNS)
    kept = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name)
        kept.append(docs.collect())
        if name != "sentencepiece":
            assert docs.columns == list(DOCUMENT_COLUMNS)
            assert all(r.n_chars == len(r.text) for r in kept[-1])
    first, ruled, lined, single, mixed, encoded = kept
    assert {r.doc_id: r.text for r in ruled} == _plain_rules(first) and len(ruled) < len(first)
    texts = {r.doc_id: r.text for r in ruled}
    assert {r.doc_id: r.text for r in lined} == _plain_templates(texts)

    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, simhash.WIDE_SHINGLE).tolist()) for r in lined}
    left = {r.doc_id for r in single}
    alike = [(a, b) for a in sets for b in sets if a < b and _similarity(sets[a], sets[b]) >= 0.8]
    assert alike and not any(a in left and b in left for a, b in alike)
    assert all(any(_similarity(sets[d], sets[o]) >= 0.6 for o in sets if o != d) for d in set(sets) - left)

    chosen, before = {r.doc_id: r.text for r in mixed}, {r.doc_id: r.text for r in single}
    assert chosen.items() <= before.items()
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    assert {r.doc_id: list(r.ids) for r in encoded} == {d: library.encode(t, add_eos=True) for d, t in chosen.items()}


def test_mixing_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, rows = table(spark, sf, "documents", *DOCUMENT_COLUMNS), table(spark, sf, "labels", "doc_id", "quality", "toxic")
    chosen, labels = {r.doc_id for r in corpus_pipeline.mix(spark, docs, sf).collect()}, rows.collect()
    clean = [r.doc_id in chosen for r in labels if r.quality == 1 and r.toxic == 0]
    toxic = [r.doc_id in chosen for r in labels if r.toxic == 1]
    assert sum(clean) >= 0.95 * len(clean) and sum(toxic) <= 0.2 * len(toxic)
