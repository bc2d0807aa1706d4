import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from datakiln.llm import pieces, token_store
from datakiln.llm.common import new_folder, table
from tests.llm.conftest import LONG, SF

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _odd_texts(n, alphabet, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(n)]


def test_segment_encoder_equals_the_library():
    library, own = Tokenizer.from_file(BPE), token_store.SegmentEncoder(BPE)
    texts = _odd_texts(3000, " \n\tab'sé🎉<|>012\xa0\x1c　.!", 1) + ["a<|endoftext|>b c", LONG, "", " ", "x  y", " lead", "trail "]
    for x, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, own.id_type).tolist() == library.encode(x, add_special_tokens=False).ids, x


def _noted(own):
    """What the library is given from now on."""
    given, packed = [], own._packed
    own._packed = lambda texts: given.extend(texts) or packed(texts)
    return given


def test_a_word_is_encoded_once_whatever_ends_it():
    library, own = Tokenizer.from_file(BPE), token_store.SegmentEncoder(BPE)
    given = _noted(own)
    texts = ["a Zorblaté. Zorblaté, Zorblaté Zorblaté!?\nZorblaté.\nZorblaté", "b Zorblaté; Zorblaté?\n\nZorblaté"]
    for x in texts:
        assert np.frombuffer(own.encode([x])[0], own.id_type).tolist() == library.encode(x, add_special_tokens=False).ids
    assert "".join(given).count("Zorblaté") == 2  # after a space and after a line feed


def test_words_met_most_are_kept(monkeypatch):
    monkeypatch.setattr(token_store, "TABLE_SIZE", 2)
    own = token_store.SegmentEncoder(BPE)
    for x in ("a rare seldom", "a frequent frequent frequent common common"):
        own.encode([x])
    given = _noted(own)
    own.encode(["a frequent common rare"])
    assert "frequent" not in "".join(given) and "common" not in "".join(given) and "rare" in "".join(given)


@pytest.mark.parametrize("size", [1, 50, 400_000])
def test_words_apart_equal_the_library(monkeypatch, size):
    monkeypatch.setattr(token_store, "TABLE_SIZE", size)
    library, own = Tokenizer.from_file(BPE), token_store.SegmentEncoder(BPE)
    for seed, alphabet in enumerate((" \n\n'stdrelvm.,!é1²ªßΩж中", "ab \n\n\n.!x", "A'S \n's'll don't.,-", "é1½.ⅷ·̀ͅ \n")):
        texts = [*_odd_texts(800, alphabet, seed), "", " ", ","]
        for x, got in zip(texts, own.encode(texts)):
            assert np.frombuffer(got, own.id_type).tolist() == library.encode(x, add_special_tokens=False).ids, x
        assert len(own.words) == len(own.ids) == len(own.met) <= size
    assert own.encode([]) == [] and own.encode([""]) == [b""]


def test_cut_points_follow_content():
    ids = np.random.default_rng(0).integers(0, 50_000, 60_000).astype(np.uint16)
    ends = token_store.cut_points(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    moved = token_store.cut_points(np.concatenate((ids[:700], ids[600:])))
    cut = lambda x, e: {x[a:b].tobytes() for a, b in zip([0, *e], e)}
    assert len(cut(ids, ends) & cut(np.concatenate((ids[:700], ids[600:])), moved)) > 0.9 * len(ends)
    h = [sum(int(token_store._GEAR[ids[j]]) << (i - j) for j in range(max(0, i - 31), i + 1)) % (1 << 64) for i in range(3000)]
    want = [i + 1 for i in range(3000) if h[i] >> 55 == 0]
    assert set(e for e in ends if e < 2900) <= set(want) | {
        e for e in ends if e - max([0] + [x for x in ends if x < e]) == token_store.MOST
    }


def test_crc_of_parts():
    r = random.Random(2)
    for _ in range(50):
        a, b = r.randbytes(r.randrange(300)), r.randbytes(r.randrange(5000))
        shifted = token_store.shifted_crc(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([len(b)]))[0]
        assert int(shifted) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_merkle_frontier():
    leaves = [bytes([i]) * 16 for i in range(37)]
    for n in range(38):
        tree = token_store._Frontier()
        for x in leaves[:n]:
            tree.add(x)
        assert tree.root() == token_store.merkle_root(leaves[:n])


@pytest.mark.parametrize("where", ["small", "edge"])
def test_store_round_trip(spark, edge, duck, where):
    top = SF if where == "small" else edge
    path = new_folder(spark, "store")
    token_store.write_store(table(spark, top, "documents", "doc_id", "text"), BPE, path)
    facts = {r.start: r for r in token_store.read_facts(spark, path).collect()}
    read = {r.start: r for r in token_store.read_ids(spark, path).collect()}
    assert all(r.sound for r in token_store.verify_files(spark, path).collect())
    chunks = token_store._chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()
    library, left = Tokenizer.from_file(BPE), {}
    for doc_id, text in duck(top).sql("select doc_id, text from documents").fetchall():
        left.setdefault(doc_id, []).append(library.encode(text or "", add_special_tokens=False).ids + [0])
    at = 0
    for start in sorted(facts):
        r = facts[start]
        assert start == at and read[start].doc_id == r.doc_id
        ids = read[start].ids
        left[r.doc_id].remove(ids)
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert not any(left.values())
    order = [facts[s].doc_id for s in sorted(facts)]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_damage_is_found(spark, tmp_path):
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    path = new_folder(spark, "store")
    token_store.write_store(table(spark, SF, "documents", "doc_id", "text"), BPE, path)
    bad = new_folder(spark, "store")
    for part in ("recipes", "bases"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
    token_store._chunks(spark, path).withColumn("payload", F.concat("payload", F.lit(b"\0"))).write.parquet(f"{bad}/chunks")
    with pytest.raises(PythonException, match="damaged"):
        token_store.read_facts(spark, bad).collect()


@pytest.mark.parametrize("lost", ["a document", "a file"])
def test_lost_recipes_are_found(spark, tmp_path, lost):
    from pyspark.sql import functions as F

    path, bad = new_folder(spark, "store"), new_folder(spark, "store")
    token_store.write_store(table(spark, SF, "documents", "doc_id", "text"), BPE, path)
    for part in ("chunks", "bases"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
    recipes = spark.read.parquet(f"{path}/recipes")
    first = recipes.where("kind = 'doc'").agg(F.min(F.struct("file", "within")).alias("x")).first().x
    gone = (F.col("file") == first.file) & (
        (F.col("kind") == "doc") & (F.col("within") == first.within) if lost == "a document" else F.lit(True)
    )
    recipes.where(~gone).write.parquet(f"{bad}/recipes")
    with pytest.raises(ValueError, match="missing or damaged"):
        token_store.read_facts(spark, bad).collect()


def test_pieces_equal_the_library(spark, edge, texts):
    own, library = pieces._Tables(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for x in [t for _, t in texts] + _odd_texts(1500, " \n\tab▁é🎉<>0123'", 3) + [LONG, "", " ", "  ", "\n"]:
        own.learn(list(set(own.model.segments(x)).difference(own.text)))
        ids = library.encode(x, add_eos=True)
        assert own.model.encode(x) == ids and own.model.decode(ids) == library.decode(ids)
    r = random.Random(4)
    for _ in range(1000):
        ids = [r.randrange(3, 259) if r.random() < 0.5 else r.randrange(32_000) for _ in range(r.randrange(12))]
        assert own.model.decode(ids) == library.decode(ids)


def test_piece_query(spark, texts):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in pieces.encode_documents(table(spark, SF, "documents", "doc_id", "text"), PIECES, keep_ids=True).collect()}
    for d, x in texts:
        ids = library.encode(x, add_eos=True)
        assert got[d].ids == ids and got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
