"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The model file is read with a small protobuf reader. A text is normalised (spaces become the meta symbol, a dummy prefix
is put in front), cut where no vocabulary piece can span, and each segment is encoded with a score-ordered agenda of
adjacent symbol pairs: the pair whose joined piece scores highest is merged first, ties go to the leftmost, and a merge
puts the two new neighbour pairs on the agenda. Symbols outside the vocabulary fall back to bytes.

Segments repeat, so each worker keeps a bounded table of encoded segments. Every segment that enters the table is
compared with the sentencepiece library, in one call per Arrow step; a difference raises.

Defined results: null and empty texts have only the end id and decode to the empty string. Repeated rows give repeated
results. A null doc_id passes through. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from datakiln.llm.common import steps, table

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments kept per worker (the first met: they are the frequent ones), the longest that is kept, and bytes of text a step.
TABLE_SIZE, TABLE_LONGEST, STEP = 500_000, 48, 2 << 20


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else _varint(data, i)
            value = data[i : i + n]
            i += n
        yield key >> 3, value


class PieceModel:
    """A merge-type vocabulary with its own encoder and decoder."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer, normalizer = {}, {}
        with open(path, "rb") as f:
            data = f.read()
        for field, value in _fields(data):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or {
            USER_DEFINED, UNUSED
        } & set(self.kinds) or normalizer.get(2) or normalizer.get(4, 1) or trainer.get(24, 0):
            raise ValueError(
                "only merge-type vocabularies with the identity normaliser, kept white space and a prefix meta symbol are supported"
            )
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unk = self.kinds.index(UNKNOWN)
        self.eos = self.pieces.index("</s>")
        long = [p for p in self.ids if len(p) > 1]
        # a text may be cut before a meta symbol that follows another character, and around characters that no longer piece holds
        if any(META in p.lstrip(META) for p in long):
            self.cut = None
        else:
            lone = "".join(c for c in "\n\t\r" if not any(c in p for p in long))
            self.cut = re.compile(
                f"[{re.escape(lone)}]|{META}*[^{META}{re.escape(lone)}]+|{META}+" if lone else f"{META}*[^{META}]+|{META}+"
            )

    def normalize(self, text: str) -> str:
        return ((" " if self.dummy_prefix else "") + text).replace(" ", META) if text else ""

    def segments(self, text: str) -> list[str]:
        norm = self.normalize(text)
        return self.cut.findall(norm) if self.cut else [norm] * bool(norm)

    def encode_segment(self, segment: str) -> list[int]:
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, agenda = self.scores, []
        for i in range(n - 1):
            score = scores.get(joined := symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((-score, i, i + 1, joined))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != joined:
                continue  # one of the two was merged meanwhile
            symbols[left], symbols[right] = joined, None
            after[left] = nxt = after[right]
            if nxt >= 0:
                before[nxt] = left
            for a, b in ((before[left], left), (left, nxt)):
                if a >= 0 and b >= 0 and (score := scores.get(both := symbols[a] + symbols[b])) is not None:
                    heapq.heappush(agenda, (-score, a, b, both))
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if (known := self.ids.get(s)) is not None:
                out.append(known)
            elif self.byte_fallback:
                out += [self.byte_ids[b] for b in s.encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        return [i for s in self.segments(text or "") for i in self.encode_segment(s)] + [self.eos] * end

    def _raw(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(_from_bytes(bytes(run)))
                run.clear()
            if self.kinds[i] == NORMAL:
                out.append(self.pieces[i].replace(META, " "))
            elif self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
        return "".join(out) + (_from_bytes(bytes(run)) if run else "")

    def decode(self, ids: list[int]) -> str:
        raw = self._raw(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        marked = first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(META)
        return raw[1:] if self.dummy_prefix and marked else raw


def _from_bytes(run: bytes) -> str:
    """UTF-8, with a replacement character for each byte that is part of no valid character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


class _Tables:
    """Encoded segments of one worker: ids as text, and what they decode to where that is not the segment itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = PieceModel(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: dict[str, str] = {}
        self.other: dict[str, str] = {}

    def learn(self, new: list[str]) -> None:
        """Encodes segments not met so far and holds them against the library in one call."""
        model, lead = self.model, 1 if self.model.dummy_prefix else 0
        # the library puts the dummy prefix before what it is given, so a segment with a leading meta symbol goes in without it
        with_meta = [s for s in new if s[0] == META or not lead]
        rest = [s for s in new if not (s[0] == META or not lead)]
        meta_id = model.ids.get(META)
        for group, cut in ((with_meta, lead), (rest, 0)):
            given = [(s[cut:] if cut else s if not lead else "\n" + s).replace(META, " ") for s in group]
            theirs = self.library.encode(given, num_threads=1)
            for s, ids in zip(group, theirs):
                own = model.encode_segment(s)
                if cut and len(s) == cut:
                    ids = own if s == META and own == [meta_id] else ids
                elif not cut and lead:  # the line feed and the dummy prefix before it
                    ids = ids[len(model.encode_segment(META)) + len(model.encode_segment("\n")) :]
                if own != ids:
                    raise ValueError(f"segment {s!r}: {own} here, {ids} in the library")
                self.text[s] = " ".join(map(str, own))
                if (plain := model._raw(own)) != s.replace(META, " "):
                    self.other[s] = plain

    def forget(self, new: set[str]) -> None:
        """Drops the new segments that the table has no room for, or that are long."""
        room = TABLE_SIZE - len(self.text) + len(new)
        for s in new:
            if room <= 0 or len(s) > TABLE_LONGEST:
                del self.text[s]
                self.other.pop(s, None)
            room -= 1


_TABLES: dict[str, _Tables] = {}


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text (and ids as an array with keep_ids), the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _TABLES.get(model_path) or _TABLES.setdefault(model_path, _Tables(model_path))
        end = str(t.model.eos)
        sha = hashlib.sha256
        for batch in batches:
            for part in steps(batch, "text", STEP):
                cut = [t.model.segments(x or "") for x in part.column("text").to_pylist()]
                new = set().union(*cut).difference(t.text)
                t.learn(list(new))
                counts, digests, plains, ids = [], [], [], []
                for segs in cut:
                    joined = " ".join([*map(t.text.__getitem__, segs), end])
                    plain = "".join([t.other.get(s, s) for s in segs] if t.other else segs).replace(META, " ")
                    counts.append(joined.count(" ") + 1)
                    digests.append(sha(joined.encode()).hexdigest())
                    plains.append(sha((plain[1:] if t.model.dummy_prefix and plain[:1] == " " else plain).encode()).hexdigest())
                    if keep_ids:
                        ids.append(np.fromstring(joined, dtype=np.int32, sep=" "))
                t.forget(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(plains, pa.string()),
                        *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
