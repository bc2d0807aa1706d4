"""Token-id output as a content-addressed store.

A rolling hash over the ids cuts each document's id stream into chunks where the content says so, so equal passages give
equal chunks. Unique chunks are stored once, under the digest of their bytes; a document is a recipe, the list of its
chunks; a Merkle root over a document's chunk digests and one over the documents of each recipe file verify that what is
read back is what was written. The store is a folder:

    recipes/  Parquet, files in ascending doc_id order: kind 'doc' rows with doc_id, start, n_tokens, root, chunk digests
              and lengths; a kind 'file' row ends each file with its counts and Merkle root
    bases/    one row per recipe file: the ids before it
    chunks/   Parquet: digest, width (bytes an id), n_ids, payload (little-endian ids)

Reading needs no shuffle of ids: every chunk is read once and checked against its digest, its CRC is shifted to its place
in the document (CRC-32 is linear) and the shifted values are combined by XOR.

Defined results: null and empty texts hold the end id only. Rows with a null doc_id come first. Rows that share a doc_id
are documents of their own, ordered by content; identical rows follow each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.llm.common import new_folder, remove, saved, steps, table

#: Chunk bounds in ids: a cut is possible after LEAST, expected each 2**BITS, forced at MOST.
LEAST, BITS, MOST, WINDOW = 128, 9, 2048, 32
#: Words kept per worker (those met most), bytes of the longest that is kept, bytes of text a step.
TABLE_SIZE, TABLE_LONGEST, STEP = 400_000, 48, 16 << 20

_SEGMENT = re.compile(r"\s*\S+|\s+")
#: White space other than spaces and line feeds, or a line feed next to a space.
_UNEVEN = (*(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"), "\n ", " \n")


#: What a word's end is made of that is learned apart.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A last letter or number that no regex engine classes otherwise.
_LATIN_END = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]\z"


class SegmentEncoder:
    """Ids of whole texts from the tokenizers library, which sees each distinct segment once.

    The byte-level pattern never joins a character to a white space after it, and takes a single space together with what
    follows. So a text whose spaces all stand alone falls into its words, each with the space before it, and words can be
    encoded apart. A line feed between words is a piece of its own and parts them too, and so is punctuation after a letter or
    number: the library sees a word once, whatever ends it. Texts with other white space next to a space are cut before
    white space by a pattern, and those that hold an added token's string, or separators that the two regex engines class
    differently, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads cost time and memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(["[\x1c-\x1f]", *map(re.escape, added)]))
        self.uneven = ("  ", *_UNEVEN, *sorted({t[:2] for t in added}))  # and the openings of added tokens
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.id_type = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.lengths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # bytes: byte-level pieces have a letter a byte
        for piece, i in vocab.items():
            self.lengths[i] = len(piece)
        # words, their ids after a space (a word that begins with a line feed has no space) and how often they were met
        self.words, self.ids, self.met = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.id_type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: pa.Array) -> pa.Array:
        """Encodes words in long rows; the bytes that each token stands for tell where a word ends."""
        pieces = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(" "), words, pa.scalar("")), " \n", "\n")
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(pieces).to_numpy(), dtype=np.int64)))
        text = b"" if not len(words) else pieces.buffers()[2].to_pybytes()
        at = [*range(0, len(words), 256), len(words)]
        rows, raws = [text[ends[i] : ends[j]].decode() for i, j in zip(at, at[1:])], []
        for k in range(0, len(rows), 16):
            raws += self._packed(rows[k : k + 16])
        raw = b"".join(raws)
        stops = np.concatenate(([0], np.cumsum(self.lengths[np.frombuffer(raw, dtype=self.id_type)])))
        cuts = np.searchsorted(stops, ends)
        if stops[-1] != ends[-1] or (stops[cuts] != ends).any():
            raise ValueError("a token spans two words")
        offsets = cuts.astype(np.int64) * self.id_type.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])

    def _learn(self, new: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Ids of new words, and what stands before their punctuation, as far as it is new too, with its ids."""
        cores = pc.ascii_rtrim(new, characters=_PUNCTUATION)
        cut = pc.and_(pc.less(pc.binary_length(cores), pc.binary_length(new)), pc.match_substring_regex(cores, _LATIN_END))
        cores = pc.if_else(cut, cores, new)
        tails = _ends(new.filter(cut), pc.binary_length(cores.filter(cut)).to_numpy()).dictionary_encode()
        tail_ids = pa.array(self._packed(tails.dictionary.to_pylist()), pa.large_binary())
        at, apart = self._places(cores)
        core_ids = self._encoded(apart)
        ids = pa.concat_arrays([self.ids, core_ids]).take(pa.array(at))
        none = pa.scalar(b"", pa.large_binary())
        ends = pc.replace_with_mask(pa.repeat(none, len(new)), cut, tail_ids.take(tails.indices))
        more = pc.invert(pc.is_in(apart, value_set=new))
        return pc.binary_join_element_wise(ids, ends, none), apart.filter(more), core_ids.filter(more)

    def _places(self, words: pa.Array, left_out: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
        """Where words stand in the table, and new ones, which stand behind it; what is left out is at -1."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().copy()
        if left_out is not None:
            at[left_out] = -2
        missed = np.flatnonzero(at == -1).astype(np.int32)
        new = words.take(pa.array(missed)).dictionary_encode()
        at[missed] = len(self.words) + new.indices.to_numpy()
        return np.maximum(at, -1, out=at), new.dictionary

    def _looked_up(self, words: pa.Array, left_out: np.ndarray) -> pa.Array:
        """Ids of the words, none for those left out."""
        at, new = self._places(words, left_out)
        ids, cores, core_ids = self._learn(new)
        n = len(self.words) + len(new)
        at[at < 0] = n
        found = pa.concat_arrays([self.ids, ids, pa.array([b""], pa.large_binary())]).take(pa.array(at))
        met = np.bincount(at, minlength=n)[:n]
        met[: len(self.met)] += self.met
        self._keep(
            pa.concat_arrays([self.words, new, cores]),
            pa.concat_arrays([self.ids, ids, core_ids]),
            np.concatenate((met, np.ones(len(cores), np.int64))),
        )
        return found

    def _keep(self, words: pa.Array, ids: pa.Array, met: np.ndarray) -> None:
        """Of the words those that were met most."""
        kept = np.flatnonzero(pc.binary_length(words).to_numpy() <= TABLE_LONGEST)
        if len(kept) > TABLE_SIZE:
            kept = np.sort(kept[np.argpartition(met[kept], len(kept) - TABLE_SIZE)[len(kept) - TABLE_SIZE :]])
        chosen = pa.array(kept)
        self.words, self.ids, self.met = words.take(chosen), ids.take(chosen), met[kept]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of id_type."""
        out: list = [b""] * len(texts)
        apart, plain, spaced = [], [], []
        for i, x in enumerate(texts):
            if x[-1:] == " " or any(odd in x for odd in self.uneven):
                apart.append(i)
                continue
            plain.append(i)
            # three line feeds, or two at the end, are not a piece each: they stay within a word
            spaced.append(x if "\n\n\n" in x or x[-2:] == "\n\n" else x.replace("\n", " \n"))
        if plain:
            spaced = pa.array(spaced, pa.string())
            words = pc.split_pattern(spaced, " ")
            del spaced
            ends, flat = words.offsets.to_numpy(), words.flatten()
            heads = flat.take(words.offsets[:-1]).dictionary_encode()  # no space before them
            head_ids = self._packed(heads.dictionary.to_pylist())
            ids = self._looked_up(flat, ends[:-1])
            at = np.frombuffer(ids.buffers()[1], np.int64)[ends].tolist()
            data = memoryview(ids.buffers()[2]) if at[-1] else b""
            for i, head, first, end in zip(plain, heads.indices.to_pylist(), at, at[1:]):
                out[i] = b"".join((head_ids[head], data[first:end]))
        for i in apart:
            x = texts[i]
            out[i] = b"".join(self._packed([x] if self.whole.search(x) else _SEGMENT.findall(x)))
        return out


def _ends(words: pa.Array, skipped: np.ndarray) -> pa.Array:
    """What is left of each word after so many bytes."""
    sizes = pc.binary_length(words).to_numpy() - skipped
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][1 : len(words) + 1]
    at = np.repeat(ends - offsets[1:], sizes) + np.arange(offsets[-1])
    data = np.frombuffer(words.buffers()[2], np.uint8)[at] if len(at) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


_GEAR = np.random.Generator(np.random.PCG64(0)).integers(0, 1 << 64, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: a gear hash over the last WINDOW ids, computed by doubling."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    h = _GEAR[ids & 0xFFFF]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint64(width)  # the right side is read before it is changed
        width *= 2
    candidates = np.flatnonzero(h >> np.uint64(64 - BITS) == 0) + 1
    ends, at = [], 0
    for c in candidates.tolist():
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST:
            ends.append(c)
            at = c
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is. No leaves: the digest of nothing."""
    level = leaves
    while len(level) > 1:
        level = [_digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else _digest(b"")


class _Frontier:
    """merkle_root over a stream of leaves: at most one pending node per level."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for k, pending in enumerate(self.levels):
            if pending is None:
                self.levels[k] = node
                return
            self.levels[k], node = None, _digest(b"\x01" + pending + node)
        self.levels.append(node)

    def root(self) -> bytes:
        node = None
        for pending in self.levels:
            if pending is not None:
                node = pending if node is None else _digest(b"\x01" + pending + node)
        return node or _digest(b"")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


_ENCODERS: dict[str, SegmentEncoder] = {}


def _chunked(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encodes and cuts every document; a chunk's payload is left out where the same task has written it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, SegmentEncoder(tokenizer_path))
        end, size = np.array([end_id], dtype=enc.id_type).tobytes(), enc.id_type.itemsize
        met: set[bytes] = set()
        for batch in batches:
            for part in steps(batch, "text", STEP):
                counts, roots, digests, lengths, payloads = [], [], [], [], []
                for raw in enc.encode([x or "" for x in part.column("text").to_pylist()]):
                    raw += end
                    ids = np.frombuffer(raw, dtype=enc.id_type)
                    at, names, sizes, bodies = 0, [], [], []
                    for stop in cut_points(ids):
                        body = raw[at * size : stop * size]
                        name = _digest(bytes([size]) + body)
                        names.append(name)
                        sizes.append(stop - at)
                        bodies.append(None if name in met else body)
                        met.add(name)
                        at = stop
                    counts.append(len(ids))
                    roots.append(merkle_root(names))
                    digests.append(names)
                    lengths.append(sizes)
                    payloads.append(bodies)
                    if len(met) > 1 << 20:
                        met.clear()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array(roots, pa.binary()),
                        pa.array(digests, pa.list_(pa.binary())),
                        pa.array(lengths, pa.list_(pa.int32())),
                        pa.array(payloads, pa.list_(pa.binary())),
                        pa.array([size] * len(counts), pa.int32()),
                    ],
                    names=["doc_id", "n_tokens", "root", "digests", "lengths", "payloads", "width"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, root binary, digests array<binary>, lengths array<int>, payloads array<binary>, width int"
    )


_RECIPE = "kind string, file int, doc_id long, within long, n_tokens long, root binary, digests array<binary>, lengths array<int>"


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of one file in order, with the ids before each in the file, then the file's own row."""
    from pyspark import TaskContext

    file, total, count, tree = TaskContext.get().partitionId(), 0, 0, _Frontier()
    schema = None
    for b in batches:
        n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
        within = total + np.cumsum(n) - n
        total += int(n.sum())
        count += len(n)
        for root in b.column("root").to_pylist():
            tree.add(root)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(["doc"] * len(n)),
                pa.array(np.full(len(n), file, np.int32)),
                b.column("doc_id"),
                pa.array(within),
                pa.array(n),
                *(b.column(c) for c in ("root", "digests", "lengths")),
            ],
            names=["kind", "file", "doc_id", "within", "n_tokens", "root", "digests", "lengths"],
        )
        schema = out.schema
        yield out
    if schema is not None:
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "kind": "file",
                    "file": file,
                    "doc_id": None,
                    "within": count,
                    "n_tokens": total,
                    "root": tree.root(),
                    "digests": [],
                    "lengths": [],
                }
            ],
            schema=schema,
        )


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0) -> None:
    """Encodes (doc_id, text) rows and writes the store to path, a folder that all executors share."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    staged = saved(_chunked(docs, tokenizer_path, end_id), "chunked", compression="zstd")
    order = ["doc_id", "root"]
    recipes = staged.select("doc_id", "n_tokens", "root", "digests", "lengths").repartitionByRange(*order).sortWithinPartitions(*order)
    recipes = saved(recipes.mapInArrow(_filed, _RECIPE), "recipes", f"{path}/recipes")
    before = F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    saved(recipes.where("kind = 'file'").select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base")), "bases", f"{path}/bases")
    parts = staged.select(F.explode(F.arrays_zip("digests", "lengths", "payloads")).alias("c"), "width").where("c.payloads is not null")
    parts = parts.select("c.digests", "width", F.col("c.lengths").alias("n_ids"), F.col("c.payloads").alias("payload"))
    # a digest comes at most once from each task: nothing to combine before the shuffle
    first = F.row_number().over(Window.partitionBy("digest").orderBy("digest"))
    unique = parts.select(
        F.col("digests").alias("digest"), "width", "n_ids", "payload"
    ).repartition("digest").withColumn("nth", first).where("nth = 1").drop("nth")
    unique.write.option("compression", "zstd").parquet(f"{path}/chunks")
    remove(spark, staged.saved_path)


def _poly_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of CRC-32 polynomials (reflected) modulo the generator, element by element."""
    out = np.zeros(len(a), dtype=np.uint32)
    b = b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


def shifted_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a CRC-32 adds to that of a longer string when n_bytes follow it."""
    out = crc.astype(np.uint32)
    power = np.array([0x00800000], dtype=np.uint32)  # x to the 8th: one byte
    left = n_bytes.astype(np.int64).copy()
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _poly_times(out[odd], np.repeat(power, len(odd)))
        power = _poly_times(power, power)
        left >>= 1
    return out


def _chunk_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads chunks: their bytes must match their digest; gives the CRC of their ids as 32-bit integers."""
    for b in batches:
        crcs = []
        for name, size, n, body in zip(*(b.column(c).to_pylist() for c in ("digest", "width", "n_ids", "payload"))):
            if _digest(bytes([size]) + body) != name or len(body) != n * size:
                raise ValueError(f"chunk {name.hex()} is damaged")
            crcs.append(zlib.crc32(np.frombuffer(body, dtype=f"<u{size}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [b.column("digest"), b.column("n_ids"), pa.array(crcs, pa.int64())], names=["chunk", "n_ids", "crc"]
        )


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes to (document, chunk, ids that follow it in the document); the recipe must match its root."""
    for b in batches:
        files, within, names, lengths, after = [], [], [], [], []
        for file, at, root, digests, sizes in zip(*(b.column(c).to_pylist() for c in ("file", "within", "root", "digests", "lengths"))):
            if merkle_root(digests) != root:
                raise ValueError(f"the recipe at {at} of file {file} is damaged")
            total = np.sum(sizes) - np.cumsum(sizes)
            files += [file] * len(sizes)
            within += [at] * len(sizes)
            names += digests
            lengths += sizes
            after += total.tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(files, pa.int32()),
                pa.array(within, pa.int64()),
                pa.array(names, pa.binary()),
                pa.array(lengths, pa.int32()),
                pa.array(after, pa.int64()),
            ],
            names=["file", "within", "digest", "length", "after"],
        )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = b.column("crc").to_numpy(zero_copy_only=False).astype(np.uint32)
        after = b.column("after").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [b.column("file"), b.column("within"), b.column("length"), pa.array(shifted_crc(crc, after * 4).astype(np.int64))],
            names=["file", "within", "length", "crc"],
        )


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPE).parquet(f"{path}/recipes").where("kind = 'doc'")


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """file, base of the recipe files, a row per file; each must be there and sound."""
    bases = spark.read.schema("file int, base long").parquet(f"{path}/bases")
    found = bases.join(verify_files(spark, path), "file", "left")
    if bad := found.where("sound is null or not sound").limit(1).collect():
        raise ValueError(f"recipe file {bad[0].file} of {path} is missing or damaged")
    return F.broadcast(bases)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, width int, n_ids int, payload binary").parquet(f"{path}/chunks")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the chunks read back and verified."""
    facts = _chunks(spark, path).mapInArrow(_chunk_facts, "chunk binary, n_ids int, crc long")
    uses = _recipes(spark, path).select("file", "within", "root", "digests", "lengths").mapInArrow(
        _uses, "file int, within long, digest binary, length int, after long"
    )
    met = uses.join(facts, uses.digest == facts.chunk, "left").select(
        "file",
        "within",
        F.when(F.col("length") == F.col("n_ids"), F.col("length")).otherwise(
            F.raise_error("a chunk is missing or has another length").cast("int")
        ).alias("length"),
        "after",
        "crc",
    )
    placed = met.mapInArrow(_placed, "file int, within long, length int, crc long")
    docs = placed.groupBy("file", "within").agg(F.sum("length").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    ids = _recipes(spark, path).select("file", "within", "doc_id")
    return docs.join(ids, ["file", "within"]).join(_bases(spark, path), "file").select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk payloads of documents in order to lists of ids."""
    for b in batches:
        ids, ends = [np.zeros(0, np.int64)], [0]
        for parts, size in zip(b.column("parts").to_pylist(), b.column("width").to_pylist()):
            got = np.frombuffer(b"".join(parts), dtype=f"<u{size}")
            ids.append(got.astype(np.int64))
            ends.append(ends[-1] + len(got))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
        yield pa.RecordBatch.from_arrays(
            [b.column("file"), b.column("within"), b.column("doc_id"), lists], names=["file", "within", "doc_id", "ids"]
        )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids themselves, put together from the chunks."""
    uses = _recipes(spark, path).select("file", "within", "doc_id", F.posexplode("digests").alias("pos", "digest"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("parts")
    met = uses.join(_chunks(spark, path), "digest").groupBy("file", "within", "doc_id").agg(ordered, F.max("width").alias("width"))
    rows = met.select("file", "within", "doc_id", "parts.payload", "width").withColumnRenamed("payload", "parts")
    found = rows.mapInArrow(_unpacked, "file int, within long, doc_id long, ids array<long>")
    return found.join(_bases(spark, path), "file").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "ids")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams recipe files, each in order with its own row last; holds a node per level of one tree."""
    file, tree, count, tokens = None, _Frontier(), 0, 0
    for b in batches:
        files, docs, sound = [], [], []
        for kind, of, within, n, root in zip(*(b.column(c).to_pylist() for c in ("kind", "file", "within", "n_tokens", "root"))):
            if of != file:
                file, tree, count, tokens = of, _Frontier(), 0, 0
            if kind == "doc":
                tree.add(root)
                count, tokens = count + 1, tokens + n
            else:
                files.append(of), docs.append(count), sound.append(tree.root() == root and count == within and tokens == n)
        columns = [pa.array(files, pa.int32()), pa.array(docs, pa.int64()), pa.array(sound, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "n_docs", "sound"])


def verify_files(spark: SparkSession, path: str) -> DataFrame:
    """file, n_docs, sound: whether each recipe file's counts and Merkle root follow from its recipes."""
    rows = spark.read.schema(_RECIPE).parquet(f"{path}/recipes").select("kind", "file", "within", "n_tokens", "root")
    ordered = rows.repartition("file").sortWithinPartitions("file", "kind", "within")
    return ordered.mapInArrow(_verified, "file int, n_docs long, sound boolean")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "token-store")
    write_store(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_facts(spark, path)
