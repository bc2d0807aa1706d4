"""Near duplicates by SimHash fingerprints and BK-trees.

A fingerprint has 64 bits; two link if at most `radius` bits differ. Equal fingerprints are one node from the start, so
copies cost nothing. Fingerprints are dealt to groups in which linked ones meet, and a shard holds a forest of BK-trees, one
per group: a child hangs below its parent under the integer Hamming distance between the two, and a search follows only the
edges whose label lies within the radius of the distance just measured. Trees are built and searched level by level over
whole shards. A group of more than GROUP fingerprints is cut into pieces of about GROUP; a tree is built over each piece and
searched with each piece, so no task holds more than two pieces of one group. Of groups with the same members one is enough.

Groups at a small radius are blocks of bits: by the pigeonhole principle two fingerprints within the radius agree on a whole
one of radius + 1 blocks. That is exact. In the five-word stage, where texts that share 0.8 of their shingles differ in up to
about 17 bits and blocks tell nothing apart, a group is the documents that have a shingle hash among their BOTTOM least ones:
two texts that share 0.8 of their shingles have none of these in common with a chance of at most 0.2 ** BOTTOM (0.0016), and
unlike texts only meet where they share a passage, so the work grows with the documents and not with their square. A link
within the radius counts there if the sketches of the texts agree. Recall is measured against brute force in the tests.

A shard reports a spanning forest, not pairs. Components of what the shards report are found by alternating large-star
and small-star rounds, each written to the shared folder. Trees are shipped to the shard that searches them rather than
broadcast whole, because their total size grows with the input.

Defined results: null and empty texts and texts without a word have fingerprint zero and are linked like any other. Rows
with a null doc_id take part; a component of such rows alone has a null id. Repeated rows each give a result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from datakiln.llm.common import DOCUMENT_COLUMNS, in_pieces, numbered, remove, saved, steps, table

SEED = 42
#: The five-word stage: bits that may differ, least hashes that are groups, sketch size and the share of it that must
#: agree. Texts that share 0.8 of their shingles share 0.89 of their sketches, give or take 0.05.
WIDE_SHINGLE, WIDE_RADIUS, BOTTOM, SKETCH, AGREE = 5, 17, 4, 48, 0.78
GROUP = 4096
#: Fingerprints a shard holds, about, and pairs whose sketches are compared at once.
SHARD, PAIRS = 100_000, 1 << 14
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of the text; of the whole sequence if it has fewer words; none if it has no word."""
    words = (text or "").encode().translate(_LOWER).split()
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), dtype=np.uint64, count=len(starts))


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, from the highest bit down."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned fingerprint: bit set if it is set in over half of the shingles' XXH64."""
    hashes = shingle_hashes(text, shingle)
    return int.from_bytes(np.packbits(2 * votes(hashes) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                fps = np.array([fingerprint(x, shingle) for x in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fps)], names=[*keep, "fp"])

    rows = docs.select(*keep, "text")
    return rows.mapInArrow(run, rows.select(*keep).schema.add("fp", "long"))


class Forest:
    """BK-trees over several groups at once, built and searched a level at a time.

    keys: 64-bit values; group: the tree each belongs to. Children of a node are found by (node, distance) in a sorted table.
    """

    def __init__(self, keys: np.ndarray, group: np.ndarray) -> None:
        self.keys = keys
        self.roots, first = np.unique(group, return_index=True)
        self.root_node = first
        parent, label, node = [], [], []
        waiting = np.setdiff1d(np.arange(len(keys)), first)
        at = first[np.searchsorted(self.roots, group[waiting])]
        while len(waiting):
            edge = at * 65 + np.bitwise_count(keys[waiting] ^ keys[at]).astype(np.int64)
            edges, head, back = np.unique(edge, return_index=True, return_inverse=True)
            child = waiting[head]
            parent.append(edges // 65), label.append(edges % 65), node.append(child)
            rest = np.ones(len(waiting), dtype=bool)
            rest[head] = False
            waiting, at = waiting[rest], child[back[rest]]
        edge = np.concatenate(parent) * 65 + np.concatenate(label) if parent else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], np.concatenate(node)[order] if node else np.zeros(0, np.int64)

    def search(self, keys: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, by level."""
        pos = np.searchsorted(self.roots, group)
        known = (pos < len(self.roots)) & (self.roots[np.minimum(pos, len(self.roots) - 1)] == group)
        query = np.flatnonzero(known)
        node = self.root_node[pos[query]]
        while len(query):
            d = np.bitwise_count(keys[query] ^ self.keys[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            query, low, n = query[n > 0], low[n > 0], n[n > 0]
            node = self.child[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            query = np.repeat(query, n)


def joined_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unites a[i] with b[i] in parent, in place; a root is the smallest of its set. Gives the i that joined two sets."""
    at, used = np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        x, y = parent[a[at]], parent[b[at]]
        at, x, y = at[x != y], x[x != y], y[x != y]
        if not len(at):
            return np.concatenate(used)
        upper, first = np.unique(np.maximum(x, y), return_index=True)  # each set hangs below one smaller one
        parent[upper] = np.minimum(x, y)[first]
        used.append(at[first])


class Sketches:
    """Sketches cut to the low 32 bits of each hash: two that agree in whole agree here."""

    def __init__(self, packed: list[bytes]) -> None:
        self.size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        self.values = np.zeros((len(packed), SKETCH), dtype=np.uint32)
        filled = np.arange(SKETCH) < self.size[:, None]
        self.values[filled] = np.frombuffer(b"".join(packed), dtype="<u4")
        self.bits = np.zeros((len(packed), 2), dtype=np.uint64)  # which values modulo 128 there are
        for k in range(SKETCH):
            for word in range(2):
                has = filled[:, k] & (self.values[:, k] >> np.uint32(6) & np.uint32(1) == word)
                self.bits[has, word] |= np.uint64(1) << (self.values[has, k] & np.uint32(63)).astype(np.uint64)

    def agree(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether the sketches u[i] and v[i] share AGREE of the smaller one."""
        need = AGREE * np.minimum(self.size[u], self.size[v])
        # a value whose bit the other one lacks isn't shared
        out = self.size[u] - np.bitwise_count(self.bits[u] & ~self.bits[v]).sum(axis=1, dtype=np.int64) >= need
        at = np.flatnonzero(out)
        both = []
        for side, x in enumerate((u[at], v[at])):
            none = np.arange(SKETCH, dtype=np.uint64) + np.uint64((side + 1) << 32)  # like nothing else
            both.append(np.where(np.arange(SKETCH) < self.size[x][:, None], self.values[x].astype(np.uint64), none))
        met = np.sort(np.concatenate(both, axis=1), axis=1)
        out[at] = (met[:, 1:] == met[:, :-1]).sum(axis=1) >= need[at]
        return out


def forest_links(shard: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning forest of the links within a shard. shard: fp; grp, the tree it takes part in; in_tree and as_query.

    With a column sketch (values of Sketches) only links whose sketches agree count.
    """
    fps, first, number = np.unique(shard.fp.to_numpy(), return_index=True, return_inverse=True)
    sketches = Sketches(shard.sketch.iloc[first].tolist()) if "sketch" in shard else None
    grp = np.unique(shard.grp.to_numpy(), return_inverse=True)[1].astype(np.int64)
    keys = shard.fp.to_numpy().view(np.uint64)
    tree, query = shard.in_tree.to_numpy(), np.flatnonzero(shard.as_query.to_numpy())
    parent, us, vs = np.arange(len(fps)), [], []
    members = np.flatnonzero(tree)
    forest = Forest(keys[members], grp[members])
    for k in range(0, len(query), 1024):
        q = query[k : k + 1024]
        for asked, node in forest.search(keys[q], grp[q], radius):
            all_u, all_v = number[q[asked]], number[members[node]]
            for i in range(0, len(all_u), PAIRS):
                u, v = all_u[i : i + PAIRS], all_v[i : i + PAIRS]
                apart = parent[u] != parent[v]
                u, v = u[apart], v[apart]
                if sketches is not None and len(u):
                    alike = sketches.agree(u, v)
                    u, v = u[alike], v[alike]
                if len(u):
                    used = joined_up(parent, u, v)
                    us.append(fps[u[used]]), vs.append(fps[v[used]])
    none = np.zeros(0, np.int64)
    return pd.DataFrame({"u": np.concatenate([none, *us]), "v": np.concatenate([none, *vs])})


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks of bits that make up 64."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """u, v: links that connect the distinct fingerprints (column fp) within the radius exactly as all pairs would."""
    blocks = []
    for i, (shift, width) in enumerate(_blocks(radius)):
        mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(mask)
        blocks.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
    members = nodes.select("fp", F.explode(F.array(*blocks)).alias("b")).select("fp", "b.*")
    return _shard_links(members, ["block", "value"], radius)


def sketched_links(nodes: DataFrame, radius: int) -> DataFrame:
    """u, v: links within the radius between texts with a hash in common among their least and with sketches that agree.

    nodes: fp and sketch, the least hashes in ascending order. Shards compare 32 bits of each hash; what they report is
    confirmed with all 64.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("sketch")
            low = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).astype("<u4")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            ends = (np.concatenate(([0], np.cumsum(sizes))) * 4).astype(np.int32)
            values = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(low)])
            yield pa.RecordBatch.from_arrays([b.column("fp"), values], names=["fp", "sketch"])

    members = saved(nodes.select("fp", F.explode(F.slice("sketch", 1, BOTTOM)).alias("value")), "least-hashes")
    found = _shard_links(members, ["value"], radius, nodes.select("fp", "sketch").mapInArrow(packed, "fp long, sketch binary"))
    u, v = (nodes.select(F.col("fp").alias(s), F.col("sketch").alias(f"sketch_{s}")) for s in "uv")
    both = saved(found.distinct(), "links").join(u, "u").join(v, "v")
    shared = F.size(F.array_intersect("sketch_u", "sketch_v"))
    return both.where(shared >= AGREE * F.least(F.size("sketch_u"), F.size("sketch_v"))).select("u", "v")


def dealt_groups(members: DataFrame, at: list[str]) -> tuple[DataFrame, int]:
    """fp, grp (a group's pair of pieces), in_tree, as_query of the members (fp, at) of groups, and the number of rows.

    The piece with the smaller number is the tree and the other one asks; a piece also asks itself.
    """
    sums = [F.count("*").alias("size"), *(F.bit_xor(F.xxhash64("fp", F.lit(k))).alias(f"x{k}") for k in (1, 2))]
    sizes = members.groupBy(*at).agg(*sums).where("size > 1")
    sizes = sizes.groupBy("size", "x1", "x2").agg(F.min(F.struct(*at)).alias("first")).select("first.*", "size")
    sizes = saved(sizes, "group-sizes")  # written, so that a hot group can be split in the join
    low, high = F.least("own", "other"), F.greatest("own", "other")
    in_tree, as_query = (F.col("own") == low).alias("in_tree"), (F.col("own") == high).alias("as_query")
    met = in_pieces(members, sizes, at, "fp", GROUP)
    n = sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / GROUP))).first()[0] or 0
    return met.select("fp", F.xxhash64(*at, low, high).alias("grp"), in_tree, as_query), int(n)


def _shard_links(members: DataFrame, at: list[str], radius: int, sketches: DataFrame | None = None) -> DataFrame:
    """u, v: forests of the links among the members (fp, at) of each group."""
    dealt, n = dealt_groups(members, at)
    if sketches is not None:
        dealt = dealt.join(sketches, "fp")
    shards = max(1, -(-n // SHARD), members.sparkSession.sparkContext.defaultParallelism)
    rows = dealt.withColumn("shard", F.pmod(F.col("grp"), F.lit(shards)))
    return rows.groupBy("shard").applyInPandas(lambda pdf: forest_links(pdf, radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that has a link; root is the smallest node of its component.

    Large-star hangs each node's larger neighbours below its smallest; small-star hangs a node and its smaller neighbours
    below the smallest. Both only aggregate and join. A hub is pre-aggregated, and its least neighbour is written before it
    is joined, so that adaptive execution can split the join of a hub with very many neighbours.
    """
    spark = edges.sparkSession
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    mark = signature(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        turned = F.col("v").alias("u"), F.col("m").alias("v")
        large = saved(both.join(least, "u").where("v > u").select(*turned).distinct(), "large-star")
        smallest = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        smaller = large.join(smallest, "u").where("v > m").select(*turned)
        after = saved(smaller.union(smallest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(spark, *(x.saved_path for x in (now, least, large, smallest)))
        now, (before, mark) = after, (mark, signature(after))
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def with_component(
    prints: DataFrame, radius: int, label: Column, name: str = "component_id", linked: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """prints (with fp) and the smallest label of each row's component; linked gives other links than those of links()."""
    extra = [F.min(c).alias(c) for c in ("sketch",) if c in prints.columns]
    nodes = saved(prints.groupBy("fp").agg(F.min(label).alias("label"), *extra), "nodes")
    roots = components(linked(nodes) if linked else links(nodes, radius))
    by_root = nodes.join(roots, nodes.fp == roots.node).select("fp", "root", "label")
    least = by_root.groupBy("root").agg(F.min("label").alias(name))
    moved = by_root.join(least, "root").select(F.col("fp").alias("f"), name)
    full = nodes.join(moved, nodes.fp == moved.f, "left").select(F.col("fp").alias("f"), F.coalesce(name, "label").alias(name))
    # both sides are dealt for this join, so a hot one can be split
    return prints.join(saved(full, "labels"), F.col("fp") == F.col("f")).drop("f")


def wide_prints(docs: DataFrame) -> DataFrame:
    """row, doc_id, fp and sketch (the SKETCH least hashes, ascending) of each (row, doc_id, text), on five-word shingles."""
    rows = docs.select("row", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                fps, sketches = [], []
                for text in part.column("text").to_pylist():
                    hashes = shingle_hashes(text, WIDE_SHINGLE)
                    fps.append(int.from_bytes(np.packbits(2 * votes(hashes) > len(hashes)).tobytes(), "big"))
                    sketches.append(np.unique(hashes)[:SKETCH].view(np.int64))
                columns = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sketches, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=["row", "doc_id", "fp", "sketch"])

    return rows.mapInArrow(run, rows.select("row", "doc_id").schema.add("fp", "long").add("sketch", ArrayType(LongType())))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents with one of each group of near duplicates, the one with the smallest doc_id (null last).

    Links found by fingerprint are confirmed by the texts' sketches, so two unlike texts whose fingerprints are close by
    chance both stay. Documents without a word are copies of each other.
    """
    rows = numbered(docs.select(*DOCUMENT_COLUMNS))
    prints = saved(wide_prints(rows), "wide-prints")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    member = with_component(prints, WIDE_RADIUS, first, "first", lambda nodes: sketched_links(nodes, WIDE_RADIUS))
    return rows.join(member.where("row <> first.row").select("row"), "row", "left_anti").select(*DOCUMENT_COLUMNS)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    prints = saved(fingerprints(docs, 3), "fingerprints")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return with_component(prints, 2, F.col("doc_id")).select("doc_id", shown, "component_id")
