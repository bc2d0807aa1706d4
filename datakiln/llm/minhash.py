"""MinHash near duplicates: many universal hash minima, banding, signature verification, components.

A document's set is its distinct word shingles. Documents with equal sets are one node from the start, so copies cost
nothing. A node's signature has the minima of BANDS * ROWS universal hashes of its shingles; two nodes are candidates if they agree
in a whole band. Two sets that share 0.8 of their union miss each other with a chance of (1 - 0.8 ** ROWS) ** BANDS (5e-7).
Candidates whose signatures agree in less than AGREE of SIGNED minima are dropped (a chance of 1e-5 at 0.8), and links are
confirmed on the full sets, so no false link remains.

A bucket of a band is never expanded into all its pairs. First each member is compared with the bucket's least
node alone. The components of the confirmed links mostly settle a group of copies. What is left are buckets with members of several
components: there, members of the largest one and the others are cut in pieces of about GROUP, and a task compares the
signatures of one piece of the others with one more piece, across components only. It reports a spanning forest of
the candidates. Last, each component of these forests, cut the same way, comes with its full sets, and a task reports a
spanning forest of the confirmed links. So the sets of a text are sent once for each step and not once for each bucket. The work on a hot
group is its size times the members outside its largest component.

Components are found by alternating large-star and small-star rounds (simhash.components). Sets are not stored: they are
made again from the texts of the nodes that have candidates.

Defined results: null and empty texts and texts without a word have an empty set, are linked with nothing and are kept. A
document with fewer words than a shingle has its whole sequence as one. Rows with a null doc_id take part; a component of
such rows alone has a null id. Repeated rows each give a result and are kept alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from datakiln.llm.common import numbered, saved, steps, table
from datakiln.llm.simhash import components, joined_up, shingle_hashes

SHINGLE, SHARE = 2, 80
ROWS, BANDS, SEED = 6, 48, 13
#: Minima that signatures keep (16 bits of each) and the share of them that candidates agree in at least.
SIGNED, AGREE = 144, 0.66
#: Members of a piece, and hashes of their sets, about.
GROUP, SET_HASHES = 2048, 4 << 20
#: Shingles hashed at once.
BLOCK = 512


class Family:
    """ROWS * BANDS hashes a * x + b of 32-bit values; the high 32 of 64 bits are strongly universal."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.a, self.b = (rng.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) for _ in range(2))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The least value of each hash over the shingles."""
        x = hashes >> np.uint64(32)
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for k in range(0, len(x), BLOCK):
            h = x[k : k + BLOCK, None] * self.a
            h += self.b
            np.minimum(least, h.min(axis=0), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)


def shingle_set(text: str | None) -> np.ndarray:
    """The text's distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, SHINGLE))


def signed(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, digest of the set, bands and sig of each (row, doc_id, text); no digest for empty sets."""
    rows = docs.select("row", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for batch in batches:
            for part in steps(batch, "text"):
                n, digests, bands, sigs = [], [], [], []
                for text in part.column("text").to_pylist():
                    found = shingle_set(text)
                    n.append(len(found))
                    if not len(found):
                        digests.append(None), bands.append(None), sigs.append(None)
                        continue
                    least = family.minima(found)
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    raw = least.tobytes()
                    width = 4 * ROWS
                    bands.append([xxhash.xxh64_intdigest(raw[k : k + width], k) - (1 << 63) for k in range(0, len(raw), width)])
                    sigs.append(least[::2].astype("<u2").tobytes())
                columns = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=["row", "doc_id", "n_shingles", "digest", "bands", "sig"])

    kinds = rows.select("row", "doc_id").schema.add("n_shingles", "long").add("digest", "binary").add("bands", ArrayType(LongType()))
    return saved(rows.mapInArrow(run, kinds.add("sig", "binary")), "minhash", compression="zstd")


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose signatures agree in AGREE of their minima."""
    u, v = (nodes.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}")) for s in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (_signatures(b.column(x)) for x in ("sig_u", "sig_v"))
            yield b.select(["u", "v"]).filter(pa.array((a == c).sum(axis=1) >= AGREE * SIGNED))

    return pairs.join(u, "u").join(v, "v").select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long")


def _signatures(packed: pa.Array | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist() if isinstance(packed, pa.Array) else packed), "<u2").reshape(-1, SIGNED)


def shingle_sets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, set (packed hashes, ascending) of the nodes (node, row), from texts (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                found = [shingle_set(x).tobytes() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], names=["node", "set"])

    return texts.join(nodes.select("node", "row"), "row").select("node", "text").mapInArrow(run, "node long, set binary")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (ascending) share SHARE per cent of their union."""
    if 100 * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= SHARE * (len(a) + len(b) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that their full sets confirm."""
    u, v = (sets.select(F.col("node").alias(s), F.col("set").alias(f"set_{s}")) for s in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, "set_u"):
                columns = (part.column(x).to_pylist() for x in ("set_u", "set_v"))
                fits = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(*columns)]
                yield part.select(["u", "v"]).filter(pa.array(fits, pa.bool_()))

    return pairs.join(u, "u").join(v, "v").select("u", "v", "set_u", "set_v").mapInArrow(run, "u long, v long")


def forest(task: pd.DataFrame, exact: bool) -> pd.DataFrame:
    """u, v: spanning forest of the links among a task's members, of those between different parts only.

    task: node, part (the component it is known to be in), asks, sig, and set if links are to be confirmed on full sets.
    """
    task = task.drop_duplicates("node").sort_values("node", kind="stable")
    node, part = task.node.to_numpy(), np.unique(task.part.to_numpy(), return_inverse=True)[1]
    sigs = _signatures(task.sig.tolist())
    sets = [np.frombuffer(x, np.uint64) for x in task.set] if exact else []
    # confirmed links unite whole parts; candidates don't, as a part's members have links of their own
    parent = part.copy() if exact else np.arange(len(node))
    parent = np.unique(parent, return_index=True)[1][parent] if exact else parent
    us, vs = [], []
    for i in np.flatnonzero(task.asks.to_numpy()).tolist():
        at = np.flatnonzero(part != part[i])
        if exact:
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]
            at = at[parent[at] != parent[i]]
        at = at[(sigs[at] == sigs[i]).sum(axis=1) >= AGREE * SIGNED]
        if exact:
            for j in at.tolist():
                if parent[j] != parent[i] and linked(sets[i], sets[j]):
                    joined_up(parent, np.array([i]), np.array([j]))
                    us.append(node[i]), vs.append(node[j])
        elif len(at):
            used = joined_up(parent, np.full(len(at), i), at)
            us.extend([node[i]] * len(used)), vs.extend(node[at[used]])
    return pd.DataFrame({"u": np.array(us, dtype=np.int64), "v": np.array(vs, dtype=np.int64)})


def split_links(members: DataFrame, at: list[str], weight: Column, limit: int, about: DataFrame, exact: bool) -> DataFrame:
    """u, v: forests of the links between different parts of each group. members: at, node, part; about: node and sig, set.

    The members of a group's largest part and the others are cut in pieces of about limit in weight. A task has a piece of
    the others, which asks, and one other piece.
    """
    by_part = members.groupBy(*at, "part").agg(F.sum(weight).alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"), F.count("*").alias("n"))
    groups = by_part.groupBy(*at).agg(
        F.max_by("part", F.struct("w", "part")).alias("main"), F.max("w").alias("most"), F.sum("w").alias("all"),
        F.bit_xor("x").alias("x"), F.sum("n").alias("n"), F.count("*").alias("parts"),
    ).where("parts > 1")
    # of groups with the same members one is enough
    groups = groups.groupBy("x", "n", "all", "most", "main").agg(F.min(F.struct(*at)).alias("first")).select("first.*", "main", "most", "all")
    cut = lambda w: F.greatest(F.lit(1), F.ceil(w / limit)).cast("int")
    groups = saved(groups.select(*at, "main", cut(F.col("all") - F.col("most")).alias("others"), cut(F.col("most")).alias("mains")), "groups")
    met = members.join(groups, at).withColumn("asks", F.col("part") != F.col("main"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("asks"), F.col("others")).otherwise(F.col("mains"))).cast("int").alias("own")
    met = met.select(*at, "node", "part", "asks", "others", "mains", own)
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # tasks: (piece of the others, piece of the largest part, -1) and (piece of the others, -1, a later piece of the others)
    with_main = F.transform(count("mains"), lambda j: F.struct(F.col("own").alias("a"), j.alias("b"), F.lit(-1).alias("c")))
    among = F.transform(
        F.filter(count("others"), lambda j: j != F.col("own")),
        lambda j: F.struct(F.least("own", j).alias("a"), F.lit(-1).alias("b"), F.greatest("own", j).alias("c")),
    )
    as_main = F.transform(count("others"), lambda j: F.struct(j.alias("a"), F.col("own").alias("b"), F.lit(-1).alias("c")))
    tasks = F.explode(F.when(F.col("asks"), F.concat(with_main, among)).otherwise(as_main))
    dealt = met.select(*at, "node", "part", "asks", tasks.alias("task")).select(F.xxhash64(*at, "task").alias("task"), "node", "part", "asks")
    kind = "u long, v long"
    return dealt.join(about, "node").groupBy("task").applyInPandas(lambda pdf: forest(pdf, exact), kind)


def united(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, part: the nodes with the smallest node of their component."""
    roots = components(edges)
    return saved(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("part")), "parts")


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: links that connect the nodes (node, row, n_shingles, bands, sig) as all pairs that share enough would."""
    band = F.posexplode("bands").alias("band", "value")
    members = nodes.select("node", band)
    buckets = members.groupBy("band", "value").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
    met = saved(members.join(saved(buckets, "buckets"), ["band", "value"]).select("band", "value", "node", "least"), "members")
    # each member with its bucket's least node
    stars = met.where("node > least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct()
    signs = nodes.select("node", "sig")
    stars = saved(agreeing(saved(stars, "stars"), signs), "agreeing")
    with_star = stars.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sure = saved(confirmed(stars, saved(shingle_sets(nodes.join(with_star, "node"), texts), "star-sets")), "sure")
    parts = united(nodes.select("node"), sure)
    # candidates across components
    between = saved(met.select("band", "value", "node").join(parts, "node"), "between")
    near = saved(split_links(between, ["band", "value"], F.lit(1), GROUP, signs, False).distinct(), "near")
    families = components(near).select("node", F.col("root").alias("family"))
    inside = saved(families.join(parts, "node").join(nodes.select("node", "row", "n_shingles"), "node"), "families")
    sets = saved(shingle_sets(inside, texts).join(signs, "node"), "family-sets")
    limit = min(GROUP * 256, SET_HASHES)
    # a set weighs its hashes, and at least what makes GROUP of them fill a piece
    weight = F.greatest("n_shingles", F.lit(256))
    exact = split_links(inside.select("family", "node", "part", "n_shingles"), ["family"], weight, limit, sets, True)
    return sure.union(exact)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document (doc_id, text)."""
    rows = numbered(docs.select("doc_id", "text"))
    facts = signed(rows)
    first = [F.min("doc_id").alias("label"), *(F.first(c).alias(c) for c in ("row", "n_shingles", "bands", "sig"))]
    nodes = facts.where("digest IS NOT NULL").groupBy("digest").agg(*first)
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", compression="zstd")
    parts = united(nodes.select("node"), links(nodes, rows.select("row", "text")))
    labels = nodes.select("node", "digest", "label").join(parts, "node")
    least = labels.groupBy("part").agg(F.min("label").alias("component_id"))
    # written, so that a group of very many copies can be split in the join
    of_set = saved(labels.join(least, "part").select(F.col("digest").alias("set_digest"), "component_id"), "component-of")
    out = facts.select("doc_id", "n_shingles", "digest").join(of_set, F.col("digest") == F.col("set_digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
