"""Line deduplication with a tree of log templates.

A line is its tokens, with tokens that hold a digit taken as variable. The tree has fixed depth: number of tokens, then the
leading tokens. In a leaf, lines that agree in SIMILAR tenths of the positions after the leading ones are similar, and lines that
such steps connect are a group. A template is a pattern and not a chain: a group whose lines don't all agree in that many
positions is parted by its tokens in as many positions, those that vary least (the commonest token is held by the most
lines; ties: the first position). So the lines of a template always have SIMILAR tenths of their free positions in common; where they
differ, its tokens are variable. A template that MIN_DOCUMENTS distinct documents hold is boilerplate or a repeated
passage: its lines are dropped.

Similar lines are found by the pigeonhole principle. Two lines that may differ in m positions agree on a whole one of m + 1
blocks of the positions after the leading ones, so only lines that share a block are compared, and of blocks with the same
lines only one. Lines that share a block are compared in pieces of about GROUP; each task reports a spanning forest, and the
components of all forests are the groups. So templates don't depend on GROUP or on how lines are dealt.

Rows with equal sequences of lines (digits made equal) are one document to the count, so copies of a text neither make a
template recur nor keep it from that. A document that would lose more than MOST_DROPPED per cent of its words stays whole:
it is a copy or a near copy of others, which is for near deduplication to settle, not a page with boilerplate.

Defined results: a null text stays null and has no lines, an empty one stays empty; lines without a token are kept. Rows
with equal or null doc_id are documents of their own. Other columns than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from datakiln.llm.common import DOCUMENT_COLUMNS, in_pieces, numbered, saved, steps, table
from datakiln.llm.line_rules import without_lines
from datakiln.llm.simhash import components, joined_up

#: Leading tokens in the path to a leaf; tenths of the positions after them in which lines of a template agree.
DEPTH, SIMILAR = 3, 7
MIN_DOCUMENTS, MOST_DROPPED = 4, 50
#: Lines of a block compared with as many at once, lines a task takes, and cells of a comparison held in memory.
GROUP, SHARD, CELLS = 2000, 10_000, 1 << 18
#: Leaves that are few enough to be sent to every task.
FEW_LEAVES = 500_000
#: Bytes of text tokenised at once.
STEP = 2 << 20
ANY = b"<*>"
_DIGIT = re.compile(rb"\d")


def masked(line: bytes) -> list[bytes]:
    """Tokens, with those that hold a digit made variable."""
    return [ANY if _DIGIT.search(t) else t for t in line.split()] if _DIGIT.search(line) else line.split()


def _hash(data: bytes) -> int:
    """The value of Spark's xxhash64 of the string."""
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def line_key(line: bytes) -> int | None:
    """Hash of the masked line; None if it has no token."""
    tokens = masked(line)
    return _hash(b" ".join(tokens)) if tokens else None


def leaf_key(tokens: list[bytes]) -> int:
    """Hash of the path to the leaf: number of tokens and the leading ones."""
    return _hash(b" ".join([str(len(tokens)).encode(), *tokens[:DEPTH]]))


#: What a text gives, after row.
FACTS = {
    "copy": pa.int64(),
    "n_lines": pa.int64(),
    "n_words": pa.int64(),
    "lines": pa.list_(pa.struct([("key", pa.int64()), ("leaf", pa.int64()), ("n", pa.int64())])),
}


def line_facts(text: str | None) -> tuple:
    """The values of FACTS for a text."""
    found: dict[int, list[int]] = {}
    keys, n_words = [], 0
    for line in (text or "").encode().split(b"\n"):
        if tokens := masked(line):
            key = _hash(b" ".join(tokens))
            keys.append(key)
            n_words += len(tokens)
            if key in found:
                found[key][1] += len(tokens)
            else:
                found[key] = [leaf_key(tokens), len(tokens)]
    copy = _hash(np.array(keys, dtype=np.int64).tobytes())
    return copy, len(keys), n_words, [{"key": k, "leaf": leaf, "n": n} for k, (leaf, n) in found.items()]


def _facts(docs: DataFrame) -> DataFrame:
    """row and FACTS of each (row, text)."""
    rows = docs.select("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                columns = zip(*map(line_facts, part.column("text").to_pylist()))
                values = [pa.array(c, kind) for c, kind in zip(columns, FACTS.values())]
                yield pa.RecordBatch.from_arrays([part.column("row"), *values], names=["row", *FACTS])

    schema = StructType([rows.schema["row"], *from_arrow_schema(pa.schema(list(FACTS.items()))).fields])
    return saved(rows.mapInArrow(run, schema), "line-keys")


def _texts(docs: DataFrame, leaves: np.ndarray | None) -> DataFrame:
    """key, leaf, body: the distinct masked lines of each step with more than DEPTH tokens, in the given leaves or in all."""
    shared = docs.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for part in steps(batch, "text", STEP):
                texts = [(text or "").encode() for text in part.column("text").to_pylist()]
                lines = [tokens for text in texts for line in text.split(b"\n") if len(tokens := masked(line)) > DEPTH]
                leaf = np.fromiter(map(leaf_key, lines), dtype=np.int64, count=len(lines))
                at = range(len(lines)) if wanted is None else np.flatnonzero(np.isin(leaf, wanted)).tolist()
                found = {}
                for i in at:
                    body = b" ".join(lines[i])
                    found[_hash(body)] = (int(leaf[i]), body)
                leaf_of, bodies = zip(*found.values()) if found else ((), ())
                columns = [pa.array(list(found), pa.int64()), pa.array(leaf_of, pa.int64()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "leaf", "body"])

    return docs.select("text").mapInArrow(run, "key long, leaf long, body binary")


def needed(n: int) -> int:
    """In how many of the positions after the leading ones two lines of n tokens agree at least, if they are similar."""
    return -(-SIMILAR * (n - DEPTH) // 10)


def spans(n: int) -> list[tuple[int, int]]:
    """Blocks of the positions after the leading ones, of which similar lines of n tokens share a whole one."""
    free, blocks = n - DEPTH, n - DEPTH - needed(n) + 1
    return [(DEPTH + free * i // blocks, DEPTH + free * (i + 1) // blocks) for i in range(blocks)]


def block_keys(leaf: int, body: bytes) -> list[int]:
    """Hashes of a line's blocks: the leaf, the block's place and its tokens."""
    tokens = body.split(b" ")
    head = leaf.to_bytes(8, "little", signed=True)
    return [_hash(b"%s%d %s" % (head, a, b" ".join(tokens[a:b]))) for a, b in spans(len(tokens))]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "body", STEP):
            names, lines = [], []
            for key, leaf, body in zip(*(part.column(c).to_pylist() for c in ("key", "leaf", "body"))):
                got = block_keys(leaf, body)
                names += got
                lines += [key] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lines, pa.int64())], names=["block", "key"])


def similar_links(keys: np.ndarray, bodies: list[bytes], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as keys, of the links between the lines marked first and those marked second.

    All lines have the same number of tokens and agree in the leading ones.
    """
    rows = [b.split(b" ")[DEPTH:] for b in bodies]
    width = len(rows[0])
    number: dict[bytes, int] = {}
    ids = np.array([[number.setdefault(t, len(number)) for t in r] for r in rows], dtype=np.int32).reshape(len(rows), width)
    a, b = np.flatnonzero(first), np.flatnonzero(second)
    need = needed(width + DEPTH)
    columns = np.ascontiguousarray(ids[b].T)
    parent, us, vs = np.arange(len(rows)), [], []
    step = max(1, CELLS // max(1, len(b)))
    for k in range(0, len(a), step):
        some = a[k : k + step]
        if len(some) * len(b) * width <= CELLS:
            agree = (ids[some][:, None, :] == ids[b][None, :, :]).sum(axis=2)
        else:
            agree = np.zeros((len(some), len(b)), dtype=np.int32)
            for p in range(width):
                agree += ids[some, p][:, None] == columns[p][None, :]
        i, j = np.nonzero(agree >= need)
        u, v = some[i], b[j]
        apart = parent[u] != parent[v]
        u, v = u[apart], v[apart]
        used = joined_up(parent, u, v)
        us.append(u[used]), vs.append(v[used])
    none = np.zeros(0, np.int64)
    return keys[np.concatenate([none, *us])], keys[np.concatenate([none, *vs])]


def _compared(shard: pd.DataFrame) -> pd.DataFrame:
    """u, v: the forests of a shard's groups. shard: grp, key, body, first, second."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(shard.grp.to_numpy(), kind="stable")
    grp, keys, bodies = shard.grp.to_numpy()[order], shard.key.to_numpy()[order], shard.body.to_numpy()[order]
    first, second = shard["first"].to_numpy()[order], shard["second"].to_numpy()[order]
    cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 1:
            u, v = similar_links(keys[a:b], bodies[a:b].tolist(), first[a:b], second[a:b])
            us.append(u), vs.append(v)
    return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})


def line_links(bodies: DataFrame) -> DataFrame:
    """u, v: links that connect the keys of (key, leaf, body) lines as all pairs of similar lines of a leaf would."""
    blocks = saved(bodies.mapInArrow(_blocks, "block long, key long"), "blocks")
    sums = [F.count("*").alias("size"), *(F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"x{k}") for k in (1, 2))]
    sizes = blocks.groupBy("block").agg(*sums).where("size > 1")
    sizes = sizes.groupBy("size", "x1", "x2").agg(F.min("block").alias("block")).select("block", "size")
    sizes = saved(sizes, "block-sizes")  # written, so that a hot block can be split in the join
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = in_pieces(blocks, sizes, ["block"], "key", GROUP)
    first, second = (F.col("own") == low).alias("first"), (F.col("own") == high).alias("second")
    dealt = dealt.select("key", F.xxhash64("block", low, high).alias("grp"), first, second)
    n = sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / GROUP))).first()[0] or 0
    shards = max(1, -(-n // SHARD), bodies.sparkSession.sparkContext.defaultParallelism)
    rows = dealt.join(bodies.select("key", "body"), "key").withColumn("shard", F.pmod("grp", F.lit(shards)))
    return rows.groupBy("shard").applyInPandas(_compared, "u long, v long")


def parsed(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """key, template: the template, named by the least key of its lines, of the lines that share theirs with others."""
    keys = facts.select(F.explode("lines").alias("l")).select("l.key", "l.leaf").groupBy("key", "leaf").agg(F.count("*").alias("n"))
    leaves = saved(keys.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1").select("leaf"), "leaves")
    if leaves.count() <= FEW_LEAVES:
        lines = _texts(docs, np.sort(leaves.toPandas().leaf.to_numpy(dtype=np.int64)))
    else:
        lines = _texts(docs, None).join(leaves, "leaf", "left_semi")
    bodies = saved(lines.groupBy("key", "leaf").agg(F.first("body").alias("body")), "bodies")
    groups = components(line_links(bodies)).select(F.col("node").alias("key"), F.col("root").alias("template"))
    return parted(saved(groups.join(bodies.select("key", "body"), "key"), "line-groups"))


def parted(groups: DataFrame) -> DataFrame:
    """key, template of (key, template, body): groups whose lines have too little in common, cut into templates that have enough."""
    tokens = F.split(F.col("body").cast("string"), " ")
    each = groups.select("template", F.posexplode(tokens).alias("at", "token")).groupBy("template", "at", "token").agg(F.count("*").alias("n"))
    places = each.groupBy("template", "at").agg(F.max("n").alias("most"), F.count("*").alias("tokens"))
    free = places.where(F.col("at") >= DEPTH)
    need = F.ceil(F.lit(SIMILAR) * F.count("*") / 10)
    # positions in order: those that vary least first
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("most")).alias("most"), "at"))).alias("order")
    loose = free.groupBy("template").agg(need.alias("need"), F.count_if(F.col("tokens") == 1).alias("kept"), ordered).where("kept < need")
    # written, so that a hot group can be split in the join
    loose = saved(loose.select("template", F.transform(F.slice("order", F.lit(1), F.col("need").cast("int")), lambda x: x["at"]).alias("by")), "loose")
    met = groups.join(loose, "template", "left").withColumn("tokens", tokens)
    part = F.when(F.col("by").isNotNull(), F.xxhash64(F.transform("by", lambda i: F.get("tokens", i))))
    named = met.select("key", "template", part.alias("part"))
    whole = named.where("part IS NULL").select("key", "template")
    cut = named.where("part IS NOT NULL")
    least = saved(cut.groupBy(F.col("template").alias("of"), F.col("part").alias("p")).agg(F.min("key").alias("first")), "cut-groups")
    apart = cut.join(least, (F.col("template") == F.col("of")) & (F.col("part") == F.col("p"))).select("key", F.col("first").alias("template"))
    return whole.union(apart)


def patterns(members: DataFrame) -> DataFrame:
    """template, pattern of (template, body) lines: the tokens in which all its lines agree, <*> elsewhere."""
    tokens = members.select("template", F.posexplode(F.split(F.col("body").cast("string"), " ")).alias("at", "token"))
    least, most = F.min("token"), F.max("token")
    each = tokens.groupBy("template", "at").agg(F.when(least == most, least).otherwise(ANY.decode()).alias("token"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "token")))
    return each.groupBy("template").agg(F.concat_ws(" ", F.transform(ordered, lambda x: x.token)).alias("pattern"))


def recurring(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The facts of docs (row, text), and (row, drop): the keys of the lines to drop of each row that has any."""
    facts = _facts(docs)
    own = ("row", "copy", "n_words")
    lines = facts.select(*own, F.explode("lines").alias("l")).select(*own, "l.key", "l.n")
    lines = lines.join(parsed(docs, facts), "key", "left").withColumn("template", F.coalesce("template", "key"))
    lines = saved(lines, "line-templates")
    counts = lines.groupBy("template").agg(F.count_distinct("copy").alias("n_documents"))
    gone = saved(counts.where(F.col("n_documents") >= min_documents).select("template"), "recurring")
    met = lines.join(gone, "template", "left_semi")
    drop = met.groupBy("row", "n_words").agg(F.sum("n").alias("n"), F.collect_set("key").alias("drop"))
    return facts, drop.where(100 * F.col("n") <= MOST_DROPPED * F.col("n_words")).select("row", "drop")


def apply_templates(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All documents, without the lines of recurring templates."""
    rows = numbered(docs.select(*DOCUMENT_COLUMNS))
    drop = recurring(rows, min_documents)[1]
    return without_lines(rows.join(drop, "row", "left"), line_key).select(*DOCUMENT_COLUMNS)


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, n_lines (with a token) and n_dropped."""
    rows = numbered(table(spark, sf_dir, "documents", "doc_id", "text"))
    facts, drop = recurring(rows)
    judged = rows.join(facts.select("row", "n_lines"), "row").join(drop, "row", "left")
    return without_lines(judged, line_key).select("doc_id", "text", "n_lines", "n_dropped")
