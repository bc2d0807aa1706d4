"""Near duplicates by perceptual hash: Hamming pairs, components over cross-origin pairs, and which sample of each stays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datakiln.functions import constants as C
from datakiln.sources.scratch import removed, written

#: Keys a hash is looked up under at most, and cost of a pair that is met, in keys.
MOST_KEYS, PAIR_COST = 100_000, 0.05
#: Cost of a pair that two blocks of hashes compare, in keys; least and most hashes of a block, blocks where neither bound holds.
COMPARE_COST, LEAST_BLOCK, MOST_BLOCK, BLOCKS = 0.002, 2048, 1 << 17, 64
#: Rows up to which the planner may broadcast a table: what is broadcast passes the driver, in each of many joins.
SMALL = 20_000
REASON = "phash_near_duplicate"


def shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, joined by shuffles alone if it or its partner has more than SMALL rows, or it isn't known how many."""
    return df if rows is not None and rows <= SMALL else df.hint("merge")


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def substrings(n: int, threshold: int) -> list[tuple[int, int, int]]:
    """(low, width, radius) of the substrings of 64 bits by which n hashes find all others within the threshold.

    Of m substrings, threshold = m * a + b: were the first b + 1 over a bits apart and the others over a - 1, the whole would be
    over the threshold. So one of the first is within a or one of the others within a - 1, and where a is 0 the others needn't be
    looked at. m is where the keys that are probed and the pairs that they are expected to meet cost least.
    """
    best = None
    for m in range(1, threshold + 2):
        cuts = [64 * i // m for i in range(m + 1)]
        a, b = divmod(threshold, m)
        found = [(x, y - x, a if i <= b else a - 1) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))]
        found = [f for f in found if f[2] >= 0]
        cost = _probing_cost(n, found)
        if sum(_keys(found)) <= MOST_KEYS and (best is None or cost < best[0]):
            best = cost, found
    return best[1]


def _keys(subs: list[tuple[int, int, int]]) -> list[int]:
    """Keys that a hash is looked up under, by substring."""
    return [sum(comb(w, r) for r in range(radius + 1)) for _, w, radius in subs]


def _probing_cost(n: int, subs: list[tuple[int, int, int]]) -> float:
    return n * sum(_keys(subs)) + PAIR_COST * n * n * sum(k / 2.0**w for k, (_, w, _) in zip(_keys(subs), subs))


def _flips(spark: SparkSession, subs: list[tuple[int, int, int]]) -> DataFrame:
    """i, flip: what turns a key of substring i into each key within its radius."""
    signed = lambda bits: sum(1 << k if k < 63 else -(1 << 63) for k in bits)
    rows = [(i, signed(bits)) for i, (_, w, radius) in enumerate(subs) for r in range(radius + 1) for bits in combinations(range(w), r)]
    return spark.createDataFrame(rows, "i int, flip long")


def hash_pairs(hashes: DataFrame, threshold: int) -> DataFrame:
    """a < b, distance of all pairs of the distinct 64-bit numbers h that differ in 1 to threshold bits.

    Substrings of the bits are looked up under all keys within their radius (see substrings), and what is met is verified on
    the whole hash. A pair is reported by the first substring that meets it, so nothing is listed twice. Where the threshold is
    so wide, or the table so small, that this costs more than to compare all pairs in blocks, blocks are compared.
    """
    n = hashes.count()
    subs = substrings(n, threshold)
    if COMPARE_COST * n * n / 2 < _probing_cost(n, subs):
        return block_pairs(hashes, n, threshold)
    return met_pairs(probes(hashes, subs), indexed(hashes, subs), subs, threshold).where("a < b")


def block_pairs(hashes: DataFrame, n: int, threshold: int) -> DataFrame:
    """hash_pairs of about n hashes by comparing every two blocks of them.

    A hash falls into a block by its own hash. A task gets some pairs of blocks and compares a hash with a whole block at once, so
    it holds a few blocks and the pairs of one hash, whatever n. All pairs are compared, but only 16 bytes a hash and block move.
    """
    n_blocks = max(min(BLOCKS, -(-n // LEAST_BLOCK)), -(-n // MOST_BLOCK), 1)
    block = F.pmod(F.xxhash64("h"), F.lit(n_blocks)).cast("int").alias("i")
    packed = written(hashes.groupBy(block).agg(F.collect_list("h").alias("own")))
    left = packed.select("i", "own", F.explode(F.sequence("i", F.lit(n_blocks - 1))).alias("j"))
    pairs = left.join(packed.select(F.col("i").alias("j"), F.col("own").alias("other")), "j")
    n_pairs = n_blocks * (n_blocks + 1) // 2
    dealt = pairs.repartition(max(min(n_pairs, 8 * n_blocks), n_pairs // 16), "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, own, other in zip(*(batch.column(c) for c in ("i", "j", "own", "other"))):
                yield from _compared(*(_unsigned(x) for x in (own, other)), threshold, i.as_py() == j.as_py())

    return dealt.mapInArrow(run, "a long, b long, distance int")


def _unsigned(numbers: pa.ListScalar) -> np.ndarray:
    return numbers.values.to_numpy(zero_copy_only=False).view(np.uint64)


def _compared(own: np.ndarray, other: np.ndarray, threshold: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Pairs within the threshold of a hash of own and one of other; same: both are one block, whose pairs come once."""
    apart, bits, near = np.empty(len(other), np.uint64), np.empty(len(other), np.uint8), np.empty(len(other), bool)
    found, size = [], 0
    for k, h in enumerate(own):
        first = k + 1 if same else 0
        np.bitwise_xor(other[first:], h, out=apart[first:])
        np.bitwise_count(apart[first:], out=bits[first:])
        np.less_equal(bits[first:], threshold, out=near[first:])
        at = first + np.flatnonzero(near[first:])
        found.append((np.full(len(at), h), other[at], bits[at]))
        size += len(at)
        if size > 1 << 16 or k + 1 == len(own):
            a, b, d = (np.concatenate(x) for x in zip(*found))
            a, b = a.view(np.int64), b.view(np.int64)
            columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "distance"])
            found, size = [], 0


def _part(h: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def indexed(hashes: DataFrame, subs: list[tuple[int, int, int]]) -> DataFrame:
    """b, i, key: the hashes under each of their substrings."""
    return hashes.select(F.col("h").alias("b"), F.posexplode(F.array(*(_part(F.col("h"), low, width) for low, width, _ in subs))).alias("i", "key"))


def probes(hashes: DataFrame, subs: list[tuple[int, int, int]]) -> DataFrame:
    """a, i, key: the hashes under every key within the radius of each of their substrings."""
    flips = _flips(hashes.sparkSession, subs)  # MOST_KEYS rows at most
    own = indexed(hashes, subs).join(F.broadcast(flips), "i")
    return own.select(F.col("b").alias("a"), "i", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))


def met_pairs(probing: DataFrame, index: DataFrame, subs: list[tuple[int, int, int]], threshold: int, rows: int | None = None) -> DataFrame:
    """a, b, distance of what probes meet in an index within the threshold, each by the first substring that meets it.

    rows: about how many hashes are looked up, if that is known; a few are broadcast.
    """
    d, apart = hamming(F.col("a"), F.col("b")), F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    for i, (low, width, radius) in enumerate(subs):
        earlier = earlier | ((F.col("i") > i) & (F.bit_count(_part(apart, low, width)) <= radius))
    met = shuffled(probing, rows).join(index, ["i", "key"]).where((F.col("a") != F.col("b")) & (d <= threshold) & ~earlier)
    return met.select("a", "b", d.alias("distance"))


def pairwise_hamming_le(df: DataFrame, threshold: int, key: str = "file", value: str = "phash") -> DataFrame:
    """key_a < key_b, distance of all pairs whose 64-bit hashes differ in at most threshold bits; null hashes take no part.

    Distinct hashes are compared once, however many samples have them; then pairs are listed sample by sample. dedup() and
    its report do not need the list.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("h"))
    near = hash_pairs(rows.select("h").distinct(), threshold)
    left, right = rows.select(F.col("k").alias("ka"), F.col("h").alias("a")), rows.select(F.col("k").alias("kb"), F.col("h").alias("b"))
    apart = near.join(left, "a").join(right, "b").select("ka", "kb", "distance")
    equal = left.join(right, (F.col("a") == F.col("b")) & (F.col("ka") < F.col("kb"))).select("ka", "kb", F.lit(0).alias("distance"))
    first, second = F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")
    return apart.unionByName(equal).select(first, second, "distance")


def with_origins(pairs: DataFrame, df: DataFrame, key: str = "file", origin: str = "origin_id") -> DataFrame:
    """pairs with the origin of either side and cross, whether they differ."""
    a, b = (df.select(F.col(key).alias(f"{key}_{s}"), F.col(origin).alias(f"origin_{s}")) for s in "ab")
    return pairs.join(a, f"{key}_a").join(b, f"{key}_b").withColumn("cross", ~F.col("origin_a").eqNullSafe(F.col("origin_b")))


def exact_groups(df: DataFrame, digest: str = "sha1") -> DataFrame:
    """Digests that more than one sample has; reported, never removed."""
    return df.where(F.col(digest).isNotNull() & (F.col(digest) != "")).groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for all nodes of the pairs; root is the least node that can be reached.

    Rounds of large-star and small-star until nothing changes; each only aggregates and joins. A round's tables are removed
    when the next one's edges are written.
    """
    now = written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not sign[0] or sign == mark:
            break
        mark = sign
        both = now.union(now.select("v", "u"))
        # what a hub joins is written, so that adaptive execution can split the join
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(shuffled(both, sign[0]).join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = shuffled(large, sign[0]).join(lower, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, written(small.union(lower.select("u", "m")).distinct())
        removed(before, least, large, lower)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def keepers(df: DataFrame, roots: DataFrame, key: str = "file", source: str = "source") -> DataFrame:
    """df with dedup_removed and dedup_reason: of a component the sample of the first source stays (ties: the least key)."""
    table = F.create_map(*(F.lit(x) for kv in C.KEEP_PRIORITY.items() for x in kv))
    priority = F.coalesce(table[F.col(source)], F.lit(C.OTHER_PRIORITY)).alias("p")
    member = df.join(shuffled(roots.withColumnRenamed("node", key)), key, "left")
    first = member.where("root is not null").groupBy("root").agg(F.min(F.struct(priority, F.col(key).alias("k"))).alias("first"))
    first = first.select(F.col("root").alias("_root"), F.col("first.k").alias("_keep"))
    joined = member.join(shuffled(first), F.col("root") == F.col("_root"), "left")
    removed = F.col("root").isNotNull() & (F.col(key) != F.col("_keep"))
    own = [c for c in df.columns if c not in ("dedup_removed", "dedup_reason")]
    return joined.select(*own, removed.alias("dedup_removed"), F.when(removed, REASON).alias("dedup_reason"))


def _units(df: DataFrame, origin: str, value: str) -> DataFrame:
    """h, o, n: how many samples of an origin have a hash; o is (is null, origin), so that null is an origin like others."""
    return df.where(F.col(value).isNotNull()).groupBy(*unit_of(value, origin)).agg(F.count("*").alias("n"))


def unit_links(units: DataFrame, threshold: int) -> DataFrame:
    """u, v: links between (h, o) units that connect them exactly as all near pairs of samples of different origins would.

    Samples of a hash and an origin have the same partners, so they stand or fall together. The units of a hash all link to
    its first origin's. Between two near hashes one link is enough: a hash with two origins or more hangs together anyway,
    so it links by whichever of its origins differs from the other side's.
    """
    hashes = units.groupBy("h").agg(F.min("o").alias("first"), F.max("o").alias("last"))
    return links_of(units, hashes, hash_pairs(hashes.select("h"), threshold))


def links_of(units: DataFrame, hashes: DataFrame, near: DataFrame) -> DataFrame:
    """unit_links of units, from their hashes (h, first, last origin) and the near pairs (a, b) among these."""
    same = units.join(shuffled(hashes), "h").where(F.col("o") != F.col("first"))
    same = same.select(F.struct("h", "o").alias("u"), F.struct("h", F.col("first").alias("o")).alias("v"))
    left = hashes.select(F.col("h").alias("a"), F.col("first").alias("fa"), F.col("last").alias("la"))
    right = hashes.select(F.col("h").alias("b"), F.col("first").alias("fb"), F.col("last").alias("lb"))
    near = near.join(shuffled(left), "a").join(shuffled(right), "b")
    oa = F.when((F.col("fa") == F.col("fb")) & (F.col("la") != F.col("fa")), F.col("la")).otherwise(F.col("fa"))
    ob = F.when(oa == F.col("fb"), F.col("lb")).otherwise(F.col("fb"))
    apart = near.where(oa != ob).select(
        F.struct(F.col("a").alias("h"), oa.alias("o")).alias("u"), F.struct(F.col("b").alias("h"), ob.alias("o")).alias("v")
    )
    return same.unionByName(apart)


def unit_of(value: str, origin: str) -> list[Column]:
    """h and o of a sample, as in units."""
    return [F.col(value).alias("h"), F.struct(F.col(origin).isNull().alias("none"), F.col(origin).alias("origin")).alias("o")]


def sample_roots(df: DataFrame, roots: DataFrame, key: str = "file", origin: str = "origin_id", value: str = "phash") -> DataFrame:
    """node, root of the samples whose units roots (h, o, root) names."""
    named = df.select(F.col(key).alias("node"), *unit_of(value, origin))
    units = roots.select(F.col("h").alias("uh"), F.col("o").alias("uo"), "root")
    return named.join(shuffled(units), (F.col("h") == F.col("uh")) & F.col("o").eqNullSafe(F.col("uo"))).select("node", "root")


def sample_components(df: DataFrame, threshold: int = 4, key: str = "file", origin: str = "origin_id", value: str = "phash") -> DataFrame:
    """node, root of every sample with a near sample of another origin; root is one unit (h, o) of the component."""
    found = components(unit_links(_units(df, origin, value), threshold), "u", "v")
    return sample_roots(df, found.select("node.h", "node.o", "root"), key, origin, value)


def dedup(
    df: DataFrame, threshold: int = 4, key: str = "file", origin: str = "origin_id", source: str = "source", value: str = "phash"
) -> DataFrame:
    """The manifest with dedup marks: near pairs of different origins only, as components."""
    return keepers(df, sample_components(df, threshold, key, origin, value), key, source)


def dedup_report(
    df: DataFrame, marked: DataFrame, threshold: int = 4, origin: str = "origin_id", value: str = "phash", digest: str = "sha1"
) -> DataFrame:
    """One row: total, removed, kept, pairs by kind (counted by hash, not listed) and exact groups."""
    units = _units(df, origin, value)
    hashes = units.groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    inside = hashes.agg(
        F.sum((F.col("n") * F.col("n") - F.col("n")) / 2).alias("every"), F.sum((F.col("squares") - F.col("n")) / 2).alias("same")
    )
    near = hash_pairs(hashes.select("h"), threshold)
    left, right = (units.select(F.col("h").alias(s), "o", F.col("n").alias(f"n{s}")) for s in "ab")
    sizes = (hashes.select(F.col("h").alias(s), F.col("n").alias(f"n{s}")) for s in "ab")
    every = near.join(next(sizes), "a").join(next(sizes), "b").agg(F.sum(F.col("na") * F.col("nb")).alias("every"))
    same = near.join(left, "a").join(right, ["b", "o"]).agg(F.sum(F.col("na") * F.col("nb")).alias("same"))
    between = every.crossJoin(same)
    sums = inside.unionByName(between).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("every", "same")))
    kinds = sums.select(F.col("same").alias("same_origin_pairs_skipped"), (F.col("every") - F.col("same")).alias("cross_origin_dup_pairs"))
    counts = marked.agg(
        F.count("*").alias("total"), F.count_if("dedup_removed").alias("removed"), F.count_if(~F.col("dedup_removed")).alias("kept")
    )
    return counts.crossJoin(kinds).crossJoin(exact_groups(df, digest).agg(F.count("*").alias("exact_sha1_groups")))


def removed_by_source(marked: DataFrame, source: str = "source") -> DataFrame:
    return marked.where("dedup_removed").groupBy(F.coalesce(source, F.lit("?")).alias(source)).agg(F.count("*").alias("n"))


def removed_head(marked: DataFrame, n: int = 50, key: str = "file") -> DataFrame:
    return marked.where("dedup_removed").orderBy(key).limit(n)


def count_by(files: DataFrame, df: DataFrame, key: str = "file", source: str = "source") -> DataFrame:
    """Files per source; a file that is not in df counts as '?'."""
    return files.select(key).join(df.select(key, source), key, "left").groupBy(
        F.coalesce(source, F.lit("?")).alias(source)
    ).agg(F.count("*").alias("n"))


def keep_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key in seq order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(seq))).where("_nth = 1").drop("_nth")
