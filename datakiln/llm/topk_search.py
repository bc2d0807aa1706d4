"""Exact top-k search by inner product with a pivot table.

Vectors become whole numbers, floor(64 * x) of each component as a double. Centres are picked farthest-first from a sample
of SAMPLE rows, the first PIVOTS of them are the pivots; the table holds every row's distance to every pivot. By the triangle
inequality the largest difference between two rows' entries is a lower bound of their distance, and with the norms an upper
bound of their inner product.

Rows lie in slices and queries in groups, by nearest centre and in pieces of bounded size. Each group first searches the
slices of its own centre, which gives its queries a score that their k-th best reaches at least. Then the pairs of groups and
slices are bounded as wholes, from the intervals of their entries and from centres and radii, and only pairs that can still
hold a result are sent to a task at all. There, rows whose bound is below a query's k-th best score so far are eliminated,
and the rest is evaluated in the order of the bounds until the next bound is below. The k best of all slices are merged.

All is computed in doubles. Rows with squared norms below EXACT have exact squared distances, so that bounds err by less than
SLACK; larger rows, if there are any, form slices and groups of their own and are never eliminated.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null vec_id, take no part.
Shorter vectors count as padded with zeros. Repeated rows are rows of their own: each finds the others. Ties go to the
smaller vec_id. Scores outside 64 bits are held at its ends. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datakiln.llm.common import saved, table

K, PIVOTS, CENTRES, SAMPLE = 20, 32, 512, 2048
QUERY_ROWS, SLICE_ROWS = 4096, 32_768
CHUNK, BLOCK = 64, 2048
#: Groups or slices whose bounds a task compares with as many others.
BOUNDS = 2048
#: Sums and differences of products below this are exact in a double.
EXACT = 2.0**50
#: Over the error of a bound of twice the score: two roots below 2**26 err by 2**-27 each, their squared difference by 2.
SLACK = 8.0
#: Below any score.
LEAST = -1e30


def _quantized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with vec: the whole numbers as doubles in bytes."""
    for b in batches:
        keep, vecs = [], []
        for i, v in enumerate(b.column("embedding")):
            valid = v.is_valid and not v.values.null_count
            x = np.floor(64.0 * v.values.to_numpy(zero_copy_only=False).astype(np.float64)) if valid else None
            if x is not None and np.isfinite(x).all():
                keep.append(i)
                vecs.append(x.tobytes())
        at = pa.array(keep, pa.int64())
        columns = [b.column(c).take(at) for c in ("row", "vec_id", "is_query")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(vecs, pa.binary())], names=["row", "vec_id", "is_query", "vec"])


def _matrix(vecs, width: int | None = None) -> np.ndarray:
    rows = [np.frombuffer(v, dtype=np.float64) for v in vecs]
    width = max([len(r) for r in rows] + [0]) if width is None else width
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it; rows too large for exact sums are left out."""
    sample = sample[_norms(sample) < EXACT]
    if not len(sample):
        return sample
    picked, nearest = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(sample)) and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x, p = _padded(x, width), _padded(pivots, width)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T)))


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x * x).sum(axis=1)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers."""
    if max(_norms(q).max(initial=0), _norms(x).max(initial=0)) < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(x).T
    return np.vectorize(lambda s: max(-(1 << 63), min((1 << 63) - 1, s)), otypes=[np.int64])(exact)


def upper_bounds(nq: np.ndarray, dq: np.ndarray, nx: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """What the score of each query and row is at most, from squared norms and pivot distances (rows by pivots)."""
    low = np.zeros((len(nq), len(nx)))
    for p in range(dx.shape[1]):
        np.maximum(low, np.abs(dq[:, p][:, None] - dx[:, p][None, :]), out=low)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = (nq[:, None] + nx[None, :] + SLACK - low * low) * 0.5
    bound[nq >= EXACT] = np.inf
    bound[:, nx >= EXACT] = np.inf
    return bound


def sample_floors(q: np.ndarray, rows: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """A score that each query's k-th best reaches, from the sample without the query's own row."""
    srow, svec = sample
    floors = np.full(len(q), LEAST)
    at = np.flatnonzero(_norms(q) < EXACT)
    small = _norms(svec) < EXACT
    if small.sum() <= k or not len(at):
        return floors
    width = max(q.shape[1], svec.shape[1])
    known = _scores(_padded(q[at], width), _padded(svec[small], width)).astype(np.float64)
    known[rows[at][:, None] == srow[small][None, :]] = LEAST
    floors[at] = np.partition(known, -k, axis=1)[:, -k]
    return floors


def nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of the slice for each query, of those that reach its floor.

    queries and rows: row, vec_id, vec, dist (pivot distances in bytes); queries: floor.
    """
    width = max(len(v) for part in (queries.vec, rows.vec) for v in part) // 8
    q, x = _matrix(queries.vec, width), _matrix(rows.vec, width)
    dq, dx = (np.stack([np.frombuffer(d, dtype=np.float64) for d in part.dist]) for part in (queries, rows))
    nq, nx = _norms(q), _norms(x)
    qrow, xrow, xid, floors = queries.row.to_numpy(), rows.row.to_numpy(), rows.vec_id.to_numpy(), queries.floor.to_numpy()
    own = {r: i for i, r in enumerate(xrow)}
    # alike queries together: they eliminate the same rows
    order = np.lexsort((dq.min(axis=1), dq.argmin(axis=1))) if dq.shape[1] else np.arange(len(q))
    out = []
    for at in range(0, len(order), CHUNK):
        some = order[at : at + CHUNK]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(some)
        floor = floors[some].copy()
        bound = upper_bounds(nq[some], dq[some], nx, dx)
        for i, s in enumerate(some):
            if (me := own.get(qrow[s])) is not None:
                bound[i, me] = -np.inf
        chance = (bound - floor[:, None]).max(axis=0)
        left = np.flatnonzero(chance >= 0)
        left = left[np.argsort(-chance[left], kind="stable")]
        for begin in range(0, len(left), BLOCK):
            block = left[begin : begin + BLOCK]
            possible = bound[:, block] >= floor[:, None]
            if not possible.any():
                if (bound[:, left[begin:]] < floor[:, None]).all():
                    break
                continue
            scores = _scores(q[some], x[block])
            good = possible & (scores >= floor[:, None])
            for i in np.flatnonzero(good.any(axis=1)):
                hit = np.flatnonzero(good[i])
                sc, ids = np.concatenate((best[i][0], scores[i, hit])), np.concatenate((best[i][1], xid[block[hit]]))
                top = np.lexsort((ids, -sc))[:k]
                best[i] = (sc[top], ids[top])
                if len(top) == k:
                    floor[i] = max(floor[i], float(best[i][0][-1]))
        for i, s in enumerate(some):
            ids = {"query_row": qrow[s], "query_id": queries.vec_id.iloc[s]}
            out.append(pd.DataFrame({**ids, "vec_id": best[i][1], "score": best[i][0]}))
    return pd.concat(out, ignore_index=True)


def indexed(
    rows: DataFrame, centres: np.ndarray, cells: tuple[int, int], sample: tuple[np.ndarray, np.ndarray], k: int
) -> DataFrame:
    """rows with dist (to the first PIVOTS centres, in bytes), norm, cell and near, and for queries q_cell, q_near and floor.

    A cell is the nearest of the first centres, as many as cells says for rows and for queries, and near is the distance to
    it; the cell is -1 if the row is too large or there is no centre.
    """

    def nearest_of(dist: np.ndarray, small: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        cell, near = np.full(len(dist), -1, dtype=np.int32), np.zeros(len(dist))
        if len(centres):
            cell[small] = dist[small, :n].argmin(axis=1)
            near[small] = dist[small, :n].min(axis=1)
        return cell, near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vec").to_pylist())
            norm, dist = _norms(x), pivot_distances(x, centres)
            small = norm < EXACT
            found = [v for n in cells for v in nearest_of(dist, small, n)]
            asks = b.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            floor = np.full(len(x), LEAST)
            floor[asks] = sample_floors(x[asks], b.column("row").to_numpy()[asks], sample, k)
            table = pa.array([d.tobytes() for d in dist[:, :PIVOTS]], pa.binary())
            values = [table, *map(pa.array, (norm, *found, floor))]
            names = ["dist", "norm", "cell", "near", "q_cell", "q_near", "floor"]
            yield pa.RecordBatch.from_arrays([*b.columns, *values], names=[*b.schema.names, *names])

    own = "row long, vec_id long, is_query boolean, vec binary, dist binary, norm double"
    schema = f"{own}, cell int, near double, q_cell int, q_near double, floor double"
    return saved(rows.mapInArrow(run, schema), "pivot-table")


_EXTENT = "part long, cell int, low binary, high binary, norm double, radius double, floor double"


def _joined_extents(extents: pd.DataFrame) -> pd.DataFrame:
    low, high = _matrix(extents.low).min(axis=0), _matrix(extents.high).max(axis=0)
    numbers = {"norm": extents.norm.max(), "radius": extents.radius.max(), "floor": extents.floor.min()}
    first = extents.iloc[0]
    return pd.DataFrame([{"part": first.part, "cell": first.cell, "low": low.tobytes(), "high": high.tobytes(), **numbers}])


def extents(rows: DataFrame) -> DataFrame:
    """Of each part: least and greatest distance to every pivot, greatest norm and radius, least floor. Tasks sum up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, pd.DataFrame] = {}
        for b in batches:
            pdf = b.to_pandas().assign(low=lambda x: x.dist, high=lambda x: x.dist).rename(columns={"near": "radius"})
            for part, some in pdf.groupby("part"):
                met[part] = _joined_extents(pd.concat([met[part], some]) if part in met else some)
        if met:
            order = ["part", "cell", "low", "high", "norm", "radius", "floor"]
            whole = pd.concat(met.values())[order].astype({"part": "int64", "cell": "int32"})
            yield pa.RecordBatch.from_pandas(whole, preserve_index=False)

    parts = rows.select("part", "cell", "dist", "norm", "near", "floor").mapInArrow(run, _EXTENT)
    return saved(parts.groupBy("part").applyInPandas(_joined_extents, _EXTENT), "extents")


def surviving(groups: DataFrame, slices: DataFrame, centres: np.ndarray) -> DataFrame:
    """g, s: the pairs of groups and slices, not of one cell, that may hold a score at the group's floor or above."""
    apart = pivot_distances(centres, centres)

    def bounded(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"g": [], "s": []}).astype("int64")
        (al, ah), (hl, hh) = ((_matrix(p.low), _matrix(p.high)) for p in (asked, held))
        ac, hc = asked.cell.to_numpy(), held.cell.to_numpy()
        low = np.zeros((len(asked), len(held)))
        for p in range(al.shape[1]):
            gap = np.maximum(al[:, p][:, None] - hh[:, p][None, :], hl[:, p][None, :] - ah[:, p][:, None])
            np.maximum(low, gap, out=low)
        if len(apart):
            reach = asked.radius.to_numpy()[:, None] + held.radius.to_numpy()[None, :]
            np.maximum(low, apart[ac][:, hc] - reach, out=low)
        with np.errstate(over="ignore", invalid="ignore"):
            most = (asked.norm.to_numpy()[:, None] + held.norm.to_numpy()[None, :] + SLACK - low * low) * 0.5
        most[ac < 0] = np.inf
        most[:, hc < 0] = np.inf
        i, j = np.nonzero((most >= asked.floor.to_numpy()[:, None]) & (ac[:, None] != hc[None, :]))
        return pd.DataFrame({"g": asked.part.to_numpy()[i], "s": held.part.to_numpy()[j]})

    def blocks(n: int) -> int:
        return max(1, -(-n // BOUNDS))

    n_groups, n_slices = blocks(groups.count()), blocks(slices.count())
    a, b = (F.pmod(F.xxhash64("part"), F.lit(n)).cast("long") for n in (n_groups, n_slices))
    every_a, every_b = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (n_groups, n_slices))
    asked = groups.select("*", a.alias("a"), every_b.alias("b")).groupBy("a", "b")
    held = slices.select("*", b.alias("b"), every_a.alias("a")).groupBy("a", "b")
    return asked.cogroup(held).applyInPandas(bounded, "g long, s long")


def _met(queries: DataFrame, rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """query_row, query_id, vec_id, score: the k best of each pair of a group and a slice."""
    asked = queries.select(F.col("part").alias("g"), "row", "vec_id", "vec", "dist", "floor").join(pairs, "g")
    held = rows.select(F.col("part").alias("s"), "row", "vec_id", "vec", "dist").join(pairs, "s")

    def evaluate(some: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if some.empty or part.empty:
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        return nearest(some, part, k)

    schema = "query_row long, query_id long, vec_id long, score long"
    return asked.groupBy("g", "s").cogroup(held.groupBy("g", "s")).applyInPandas(evaluate, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _in_parts(rows: DataFrame, most: int) -> DataFrame:
    """rows with part, a number for each cell and piece of it of about most rows."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("pieces"))  # a row per centre
    piece = F.pmod(F.xxhash64("row"), F.col("pieces"))
    return rows.join(F.broadcast(sizes), "cell").withColumn("part", (F.col("cell") + 1) * F.lit(1 << 40) + piece).drop("pieces")


def searched(vectors: DataFrame, is_query: Column, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """query_id, rank, vec_id, score of the k best other rows of every (vec_id, embedding) row that is a query.

    Also the pairs of groups and slices of other centres that were left to search, and the extents of all slices.
    """
    spark = vectors.sparkSession
    number = F.monotonically_increasing_id().alias("row")
    given = vectors.where("vec_id is not null").select(number, "vec_id", is_query.alias("is_query"), "embedding")
    rows = saved(given.mapInArrow(_quantized, "row long, vec_id long, is_query boolean, vec binary"), "whole-vectors")
    drawn = rows.select("row", "vec").orderBy(F.xxhash64("row", F.lit(17)), "row").limit(SAMPLE).toPandas()
    sample = (drawn.row.to_numpy(dtype=np.int64), _matrix(drawn.vec))
    n, n_queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    n_cells = min(CENTRES, max(1, -(-n // SLICE_ROWS), min(2 * spark.sparkContext.defaultParallelism, n // 1024)))
    n_groups = min(n_cells, max(1, -(-n_queries // QUERY_ROWS)))  # each group meets copies of the slices, so few of them
    centres = farthest_first(sample[1], max(PIVOTS, n_cells))
    index = indexed(rows, centres, (n_cells, n_groups), sample, k)
    slices = saved(_in_parts(index.drop("q_cell", "q_near"), SLICE_ROWS), "slices")
    asked = index.where("is_query").withColumn("cell", F.col("q_cell")).withColumn("near", F.col("q_near"))
    queries = saved(_in_parts(asked.drop("q_cell", "q_near"), QUERY_ROWS), "queries")

    held = extents(slices)
    s_of = held.select(F.col("part").alias("s"), "cell")
    own = queries.select(F.col("part").alias("g"), "cell").distinct().join(s_of, "cell").select("g", "s")
    first = saved(_met(queries, slices, own, k), "own-cells")
    kth = _best(first, k).groupBy("query_row").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    known = queries.join(kth, F.col("row") == F.col("query_row"), "left")
    better = known.withColumn("floor", F.greatest("floor", F.col("kth").cast("double"))).select(*queries.columns)
    better = saved(better, "floors")
    pairs = saved(surviving(extents(better), held, centres[:n_cells]), "pairs")
    rest = _met(better, slices, pairs, k)
    return _best(first.union(rest), k).select("query_id", "rank", "vec_id", "score"), pairs, held


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for every (vec_id, embedding) row that is a query."""
    return searched(vectors, is_query, k)[0]


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id,
      coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
