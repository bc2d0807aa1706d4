"""Networks trained by distributed mini-batches, many runs in the same jobs.

A run is a network (one hidden layer of tanh units, or none) with a logit per class, trained by AdamW with a cosine schedule on
weighted cross-entropy, features standardised over its rows. Mini-batches are slices of the samples by hash, written apart so that a
step reads its own slice only; their order changes with the epoch. In a step each task adds up the gradients of all runs over
its samples, tasks' sums are added in a second level of tasks where there are many, and the driver moves the weights. It holds
weights and moments of the runs, which don't grow with the samples. An epoch is one job for each batch and one for validation,
however many runs there are. After each epoch the state is written; a restart goes on from the last whole one.

Samples take no part if features or truth are null, hold nulls or numbers that aren't finite, or have another length than most
have (truth: than there are classes). Repeated rows count as often as they are there. A run that has no samples, settings out of range or
weights that overflow ends with an error and leaves the others alone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.operators.evaluation import with_probs
from datakiln.sources import scratch

BETA_1, BETA_2, TINY = 0.9, 0.999, 1e-8
#: Tasks whose sums the driver adds up itself; more go through a second level.
FEW_TASKS = 64
STATE = (
    "run string, settings string, width int, classes int, mean array<double>, scale array<double>, pos_weight array<double>, w array<double>,"
    "m array<double>, v array<double>, steps int, best array<double>, best_epoch int, best_f1 double, epochs array<int>, losses array<double>,"
    "scores array<double>, error string"
)


@dataclass(frozen=True)
class Settings:
    """mix: the run trains on samples whose mixes hold it (null: on all)."""

    hidden: int = 16
    epochs: int = 10
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 42
    mix: str | None = None


@dataclass
class Run:
    run: str
    settings: Settings
    width: int
    classes: int
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pos_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    m: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: int = 0
    best: np.ndarray = field(default_factory=lambda: np.zeros(0))
    best_epoch: int = -1
    best_f1: float = -1.0
    epochs: list[int] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    scores: list[float | None] = field(default_factory=list)
    error: str | None = None
    total: np.ndarray | None = None

    def goes_on(self, epoch: int) -> bool:
        return self.error is None and epoch < self.settings.epochs


# ---- the network -----------------------------------------------------------------------------------------------------------
def shapes(width: int, hidden: int, classes: int) -> list[tuple[int, ...]]:
    return [(width, hidden), (hidden,), (hidden, classes), (classes,)] if hidden else [(width, classes), (classes,)]


def initial(width: int, hidden: int, classes: int, seed: int) -> np.ndarray:
    """Weights and biases spread evenly within one over the root of their layer's inputs."""
    rng, parts = np.random.default_rng(seed), shapes(width, hidden, classes)
    spread = [1 / math.sqrt(max(1, parts[i - i % 2][0])) for i in range(len(parts))]
    return np.concatenate([rng.uniform(-s, s, math.prod(p)) for p, s in zip(parts, spread)])


def _layers(w: np.ndarray, width: int, hidden: int, classes: int) -> list[np.ndarray]:
    parts = shapes(width, hidden, classes)
    ends = np.cumsum([math.prod(p) for p in parts])
    return [x.reshape(p) for x, p in zip(np.split(w, ends[:-1]), parts)]


def logits(w: np.ndarray, x: np.ndarray, hidden: int, classes: int) -> np.ndarray:
    layers = _layers(w, x.shape[1], hidden, classes)
    if hidden:
        x = np.tanh(x @ layers[0] + layers[1])
    return x @ layers[-2] + layers[-1]


def loss_and_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, pos_weight: np.ndarray, hidden: int) -> tuple[float, np.ndarray]:
    """Sums over samples and classes of the weighted cross-entropy and of its derivative by each weight."""
    classes = y.shape[1]
    layers = _layers(w, x.shape[1], hidden, classes)
    units = np.tanh(x @ layers[0] + layers[1]) if hidden else x
    z = units @ layers[-2] + layers[-1]
    loss = (pos_weight * y * np.logaddexp(0, -z) + (1 - y) * np.logaddexp(0, z)).sum()
    p = np.exp(-np.logaddexp(0, -z))
    back = pos_weight * y * (p - 1) + (1 - y) * p
    out = [units.T @ back, back.sum(0)]
    if hidden:
        inner = (back @ layers[-2].T) * (1 - units**2)
        out = [x.T @ inner, inner.sum(0), *out]
    return float(loss), np.concatenate([g.ravel() for g in out])


def adamw(run: Run, gradient: np.ndarray, rate: float) -> None:
    """One step; decay is apart from the gradient."""
    run.steps += 1
    run.m = BETA_1 * run.m + (1 - BETA_1) * gradient
    run.v = BETA_2 * run.v + (1 - BETA_2) * gradient**2
    m, v = run.m / (1 - BETA_1**run.steps), run.v / (1 - BETA_2**run.steps)
    with np.errstate(all="ignore"):
        run.w = run.w * (1 - rate * run.settings.decay) - rate * m / (np.sqrt(v) + TINY)
    if not np.isfinite(run.w).all():
        run.error = "weights are not finite"


# ---- sums over tasks -------------------------------------------------------------------------------------------------------
def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(n, -1)


def _members(batch: pa.RecordBatch, mixes: set[str | None]) -> dict[str | None, np.ndarray]:
    """The rows of a batch that each mix has."""
    lists = batch.column("mixes")
    at = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
    names = np.asarray(lists.flatten(), dtype=object)
    return {x: np.arange(batch.num_rows) if x is None else np.unique(at[names == x]) for x in mixes}


def summed(rows: DataFrame, runs: Sequence[Run], of: Callable[[Run, np.ndarray, np.ndarray], np.ndarray], all_rows: bool = False) -> None:
    """Gives each run the sum of of(run, x, y) over its samples as run.total, or an error. Sums may differ in the last bits."""
    if not runs:
        return
    mixes = {None if all_rows else r.settings.mix for r in runs}
    none = np.zeros(0)
    sent = [replace(r, m=none, v=none, best=none, total=None) for r in runs]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        errors: dict[int, str] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            x, y, members = _matrix(b.column("x"), b.num_rows), _matrix(b.column("y"), b.num_rows), _members(b, mixes)
            for i, run in enumerate(sent):
                at = members[None if all_rows else run.settings.mix]
                if i in errors or not len(at):
                    continue
                try:
                    with np.errstate(all="ignore"):
                        part = of(run, x[at], y[at])
                    totals[i] = totals[i] + part if i in totals else part
                except (ValueError, ArithmeticError) as failure:
                    errors[i] = str(failure)[:500]
        yield _sums(totals, errors, TaskContext.get().partitionId())

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, errors = _added(r for b in batches for r in b.to_pylist())
        yield _sums(totals, errors, 0)

    kind = "run int, task int, total array<double>, error string"
    parts = rows.select("x", "y", "mixes").mapInArrow(partial, kind)
    tasks = rows.rdd.getNumPartitions()
    if tasks > FEW_TASKS:
        parts = parts.repartition(math.isqrt(tasks), "task").mapInArrow(added, kind)
    totals, errors = _added(r.asDict() for r in sorted(parts.collect(), key=lambda r: (r.run, r.task)))  # a row per run and task
    for i, run in enumerate(runs):
        run.total = totals.get(i)
        run.error = errors.get(i) or (None if run.total is None or np.isfinite(run.total).all() else "sums are not finite")


def _sums(totals: dict[int, np.ndarray], errors: dict[int, str], task: int) -> pa.RecordBatch:
    runs = sorted({*totals, *errors})
    values = [list(totals[i]) if i in totals else None for i in runs]
    columns = [pa.array(runs, pa.int32()), pa.array([task] * len(runs), pa.int32()), pa.array(values, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([errors.get(i) for i in runs], pa.string())], names=["run", "task", "total", "error"])


def _added(rows) -> tuple[dict[int, np.ndarray], dict[int, str]]:
    totals: dict[int, np.ndarray] = {}
    errors: dict[int, str] = {}
    for r in rows:
        if r["error"] is not None:
            errors[r["run"]] = r["error"]
        if r["total"] is not None:
            totals[r["run"]] = totals[r["run"]] + np.asarray(r["total"]) if r["run"] in totals else np.asarray(r["total"])
    return totals, errors


# ---- training --------------------------------------------------------------------------------------------------------------
def usable(rows: DataFrame, width: int, classes: int, features: str = "features", truth: str = "truth") -> DataFrame:
    """x, y and mixes of the samples that take part."""
    x, y = F.col(features).cast("array<double>"), F.col(truth).cast("array<double>")
    mixes = F.coalesce(F.col("mixes"), F.array()) if "mixes" in rows.columns else F.array()
    out = rows.withColumns({"_x": x, "_y": y, "_mixes": mixes.cast("array<string>")})
    finite = F.forall("_x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    whole = F.forall("_y", lambda v: F.coalesce(v.isin(0.0, 1.0), F.lit(False)))
    return out.where((F.size("_x") == width) & (F.size("_y") == classes) & finite & whole)


def width_of(rows: DataFrame, features: str = "features") -> int:
    """The length that most rows have (the smaller if tied; 0 without rows)."""
    sizes = rows.where(F.size(features) > 0).groupBy(F.size(features).alias("d")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), "d").first()
    return first.d if first else 0


def sliced(rows: DataFrame, batches: int, key: str) -> DataFrame:
    """Samples written in as many slices by hash of the key; a filter by batch reads that slice only."""
    spark, path = rows.sparkSession, scratch.new_folder(rows.sparkSession, "slices")
    batch = F.pmod(F.xxhash64(F.col(key)), F.lit(batches)).cast("int").alias("batch")
    table = rows.select(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_mixes").alias("mixes"), batch)
    table.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
    out = spark.read.schema(table.schema).parquet(path)
    out.written_path = path
    return out


def _standard(run: Run, x: np.ndarray) -> np.ndarray:
    return (x - run.mean) * run.scale


def _moments(run: Run, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0), y.sum(0)])


def step_sums(run: Run, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples, loss and gradient of a run over rows, as sums."""
    loss, gradient = loss_and_gradient(run.w, _standard(run, x), y, run.pos_weight, run.settings.hidden)
    return np.concatenate([[len(x), loss], gradient])


def _confusion(run: Run, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """True and false positives and false negatives of each class at one half."""
    pred, truth = logits(run.w, _standard(run, x), run.settings.hidden, run.classes) > 0, y > 0
    return np.concatenate([(pred & truth).sum(0), (pred & ~truth).sum(0), (~pred & truth).sum(0)]).astype(float)


def _macro_f1(total: np.ndarray) -> float | None:
    tp, fp, fn = total.reshape(3, -1)
    seen = tp + fp + fn > 0
    return float((2 * tp[seen] / (2 * tp + fp + fn)[seen]).mean()) if seen.any() else None


def _begin(run: Run) -> None:
    n, d = (0.0, run.width) if run.total is None else (run.total[0], run.width)
    if run.error or n == 0:
        run.error = run.error or "no samples"
        return
    run.mean = run.total[1 : d + 1] / n
    spread = np.sqrt(np.maximum(run.total[d + 1 : 2 * d + 1] / n - run.mean**2, 0))
    run.scale = np.where(spread > 1e-9 * np.maximum(1, np.abs(run.mean)), 1 / np.where(spread > 0, spread, 1), 0.0)
    positive = run.total[2 * d + 1 :]
    run.pos_weight = (n - positive) / np.maximum(positive, 1)
    run.w = initial(d, run.settings.hidden, run.classes, run.settings.seed)
    run.m, run.v, run.best = np.zeros_like(run.w), np.zeros_like(run.w), run.w


def train_runs(
    rows: DataFrame, val: DataFrame, classes: Sequence[str], settings: dict[str, Settings], out: str | None = None, batches: int = 8,
    features: str = "features", key: str = "file",
) -> dict[str, Run]:
    """Trains all runs together; weights of each are those of its best epoch, the first of the greatest macro F1 on val.

    rows and val: key, features, truth (a 0 or 1 per class) and, where settings name mixes, mixes (array of their names, rows only).
    Without a usable val sample the last epoch is the best. out: where the state is kept; without it a new folder.
    """
    spark, width, c = rows.sparkSession, width_of(rows, features), len(classes)
    out = out or scratch.new_folder(spark, "training")
    epoch, runs = _resumed(spark, out, settings)
    if not runs:
        runs = [Run(name, s, width, c) for name, s in sorted(settings.items())]
        for r in runs:
            s = r.settings
            good = s.epochs > 0 and s.hidden >= 0 and s.rate > 0 and s.decay >= 0
            r.error = None if good else "settings out of range"
    last = max((r.settings.epochs for r in runs if r.error is None), default=0)
    if epoch >= last:
        return {r.run: r for r in runs}
    train = sliced(usable(rows, width, c, features), batches, key)
    held = scratch.written(usable(val, width, c, features).select(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_mixes").alias("mixes")), "val")
    if epoch == 0:
        fresh = [r for r in runs if r.error is None]
        summed(train, fresh, _moments)
        for r in fresh:
            _begin(r)
    for e in range(epoch, last):
        live = [r for r in runs if r.goes_on(e)]
        seen = {r.run: np.zeros(2) for r in live}
        for b in np.random.default_rng([17, e]).permutation(batches):
            now = [r for r in live if r.error is None]
            summed(train.where(F.col("batch") == int(b)), now, step_sums)
            for r in now:
                if r.error is None and r.total is not None:
                    seen[r.run] += r.total[:2]
                    rate = r.settings.rate * (1 + math.cos(math.pi * e / r.settings.epochs)) / 2
                    adamw(r, r.total[2:] / (r.total[0] * c), rate)
        live = [r for r in live if r.error is None]
        summed(held, live, _confusion, all_rows=True)
        for r in live:
            if r.error is None:
                n, loss = seen[r.run]
                score = None if r.total is None else _macro_f1(r.total)
                r.epochs, r.losses, r.scores = [*r.epochs, e], [*r.losses, float(loss / (n * c))], [*r.scores, score]
                if score is None or score > r.best_f1:
                    r.best, r.best_epoch, r.best_f1 = r.w, e, r.best_f1 if score is None else score
        _keep(spark, out, e + 1, runs)
    scratch.removed(train, held)
    return {r.run: r for r in runs}


def _keep(spark: SparkSession, out: str, epoch: int, runs: Sequence[Run]) -> None:
    columns = [f.split()[0] for f in STATE.split(",")]
    rows = []
    for r in runs:
        values = {k: getattr(r, k) for k in columns} | {"settings": json.dumps(asdict(r.settings), sort_keys=True)}
        rows.append(tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in values.values()))
    spark.createDataFrame(rows, STATE).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    scratch.mark(spark, f"{out}/DONE-{epoch}")


def _resumed(spark: SparkSession, out: str, settings: dict[str, Settings]) -> tuple[int, list[Run]]:
    """The epochs done and the runs after them."""
    epoch = 0
    while scratch.is_there(spark, f"{out}/DONE-{epoch + 1}"):
        epoch += 1
    if epoch == 0:
        return 0, []
    runs = []
    for row in spark.read.schema(STATE).parquet(f"{out}/epoch={epoch}").orderBy("run").collect():  # a row per run
        values = row.asDict() | {"settings": Settings(**json.loads(row.settings))}
        arrays = {k: np.asarray(values[k], dtype=float) for k in ("mean", "scale", "pos_weight", "w", "m", "v", "best")}
        runs.append(Run(**(values | arrays)))
    if {r.run: r.settings for r in runs} != settings:
        raise ValueError(f"{out} holds the state of other runs")
    return epoch, runs


def history(spark: SparkSession, runs: dict[str, Run]) -> DataFrame:
    """run, epoch, train_loss, val_macro_f1."""
    rows = [(r.run, *x) for r in runs.values() for x in zip(r.epochs, r.losses, r.scores)]
    return spark.createDataFrame(rows, "run string, epoch int, train_loss double, val_macro_f1 double")


def network_scores(rows: DataFrame, runs: dict[str, Run], classes: Sequence[str], keys: Sequence[str] = ("file",), features: str = "features") -> DataFrame:
    """Long scores (keys, run, class, logit, prob, y) of all runs without error, in one pass over the samples that take part."""
    good = [r for r in runs.values() if r.error is None]
    width = good[0].width if good else 0
    table = usable(rows, width, len(classes), features).select(*keys, "_x", "_y")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in good:
                z = logits(r.best, _standard(r, _matrix(b.column("_x"), b.num_rows)), r.settings.hidden, r.classes) if b.num_rows else np.zeros((0, r.classes))
                offsets = pa.array(np.arange(0, z.size + 1, r.classes), pa.int32())
                named = pa.array([r.run] * b.num_rows, pa.string())
                values = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("_y"), named, values], names=[*keys, "_y", "run", "_z"])

    kind = ", ".join([*(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys), "_y array<double>, run string, _z array<double>"])
    names = F.array(*(F.lit(c) for c in classes)).alias("class")
    zipped = F.explode(F.arrays_zip(names, F.col("_z").alias("logit"), F.col("_y").alias("y"))).alias("_s")
    long = table.mapInArrow(score, kind).select(*keys, "run", zipped)
    return with_probs(long.select(*keys, "run", "_s.class", "_s.logit", F.col("_s.y").cast("int").alias("y")))
