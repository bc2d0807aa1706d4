"""Synthetic variants: who gets which source, class and strength is a DataFrame plan; only pixels are made in Python.

Every draw is a hash of seed, turn and purpose, so a variant does not depend on those before it, or on partitions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datakiln.functions import constants as C
from datakiln.functions import degrade as D
from datakiln.functions.image import pixels
from datakiln.operators.tables import round_robin

DERIVED = (
    "i long, file string, sha1 string, source string, origin_id string, labels array<string>, params string, scene string, difficulty "
    "string, width int, height int, parent_sha1 string, split string, aigc_backend string, eval_longtail boolean, review_status string, "
    "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
)


def uniform(seed: int, i: Column, purpose: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), i, F.lit(purpose)), F.lit(1 << 30)) / float(1 << 30)


def _choice(u: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.least(F.floor(u * len(values)).cast("int") + 1, F.lit(len(values))))


def degrade_schedule(turns: DataFrame, seed: int = 42, double: float = 0.25, clean: float = 0.0, noise_last: bool = True) -> DataFrame:
    """Adds classes and strengths to rows with i: two classes with chance double, else one; noise goes last; none with chance clean."""
    i = F.col("i")
    first = _choice(uniform(seed, i, "first"), C.CLASSES)
    others = F.filter(F.array(*(F.lit(c) for c in C.CLASSES)), lambda c: c != first)
    second = F.element_at(
        others, F.least(F.floor(uniform(seed, i, "second") * (len(C.CLASSES) - 1)).cast("int") + 1, F.lit(len(C.CLASSES) - 1))
    )
    classes = F.when(uniform(seed, i, "two") < double, F.array(first, second)).otherwise(F.array(first))
    if noise_last:
        classes = F.concat(F.filter(classes, lambda c: c != "noise"), F.filter(classes, lambda c: c == "noise"))
    classes = F.when(uniform(seed, i, "clean") < clean, F.array().cast("array<string>")).otherwise(classes)
    strengths = F.array(_choice(uniform(seed, i, "s1"), D.STRENGTHS), _choice(uniform(seed, i, "s2"), D.STRENGTHS))
    return turns.withColumn("classes", classes).withColumn("strengths", F.slice(strengths, 1, F.greatest(F.size(F.col("classes")), F.lit(1)))).withColumn(
        "strengths", F.when(F.size("classes") > 0, F.col("strengths")).otherwise(F.array().cast("array<string>"))
    )


def _rendered(
    plan: DataFrame,
    make: Callable[[dict, np.ndarray, np.random.Generator], tuple[np.ndarray, dict]],
    seed: int,
    describe: Callable[[dict, dict], dict],
) -> DataFrame:
    """Derived manifest rows with their images; rows whose image cannot be read are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                img = pixels(row.get("image") or {})
                if img is None:
                    continue
                img, params = make(row, img, np.random.default_rng([seed, row["i"]]))
                data = np.ascontiguousarray(img).tobytes()
                h, w = img.shape[:2]
                common = {
                    "i": row["i"],
                    "sha1": hashlib.sha1(f"{h}x{w}:".encode() + data).hexdigest(),
                    "origin_id": row["origin_id"],
                    "params": json.dumps(params, sort_keys=True),
                    "scene": row["scene"] or "indoor",
                    "width": w,
                    "height": h,
                    "parent_sha1": row["sha1"],
                    "split": "unassigned",
                    "aigc_backend": None,
                    "eval_longtail": None,
                    "review_status": None,
                }
                out.append(
                    common | describe(row, params) | {
                        "image": {"origin": None, "height": h, "width": w, "nChannels": 3, "mode": 16, "data": data}
                    }
                )
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return plan.mapInArrow(run, DERIVED)


_ARROW = pa.schema(
    [
        ("i", pa.int64()),
        *((n, pa.string()) for n in ("file", "sha1", "source", "origin_id")),
        ("labels", pa.list_(pa.string())),
        *((n, pa.string()) for n in ("params", "scene", "difficulty")),
        ("width", pa.int32()),
        ("height", pa.int32()),
        *((n, pa.string()) for n in ("parent_sha1", "split", "aigc_backend")),
        ("eval_longtail", pa.bool_()),
        ("review_status", pa.string()),
    ]
    + [
        (
            "image",
            pa.struct(
                [
                    ("origin", pa.string()),
                    ("height", pa.int32()),
                    ("width", pa.int32()),
                    ("nChannels", pa.int32()),
                    ("mode", pa.int32()),
                    ("data", pa.binary()),
                ]
            ),
        )
    ]
)


def _sources(real: DataFrame, num: int, seq: str, offset: int) -> DataFrame:
    """Turns with their source row; the schedule is dealt on keys alone and pixels are joined last."""
    turns = round_robin(real.select(seq), num, seq, offset)
    return turns.join(real.select(seq, "sha1", "origin_id", "scene", "image"), seq)


def build_procedural(real: DataFrame, num: int = 6000, seed: int = 42, seq: str = "seq") -> DataFrame:
    plan = degrade_schedule(_sources(real, num, seq, 0), seed)
    return _rendered(
        plan,
        lambda row, img, rng: D.applied(img, rng, row["classes"], row["strengths"], D.DEGRADE),
        seed,
        lambda row, p: {
            "file": f"procedural/proc_{row['i']:06d}.png", "source": "procedural", "labels": row["classes"], "difficulty": p["_difficulty"]
        },
    )


def build_edits(real: DataFrame, num: int = 2000, seed: int = 42, seq: str = "seq", offset: int = 0, clean: float = 0.15) -> DataFrame:
    def make(row, img, rng):
        if not row["classes"]:
            out, p = D.clean_edit(img, rng)
            return out, p | {"_order": [], "_difficulty": "none"}
        out, p = D.applied(img, rng, row["classes"], row["strengths"], D.EDITS)
        if rng.random() < 0.35:
            out, p["chromatic"] = D.chromatic(out, rng, row["strengths"][0])
        return out, p

    plan = degrade_schedule(_sources(real, num, seq, offset), seed, 0.2, clean, noise_last=False)
    return _rendered(
        plan,
        make,
        seed,
        lambda row, p: {
            "file": f"aigc/aigc_{row['i']:06d}.png",
            "source": "aigc",
            "labels": row["classes"],
            "difficulty": p["_difficulty"],
            "aigc_backend": "edit",
        },
    )


def build_longtail(pool: DataFrame, num: int = 200, seed: int = 42, seq: str = "seq") -> DataFrame:
    kinds = list(D.LONGTAIL)
    plan = _sources(pool, num, seq, 0).withColumn(
        "kind", F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("i") % len(kinds) + 1).cast("int"))
    )

    def make(row, img, rng):
        out, p = D.LONGTAIL[row["kind"]][1](img, rng, "severe")
        return out, p | {"kind": row["kind"], "_order": list(D.LONGTAIL[row["kind"]][0]), "_difficulty": "hard"}

    return _rendered(
        plan,
        make,
        seed,
        lambda row, p: {
            "file": f"longtail/lt_{row['i']:05d}.png",
            "source": "procedural",
            "labels": list(D.LONGTAIL[row["kind"]][0]),
            "difficulty": "hard",
            "split": "eval",
            "eval_longtail": True,
            "review_status": "pending_human",
        },
    )
