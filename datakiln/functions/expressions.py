"""Column expressions: labels, scores, strata and answers. No UDF among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from datakiln.functions import constants as C


def _classes(classes: Sequence[str]) -> Column:
    return F.array(*(F.lit(c) for c in classes))


def labels_to_multihot(labels: Column, classes: Sequence[str] = C.CLASSES) -> Column:
    """1 or 0 per class; unknown labels are ignored and null labels are none."""
    return F.transform(_classes(classes), lambda c: F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("int"))


def multihot_to_labels(vector: Column, classes: Sequence[str] = C.CLASSES) -> Column:
    """Classes whose entry is over one half."""
    pairs = F.zip_with(_classes(classes), vector, lambda c, v: F.when(v > 0.5, c))
    return F.filter(pairs, lambda c: c.isNotNull())


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def apply_temperature(logit: Column, temperature: Column | float) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return logit / F.greatest(F.lit(1e-3), t)


def stable_bce(logit: Column, y: Column) -> Column:
    """Binary cross entropy of a logit without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def known_labels(labels: Column, classes: Sequence[str] = C.CLASSES) -> Column:
    """Labels that are classes; order and repeats stay."""
    return F.filter(labels, lambda x: x.isin(*classes))


def label_iou(a: Column, b: Column) -> Column:
    """Jaccard index of two label sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def same_labels(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def clean_frame_reason(width: Column, height: Column, sharpness: Column, luminance: Column, night: Column) -> Column:
    """Why a frame is not clean (the first rule that it breaks), null if it is."""
    sharp = F.when(night, C.LEAST_SHARPNESS["night"]).otherwise(C.LEAST_SHARPNESS["day"])
    low, high = (F.when(night, C.LUMINANCE["night"][i]).otherwise(C.LUMINANCE["day"][i]) for i in (0, 1))
    return F.when(F.least(width, height) < C.LEAST_SIDE, C.TOO_SMALL).when(sharpness < sharp, C.TOO_BLURRED).when(
        (luminance < low) | (luminance > high), C.OUT_OF_RANGE
    )


def scene_of(mean: Column, b: Column, g: Column, r: Column, sky: Column, green: Column) -> Column:
    """Scene from channel means and the shares of sky and green pixels."""
    bluish = (b > r + 12) & (b > g)
    return F.when(mean < 60, "night").when((mean < 95) & bluish, "night").when(sky + green > 0.18, "outdoor").otherwise("indoor")


def stratum(labels: Column, order: Column, scene: Column, difficulty: Column, classes: Sequence[str] = C.CLASSES) -> Column:
    """defect, scene, difficulty of a sample: the first applied class, else the first label; clean samples are normal, none."""
    clean = F.coalesce(F.size(labels), F.lit(0)) <= 0
    first = F.try_element_at(order, F.lit(1))
    defect = F.when(clean, C.NORMAL).when(first.isin(*classes), first).otherwise(F.try_element_at(labels, F.lit(1)))
    level = F.when(clean, "none").otherwise(F.coalesce(difficulty, F.lit("mid")))
    return F.struct(defect.alias("defect"), F.coalesce(scene, F.lit("indoor")).alias("scene"), level.alias("difficulty"))


def hardest(strengths: Column) -> Column:
    """Difficulty of the mildest strength among those applied: a mild defect is hard to see."""
    return F.when(F.exists(strengths, lambda s: s == "mild"), "hard").when(
        F.exists(strengths, lambda s: s == "moderate"), "mid"
    ).otherwise("easy")


def prompt_labels(prompt: Column) -> Column:
    """Labels of the phrases that a prompt holds, in the order of the phrase table."""
    text = F.lower(F.coalesce(prompt, F.lit("")))
    return F.filter(F.array(*(F.when(text.contains(p), label) for p, label in C.PROMPT_LABELS)), lambda x: x.isNotNull())


def answer_labels(answer: Column, classes: Sequence[str] = C.CLASSES) -> Column:
    """Known labels of the JSON object in a model's answer (from its first to its last brace); none if there is no such list."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1)
    found = F.try_variant_get(F.try_parse_json(F.nullif(body, F.lit(""))), "$.labels", "array<string>")
    return F.coalesce(known_labels(found, classes), F.array().cast("array<string>"))


def label_scores(labels: Column, classes: Sequence[str] = C.CLASSES) -> Column:
    """1 or 0 by class name."""
    return F.map_from_arrays(_classes(classes), F.transform(labels_to_multihot(labels, classes), lambda v: v.cast("double")))


def split_labels(text: Column) -> Column:
    """Labels in a string, parted by comma or bar; trimmed, empty ones left out."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), "|", ","), ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def percent(value: Column, digits: int = 1) -> Column:
    """A share as a percentage; what lies exactly between two numbers goes to the even one."""
    pattern = F.lit("0." + "0" * digits if digits else "0")
    shown = F.call_function("format_number", (value * 100).cast("double"), pattern)
    return F.when(value.isNull(), "n/a").otherwise(F.concat(shown, F.lit("%")))


def relative_path(path: Column, root: str) -> Column:
    """Path below root with forward slashes, else the path as it is."""
    slashes = F.translate(path, "\\", "/")
    base = root.rstrip("/") + "/"
    return F.when(slashes.startswith(base), F.substring(slashes, len(base) + 1, 1 << 20)).otherwise(slashes)


def order_key(seed: int, key: Column) -> Column:
    """Pseudo-random order of rows that any engine with MD5 gives alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def median_hash(vector: Column) -> Column:
    """64 bits of a vector of 64 numbers, first component highest: set where a component is over the median."""
    ordered = F.array_sort(vector)
    middle = (F.element_at(ordered, 32).cast("double") + F.element_at(ordered, 33).cast("double")) / 2
    pair = F.aggregate(
        vector,
        F.struct(F.lit(0).cast("long").alias("h"), middle.alias("m")),
        lambda a, x: F.struct(
            F.shiftleft(a["h"], 1).bitwiseOR(
                F.when(x.cast("double") > a["m"], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
            ).alias("h"),
            a["m"].alias("m"),
        ),
    )
    return pair["h"]


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
