"""The registered queries of the pixel kernels and the SQL they are held against.

The images are small tiles made of the rows of embeddings: 64 components are an 8 x 8 plane of bytes, and the three channels
are that plane turned by 0, 7 and 13 places. Bytes are multiples of 8, so that no luminance lies halfway between two numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.functions import image
from datakiln.functions.expressions import hex64, scene_of

_KIND = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())])


def tile(vector: np.ndarray) -> np.ndarray:
    """The 8 x 8 image of 64 numbers."""
    plane = 8 * np.clip(np.floor(vector.astype(np.float64) * 25) + 16, 0, 31)
    return np.stack([np.roll(plane, k).reshape(8, 8) for k in (0, 7, 13)], axis=2).astype(np.uint8)


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, image of every row of embeddings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for v in b.column("embedding"):
                whole = v.is_valid and len(v.values) == 64 and not v.values.null_count
                data = tile(v.values.to_numpy(zero_copy_only=False)).tobytes() if whole else None
                made.append({"height": 8, "width": 8, "nChannels": 3, "data": data})
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(made, _KIND)], names=["vec_id", "image"])

    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return rows.mapInArrow(run, "vec_id long, image struct<height:int,width:int,nChannels:int,data:binary>")


def _plane(turn: int) -> str:
    return f"8 * greatest(0, least(31, floor(embedding[(i + 64 - {turn}) % 64 + 1]::DOUBLE * 25) + 16))"


PIXELS = f"""px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, {_plane(0)} AS b, {_plane(7)} AS g, {_plane(13)} AS r
      FROM embeddings, (SELECT unnest(range(0, 64)) AS i)),
gray AS (SELECT vec_id, y, x, round_even(0.114 * b + 0.587 * g + 0.299 * r, 0) AS v FROM px),
hsv AS (SELECT vec_id, y, x, greatest(b, g, r) AS v, CASE WHEN greatest(b, g, r) > 0
        THEN round_even((greatest(b, g, r) - least(b, g, r)) / greatest(b, g, r) * 255, 0) ELSE 0 END AS s FROM px)"""


def _laplacian(name: str, table: str, column: str) -> str:
    """vec_id, l: the Laplacian of a column, borders mirrored without the edge."""
    at = f"(SELECT vec_id, y, x, {column} AS v FROM {table})"
    near = "OR ".join(
        f"(o.y = CASE WHEN c.y + {dy} < 0 THEN 1 WHEN c.y + {dy} > 7 THEN 6 ELSE c.y + {dy} END "
        f"AND o.x = CASE WHEN c.x + {dx} < 0 THEN 1 WHEN c.x + {dx} > 7 THEN 6 ELSE c.x + {dx} END AND k = {k}) "
        for k, (dy, dx) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1)))
    )
    return f"""{name} AS (SELECT c.vec_id, sum(o.v) - 4 * any_value(c.v) AS l FROM {at} c JOIN (SELECT unnest(range(0, 4)) AS k) ON true
      JOIN {at} o ON o.vec_id = c.vec_id AND ({near}) GROUP BY c.vec_id, c.y, c.x)"""


QUALITY_SQL = f"""WITH {PIXELS}, {_laplacian("lap", "gray", "v")},
m AS (SELECT vec_id, round(avg(v), 6) AS mean_lum FROM gray GROUP BY 1), l AS (SELECT vec_id, round(var_pop(l), 4) AS lap_var FROM lap GROUP BY 1)
SELECT vec_id, mean_lum, lap_var FROM m JOIN l USING (vec_id)"""


def image_quality(spark: SparkSession, d: str) -> DataFrame:
    m = image.assess_quality(tiles(spark, d))
    return m.select("vec_id", F.round("mean_lum", 6).alias("mean_lum"), F.round("lap_var", 4).alias("lap_var"))


SCENE_SQL = f"""WITH {PIXELS},
c AS (SELECT vec_id, avg(b) AS b, avg(g) AS g, avg(r) AS r, avg((g - r > 20)::INTEGER) AS green FROM px GROUP BY 1),
m AS (SELECT vec_id, avg(v) AS mean FROM gray GROUP BY 1),
k AS (SELECT vec_id, avg((v > 150 AND s < 70)::INTEGER) AS sky FROM hsv WHERE y < 2 GROUP BY 1)
SELECT vec_id, round(mean, 6) AS mean, round(b, 6) AS b, round(g, 6) AS g, round(r, 6) AS r, round(sky, 6) AS sky, round(green, 6) AS green,
       CASE WHEN mean < 60 OR mean < 95 AND b > r + 12 AND b > g THEN 'night' WHEN sky + green > 0.18 THEN 'outdoor' ELSE 'indoor' END AS scene
FROM c JOIN m USING (vec_id) JOIN k USING (vec_id)"""


def image_scene(spark: SparkSession, d: str) -> DataFrame:
    names = ("mean", "b", "g", "r", "sky", "green")
    m = image.with_scene_stats(tiles(spark, d))
    return m.select("vec_id", *(F.round(n, 6).alias(n) for n in names), scene_of(*map(F.col, names)).alias("scene"))


INDICATORS_SQL = f"""WITH {PIXELS}, {_laplacian("lap", "gray", "v")}, {_laplacian("flat", "hsv", "s")},
f AS (SELECT unnest(range(-4, 4)) AS u), w AS (SELECT a.u AS u, b.u AS v FROM f a, f b),
p AS (SELECT vec_id, u, w.v, sqrt(sum(gray.v * cos(2 * pi() * (u * y + w.v * x) / 8)) ** 2 + sum(gray.v * sin(2 * pi() * (u * y + w.v * x) / 8)) ** 2) AS power
      FROM gray, w GROUP BY ALL),
q AS (SELECT vec_id, sum(power) FILTER (u IN (-1, 0) AND v IN (-1, 0)) / (sum(power) + 1e-6) AS ratio FROM p GROUP BY 1),
l AS (SELECT vec_id, var_pop(l) AS l FROM lap GROUP BY 1), s AS (SELECT vec_id, var_pop(l) AS l FROM flat GROUP BY 1),
m AS (SELECT vec_id, avg(v) AS m FROM gray GROUP BY 1)
SELECT vec_id, round(l.l, 4) AS blur_inv, round(ratio, 6) AS low_freq_ratio, round(m, 6) AS bright, (s.l < 30)::INTEGER::DOUBLE AS flat_area
FROM l JOIN s USING (vec_id) JOIN m USING (vec_id) JOIN q USING (vec_id)"""


def image_indicators(spark: SparkSession, d: str) -> DataFrame:
    m = image.with_indicators(tiles(spark, d))
    rounded = (F.round(n, k).alias(n) for n, k in (("blur_inv", 4), ("low_freq_ratio", 6), ("bright", 6)))
    return m.select("vec_id", *rounded, "flat_area")


PHASH_SQL = f"""WITH {PIXELS},
a AS (SELECT i, greatest(0.0, least(7.0, (i + 0.5) / 4 - 0.5)) AS pos FROM (SELECT unnest(range(0, 32)) AS i)),
wt AS (SELECT i, floor(pos)::INTEGER AS j, 1 - (pos - floor(pos)) AS w FROM a
       UNION ALL SELECT i, floor(pos)::INTEGER + 1, pos - floor(pos) FROM a WHERE pos > floor(pos)),
big AS (SELECT vec_id, r.i AS y, c.i AS x, round_even(sum(r.w * c.w * v), 0) AS v FROM gray JOIN wt r ON r.j = gray.y JOIN wt c ON c.j = gray.x GROUP BY ALL),
d AS (SELECT k, n, cos(pi() * (2 * n + 1) * k / 64) * sqrt(2 / 32) / CASE WHEN k = 0 THEN sqrt(2) ELSE 1 END AS c
      FROM (SELECT unnest(range(0, 8)) AS k), (SELECT unnest(range(0, 32)) AS n)),
h AS (SELECT vec_id, k AS u, x, sum(c * v) AS v FROM big JOIN d ON n = y GROUP BY ALL),
low AS (SELECT vec_id, u, k AS v, sum(c * h.v) AS p FROM h JOIN d ON n = x GROUP BY ALL),
m AS (SELECT vec_id, median(p) AS m FROM low GROUP BY 1),
bits AS (SELECT vec_id, (u * 8 + v) // 4 AS pos, sum(CASE WHEN p > m THEN 1 << (3 - (u * 8 + v) % 4)::INTEGER ELSE 0 END) AS digit
         FROM low JOIN m USING (vec_id) GROUP BY ALL)
SELECT vec_id, string_agg(substr('0123456789abcdef', digit::INTEGER + 1, 1), '' ORDER BY pos) AS phash FROM bits GROUP BY 1"""


def image_phash(spark: SparkSession, d: str) -> DataFrame:
    return image.with_phash(tiles(spark, d)).select("vec_id", hex64(F.col("phash")).alias("phash"))


RESIZE_SQL = f"""WITH {PIXELS},
s AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, round_even(avg(b), 0) AS b, round_even(avg(g), 0) AS g, round_even(avg(r), 0) AS r FROM px GROUP BY ALL)
SELECT vec_id, 4::BIGINT AS width, 4::BIGINT AS height, sum((1 + 4 * y + x) * b)::BIGINT AS b, sum((1 + 4 * y + x) * g)::BIGINT AS g,
       sum((1 + 4 * y + x) * r)::BIGINT AS r FROM s GROUP BY 1"""


def image_resize(spark: SparkSession, d: str) -> DataFrame:
    """Sums over the pixels of the smaller image, each times its place."""

    def small(img: np.ndarray) -> dict[str, float]:
        out = image.keep_aspect(img, 4)
        sums = (out.reshape(-1, 3) * np.arange(1, out.shape[0] * out.shape[1] + 1)[:, None]).sum(axis=0)
        return {"width": out.shape[1], "height": out.shape[0], **{n: float(v) for n, v in zip("bgr", sums)}}

    names = ["width", "height", "b", "g", "r"]
    return image.measured(tiles(spark, d), small, names).select("vec_id", *(F.col(n).cast("long").alias(n) for n in names))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "image_quality": image_quality,
    "image_scene": image_scene,
    "image_indicators": image_indicators,
    "image_phash": image_phash,
    "image_resize": image_resize,
}
ORACLE_SQL = {
    "image_quality": QUALITY_SQL,
    "image_scene": SCENE_SQL,
    "image_indicators": INDICATORS_SQL,
    "image_phash": PHASH_SQL,
    "image_resize": RESIZE_SQL,
}
