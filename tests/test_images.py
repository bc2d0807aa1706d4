import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from datakiln.functions import degrade, image
from datakiln.operators import generators
from datakiln.plans import pipeline
from datakiln.sources import images, manifest, sheets
from datakiln.streaming.ingest import ingest


def scene(seed, h=64, w=80):
    rng = np.random.default_rng(seed)
    return image.resized(rng.integers(0, 256, (h // 4, w // 4, 3)).astype(np.uint8), h, w, "linear")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("png")
    for i in range(6):
        (top / f"{i}.png").write_bytes(images.png_bytes(scene(i)))
    (top / "bad.png").write_bytes(b"no image")
    return str(top)


def test_png_round_trip_and_reader(spark, folder):
    rows = images.read_images(spark, folder).collect()
    assert len(rows) == 6
    for r in rows:
        i = int(r.origin.rsplit("/", 1)[1][0])
        assert (image.pixels(r.image.asDict()) == scene(i)).all()


def test_measures(spark, folder):
    df = image.with_indicators(image.assess_quality(image.with_phash(images.read_images(spark, folder))))
    for r in df.collect():
        img = image.pixels(r.image.asDict())
        g = np.rint(img @ image.LUMA)
        assert abs(r.mean_lum - g.mean()) < 1e-9 and r.lap_var == r.blur_inv and r.phash is not None
    assert images.collect_from_dir(spark, folder, 3).count() == 0  # all are too small


@pytest.mark.parametrize(
    "name,kernel",
    [
        *degrade.DEGRADE.items(),
        *((f"edit_{k}", v) for k, v in degrade.EDITS.items()),
        *((f"tail_{k}", v[1]) for k, v in degrade.LONGTAIL.items()),
        ("clean", degrade.clean_edit),
        ("chromatic", degrade.chromatic),
    ],
)
@pytest.mark.parametrize("strength", degrade.STRENGTHS)
def test_kernels(name, kernel, strength):
    img = scene(1)
    out, params = kernel(img, np.random.default_rng(7), strength)
    again, _ = kernel(img, np.random.default_rng(7), strength)
    assert out.shape == img.shape and out.dtype == np.uint8 and (out == again).all()
    json.dumps(params)
    if name in ("dark", "edit_dark"):
        assert out.mean() < img.mean()
    if name == "over_expo":
        assert out.mean() > img.mean()
    if name == "blur":
        assert image.quality(out)["lap_var"] < image.quality(img)["lap_var"]


def _real(spark, folder):
    rows = images.read_images(spark, folder).withColumn("seq", F.regexp_extract("origin", r"(\d)\.png", 1).cast("long"))
    return rows.select(
        "seq",
        F.concat(F.lit("real/"), F.col("seq").cast("string")).alias("file"),
        F.sha1("image.data").alias("sha1"),
        F.lit("real").alias("source"),
        F.concat(F.lit("real_"), F.col("seq").cast("string")).alias("origin_id"),
        F.array().cast("array<string>").alias("labels"),
        F.lit("indoor").alias("scene"),
        F.lit("none").alias("difficulty"),
        "image",
    )


def test_generators_are_repeatable(spark, folder, tmp_path):
    real = _real(spark, folder)
    a = {r.file: r for r in generators.build_procedural(real, 20).collect()}
    b = {r.file: r for r in generators.build_procedural(real.repartition(3), 20).collect()}
    assert len(a) == 20 and {k: v.sha1 for k, v in a.items()} == {k: v.sha1 for k, v in b.items()}
    for r in a.values():
        assert r.labels and json.loads(r.params)["_order"] == r.labels and "noise" not in r.labels[:-1]
        assert r.origin_id == f"real_{r.i % 6}"
    assert generators.build_edits(real, 30).where(F.size("labels") == 0).count() > 0
    tail = generators.build_longtail(real, 5)
    assert {r.difficulty for r in tail.collect()} == {"hard"}
    images.register(spark)
    tail.select("file", "image").write.format("png_files").mode("append").save(f"file://{tmp_path}/out")
    assert images.read_images(spark, f"{tmp_path}/out").count() == 5


def test_frames(spark, tmp_path):
    np.save(tmp_path / "clip.npy", np.stack([scene(i) for i in range(7)]))
    images.register(spark)
    got = spark.read.format("frames").option("path", f"file://{tmp_path}/clip.npy").option("every", "3").load()
    assert sorted(r.fid for r in got.collect()) == [0, 3, 6]


def test_curate(spark, folder):
    real = image.with_phash(_real(spark, folder))
    made = pipeline.curate(real, procedural=30, edits=12, eval_target=10, picked=6, longtail=5)
    frozen = made.eval_set.collect()
    assert len({r.file for r in frozen}) == len(frozen) and sum(r.longtail for r in frozen) == 5


def test_manifest_and_sheets(spark, tmp_path):
    path = str(tmp_path / "m")
    assert manifest.load_manifest(spark, path).count() == 0
    rows = spark.createDataFrame([(1, "a", '{"_order": ["blur"]}'), (2, "b", None)], "seq long, file string, params string")
    manifest.append_manifest(rows, path)
    manifest.append_manifest(rows, path)
    back = manifest.with_defaults(manifest.load_manifest(spark, path))
    assert back.count() == 4 and back.where("order[0] = 'blur' and not dedup_removed").count() == 2
    manifest.export_manifest_json(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    manifest.export_manifest_json(rows, str(tmp_path / "j"), one_array=True)
    assert len(json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect()))) == 2
    (tmp_path / "bad.jsonl").write_text('{"seq": 1}\n{oops\n')
    with pytest.raises(Exception):
        manifest.load_manifest(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "s.csv").write_text("﻿file,labels\n x ,blur|dark\nx,noise\n,blur\ny,\n", encoding="utf-8")
    assert {r.file: r.labels for r in sheets.read_single(spark, str(tmp_path / "s.csv")).collect()} == {"x": ["noise"], "y": []}
    (tmp_path / "s.txt").write_text("file\tannotator1\tannotator2\nx\tblur,dark\tblur\n")
    assert sheets.read_annotations(spark, str(tmp_path / "s.txt")).first().annotator1 == ["blur", "dark"]
    (tmp_path / "e.csv").write_bytes(b"%TSD-Header-###%")
    with pytest.raises(ValueError):
        sheets.read_rows(spark, str(tmp_path / "e.csv"))


def _jpeg(spark, img):
    """A JPEG of the image by the JVM's encoder."""
    jvm = spark._jvm
    out, picture = jvm.java.io.ByteArrayOutputStream(), jvm.java.awt.image.BufferedImage(img.shape[1], img.shape[0], 5)
    for y, row in enumerate(img.astype(int).tolist()):
        for x, (b, g, r) in enumerate(row):
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
    return bytes(out.toByteArray())


def test_shards_of_jpeg_and_png(spark, tmp_path):
    smooth = (np.add.outer(np.arange(24) * 4, np.arange(32) * 3)[:, :, None] + [10, 30, 50]).astype(np.uint8)
    jpeg = _jpeg(spark, smooth)
    data = [(1, (images.png_bytes(scene(1)), "p")), (2, (jpeg, "q")), (3, (jpeg, "r")), (4, (b"junk", "s")), (5, (None, "t"))]
    df = spark.createDataFrame(data, "id long, picture struct<bytes:binary,path:string>")
    df.write.parquet(str(tmp_path / "s.parquet"))
    assert images.find_image_column(df.schema) == "picture"
    assert images.decoded(images.read_shards(spark, str(tmp_path / "s.parquet"))).count() == 3
    rows = images.decoded(df.select("id", images.image_bytes(df).alias("content")), drop_invalid=False)
    got = {r.id: r.image for r in rows.collect()}
    assert (image.pixels(got[1].asDict()) == scene(1)).all() and got[4] is None and got[5] is None
    for k in (2, 3):  # a lossy codec: close to what went in
        assert np.abs(image.pixels(got[k].asDict()).astype(int) - smooth.astype(int)).mean() < 8
    assert images.decode_report(rows).first().asDict() == {"total": 5, "decoded": 3, "undecodable": 2}
    assert images.decoded(df.where("false").select(images.image_bytes(df).alias("content"))).count() == 0


def test_kernels_against_plain_loops(monkeypatch):
    """Brute force: resizing, the Laplacian, convolution, the cosine transform and the hash as sums written out."""
    img = scene(3, 12, 16)
    g = image.gray(img).astype(int)
    h, w = g.shape
    at = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i  # noqa: E731  mirrored without the edge
    lap = [
        [
            g[at(y - 1, h), x] + g[at(y + 1, h), x] + g[y, at(x - 1, w)] + g[y, at(x + 1, w)] - 4 * g[y, x] for x in range(w)
        ] for y in range(h)
    ]
    assert np.array_equal(image.laplacian(image.gray(img)), lap)
    kernel = np.arange(9.0).reshape(3, 3)
    plain = [
        [sum(kernel[i, j] * g[at(y + i - 1, h), at(x + j - 1, w)] for i in range(3) for j in range(3)) for x in range(w)] for y in range(h)
    ]
    for taps in (64, 0):  # entry by entry, and by the Fourier transform
        monkeypatch.setattr(image, "MOST_TAPS", taps)
        assert np.allclose(image.convolved(image.gray(img)[:, :, None], kernel)[:, :, 0], plain)
        assert np.allclose(image.convolved(image.gray(img), kernel), plain)
    small = image.resized(img, 6, 4)
    for y in range(6):
        for x in range(4):
            assert (small[y, x] == np.rint(img[2 * y : 2 * y + 2, 4 * x : 4 * x + 4].reshape(-1, 3).mean(axis=0))).all()
    wide = image.resized(img, 12, 32).astype(int)
    for x in range(32):
        u = min(max((x + 0.5) * 16 / 32 - 0.5, 0), 15)
        low = int(u)
        want = img[:, low] * (1 - (u - low)) + img[:, min(low + 1, 15)] * (u - low)
        assert np.abs(wide[:, x] - want).max() <= 0.5 + 1e-9
    d = image.dct_matrix(8)
    for k in range(8):
        for n in range(8):
            assert np.isclose(d[k, n], np.cos(np.pi * (2 * n + 1) * k / 16) * (0.5 if k else np.sqrt(1 / 8)))
    big = image.resized(image.gray(img), 32, 32).astype(float)
    c = [[np.cos(np.pi * (2 * n + 1) * k / 64) * np.sqrt((2 if k else 1) / 32) for n in range(32)] for k in range(8)]
    low = [[sum(c[u][y] * c[v][x] * big[y, x] for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    bits = "".join("1" if v > np.median(low) else "0" for row in low for v in row)
    assert image.phash(img) == int(bits, 2)


def test_stream_adds_each_file_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text('{"seq": 1, "file": "a"}\n{"seq": 2, "file": "a"}\n{"seq": 3, "file": "b"}\n')
    ingest(spark, str(src), out, str(tmp_path / "c")).awaitTermination()
    (src / "2.json").write_text('{"seq": 4, "file": "b"}\n{"seq": 5, "file": "c"}\n')
    ingest(spark, str(src), out, str(tmp_path / "c")).awaitTermination()
    assert sorted((r.file, r.seq) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3), ("c", 5)]


def test_sheets_of_several_files_keep_their_order(spark, tmp_path):
    (tmp_path / "sheets").mkdir()
    (tmp_path / "sheets/a.csv").write_text("file,labels\nx,noise\n")
    (tmp_path / "sheets/b.csv").write_text("file,labels\n" + "".join(f"f{i},dark\n" for i in range(5000)) + "x,blur\nx,dark\n")
    found = sheets.read_single(spark, f"{tmp_path}/sheets").where("file = 'x'").first()
    assert found.labels == ["dark"]
    (tmp_path / "sheets/c.csv").write_bytes(sheets.PROTECTED + b"\0\1")
    with pytest.raises(ValueError):
        sheets.read_rows(spark, f"{tmp_path}/sheets")
