"""Registered queries of filters, files and formats, and the SQL they are held against. Files go to the shared folder and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datakiln.functions import constants as C
from datakiln.functions import expressions as X
from datakiln.functions import image
from datakiln.operators import consistency, evaluation, sampling, tables, training
from datakiln.plans import experiments, image_queries
from datakiln.sources import images, manifest, sheets
from datakiln.sources.scratch import new_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """documents as manifest rows: marks, splits, sources and labels follow from doc_id."""
    i = F.col("doc_id")
    names = [i.alias("seq"), F.concat(F.lit("img/"), i.cast("string")).alias("file"), F.md5("text").alias("sha1")]
    source = F.element_at(F.array(*(F.lit(s) for s in C.SOURCES)), (i % 3 + 1).cast("int")).alias("source")
    split = F.element_at(F.array(*(F.lit(s) for s in C.SPLITS)), (F.expr("doc_id div 3") % 4 + 1).cast("int")).alias("split")
    removed = F.when(i % 7 == 0, True).when(i % 7 == 2, False).alias("dedup_removed")
    longtail = F.when(i % 11 == 0, True).when(i % 11 == 1, False).alias("eval_longtail")
    labels = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit("blur"), F.lit("dark")))
    origin = F.concat(F.lit("o"), (i % 40).cast("string")).alias("origin_id")
    return spark.read.parquet(f"{d}/documents.parquet").select(*names, source, split, removed, longtail, labels.alias("labels"), origin)


M = """m AS (SELECT doc_id AS seq, 'img/' || doc_id AS file, md5(text) AS sha1, ['real', 'procedural', 'aigc'][doc_id % 3 + 1] AS source,
      ['train', 'val', 'test', 'eval'][doc_id // 3 % 4 + 1] AS split,
      CASE WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 7 = 2 THEN false END AS dedup_removed,
      CASE WHEN doc_id % 11 = 0 THEN true WHEN doc_id % 11 = 1 THEN false END AS eval_longtail,
      CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'blur|dark' END AS labels, 'o' || doc_id % 40 AS origin_id FROM documents)"""
ACTIVE = "NOT coalesce(dedup_removed, false)"


@query("active_rows", f"WITH {M} SELECT file FROM m WHERE {ACTIVE}")
def _(spark, d):
    return tables.active(_manifest(spark, d)).select("file")


@query("of_source", f"WITH {M} SELECT file, source FROM m WHERE source IN ('real', 'aigc') AND source NOT IN ('aigc')")
def _(spark, d):
    return tables.of_source(_manifest(spark, d), keep=["real", "aigc"], exclude=["aigc"]).select("file", "source")


@query("of_split", f"WITH {M} SELECT file, split FROM m WHERE split = 'val'")
def _(spark, d):
    return tables.of_split(_manifest(spark, d), "val").select("file", "split")


@query("eval_pool", f"WITH {M} SELECT file FROM m WHERE {ACTIVE} AND split = 'eval' AND NOT coalesce(eval_longtail, false)")
def _(spark, d):
    return tables.eval_pool(_manifest(spark, d)).select("file")


@query(
    "longtail_pool",
    f"WITH {M} SELECT file FROM m WHERE source = 'real' AND {ACTIVE} AND origin_id IN (SELECT origin_id FROM m WHERE split = 'eval')",
)
def _(spark, d):
    return tables.longtail_pool(_manifest(spark, d)).select("file")


@query("first_clean", f"WITH {M} SELECT seq FROM m WHERE coalesce(labels, '') = '' ORDER BY seq LIMIT 30")
def _(spark, d):
    return consistency.first_clean(_manifest(spark, d), 30).select("seq")


@query(
    "manifest_union",
    f"WITH {M} SELECT file, source, NULL::INTEGER AS width FROM m WHERE seq % 2 = 0 UNION ALL SELECT file, NULL, 7 FROM m WHERE seq % 2 = "
    f"1",
)
def _(spark, d):
    rows = _manifest(spark, d)
    even, odd = rows.where("seq % 2 = 0").select("file", "source"), rows.where("seq % 2 = 1").select("file", F.lit(7).alias("width"))
    return tables.manifest_union(even, odd)


@query("unique_files", f"WITH {M} SELECT (SELECT count(DISTINCT file) FROM m) AS files, (SELECT count(DISTINCT sha1) FROM m) AS contents")
def _(spark, d):
    m = _manifest(spark, d)
    found = experiments.unique_files(m.unionByName(m.where("seq % 3 = 0"))), experiments.unique_files(m, "sha1")
    return spark.createDataFrame([found], "files long, contents long")


@query(
    "percent_text",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'n/a' ELSE printf('%.1f%%', doc_id % 1000 / 1024 * 100) END AS share FROM documents",
)
def _(spark, d):
    share = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 1000 / 1024)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.percent(share).alias("share"))


@query("relative_path", f"WITH {M} SELECT seq, CASE WHEN seq % 2 = 0 THEN file ELSE '/other/' || file END AS path FROM m")
def _(spark, d):
    below = F.concat(F.lit("\\data\\set\\"), F.translate("file", "/", "\\"))
    path = F.when(F.col("seq") % 2 == 0, below).otherwise(F.concat(F.lit("/other/"), "file"))
    return _manifest(spark, d).select("seq", X.relative_path(path, "/data/set").alias("path"))


@query("extrapolated_hours", "SELECT l_orderkey, l_linenumber, round(6400 / l_quantity * 10 * 3 / 3600, 6) AS hours FROM lineitem")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("images_per_second", F.col("l_quantity"))
    return tables.extrapolated_hours(rows).select("l_orderkey", "l_linenumber", F.round("hours", 6).alias("hours"))


@query(
    "auto_probs",
    "WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) AS i FROM embeddings), "
    "z AS (SELECT 'logits' AS kind, vec_id, i, p FROM s UNION ALL SELECT 'probs', vec_id, i, abs(p) FROM s) "
    "SELECT kind, vec_id, round(sum(CASE WHEN kind = 'logits' THEN 1 / (1 + exp(-p)) ELSE p END), 6) AS total FROM z GROUP BY ALL",
)
def _(spark, d):
    long = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.explode("embedding").alias("p"))
    both = {"logits": F.col("p").cast("double"), "probs": F.abs(F.col("p").cast("double"))}
    parts = [evaluation.with_auto_probs(long.select("vec_id", p.alias("prob"))).withColumn("kind", F.lit(k)) for k, p in both.items()]
    return parts[0].unionByName(parts[1]).groupBy("kind", "vec_id").agg(F.round(F.sum("prob"), 6).alias("total"))


VOCABULARY = ", ".join(f"('{c}', '{name}', {i})" for i, (c, name) in enumerate(C.CLASS_CN.items()))


@query(
    "vocabulary",
    f"WITH {M}, v(class, name, place) AS (VALUES {VOCABULARY}), l AS (SELECT unnest(string_split(labels, '|')) AS class FROM m) "
    "SELECT class, name, place, count(l.class) AS n FROM v LEFT JOIN l USING (class) GROUP BY ALL",
)
def _(spark, d):
    """The classes with their names and how many samples of the manifest have each."""
    rows = spark.createDataFrame([(c, C.CLASS_CN[c], i) for i, c in enumerate(C.CLASSES)], "class string, name string, place int")
    used = _manifest(spark, d).select(F.explode("labels").alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return rows.join(used, "class", "left").fillna(0, ["n"])


@query(
    "markdown_report",
    "WITH g AS (SELECT lang, count(*) AS n, avg(n_chars) AS chars FROM documents GROUP BY 1) SELECT '| lang | n | chars |' || chr(10) || "
    "'| --- | --- | --- |' || chr(10) || string_agg(printf('| %s | %d | %.4f |', lang, n, chars), chr(10) ORDER BY lang) AS report FROM g",
)
def _(spark, d):
    g = spark.read.parquet(f"{d}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("chars"))
    return spark.createDataFrame([(tables.to_markdown(g.orderBy("lang")),)], "report string")


@query(
    "tune_ranking",
    "SELECT o_orderkey AS name, round_even(o_totalprice, 0) AS macro_f1, "
    "row_number() OVER (ORDER BY round_even(o_totalprice, 0) DESC, o_orderkey)::BIGINT AS place FROM orders",
)
def _(spark, d):
    """The whole ranking, with places from the order in which its parts come: no part is moved or counted twice."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("name"), F.bround("o_totalprice", 0).alias("macro_f1")
    )
    part, nth = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranked = written(tables.tune_ranking(rows).withColumn("part", part).withColumn("nth", nth))
    sizes = ranked.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as parts
    bases = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return ranked.join(F.broadcast(bases), "part").select("name", "macro_f1", (F.col("base") + F.col("nth") + 1).alias("place"))


# ---- training ----------------------------------------------------------------------------------------------------------
def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with labels as samples: two features, and quality and toxic as targets."""
    rows = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    x = F.array(F.col("n_chars") / 1000.0, F.col("doc_id") % 7 / 7.0).alias("features")
    return rows.select(F.col("doc_id").cast("string").alias("file"), x, F.array("quality", "toxic").alias("truth"))


#: Weights of two features for two classes and a bias for each, and the weight of the positives of each class.
LINE, POSITIVES = (0.5, -0.25, 0.125, 0.75, 0.0625, -1.0), (2.0, 0.5)
_Z = [f"x1 * {LINE[c]}e0 + x2 * {LINE[2 + c]}e0 + ({LINE[4 + c]}e0)" for c in (0, 1)]
_BACK = ", ".join(
    f"{POSITIVES[c]}e0 * y{c} * (1 / (1 + exp(-({_Z[c]}))) - 1) + (1 - y{c}) / (1 + exp(-({_Z[c]}))) AS b{c}, "
    f"{POSITIVES[c]}e0 * y{c} * ln(1 + exp(-({_Z[c]}))) + (1 - y{c}) * ln(1 + exp({_Z[c]})) AS l{c}" for c in (0, 1)
)
_PLACES = ("l0 + l1", "x1 * b0", "x1 * b1", "x2 * b0", "x2 * b1", "b0", "b1")


@query(
    "weighted_gradient",
    "WITH r AS (SELECT n_chars / 1000e0 AS x1, doc_id % 7 / 7e0 AS x2, quality AS y0, toxic AS y1 FROM documents JOIN labels USING (doc_id) "
    f"WHERE n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL), g AS (SELECT *, {_BACK} FROM r) "
    + " UNION ALL ".join(f"SELECT {i}::INTEGER AS place, round(avg({x}), 6) AS value FROM g" for i, x in enumerate(_PLACES)),
)
def _(spark, d):
    """The mean weighted cross-entropy of a linear model and its gradient."""
    run = training.Run("line", training.Settings(hidden=0), 2, 2, np.zeros(2), np.ones(2), np.array(POSITIVES), np.array(LINE))
    rows = training.usable(_labelled(spark, d), 2, 2).select(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_mixes").alias("mixes"))
    training.summed(rows, [run], training.step_sums)
    found = [] if run.total is None else [(i, float(v / run.total[0])) for i, v in enumerate(run.total[1:])]
    return spark.createDataFrame(found, "place int, value double").select("place", F.round("value", 6).alias("value"))


def network_history(spark: SparkSession, d: str) -> DataFrame:
    """Loss and macro F1 of the epochs of four runs that train together; a fifth of the documents validates."""
    rows = _labelled(spark, d)
    held = F.pmod(F.xxhash64("file"), F.lit(5)) == 0
    settings = {f"h{h}-{s}": training.Settings(h, 3, seed=s) for h in (0, 8) for s in (1, 2)}
    runs = training.train_runs(rows.where(~held), rows.where(held), ("quality", "toxic"), settings, batches=2)
    return training.history(spark, runs)


def network_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all labelled documents by two runs that train together on all of them."""
    rows = _labelled(spark, d)
    runs = training.train_runs(rows, rows, ("quality", "toxic"), {f"h{h}": training.Settings(h, 2) for h in (0, 8)}, batches=2)
    return training.network_scores(rows, runs, ("quality", "toxic")).drop("prob")


QUERIES |= {"network_history": network_history, "network_scores": network_scores}
MIXES = {"quarter": (0.25, 1), "half": (0.5, 2), "all": (1.0, 1)}
_TAKEN = " UNION ALL ".join(
    f"SELECT '{n}' AS mix, {r}e0 AS ratio, {s} AS seed" for n, (r, s) in MIXES.items()
)


@query(
    "train_mixes",
    f"WITH {M}, c AS (SELECT count(*) FILTER (source = 'real') AS r, count(*) FILTER (source <> 'real') AS n FROM m), w AS ({_TAKEN}), "
    "q AS (SELECT w.*, CASE WHEN ratio >= 1 THEN least(4 * r, n) ELSE least(round_even(r * ratio / (1 - ratio), 0), n) END AS quota FROM w, c), "
    "k AS (SELECT file, mix, quota, row_number() OVER (PARTITION BY mix ORDER BY md5(seed || ':' || file)) AS nth FROM m, q "
    "WHERE source <> 'real') SELECT mix, file FROM k WHERE nth <= quota UNION ALL SELECT mix, file FROM m, q WHERE source = 'real' AND ratio < 1",
)
def _(spark, d):
    mixes = sampling.make_train_mixes(_manifest(spark, d), MIXES)
    return mixes.select(F.explode("mixes").alias("mix"), "file")


# ---- files -------------------------------------------------------------------------------------------------------------
@query(
    "manifest_files",
    f"WITH {M} SELECT file, sha1, source, labels, coalesce(dedup_removed, false) AS dedup_removed, coalesce(eval_longtail, false) AS "
    "eval_longtail, 'auto' AS review_status, 'indoor' AS scene FROM m",
)
def _(spark, d):
    """Reset, two appends of JSON lines, and the read with defaults."""
    rows, path = _manifest(spark, d), new_folder(spark, "manifest")
    manifest.reset_manifest(spark, path)
    for part in (0, 1):
        manifest.append_manifest(rows.where(f"seq % 2 = {part}"), path)
    back = manifest.with_defaults(manifest.load_manifest(spark, path))
    return back.select(
        "file", "sha1", "source", F.array_join("labels", "|").alias("labels"), "dedup_removed", "eval_longtail", "review_status", "scene"
    )


@query("report_file", "SELECT count(*) AS n, round(avg(n_chars), 6) AS chars, NULL::VARCHAR AS note FROM documents")
def _(spark, d):
    path = new_folder(spark, "report")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    manifest.write_report(
        docs.agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("chars"), F.lit(None).cast("string").alias("note")), path
    )
    return manifest.read_report(spark, path).select("n", "chars", F.col("note").cast("string").alias("note"))


@query(
    "sheet_single",
    "SELECT 'f' || lang AS file, arg_max(CASE WHEN doc_id % 2 = 0 THEN 'blur/dark' ELSE 'noise' END, doc_id) AS labels FROM documents "
    "WHERE lang IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    """A sheet in which files repeat: the last row wins."""
    path = f"{new_folder(spark, 'sheet')}.csv"
    text = F.when(F.col("doc_id") % 2 == 0, " blur | dark").otherwise("noise")
    rows = spark.read.parquet(f"{d}/documents.parquet").where("lang is not null").orderBy("doc_id")
    rows.select(F.concat(F.lit(" f"), "lang").alias("file"), text.alias("labels")).coalesce(1).write.option("header", True).csv(path)
    return sheets.read_single(spark, path).select("file", F.array_join("labels", "/").alias("labels"))


@query(
    "sheet_annotations",
    "SELECT 'f' || doc_id AS file, CASE WHEN doc_id % 2 = 0 THEN 'blur/dark' ELSE 'noise' END AS annotator1, "
    "CASE WHEN doc_id % 3 = 0 THEN 'dark' ELSE '' END AS annotator2 FROM documents",
)
def _(spark, d):
    path = f"{new_folder(spark, 'sheet')}.jsonl"
    first = F.when(F.col("doc_id") % 2 == 0, "blur,dark").otherwise("noise").alias("annotator1")
    second = F.when(F.col("doc_id") % 3 == 0, "dark|").otherwise("").alias("annotator2")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file")
    spark.read.parquet(f"{d}/documents.parquet").select(name, first, second).write.json(path)
    found = sheets.read_annotations(spark, path)
    return found.select("file", *(F.array_join(c, "/").alias(c) for c in ("annotator1", "annotator2")))


@query(
    "experiment_log",
    "SELECT o_orderkey AS seq, o_orderpriority AS model, round(o_totalprice, 2) AS macro_f1 FROM orders WHERE o_orderstatus <> 'P'",
)
def _(spark, d):
    """A log with error rows and malformed lines."""
    path = new_folder(spark, "log")
    error = F.when(F.col("o_orderstatus") == "P", "failed").alias("error")
    names = F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("model"), F.round("o_totalprice", 2).alias("macro_f1")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(*names, error)
    rows.write.json(path)
    spark.createDataFrame([("{broken",), ('{"seq": ',)], "value string").write.mode("append").text(path)
    return manifest.load_log(spark, path, "seq long, model string, macro_f1 double, error string").drop("error")


@query(
    "eval_set_files",
    "WITH r AS (SELECT 'img/' || doc_id AS file, source, lang FROM documents) SELECT file, source, lang AS origin_id, 'blur|dark' AS "
    "labels, "
    "'0' AS longtail, 'auto' AS review_status FROM r",
)
def _(spark, d):
    """The frozen eval set as JSON lines and as a sheet, which must say the same."""
    top = new_folder(spark, "eval")
    names = F.col("doc_id").alias("seq"), F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("file"), F.md5("text").alias("sha1")
    fixed = F.array(F.lit("blur"), F.lit("dark")).alias("labels"), F.lit("indoor").alias("scene"), F.lit("mid").alias("difficulty")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    manifest.write_eval_set(
        tables.eval_rows(docs.select(*names, "source", F.col("lang").alias("origin_id"), *fixed)), f"{top}/json", f"{top}/csv"
    )
    sheet = spark.read.option("header", True).csv(f"{top}/csv")
    lines = spark.read.json(f"{top}/json").select("file", "sha1", F.array_join("labels", "|").alias("labels"))
    return sheet.join(lines, ["file", "sha1", "labels"]).select("file", "source", "origin_id", "labels", "longtail", "review_status")


@query("shard_quality", image_queries.QUALITY_SQL)
def _(spark, d):
    """Tiles as encoded images in Parquet shards, found, decoded and measured."""
    top = new_folder(spark, "shards")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [images.png_bytes(image.pixels(cell)) for cell in b.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(found, pa.binary())], names=["vec_id", "bytes"])

    made = image_queries.tiles(spark, d).where("image.data is not null").mapInArrow(encode, "vec_id long, bytes binary")
    made.select("vec_id", F.struct("bytes", F.lit("x").alias("path")).alias("picture")).repartition(3).write.parquet(f"{top}/set")
    rows = spark.read.parquet(*images.list_shards(spark, f"{top}/set/*.parquet"))
    decoded = images.decoded(rows.select("vec_id", images.image_bytes(rows).alias("content")))
    m = image.assess_quality(decoded)
    return m.select("vec_id", F.round("mean_lum", 6).alias("mean_lum"), F.round("lap_var", 4).alias("lap_var"))


@query("png_files_phash", image_queries.PHASH_SQL)
def _(spark, d):
    """Tiles written as PNG files by the sink, read back by the image reader and hashed."""
    top = new_folder(spark, "png")
    images.register(spark)
    name = F.concat(F.lit("real/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("file")
    image_queries.tiles(spark, d).where("image.data is not null").select(name, "image").write.format("png_files").mode("append").save(top)
    found = image.with_phash(images.read_images(spark, top))
    number = F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("long").alias("vec_id")
    return found.select(number, X.hex64(F.col("phash")).alias("phash"))


TENSOR_SQL = f"""WITH {image_queries.PIXELS},
s AS (SELECT vec_id, round_even(avg(b), 0) AS b, round_even(avg(g), 0) AS g, round_even(avg(r), 0) AS r FROM px GROUP BY vec_id, y // 2, x // 2)
SELECT vec_id, round(sum((r / 255 - 0.485) / 0.229), 3) AS first, round(sum((g / 255 - 0.456) / 0.224), 3) AS second,
       round(sum((b / 255 - 0.406) / 0.225), 3) AS third FROM s GROUP BY 1"""


@query("training_tensor", TENSOR_SQL)
def _(spark, d):
    """Sums of the three channels of the normalised training input."""
    sums = lambda img: dict(zip(names, image.training_tensor(img, 4).astype(float).sum(axis=(1, 2)).tolist()))
    names = ["first", "second", "third"]
    return image.measured(image_queries.tiles(spark, d), sums, names).select("vec_id", *(F.round(n, 3).alias(n) for n in names))
