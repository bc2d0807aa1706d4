"""The registered queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.functions import expressions as X
from datakiln.operators import agreement, calibration, consistency, dedup, evaluation, sampling, split, tables
from datakiln.operators.eval_state import EvaluationStore
from datakiln.operators.incremental import DedupStore
from datakiln.plans import image_queries, table_queries
from datakiln.sources.scratch import new_folder
from datakiln.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


CLASSES = ("quality", "toxic")


# ---- labels and strata -------------------------------------------------------------------------------------------------
def _labelled(spark, d):
    names = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumn("labels", names)


@query(
    "multihot_encode",
    "SELECT doc_id, (quality = 1)::INTEGER AS m0, (toxic = 1)::INTEGER AS m1 FROM documents JOIN labels USING (doc_id)",
)
def _(spark, d):
    return _labelled(spark, d).withColumn("m", X.labels_to_multihot(F.col("labels"), CLASSES)).select(
        "doc_id", F.col("m")[0].alias("m0"), F.col("m")[1].alias("m1")
    )


@query(
    "multihot_decode",
    "SELECT doc_id, concat_ws('|', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS labels FROM labels",
)
def _(spark, d):
    return t(spark, d, "labels").select(
        "doc_id", F.array_join(X.multihot_to_labels(F.array("quality", "toxic"), CLASSES), "|").alias("labels")
    )


def _cells(spark, d):
    labels = F.when(F.col("o_orderstatus") == "O", F.array().cast("array<string>")).otherwise(F.array("o_orderstatus"))
    cell = X.stratum(
        labels,
        F.lit(None).cast("array<string>"),
        F.nullif("o_orderpriority", F.lit("3-MEDIUM")),
        F.nullif("c_mktsegment", F.lit("BUILDING")),
    )
    rows = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rows.select("o_orderkey", "o_totalprice", cell.alias("c")).select("o_orderkey", "o_totalprice", "c.*")


CELLS = """c AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'O' THEN 'normal' ELSE o_orderstatus END AS defect,
      coalesce(nullif(o_orderpriority, '3-MEDIUM'), 'indoor') AS scene,
      CASE WHEN o_orderstatus = 'O' THEN 'none' ELSE coalesce(nullif(c_mktsegment, 'BUILDING'), 'mid') END AS difficulty
      FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("cell_of", f"WITH {CELLS} SELECT o_orderkey, defect, scene, difficulty FROM c")
def _(spark, d):
    return _cells(spark, d).select("o_orderkey", "defect", "scene", "difficulty")


BY = ["defect", "scene", "difficulty"]


@query("stratum_counts", f"WITH {CELLS} SELECT defect, scene, difficulty, count(*) AS available FROM c GROUP BY ALL")
def _(spark, d):
    return sampling.stratum_counts(_cells(spark, d), BY)


TARGET = 1200
WATER = f"""{CELLS}, a AS (SELECT defect, scene, difficulty, count(*) AS available, min(o_orderkey) AS first_seen FROM c GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS k, coalesce(sum(available) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, count(*) OVER () AS n FROM a WINDOW w AS (ORDER BY available, first_seen)),
s AS (SELECT *, floor(({TARGET} - cum) / (n - k + 1.0)) AS share FROM k),
l AS (SELECT *, coalesce(min(CASE WHEN share < available THEN k END) OVER (), n + 1) AS kk FROM s),
v AS (SELECT *, coalesce(max(CASE WHEN k = kk THEN share END) OVER (), max(available) OVER ()) AS level FROM l),
q AS (SELECT *, least(available, level) AS base, {TARGET} - sum(least(available, level)) OVER () AS rest, row_number() OVER (PARTITION BY available > level ORDER BY first_seen) AS turn FROM v),
quotas AS (SELECT defect, scene, difficulty, available, (base + CASE WHEN available > level AND turn <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM q)"""


@query("quota_waterfill", f"WITH {WATER} SELECT * FROM quotas")
def _(spark, d):
    cells = _cells(spark, d).groupBy(*BY).agg(F.count("*").alias("available"), F.min("o_orderkey").alias("first_seen"))
    return sampling.allocate_quotas(cells, TARGET).select(*BY, "available", "quota")


SAMPLED = (
    f"{WATER}, r AS (SELECT *, row_number() OVER (PARTITION BY defect, scene, difficulty ORDER BY md5('42:' || o_orderkey), o_orderkey) "
    f"AS rn FROM c), picked AS (SELECT r.*, quota FROM r JOIN quotas USING (defect, scene, difficulty) WHERE rn <= quota)"
)


@query("stratified_sample", f"WITH {SAMPLED} SELECT o_orderkey, defect, scene, difficulty FROM picked")
def _(spark, d):
    return sampling.stratified_sample(_cells(spark, d), BY, TARGET, "o_orderkey", "o_orderkey").select("o_orderkey", *BY)


@query(
    "stratified_report",
    f"WITH {SAMPLED} SELECT *, taken < quota AS underfilled FROM (SELECT defect, scene, difficulty, q.available, q.quota, "
    f"count(o_orderkey) AS taken FROM quotas q LEFT JOIN picked p USING (defect, scene, difficulty) GROUP BY ALL)",
)
def _(spark, d):
    cells = _cells(spark, d)
    picked = sampling.stratified_sample(cells, BY, TARGET, "o_orderkey", "o_orderkey")
    return sampling.stratified_report(cells, picked, BY, TARGET, "o_orderkey")


def _flagged(events):
    return events.select(
        F.col("event_id").alias("seq"),
        "value",
        "user_id",
        ((F.col("event_type") == "view") | (F.col("value") > 90)).alias("night_ok"),
        (F.col("value") > 20).alias("normal_ok"),
    )


def _scan(spark, d):
    return _flagged(t(spark, d, "events")).drop("user_id")


SCAN = """e AS (SELECT event_id AS seq, value, coalesce(event_type = 'view' OR value > 90, false) AS night_ok, coalesce(value > 20, false) AS normal_ok FROM events),
n AS (SELECT seq, 'night' AS kind FROM e WHERE night_ok ORDER BY seq LIMIT 100),
o AS (SELECT seq, 'normal' AS kind FROM e WHERE normal_ok AND seq NOT IN (SELECT seq FROM n) ORDER BY seq LIMIT 500),
a AS (SELECT *, row_number() OVER (ORDER BY seq)::INTEGER - 1 AS idx FROM (SELECT * FROM n UNION ALL SELECT * FROM o))"""


@query("quota_scan", f"WITH {SCAN} SELECT seq, kind, idx FROM a")
def _(spark, d):
    return sampling.quota_scan(_scan(spark, d), 500, 100).select("seq", "kind", "idx")


@query(
    "quota_stream",
    f"WITH {SCAN}, u AS (SELECT user_id::VARCHAR AS collection, e.* FROM e JOIN events ON seq = event_id), "
    "ns AS (SELECT * FROM u WHERE night_ok QUALIFY row_number() OVER (PARTITION BY collection ORDER BY seq) <= 3), "
    "os AS (SELECT * FROM u WHERE normal_ok AND seq NOT IN (SELECT seq FROM ns) QUALIFY row_number() OVER (PARTITION BY collection ORDER BY seq) <= 10), "
    "b AS (SELECT collection, seq, 'night' AS kind FROM ns UNION ALL SELECT collection, seq, 'normal' FROM os) "
    "SELECT *, row_number() OVER (PARTITION BY collection ORDER BY seq)::BIGINT - 1 AS idx FROM b",
)
def _(spark, d):
    """Quotas of each user's collection, kept in the state store of a stream over the events."""
    session = stateful.stateful_session(spark)
    path = f"{d}/events.parquet"
    stream = session.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    flagged = _flagged(stream).withColumn("collection", F.col("user_id").cast("string"))
    out, check = new_folder(spark, "quota-stream"), new_folder(spark, "quota-state")
    writer = stateful.collect_stream(flagged, 10, 3).writeStream.format("parquet").option("path", out)
    writer.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("collection string, seq long, kind string, idx long").parquet(out)


@query(
    "quota_rejects",
    f"WITH {SCAN} SELECT seq FROM e WHERE seq NOT IN (SELECT seq FROM a) AND seq <= CASE WHEN (SELECT count(*) FILTER (kind = 'night') = "
    f"100 AND count(*) FILTER (kind = 'normal') = 500 FROM a) THEN (SELECT max(seq) FROM a) ELSE (SELECT max(seq) FROM e) END",
)
def _(spark, d):
    rows = _scan(spark, d)
    return sampling.quota_rejects(rows, sampling.quota_scan(rows, 500, 100), 500, 100).select("seq")


REASON = (
    "CASE WHEN least(n_chars, n_chars + 100) < 320 THEN '分辨率过小' WHEN n_chars / 20e0 < CASE WHEN lang = 'de' THEN 60 ELSE 80 END THEN "
    "'天然模糊' WHEN n_chars / 30e0 < CASE WHEN lang = 'de' THEN 18 ELSE 45 END OR n_chars / 30e0 > CASE WHEN lang = 'de' THEN 88 ELSE 225 "
    "END THEN '亮度越界' END"
)


@query("clean_frame_reason", f"SELECT doc_id, {REASON} AS reason FROM documents")
def _(spark, d):
    n = F.col("n_chars")
    return t(spark, d, "documents").select(
        "doc_id", X.clean_frame_reason(n, n + 100, n / 20, n / 30, F.col("lang") == "de").alias("reason")
    )


@query(
    "scene_of",
    "SELECT doc_id, CASE WHEN n_chars % 256 < 60 THEN 'night' WHEN n_chars % 256 < 95 AND doc_id % 100 > (doc_id * 7) % 100 + 12 AND "
    "doc_id % 100 > (doc_id * 3) % 100 THEN 'night' WHEN (doc_id % 10) / 40e0 + (n_chars % 10) / 40e0 > 0.18 THEN 'outdoor' ELSE "
    "'indoor' END AS scene FROM documents",
)
def _(spark, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    return t(spark, d, "documents").select(
        "doc_id", X.scene_of(n % 256, i % 100, i * 3 % 100, i * 7 % 100, i % 10 / 40.0, n % 10 / 40.0).alias("scene")
    )


@query(
    "difficulty_rollup",
    "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 'hard' WHEN bool_or(l_returnflag = 'N') THEN 'mid' ELSE 'easy' END AS "
    "difficulty FROM lineitem GROUP BY l_orderkey",
)
def _(spark, d):
    strength = F.when(F.col("l_returnflag") == "A", "mild").when(F.col("l_returnflag") == "N", "moderate").otherwise("severe")
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(strength).alias("s")).select(
        "l_orderkey", X.hardest(F.col("s")).alias("difficulty")
    )


# ---- splits ------------------------------------------------------------------------------------------------------------
EVAL = 9000
SPLIT = f"""o AS (SELECT l_orderkey, count(*) AS n, md5('42:' || l_orderkey) AS h FROM lineitem GROUP BY l_orderkey),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
x AS (SELECT *, row_number() OVER (ORDER BY h, l_orderkey) AS rn, count(*) OVER () AS total FROM b WHERE before >= {EVAL}),
splits AS (SELECT l_orderkey, n, CASE WHEN rn <= floor(total * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(total * 0.7::DOUBLE) + floor(total * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM x
           UNION ALL SELECT l_orderkey, n, 'eval' FROM b WHERE before < {EVAL})"""


def _splits(spark, d):
    return split.assign_splits(t(spark, d, "lineitem").select("l_orderkey"), EVAL, origin="l_orderkey")


@query("grouped_split", f"WITH {SPLIT} SELECT * FROM splits")
def _(spark, d):
    return _splits(spark, d)


@query(
    "split_stats",
    f"WITH {SPLIT} SELECT split, count(DISTINCT l_orderkey) AS origins, count(*) AS samples, count(*) FILTER (l_returnflag = 'A') AS "
    f"n_real, count(*) FILTER (l_returnflag = 'N') AS n_procedural, count(*) FILTER (l_returnflag = 'R') AS n_aigc FROM lineitem JOIN "
    f"splits USING (l_orderkey) GROUP BY split",
)
def _(spark, d):
    source = F.when(F.col("l_returnflag") == "A", "real").when(F.col("l_returnflag") == "N", "procedural").otherwise("aigc")
    rows = t(spark, d, "lineitem").select("l_orderkey", source.alias("source"))
    return split.split_stats(split.with_split(rows, _splits(spark, d), "l_orderkey"), "l_orderkey")


@query(
    "leakage_check",
    "WITH s AS (SELECT o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'test' ELSE 'train' END AS split FROM orders), g AS (SELECT "
    "o_custkey, count(DISTINCT split) AS n FROM s GROUP BY 1), e AS (SELECT o_custkey FROM g WHERE n > 1 ORDER BY 1 LIMIT 10) SELECT "
    "count(*) FILTER (n > 1) = 0 AS passed, count(*) AS total_origins, count(*) FILTER (n > 1) AS leaked, (SELECT "
    "string_agg(o_custkey::VARCHAR, ',' ORDER BY o_custkey) FROM e) AS examples FROM g",
)
def _(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 97 == 0, "test").otherwise("train").alias("split"))
    return split.check_leakage(rows, "o_custkey").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


# ---- sampling ----------------------------------------------------------------------------------------------------------
@query("sample_wo_replacement", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 400")
def _(spark, d):
    return sampling.sample_without_replacement(t(spark, d, "documents").select("doc_id"), 400, "doc_id")


MIX = """m AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'real' WHEN 'fr' THEN 'procedural' ELSE 'aigc' END AS source FROM documents),
n AS (SELECT count(*) FILTER (source = 'real') AS r, count(*) FILTER (source <> 'real') AS s FROM m),
y AS (SELECT * FROM m WHERE source <> 'real' ORDER BY md5('42:' || doc_id), doc_id LIMIT (SELECT least(s, round_even(r * 0.25::DOUBLE / 0.75::DOUBLE, 0)::BIGINT) FROM n)),
mix AS (SELECT * FROM m WHERE source = 'real' UNION ALL SELECT * FROM y)"""


def _mix(spark, d):
    source = F.when(F.col("lang") == "en", "real").when(F.col("lang") == "fr", "procedural").otherwise("aigc")
    return sampling.make_train_mix(t(spark, d, "documents").select("doc_id", source.alias("source")), 0.25, "doc_id")


@query("train_mix", f"WITH {MIX} SELECT doc_id, source FROM mix")
def _(spark, d):
    return _mix(spark, d)


@query(
    "train_mix_report",
    f"WITH {MIX} SELECT 0.25::DOUBLE AS ratio_target, count(*) FILTER (source = 'real') AS n_real, count(*) FILTER (source <> 'real') AS "
    f"n_synthetic, round(count(*) FILTER (source <> 'real') / count(*), 6) AS ratio_actual, count(*) AS n_total FROM mix",
)
def _(spark, d):
    return sampling.mix_report(_mix(spark, d), 0.25).withColumn("ratio_actual", F.round("ratio_actual", 6))


@query("export_task", "SELECT doc_id AS file, '' AS labels FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 150")
def _(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.array("lang").alias("labels"))
    return sampling.export_task(rows, 150, 7)[0]


@query(
    "round_robin_schedule",
    "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part), i AS (SELECT "
    "unnest(range(0, 6000)) AS i) SELECT i, p_partkey FROM i JOIN p ON (i + 5) % n = rn",
)
def _(spark, d):
    return tables.round_robin(t(spark, d, "part").select("p_partkey"), 6000, "p_partkey", 5).select("i", "p_partkey")


# ---- dedup -------------------------------------------------------------------------------------------------------------
@query("exact_dup_groups", "SELECT md5(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return dedup.exact_groups(t(spark, d, "documents").select(F.md5("text").alias("digest")), "digest")


def _hashes(spark, d):
    return t(spark, d, "embeddings").select(
        F.col("vec_id").alias("file"), F.col("label").alias("origin_id"), X.median_hash(F.col("embedding")).alias("phash")
    )


H = """u AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i, (list_sort(embedding)[32]::DOUBLE + list_sort(embedding)[33]::DOUBLE) / 2 AS m FROM embeddings),
h AS (SELECT vec_id AS file, label AS origin_id, string_agg(CASE WHEN x::DOUBLE > m THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS b FROM u GROUP BY ALL),
pairs AS (SELECT a.file AS file_a, b.file AS file_b, bit_count(xor(a.b, b.b))::INTEGER AS distance, a.origin_id AS origin_a, b.origin_id AS origin_b FROM h a JOIN h b ON a.file < b.file WHERE bit_count(xor(a.b, b.b)) <= 16)"""


@query("hamming_pairs", f"WITH {H} SELECT file_a, file_b, distance FROM pairs")
def _(spark, d):
    return dedup.pairwise_hamming_le(_hashes(spark, d), 16)


@query("cross_origin_pairs", f"WITH {H} SELECT file_a, file_b, distance, origin_a, origin_b FROM pairs WHERE origin_a <> origin_b")
def _(spark, d):
    h = _hashes(spark, d)
    return dedup.with_origins(dedup.pairwise_hamming_le(h, 16), h).where("cross").drop("cross").select(
        "file_a", "file_b", "distance", "origin_a", "origin_b"
    )


def _near_hashes(spark, d):
    """Eight documents share a base and drift from it two bits at a time: distances of 2 to 14, chains, equal texts, origins."""
    base = F.conv(F.substring(F.md5(F.expr("doc_id div 8").cast("string")), 1, 15), 16, 10).cast("long")
    drift = F.expr("shiftleft(shiftleft(1L, int(2 * greatest(doc_id % 8 - doc_id % 3 % 2, 0))) - 1L, int(doc_id div 8 % 40))")
    source = F.when(F.col("lang") == "en", "real").when(F.col("lang") == "fr", "procedural").otherwise("aigc")
    names = F.col("doc_id").alias("file"), F.col("source").alias("origin_id"), source.alias("source")
    return t(spark, d, "documents").select(*names, base.bitwiseXOR(drift).alias("phash"), F.md5("text").alias("sha1"))


T = """d AS (SELECT doc_id AS file, source AS origin_id, CASE lang WHEN 'en' THEN 'real' WHEN 'fr' THEN 'procedural' ELSE 'aigc' END AS source,
      md5(text) AS sha1, xor(('0x' || substr(md5((doc_id // 8)::VARCHAR), 1, 15))::BIGINT,
      ((1::BIGINT << (2 * greatest(doc_id % 8 - doc_id % 3 % 2, 0))::INTEGER) - 1) << (doc_id // 8 % 40)::INTEGER) AS h FROM documents),
p AS (SELECT a.file AS a, b.file AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance, a.origin_id IS DISTINCT FROM b.origin_id AS cross_origin
      FROM d a JOIN d b ON a.file < b.file WHERE bit_count(xor(a.h, b.h)) <= 4),
e AS (SELECT a AS u, b AS v FROM p WHERE cross_origin UNION ALL SELECT b, a FROM p WHERE cross_origin),
c AS (WITH RECURSIVE w(u, v) AS (SELECT u, u FROM e UNION SELECT w.u, e.v FROM w JOIN e ON w.v = e.u) SELECT u AS node, min(v) AS root FROM w GROUP BY u),
k AS (SELECT root, min(struct_pack(p := CASE source WHEN 'real' THEN 0 WHEN 'procedural' THEN 1 ELSE 2 END, f := file)).f AS keep
      FROM c JOIN d ON node = file GROUP BY root),
marked AS (SELECT d.file, d.origin_id, d.source, root IS NOT NULL AND d.file <> keep AS dedup_removed
           FROM d LEFT JOIN c ON d.file = node LEFT JOIN k USING (root))"""


@query("hamming_pairs_banded", f"WITH {T} SELECT a AS file_a, b AS file_b, distance FROM p")
def _(spark, d):
    return dedup.pairwise_hamming_le(_near_hashes(spark, d), 4)


@query("dup_components", f"WITH {T} SELECT node, root FROM c")
def _(spark, d):
    met = dedup.sample_components(_near_hashes(spark, d))
    least = met.groupBy("root").agg(F.min("node").alias("least"))
    return met.join(least, "root").select("node", F.col("least").alias("root"))


@query("dedup_keepers", f"WITH {T} SELECT file, origin_id, source, dedup_removed FROM marked")
def _(spark, d):
    return dedup.dedup(_near_hashes(spark, d)).select("file", "origin_id", "source", "dedup_removed")


@query("dedup_incremental", f"WITH {T} SELECT file, origin_id, source, dedup_removed FROM marked")
def _(spark, d):
    """The manifest arrives in three batches; marks come from the kept components."""
    rows = _near_hashes(spark, d)
    kept = DedupStore(spark, new_folder(spark, "dedup"))
    for i in range(3):
        kept.add(rows.where(F.pmod(F.xxhash64("file"), F.lit(3)) == i), i)
    return kept.marked(rows).select("file", "origin_id", "source", "dedup_removed")


DEDUP_REPORT = """SELECT count(*) AS total, count(*) FILTER (dedup_removed) AS removed, count(*) FILTER (NOT dedup_removed) AS kept,
(SELECT count(*) FILTER (NOT cross_origin) FROM p) AS same_origin_pairs_skipped,
(SELECT count(*) FILTER (cross_origin) FROM p) AS cross_origin_dup_pairs,
(SELECT count(*) FROM (SELECT sha1 FROM d GROUP BY sha1 HAVING count(*) > 1)) AS exact_sha1_groups FROM marked"""


@query("dedup_report", f"WITH {T} {DEDUP_REPORT}")
def _(spark, d):
    h = _near_hashes(spark, d)
    return dedup.dedup_report(h, dedup.dedup(h))


@query("removed_by_source", f"WITH {T} SELECT source, count(*) AS n FROM marked WHERE dedup_removed GROUP BY source")
def _(spark, d):
    return dedup.removed_by_source(dedup.dedup(_near_hashes(spark, d)))


# ---- evaluation --------------------------------------------------------------------------------------------------------
def scores(spark, d):
    b = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    n, i = F.col("n_chars"), F.col("doc_id")
    logits = F.array((n - 1200) / F.lit(800.0), (900 - n) / F.lit(700.0) + i % 7 / F.lit(7.0) - F.lit(0.5))
    long = evaluation.to_long(
        b.select(i.alias("sample_id"), "lang", "source", logits.alias("logits"), F.array("quality", "toxic").alias("truth")),
        "logits",
        "truth",
        CLASSES,
        ("sample_id", "lang", "source"),
    )
    return evaluation.with_probs(long)


S = """b AS (SELECT * FROM documents JOIN labels USING (doc_id)),
s0 AS (SELECT doc_id AS sample_id, lang, source, 'quality' AS class, (n_chars - 1200) / 800e0 AS logit, quality AS y FROM b
       UNION ALL SELECT doc_id, lang, source, 'toxic', (900 - n_chars) / 700e0 + (doc_id % 7) / 7e0 - 0.5e0, toxic FROM b),
s AS (SELECT *, 1 / (1 + exp(-logit)) AS prob FROM s0),
f AS (SELECT *, prob > 0.5 AS pred FROM s)"""
PRF = (
    "count(*) FILTER (pred AND y = 1) AS tp, count(*) FILTER (pred AND y <> 1) AS fp, count(*) FILTER (NOT pred AND y = 1) AS fn, "
    "count(*) FILTER (NOT pred AND y <> 1) AS tn"
)
PR = "tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall"
F1 = "CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN tp + fp + fn > 0 THEN 0 END AS f1"


@query("confusion_stats", f"WITH {S} SELECT class, {PRF} FROM f GROUP BY class")
def _(spark, d):
    return evaluation.confusion(evaluation.predicted(scores(spark, d)))


@query(
    "prf_macro_f1",
    f"WITH {S}, c AS (SELECT class, {PRF} FROM f GROUP BY class), p AS (SELECT *, {PR} FROM c), r AS (SELECT *, {F1} FROM p) SELECT "
    f"class, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(avg(f1) OVER (), 6) "
    f"AS macro_f1 FROM r",
)
def _(spark, d):
    pred = evaluation.predicted(scores(spark, d))
    both = evaluation.prf(pred).crossJoin(F.broadcast(evaluation.macro_f1(pred)))
    return both.select("class", "tp", "fp", "fn", "tn", *r6("precision", "recall", "f1", "macro_f1"))


@query(
    "slice_metrics",
    f"WITH {S}, z AS (SELECT 'lang' AS key, lang AS bucket, class, pred, y FROM f UNION ALL SELECT 'source', source, class, pred, y FROM "
    f"f), c AS (SELECT key, bucket, class, {PRF} FROM z GROUP BY ALL), p AS (SELECT *, {PR} FROM c), r AS (SELECT *, {F1} FROM p) SELECT "
    f"key, bucket, max(tp + fp + fn + tn) AS n, round(avg(f1), 6) AS macro_f1, round(avg(recall), 6) AS macro_recall FROM r GROUP BY ALL",
)
def _(spark, d):
    return evaluation.slice_metrics(
        evaluation.predicted(scores(spark, d)), ("lang", "source")
    ).select("key", "bucket", "n", *r6("macro_f1", "macro_recall"))


EDGES = (
    "e AS (SELECT i::INTEGER AS bin, i * 0.1::DOUBLE AS lo, CASE WHEN i = 9 THEN 1::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS hi FROM "
    "(SELECT unnest(range(0, 10)) AS i))"
)
BINS = (
    f"{EDGES}, q AS (SELECT bin, count(*) AS n, avg(conf) AS confidence, avg(correct::INTEGER) AS accuracy FROM pr JOIN e ON conf <= hi "
    f"AND (conf > lo OR bin = 0 AND conf >= lo) GROUP BY bin), r AS (SELECT e.bin, lo, hi, coalesce(n, 0) AS n, confidence, accuracy FROM "
    f"e LEFT JOIN q USING (bin))"
)
PAIRS = f"{S}, pr AS (SELECT prob AS conf, (prob >= 0.5)::INTEGER = y AS correct FROM s)"
SINGLE = (
    f"{S}, g AS (SELECT sample_id, max(CASE WHEN class = 'quality' THEN prob END) AS pq, max(CASE WHEN class = 'toxic' THEN prob END) AS "
    f"pt, max(CASE WHEN class = 'quality' THEN y END) AS yq, max(CASE WHEN class = 'toxic' THEN y END) AS yt FROM s GROUP BY 1), pr AS "
    f"(SELECT greatest(pq, pt) AS conf, (pt > pq) = (yt > yq) AS correct FROM g)"
)
ECE = "round(sum(n * abs(accuracy - confidence)) / sum(n), 6)"


@query(
    "reliability_bins",
    f"WITH {PAIRS}, {BINS} SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n, round(confidence, 6) AS confidence, round(accuracy, 6) "
    f"AS accuracy FROM r",
)
def _(spark, d):
    return evaluation.reliability_bins(evaluation.multilabel_pairs(scores(spark, d))).select(
        "bin", *r6("lo", "hi"), "n", *r6("confidence", "accuracy")
    )


@query("ece_multilabel", f"WITH {PAIRS}, {BINS} SELECT {ECE} AS ece_multilabel FROM r")
def _(spark, d):
    return evaluation.ece_multilabel(scores(spark, d)).select(*r6("ece_multilabel"))


@query("ece_singlelabel", f"WITH {SINGLE}, {BINS} SELECT {ECE} AS ece_singlelabel FROM r")
def _(spark, d):
    return evaluation.ece_singlelabel(scores(spark, d), CLASSES).select(*r6("ece_singlelabel"))


@query("brier", f"WITH {S}, c AS (SELECT class, avg((prob - y) ** 2) AS b FROM s GROUP BY class) SELECT round(avg(b), 6) AS brier FROM c")
def _(spark, d):
    return evaluation.brier(scores(spark, d)).select(*r6("brier"))


CURVE = (
    f"{S}, g AS (SELECT 0.05::DOUBLE + i * ((0.95::DOUBLE - 0.05::DOUBLE) / 80) AS threshold FROM (SELECT unnest(range(0, 81)) AS i)), c "
    f"AS (SELECT class, threshold, count(*) FILTER (prob >= threshold AND y = 1) AS tp, count(*) FILTER (prob >= threshold AND y <> 1) AS "
    f"fp, count(*) FILTER (prob < threshold AND y = 1) AS fn FROM s, g GROUP BY ALL), v AS (SELECT class, threshold, coalesce(tp / "
    f"nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)"
)


@query(
    "threshold_curve",
    f"WITH {CURVE} SELECT class, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM v",
)
def _(spark, d):
    return evaluation.threshold_curve(scores(spark, d)).select("class", *r6("threshold", "precision", "recall"))


@query(
    "threshold_search",
    f"WITH {CURVE}, o AS (SELECT *, recall >= 0.95 AS meets, row_number() OVER (PARTITION BY class ORDER BY recall >= 0.95 DESC, CASE "
    f"WHEN recall >= 0.95 THEN precision ELSE round_even(recall, 4) END DESC, threshold) AS rn FROM v) SELECT class, round(threshold, 6) "
    f"AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, meets AS meets_recall_floor FROM o WHERE rn = 1",
)
def _(spark, d):
    return evaluation.search_thresholds(scores(spark, d)).select("class", *r6("threshold", "precision", "recall"), "meets_recall_floor")


@query(
    "pos_weight",
    f"WITH {S} SELECT class, round(count(*) FILTER (y <> 1) / greatest(count(*) FILTER (y = 1), 1), 6) AS pos_weight FROM s GROUP BY class",
)
def _(spark, d):
    return evaluation.pos_weight(scores(spark, d)).select("class", *r6("pos_weight"))


@query(
    "temperature_nll_grid",
    f"WITH {S}, g AS (SELECT (0.5 + 0.1 * i)::DOUBLE AS temperature FROM (SELECT unnest(range(0, 31)) AS i)), z AS (SELECT temperature, "
    f"logit / temperature AS z, y FROM s, g) SELECT round(temperature, 6) AS temperature, round(avg(greatest(z, 0) - z * y + ln(1 + "
    f"exp(-abs(z)))), 6) AS nll FROM z GROUP BY 1",
)
def _(spark, d):
    return calibration.nll_grid(scores(spark, d), [round(0.5 + 0.1 * i, 1) for i in range(31)]).select(*r6("temperature", "nll"))


def _temperature_sql(points: int = 17, rounds: int = 5) -> str:
    """The rounds of finer grids as a chain of tables; best holds the temperature and its loss."""
    parts = ["r0 AS (SELECT ln(0.05::DOUBLE) AS a, ln(20.0::DOUBLE) AS b)"]
    for i in range(1, rounds + 1):
        parts.append(f"""g{i} AS (SELECT exp(a + (b - a) * k / {points - 1}) AS temperature, (b - a) / {points - 1} AS step FROM r{i - 1}, (SELECT unnest(range(0, {points})) AS k)),
m{i} AS (SELECT temperature, any_value(step) AS step, avg(greatest(logit / temperature, 0) - logit / temperature * y + ln(1 + exp(-abs(logit / temperature)))) AS nll FROM s0, g{i} GROUP BY temperature),
r{i} AS (SELECT ln(temperature) - step AS a, ln(temperature) + step AS b, temperature, nll FROM m{i} ORDER BY nll, temperature LIMIT 1)""")
    return ",\n".join(parts)


CALIBRATED = f"""{_temperature_sql()},
st AS (SELECT 'before' AS stage, 1::DOUBLE AS tt UNION ALL SELECT 'after', temperature FROM r5),
v AS (SELECT stage, class, y, 1 / (1 + exp(-logit / tt)) AS prob FROM s0, st),
vc AS (SELECT stage, class, avg((prob - y) ** 2) AS b, count(*) FILTER (prob > 0.5 AND y = 1) AS tp, count(*) FILTER (prob > 0.5 AND y <> 1) AS fp,
       count(*) FILTER (prob <= 0.5 AND y = 1) AS fn FROM v GROUP BY ALL),
vp AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM vc),
vf AS (SELECT stage, avg(b) AS brier, avg(f1) AS macro_f1 FROM (SELECT *, {F1} FROM vp) GROUP BY stage),
vb AS (SELECT stage, bin, count(*) AS n, avg(prob) AS confidence, avg(((prob >= 0.5)::INTEGER = y)::INTEGER) AS accuracy
       FROM v JOIN e ON prob <= hi AND (prob > lo OR bin = 0 AND prob >= lo) GROUP BY ALL),
ve AS (SELECT stage, sum(n * abs(accuracy - confidence)) / sum(n) AS ece_multilabel FROM vb GROUP BY stage)
SELECT stage, round(ece_multilabel, 6) AS ece_multilabel, round(brier, 6) AS brier, round(macro_f1, 6) AS macro_f1,
       round(temperature, 4) AS temperature, round(nll, 6) AS nll FROM ve JOIN vf USING (stage), r5"""


@query("temperature_fit", f"WITH {S}, {EDGES}, {CALIBRATED}")
def _(spark, d):
    s = scores(spark, d)
    temperature, nll = calibration.fit_temperature(s)
    report = calibration.calibration_report(s, temperature).select("stage", *r6("ece_multilabel", "brier", "macro_f1"))
    return report.withColumn("temperature", F.round(F.lit(temperature), 4)).withColumn("nll", F.round(F.lit(nll), 6))


BUNDLE = f"""{CURVE.removeprefix(S + ", ")}, o AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY recall >= 0.95 DESC,
      CASE WHEN recall >= 0.95 THEN precision ELSE round_even(recall, 4) END DESC, threshold) AS rn FROM v),
w AS (SELECT s.class, y, prob > threshold AS pred FROM s JOIN o ON s.class = o.class AND rn = 1),
wc AS (SELECT class, {PRF} FROM w GROUP BY class), wp AS (SELECT *, {PR} FROM wc), wf AS (SELECT *, {F1} FROM wp),
eb AS (WITH pr AS (SELECT prob AS conf, (prob >= 0.5)::INTEGER = y AS correct FROM s) SELECT bin, count(*) AS n, avg(conf) AS confidence,
       avg(correct::INTEGER) AS accuracy FROM pr JOIN e ON conf <= hi AND (conf > lo OR bin = 0 AND conf >= lo) GROUP BY bin),
em AS (SELECT sum(n * abs(accuracy - confidence)) / sum(n) AS v FROM eb),
bc AS (SELECT string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY e.bin) AS v FROM e LEFT JOIN eb USING (bin)),
gs AS (SELECT sample_id, max(CASE WHEN class = 'quality' THEN prob END) AS pq, max(CASE WHEN class = 'toxic' THEN prob END) AS pt,
      max(CASE WHEN class = 'quality' THEN y END) AS yq, max(CASE WHEN class = 'toxic' THEN y END) AS yt FROM s GROUP BY 1),
sb AS (WITH pr AS (SELECT greatest(pq, pt) AS conf, (pt > pq) = (yt > yq) AS correct FROM gs) SELECT bin, count(*) AS n, avg(conf) AS confidence,
       avg(correct::INTEGER) AS accuracy FROM pr JOIN e ON conf <= hi AND (conf > lo OR bin = 0 AND conf >= lo) GROUP BY bin),
es AS (SELECT sum(n * abs(accuracy - confidence)) / sum(n) AS v FROM sb),
br AS (SELECT avg(b) AS v FROM (SELECT class, avg((prob - y) ** 2) AS b FROM s GROUP BY class))
SELECT class, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round((SELECT avg(f1) FROM wf), 6) AS macro_f1, round(em.v, 6) AS ece_multilabel, round(es.v, 6) AS ece_singlelabel_ref,
       round(br.v, 6) AS brier, bc.v AS bin_counts, (SELECT count(DISTINCT sample_id) FROM s) AS n FROM wf, em, es, br, bc"""


@query("evaluate_bundle", f"WITH {S}, {EDGES}, {BUNDLE}")
def _(spark, d):
    """The one row of all metrics, opened to a row per class."""
    s = scores(spark, d)
    bundle = evaluation.evaluate(s, CLASSES, evaluation.search_thresholds(s))
    rows = bundle.select("*", F.explode("per_class").alias("class", "m")).withColumn("c", F.col("confusion")[F.col("class")])
    counts = F.array_join(F.transform("reliability_bins", lambda b: b.n.cast("string")), ",").alias("bin_counts")
    whole = r6("macro_f1", "ece_multilabel", "ece_singlelabel_ref", "brier")
    own = [F.round(f"m.{x}", 6).alias(x) for x in ("precision", "recall", "f1")]
    return rows.select("class", "c.*", *own, *whole, counts, "n")


def _folded(spark, d):
    """The scores arrive in three batches, by sample."""
    kept, rows = EvaluationStore(spark, new_folder(spark, "evaluation"), CLASSES, ("lang", "source")), scores(spark, d)
    for i in range(3):
        kept.fold(evaluation.predicted(rows.where(F.pmod(F.xxhash64("sample_id"), F.lit(3)) == i)), i)
    return kept


@query("slice_metrics_folded", ORACLE_SQL["slice_metrics"])
def _(spark, d):
    return _folded(spark, d).slices().where("key <> 'all'").select("key", "bucket", "n", *r6("macro_f1", "macro_recall"))


@query(
    "calibration_folded",
    f"SELECT ({ORACLE_SQL['ece_multilabel']}) AS ece_multilabel, ({ORACLE_SQL['ece_singlelabel']}) AS ece_singlelabel, "
    f"({ORACLE_SQL['brier']}) AS brier, (SELECT count(DISTINCT doc_id) FROM documents JOIN labels USING (doc_id)) AS n",
)
def _(spark, d):
    return _folded(spark, d).calibration().select(*r6("ece_multilabel", "ece_singlelabel", "brier"), "n")


# ---- agreement and consistency -----------------------------------------------------------------------------------------
def _guessed(spark, d):
    rows = _labelled(spark, d)
    guess = F.filter(
        F.array(F.when(F.col("n_chars") > 400, "quality"), F.when(F.col("n_chars") % 5 == 0, "toxic")), lambda x: x.isNotNull()
    )
    return rows.select(
        F.col("doc_id").alias("file"),
        F.col("source").alias("origin_id"),
        F.col("lang").alias("source"),
        "labels",
        guess.alias("labels_pred"),
        F.create_map(F.lit("quality"), F.col("n_chars") / F.lit(1000.0)).alias("scores"),
    )


G = """g AS (SELECT doc_id AS file, source AS origin_id, lang AS source, n_chars, quality = 1 AS q, toxic = 1 AS x, n_chars > 400 AS gq, n_chars % 5 = 0 AS gx FROM documents JOIN labels USING (doc_id))"""
IOU = (
    "CASE WHEN (q OR gq)::INTEGER + (x OR gx)::INTEGER = 0 THEN 1 ELSE ((q AND gq)::INTEGER + (x AND gx)::INTEGER) / ((q OR gq)::INTEGER "
    "+ (x OR gx)::INTEGER) END"
)


@query("label_iou", f"WITH {G} SELECT file, round({IOU}, 6) AS iou, q = gq AND x = gx AS exact_match FROM g")
def _(spark, d):
    g = _guessed(spark, d)
    return g.select(
        "file",
        F.round(X.label_iou(F.col("labels"), F.col("labels_pred")), 6).alias("iou"),
        X.same_labels(F.col("labels"), F.col("labels_pred")).alias("exact_match"),
    )


@query(
    "kappa_multilabel",
    f"WITH {G}, p AS (SELECT 'quality' AS class, q::INTEGER AS a, gq::INTEGER AS b FROM g UNION ALL SELECT 'toxic', x::INTEGER, "
    f"gx::INTEGER FROM g), s AS (SELECT class, count(*) AS n, avg((a = b)::INTEGER) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) "
    f"AS pe FROM p GROUP BY class) SELECT class, n, round((po - pe) / (1 - pe), 6) AS kappa FROM s",
)
def _(spark, d):
    g = _guessed(spark, d)
    merged = agreement.merge_annotations(g.select("file", "labels"), g.select("file", F.col("labels_pred").alias("labels")))
    return agreement.kappa_per_class(agreement.long_pairs(merged, CLASSES)).select("class", "n", *r6("kappa"))


@query(
    "annotator_merge",
    "SELECT doc_id AS file, lang AS a, coalesce(CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END, '') AS b FROM documents LEFT JOIN labels "
    "USING (doc_id)",
)
def _(spark, d):
    a = t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.array("lang").alias("labels"))
    b = t(spark, d, "labels").select(
        F.col("doc_id").alias("file"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("labels"),
    )
    return agreement.merge_annotations(a, b).select(
        "file", F.array_join("annotator1", "|").alias("a"), F.array_join("annotator2", "|").alias("b")
    )


@query(
    "consistency_report",
    f"WITH {G} SELECT count(*) AS n, round(avg((q = gq AND x = gx)::INTEGER), 6) AS exact_rate, round(avg({IOU}), 6) AS mean_iou, "
    f"count(*) FILTER (NOT (q = gq AND x = gx)) AS review_size, round(1 - count(*) FILTER (NOT (q = gq AND x = gx)) / count(*), 6) AS "
    f"consistency, round(count(*) FILTER (NOT q AND NOT x AND (gq OR gx)) / nullif(count(*) FILTER (NOT q AND NOT x), 0), 6) AS "
    f"clean_false_alarm, round(count(*) FILTER ((q OR x) AND NOT gq AND NOT gx) / nullif(count(*) FILTER (q OR x), 0), 6) AS "
    f"defect_missed, round(avg(q::INTEGER + x::INTEGER), 6) AS mean_labels, round(avg(gq::INTEGER + gx::INTEGER), 6) AS mean_labels_pred "
    f"FROM g",
)
def _(spark, d):
    return consistency.consistency_report(_guessed(spark, d)).select(
        "n",
        *r6("exact_rate", "mean_iou"),
        "review_size",
        *r6("consistency", "clean_false_alarm", "defect_missed", "mean_labels", "mean_labels_pred"),
    )


@query(
    "consistency_recall",
    f"WITH {G} SELECT 'quality' AS class, count(*) AS support, round(avg(gq::INTEGER), 6) AS recall FROM g WHERE q UNION ALL SELECT "
    f"'toxic', count(*), round(avg(gx::INTEGER), 6) FROM g WHERE x",
)
def _(spark, d):
    return consistency.consistency_recall(_guessed(spark, d), CLASSES).select("class", "support", *r6("recall"))


@query(
    "review_queue",
    f"WITH {G} SELECT file, origin_id, source, concat_ws('|', CASE WHEN q THEN 'quality' END, CASE WHEN x THEN 'toxic' END) AS "
    f"rule_labels, concat_ws('|', CASE WHEN gq THEN 'quality' END, CASE WHEN gx THEN 'toxic' END) AS vlm_labels, 'pending' AS status FROM "
    f"g WHERE NOT (q = gq AND x = gx)",
)
def _(spark, d):
    return consistency.review_queue(_guessed(spark, d)).drop("scores")


def _indicators(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    blank = F.length("text") - F.length(F.translate("text", " ", ""))
    return rows.select(
        "doc_id", "quality", F.col("n_chars").cast("double").alias("size"), (blank / F.greatest("n_chars", F.lit(1))).alias("blank")
    )


I = """i AS (SELECT doc_id, quality, n_chars::DOUBLE AS size, (length(text) - length(replace(text, ' ', ''))) / greatest(n_chars, 1) AS blank FROM documents JOIN labels USING (doc_id)),
u AS (SELECT 'size' AS indicator, size AS x FROM i WHERE quality = 1 UNION ALL SELECT 'blank', blank FROM i WHERE quality = 1),
q AS (SELECT indicator, quantile_cont(x, 0.03) AS lo, quantile_cont(x, 0.5) AS mid, quantile_cont(x, 0.97) AS hi FROM u GROUP BY 1),
w AS (SELECT indicator, CASE WHEN indicator = 'size' THEN lo ELSE hi END AS threshold, mid FROM q),
rules AS (SELECT indicator, threshold, CASE WHEN abs(mid - threshold) <= 1e-9 THEN abs(mid) * 0.1 + 1e-6 ELSE abs(mid - threshold) END AS scale FROM w)"""


def _rules(spark, d):
    return consistency.calibrate_rules(_indicators(spark, d).where("quality = 1"), ("size", "blank"), ("size",))


@query("rule_threshold_calibration", f"WITH {I} SELECT indicator, round(threshold, 6) AS threshold, round(scale, 6) AS scale FROM rules")
def _(spark, d):
    return _rules(spark, d).select("indicator", *r6("threshold", "scale"))


@query(
    "rule_predict",
    f"WITH {I}, m AS (SELECT max(CASE WHEN indicator = 'size' THEN threshold END) AS ts, max(CASE WHEN indicator = 'size' THEN scale END) "
    f"AS ss, max(CASE WHEN indicator = 'blank' THEN threshold END) AS tb, max(CASE WHEN indicator = 'blank' THEN scale END) AS sb FROM "
    f"rules), z AS (SELECT doc_id, 1 / (1 + exp(greatest(-30, least(30, (size - ts) / ss)))) AS short, 1 / (1 + exp(-greatest(-30, "
    f"least(30, (blank - tb) / sb)))) AS airy FROM i, m) SELECT doc_id, concat_ws('|', CASE WHEN short > 0.5 THEN 'short' END, CASE WHEN "
    f"airy > 0.5 THEN 'airy' END) AS labels_pred, round(short, 6) AS short, round(airy, 6) AS airy FROM z",
)
def _(spark, d):
    out = consistency.run_backend(
        "rule", _indicators(spark, d), rules=_rules(spark, d), class_of={"size": "short", "blank": "airy"}, low_side=("size",)
    )
    return out.select(
        "doc_id",
        F.array_join("labels_pred", "|").alias("labels_pred"),
        *(F.round(F.col("scores")[c], 6).alias(c) for c in ("short", "airy")),
    )


def _similar(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    dots = e.join(
        F.broadcast(means.select(F.col("label").alias("class"), "i", "m")), "i"
    ).groupBy("vec_id", "class").agg(F.sum(F.col("x") * F.col("m")).alias("dot"))
    names = F.when(F.col("class") == "0", "normal").otherwise(F.concat(F.lit("c"), "class"))
    return dots.select("vec_id", names.alias("class"), F.round("dot", 9).alias("similarity"))


@query("class_prototype_decision", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL),
s AS (SELECT vec_id, CASE WHEN m.label = 0 THEN 'normal' ELSE 'c' || m.label END AS class, round(sum(x * m), 9) AS s FROM e JOIN m USING (i) GROUP BY ALL),
p AS (SELECT *, exp((s - max(s) OVER (PARTITION BY vec_id)) * 100) AS e FROM s), q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS pr FROM p),
z AS (SELECT vec_id, max(CASE WHEN class = 'normal' THEN pr END) AS pn, max(CASE WHEN class <> 'normal' THEN pr END) AS pm FROM q GROUP BY 1),
k AS (SELECT vec_id, class, row_number() OVER (PARTITION BY vec_id ORDER BY pr DESC, class) AS rn FROM q WHERE class <> 'normal' AND pr > 0.18)
SELECT z.vec_id, CASE WHEN pn >= pm THEN '' ELSE coalesce((SELECT string_agg(class, '|' ORDER BY rn) FROM k WHERE k.vec_id = z.vec_id AND rn <= 3), '') END AS labels_pred FROM z""")
def _(spark, d):
    return consistency.prototype_decision(_similar(spark, d), ["vec_id"]).select(
        "vec_id", F.array_join("labels_pred", "|").alias("labels_pred")
    )


@query("answer_parse", """WITH a AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'x {"labels": ["blur", "dark", "blur"]} y' WHEN 1 THEN '{"labels": ["noise", "other"]}' WHEN 2 THEN '{broken ' || text || '}' ELSE text END AS answer FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'blur|dark|blur' WHEN 1 THEN 'noise' ELSE '' END AS labels FROM a""")
def _(spark, d):
    turn = F.col("turn") % 4
    answer = F.when(turn == 0, 'x {"labels": ["blur", "dark", "blur"]} y').when(turn == 1, '{"labels": ["noise", "other"]}').when(
        turn == 2, F.concat(F.lit("{broken "), "text", F.lit("}"))
    ).otherwise(F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.answer_labels(answer), "|").alias("labels"))


PHRASES = ("the", "tion", "que", "und", "ció", "ment")


@query(
    "prompt_labels",
    "SELECT doc_id, concat_ws('|', CASE WHEN n_chars % 2 = 0 THEN 'blur' END, CASE WHEN n_chars % 3 = 0 THEN 'dark' END) AS labels FROM "
    "documents",
)
def _(spark, d):
    prompt = F.concat(
        F.when(F.col("n_chars") % 2 == 0, "A Motion Blur photo ").otherwise("A photo "),
        F.when(F.col("n_chars") % 3 == 0, "very dark").otherwise(""),
    )
    return t(spark, d, "documents").select("doc_id", F.array_join(X.prompt_labels(prompt), "|").alias("labels"))


@query(
    "split_labels",
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, '|', ','), ','), lambda x: trim(x, ' ')), "
    "lambda x: x <> ''), '/') AS labels FROM documents",
)
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(X.split_labels(F.col("text")), "/").alias("labels"))


# ---- tables ------------------------------------------------------------------------------------------------------------
DIFF = """b AS (SELECT doc_id AS file, CASE WHEN doc_id % 11 = 0 THEN '' ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 <> 0),
c AS (SELECT doc_id AS file, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 9 <> 0),
x AS (SELECT coalesce(b.file, c.file) AS file, CASE WHEN c.file IS NULL THEN 'missing' WHEN b.file IS NULL THEN 'extra' WHEN b.h <> '' AND c.h <> '' AND b.h <> c.h THEN 'mismatch' ELSE 'matched' END AS status FROM b FULL JOIN c USING (file))"""


def _diff(spark, d):
    docs, i = t(spark, d, "documents"), F.col("doc_id")
    base = docs.where(i % 10 != 0).select(i.alias("file"), F.when(i % 11 == 0, "").otherwise(F.md5("text")).alias("sha1"))
    now = docs.where(i % 9 != 0).select(
        i.alias("file"), F.when(i % 7 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("sha1")
    )
    return tables.compare(base, now)


@query("manifest_diff", f"WITH {DIFF} SELECT file, status FROM x")
def _(spark, d):
    return _diff(spark, d)


@query(
    "manifest_diff_report",
    f"WITH {DIFF}, k AS (SELECT status, file, row_number() OVER (PARTITION BY status ORDER BY file) AS rn FROM x) SELECT count(*) FILTER "
    f"(status = 'matched') AS matched, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra, "
    f"count(*) FILTER (status = 'mismatch') AS mismatch, count(*) FILTER (status IN ('missing', 'mismatch')) = 0 AS ok, (SELECT "
    f"string_agg(file::VARCHAR, ',' ORDER BY file) FROM k WHERE status = 'missing' AND rn <= 10) AS missing_examples FROM x",
)
def _(spark, d):
    return tables.compare_report(_diff(spark, d)).select(
        "matched",
        "missing",
        "extra",
        "mismatch",
        "ok",
        F.array_join(F.col("missing_examples").cast("array<string>"), ",").alias("missing_examples"),
    )


@query("load_index", "SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def _(spark, d):
    return tables.load_index(t(spark, d, "events"), "user_id", "event_type", "event_id").withColumnRenamed("event_type", "last_type")


@query("eval_semi_join", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    return tables.eval_records(t(spark, d, "documents"), t(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id")


@query("new_rows_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return tables.new_rows(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id").select("doc_id")


@query(
    "eval_export",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) SELECT source || '/' || "
    "lang AS file, md5(text) AS sha1, source, lang AS origin_id, CASE WHEN lang = 'en' THEN '' ELSE 'blur' END AS labels, 'indoor' AS "
    "scene, CASE WHEN lang = 'en' THEN 'none' ELSE 'mid' END AS difficulty, CASE WHEN lang = 'en' THEN 'normal' ELSE 'blur' END AS "
    "defect_type, 0::VARCHAR AS longtail, 'auto' AS review_status FROM r WHERE rn = 1",
)
def _(spark, d):
    rows = t(spark, d, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat_ws("/", "source", "lang").alias("file"),
        F.md5("text").alias("sha1"),
        "source",
        F.col("lang").alias("origin_id"),
        F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array(F.lit("blur"))).alias("labels"),
        F.lit("indoor").alias("scene"),
        F.when(F.col("lang") == "en", "none").otherwise("mid").alias("difficulty"),
    )
    return tables.eval_csv_rows(tables.eval_rows(rows))


@query(
    "keep_first",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1",
)
def _(spark, d):
    return dedup.keep_first(t(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id")


def _runs(spark, d):
    price, day = F.col("o_totalprice"), F.col("o_orderkey")
    return t(spark, d, "orders").select(
        day.alias("seq"),
        F.col("o_orderpriority").alias("model"),
        (F.col("o_custkey") % 5 / F.lit(4.0)).alias("ratio"),
        (price / 500000).alias("macro_f1"),
        (price / 900000).alias("ece_multilabel"),
        F.when(day % 3 != 0, price / 800000).alias("brier"),
        (price / 100).alias("train_seconds"),
        day.alias("n_total"),
        F.when(F.col("o_orderstatus") == "P", "failed").alias("error"),
    )


SUMMARY = (
    "g AS (SELECT o_orderpriority AS model, (o_custkey % 5) / 4e0 AS ratio, count(*) AS n_seeds, arg_min(o_orderkey, o_orderkey) AS "
    "n_train, avg(o_totalprice / 500000) AS macro_f1_mean, stddev_pop(o_totalprice / 500000) AS macro_f1_std, avg(o_totalprice / 900000) "
    "AS ece_mean, avg(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 800000 ELSE 0 END) AS brier_mean, avg(o_totalprice / 100) AS "
    "seconds_mean FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)"
)


@query(
    "ablation_summary",
    f"WITH {SUMMARY} SELECT model, ratio, n_seeds, n_train, round(macro_f1_mean, 6) AS macro_f1_mean, round(macro_f1_std, 6) AS "
    f"macro_f1_std, round(ece_mean, 6) AS ece_mean, round(brier_mean, 6) AS brier_mean, round(seconds_mean, 4) AS seconds_mean FROM g",
)
def _(spark, d):
    return tables.summarize(_runs(spark, d)).select(
        "model",
        "ratio",
        "n_seeds",
        "n_train",
        *r6("macro_f1_mean", "macro_f1_std", "ece_mean", "brier_mean"),
        F.round("seconds_mean", 4).alias("seconds_mean"),
    )


@query("best_group", f"WITH {SUMMARY} SELECT model, ratio FROM g ORDER BY round_even(macro_f1_mean, 4) DESC, model, ratio LIMIT 1")
def _(spark, d):
    return tables.best_group(tables.summarize(_runs(spark, d))).select("model", "ratio")


@query(
    "acceptance_checks",
    f"WITH {SUMMARY} SELECT 'macro_f1' AS \"check\", round(macro_f1_mean, 6) AS value, 0.85::DOUBLE AS target, macro_f1_mean >= 0.85 AS "
    f"passed FROM (SELECT * FROM g ORDER BY round_even(macro_f1_mean, 4) DESC, model, ratio LIMIT 1) UNION ALL SELECT 'recall_blur', "
    f"round(0.97::DOUBLE, 6), 0.95::DOUBLE, true UNION ALL SELECT 'recall_low_res', round(0.9::DOUBLE, 6), 0.95::DOUBLE, false",
)
def _(spark, d):
    summary = tables.summarize(_runs(spark, d))
    recalls = summary.select(
        "model",
        "ratio",
        F.explode(
            F.array(
                F.struct(F.lit("blur").alias("class"), F.lit(0.97).alias("recall_mean")),
                F.struct(F.lit("low_res").alias("class"), F.lit(0.9).alias("recall_mean")),
            )
        ).alias("r"),
    ).select("model", "ratio", "r.*")
    return tables.acceptance(summary, recalls).withColumn("value", F.round("value", 6))


@query(
    "resume_worklist",
    "WITH e AS (SELECT user_id || '_' || event_type AS exp_id, value FROM events) SELECT DISTINCT exp_id FROM e WHERE exp_id NOT IN "
    "(SELECT exp_id FROM e WHERE value > 90)",
)
def _(spark, d):
    e = t(spark, d, "events").select(
        F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("exp_id"),
        F.when(F.col("value") > 90, F.lit(None).cast("string")).otherwise("failed").alias("error"),
    )
    return tables.worklist(e.select("exp_id").distinct(), e)


@query(
    "count_by_source",
    "SELECT coalesce(d.source, '?') AS source, count(*) AS n FROM labels l LEFT JOIN documents d ON l.doc_id + 1 = d.doc_id AND d.doc_id "
    "% 5 <> 0 GROUP BY 1",
)
def _(spark, d):
    files = t(spark, d, "labels").select((F.col("doc_id") + 1).alias("file"))
    return dedup.count_by(files, t(spark, d, "documents").where("doc_id % 5 <> 0").withColumnRenamed("doc_id", "file"))


@query(
    "best_epoch",
    "SELECT l_suppkey, max_by(l_linenumber, struct_pack(v := round(l_quantity), e := -l_linenumber)) AS epoch, "
    "round(max(round(l_quantity)), 6) AS macro_f1 FROM lineitem GROUP BY 1",
)
def _(spark, d):
    rows = t(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("epoch"), F.round("l_quantity").alias("macro_f1"))
    return evaluation.best_epoch(rows, ["l_suppkey"])


QUERIES |= image_queries.QUERIES | table_queries.QUERIES
ORACLE_SQL |= image_queries.ORACLE_SQL | table_queries.ORACLE_SQL
