import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} tail{i % 31}," for i in range(40_000))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row long, start string, fp double, p string, drop int"


def _tables(spark, top, documents, pages, embeddings, labels, benchmark):
    spark.createDataFrame(
        [(*d, 7, "x", 0.5, "y", 1) for d in documents], DOCUMENTS
    ).repartition(2).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(
        [(*p, 3, "z") for p in pages], "page_id long, url string, html string, row long, digest string"
    ).write.parquet(f"{top}/pages.parquet")
    spark.createDataFrame(
        [(*e, 1) for e in embeddings], "vec_id long, embedding array<float>, label int, row long"
    ).write.parquet(f"{top}/embeddings.parquet")
    spark.createDataFrame(
        [(*x, 1.0) for x in labels], "doc_id long, quality int, toxic int, label double"
    ).write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(
        [(*x, 1, "t", 2) for x in benchmark], "item_id long, text string, term int, shard string, row int"
    ).write.parquet(f"{top}/benchmark.parquet")
    return str(top)


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    top = tmp_path_factory.mktemp("edge")
    same = "the same text again and again, said twice.\nsecond line here"
    documents = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, same, "en", "a", 5),
        (None, None, None, "a", None),
        (3, same, "en", "a", 5),
        (3, same, "en", "a", 5),
        (3, "other", "fr", None, 5),
        (4, LONG, "en", "b", len(LONG)),
        (5, " \n\t ", "fr", "b", 4),
        (6, "123 !!! ###", None, "b", 11),
        (7, "\n".join(["one line of five words"] * 30), "en", "b", 9),
        (8, "日本語 🎉 <|endoftext|> x\x1cy", "ja", "c", 20),
        (9, "a", "en", "c", 1),
    ]
    pages = [
        (1, None, None),
        (2, "u", ""),
        (None, "u\nv", "x" * 300),
        (3, "u", "x" * 300),
        (3, "u", "x" * 300),
        (4, None, "é" * 50),
        (5, "u", "é" * 50),
        (6, "u", "short"),
        (7, "u", "short"),
        (8, "é" * 1_500_000, "a page with a long address"),
    ]
    embeddings = [
        (0, [1.0, 0.5], 1),
        (20, [0.5, 1.0], None),
        (20, [0.5, 1.0], 2),
        (1, None, 1),
        (2, [1.0, None], 1),
        (3, [float("nan"), 1.0], 1),
        (4, [float("inf"), 1.0], 1),
        (None, [1.0, 1.0], 1),
        (5, [], 1),
        (6, [1.0], 1),
        (7, [1.0, 0.5], 1),
        (8, [1.0, 0.5], 1),
    ]
    labels = [(1, 1, 0), (2, None, 1), (3, 1, 0), (3, 0, 0), (4, 1, 0), (7, 0, 1), (None, 1, 1), (99, 1, 0), (9, 1, 0)]
    benchmark = [
        (1, None),
        (2, ""),
        (None, "the same TEXT twice twice"),
        (3, "word1 tail1 word2"),
        (3, "word1 tail1 word2"),
        (3, "other words of five"),
        (4, LONG),
        (5, "日本語 x"),
        (6, "nowhere-to-be-found"),
    ]
    return _tables(spark, top, documents, pages, embeddings, labels, benchmark)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("empty"), [], [], [], [], [])


@pytest.fixture(scope="session")
def duck():
    def connect(top):
        con = duckdb.connect()
        for n in os.listdir(top):
            path = f"{top}/{n}"
            con.sql(f"create view {n.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        return con

    return connect


@pytest.fixture(scope="session")
def texts(duck):
    return duck(SF).sql("select doc_id, text from documents").fetchall()
