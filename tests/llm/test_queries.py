"""The registered queries: against SQL where there is SQL, over the edge cases, and over empty tables."""

import pytest

import corpus_pipeline
from datakiln.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import SF

ALL = dict(QUERIES) | {"pipeline": corpus_pipeline.run}


def _rows(df):
    columns = sorted(df.columns)
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


@pytest.mark.parametrize("where", ["small", "edge"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, edge, name, where):
    top = SF if where == "small" else edge
    got = duck(top).sql(ORACLE_SQL[name])
    order = [got.columns.index(c) for c in sorted(got.columns)]
    df = QUERIES[name](spark, top)
    assert sorted(df.columns) == sorted(got.columns)
    assert _rows(df) == sorted(repr([r[i] for i in order]) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(ALL))
def test_edge_cases_and_empty_tables(spark, edge, empty, name):
    df = ALL[name](spark, edge)
    n = df.count()
    per_document = {
        "op1_token_store",
        "op3_language_id",
        "op4_line_templates",
        "op5_sentencepiece",
        "op7_extendible_shards",
        "op8_line_frequency",
        "op9_mixing",
        "op10_simhash",
        "op13_minhash",
    }
    if name in per_document:
        assert n == 13
    assert ALL[name](spark, empty).count() == 0
    assert [f.dataType for f in ALL[name](spark, empty).schema] == [f.dataType for f in df.schema]
