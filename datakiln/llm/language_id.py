"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Learned from texts with a language that are not held out; document frequencies from all of them, weights from a sample of
about SAMPLE rows (the documented bound), as many of each language as there are. Neither doc_id, lang nor source is an
input of a prediction.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text if nothing can be
learned. A null doc_id is not held out. Repeated rows give equal predictions. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datakiln.llm.common import steps, table
from datakiln.llm.text_models import Model, char_ngrams, document_frequencies, fitted, inverse_frequencies, sample_rows

BITS, SAMPLE = 15, 4000


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    return char_ngrams(text, BITS)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(rows: DataFrame, bound: int = SAMPLE) -> Model | None:
    """A model from (doc_id, text, lang) rows; None if no text with a language has a letter."""
    rows = rows.where("text is not null and lang is not null")
    sample = [x for x in sample_rows(rows, "lang", grams, bound) if len(x[2])]
    return fitted(sample, inverse_frequencies(*document_frequencies(rows, grams, BITS))) if sample else None


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text. The model's size is slots times languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in steps(batch, "text"):
                langs, scores = [], []
                for text in part.column("text").to_pylist():
                    slots, tf = grams(text or "")
                    if m is None or not len(slots):
                        langs.append("und"), scores.append(0.0)
                        continue
                    p = m.posterior(slots, tf)
                    best = int(p.argmax())
                    langs.append(m.classes[best]), scores.append(float(min(1.0, p[best])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predicted(docs, trained(docs.where(~held_out())))
