"""Toxicity: character n-gram linear classifier on naive Bayes scaled presence features."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import linear
from spanforge.llm import textkernel as tk
from spanforge.llm.stage import crc_fold

SPEC = linear.Spec(char_ngrams=(3, 4, 5, 6), word_ngrams=(), lower=True, bayes_scaled=True)
FOLDS = 5
THRESHOLD = 0.5


def train(docs: DataFrame, labels: DataFrame, spec: linear.Spec = SPEC) -> linear.Model:
    """Fit ``labels.toxic`` on rows outside fold 0 (crc32 of the id as text, modulo 5), calibrated on a part the first fit has not seen."""
    return linear.fit(linear.labelled_sample(docs, labels, "toxic", spec, lambda c: crc_fold(c, FOLDS) != 0), spec, calibrate=True, again=True)


def _scored(docs: DataFrame, model: linear.Model, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row as kept_<name>, plus text_score.

    Texts that are kept go to Python once, and rows come back a slice at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep])
    if text_col not in keep:
        rows = docs.select(*[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep], F.col(text_col).alias("scored_text"))
    text, out = f"kept_{text_col}" if text_col in keep else "scored_text", rows.drop("scored_text")
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.forget()
        scorer = linear.Scorer(shared.value)
        for batch in batches:
            kept = batch.select(names)
            for first, end, data, bounds in tk.slices(batch.column(text), linear.SLICE):
                part = kept.slice(first, end - first)
                yield pa.record_batch([*part.columns, pa.array(scorer(data, bounds))], [*part.schema.names, "text_score"])
            del batch, kept
            tk.tidy()

    return rows.mapInArrow(run, out.schema.add("text_score", "double"))


def score(docs: DataFrame, model: linear.Model, keep: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row plus score (0 to 1).

    A null or empty text scores as a text without n-grams.  Repeated rows score alike;
    a very long text is scored whole.  Nothing but the text enters the score.
    """
    return _scored(docs, model, keep, text_col).select(*[F.col(f"kept_{c}").alias(c) for c in keep], F.col("text_score").alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = score(docs, train(docs, labels), keep=("doc_id",))
    return scored.select(
        "doc_id",
        (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; columns unchanged."""
    columns = tuple(docs.columns)
    kept = _scored(docs, train(docs, labels), columns).filter(F.col("text_score") < THRESHOLD)
    return kept.select(*[F.col(f"kept_{c}").alias(c) for c in columns])
