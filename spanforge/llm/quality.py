"""Quality rules: counted text statistics, then a calibrated hashed n-gram classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import linear
from spanforge.llm import textkernel as tk
from spanforge.llm.stage import crc_fold

SPEC = linear.Spec(char_ngrams=(2, 3, 4), word_ngrams=(1, 2), lower=False, bayes_scaled=False)
#: Fixed thresholds.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_PROBABILITY = 0.5
REPEAT_WINDOW = 3
FOLDS = 5
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def _in_row(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows as well."""
    return tk.mix64(hashes + tk.mix64(row.astype(np.uint64) + np.uint64(1)))


def statistics(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counted columns of every row."""
    n_rows = len(bounds) - 1
    starts, ends, first = tk.words(data, bounds)
    n_words = np.diff(first)
    row = np.repeat(np.arange(n_rows), n_words)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    word_chars = np.bincount(row, weights=letters[ends] - letters[starts], minlength=n_rows).astype(np.int64)

    # Lines: cut after every newline and at row bounds; only lines with a word count.
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(bounds, line_start, "right") - 1
    following = np.append(line_start[1:], len(data))
    line_end = np.minimum(following, bounds[line_row + 1])
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else 0)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[worded], line_end[worded], line_row[worded]
    n_dup_lines = np.bincount(line_row, minlength=n_rows)
    if len(line_start):
        keys = _in_row(line_row, tk.span_hashes(data, line_start, line_end))
        _, where = np.unique(keys, return_index=True)
        n_dup_lines = n_dup_lines - np.bincount(line_row[where], minlength=n_rows)

    covered = np.zeros(len(starts), bool)
    if len(starts) >= REPEAT_WINDOW:
        windows = tk.sequence_hashes(tk.span_hashes(data, starts, ends), REPEAT_WINDOW)
        inside = np.flatnonzero(row[: len(windows)] == row[REPEAT_WINDOW - 1 :])
        _, back, count = np.unique(_in_row(row[inside], windows[inside]), return_inverse=True, return_counts=True)
        again = inside[count[back] > 1]
        for k in range(REPEAT_WINDOW):
            covered[again + k] = True
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": _per_row(_SYMBOL[data], bounds),
        "n_dup_lines": n_dup_lines.astype(np.int64),
        "n_repeat_words": np.bincount(row[covered], minlength=n_rows).astype(np.int64),
    }


def train(docs: DataFrame, labels: DataFrame, spec: linear.Spec = SPEC) -> linear.Model:
    """Fit ``labels.quality`` outside fold 0 and calibrate on a part the fit has not seen."""
    sample = linear.labelled_sample(docs, labels, "quality", spec, lambda c: crc_fold(c, FOLDS) != 0)
    return linear.fit(sample, spec, calibrate=True)


def assess(docs: DataFrame, model: linear.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed, quality (calibrated probability) and kept for every row.

    A null text has no words and fails; so does any text of under ``MIN_WORDS`` words, or
    with more than half its words in repeated windows.  Repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.drop("text").schema
    for name in STATISTICS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = linear.Scorer(shared.value)
        for batch in batches:
            for first, end, data, bounds in tk.slices(batch.column("text"), linear.SLICE):
                stats = statistics(data, bounds)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(first, end - first), *[pa.array(stats[c]) for c in STATISTICS], pa.array(scorer(data, bounds))],
                    ["doc_id", *STATISTICS, "quality"],
                )

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        rows.mapInArrow(run, schema.add("quality", "double"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_PROBABILITY))
    )
