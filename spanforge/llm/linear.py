"""Hashed n-gram linear models: fitted by gradients summed over partitions, scored in Arrow batches.

A feature is the presence of an n-gram in a text, hashed into ``2 ** Spec.bits`` buckets,
and every bucket has its weight: none is selected or left out.  The fit reads a bounded
labelled sample (``Spec.max_rows`` rows, lowest id hash first), which stays in shared
storage as blocks of bucket numbers; each step of the optimiser broadcasts the weights
and adds up the partitions' gradients.  What reaches the driver is bounded by the number
of buckets.  Scoring covers every row and its whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import textkernel as tk
from spanforge.llm.stage import hash32, materialize

U = np.uint64
_STEP, _SPREAD = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
#: Partitions the sample is dealt to for counting and for every gradient.
FIT_TASKS = 12
#: Text bytes whose n-grams are hashed at once.
SLICE = 1 << 18
#: Blocks of the sample sent to a Python worker together.
BLOCKS_AT_ONCE = 2
#: Pairs of steps the optimiser remembers.
MEMORY = 5


@dataclass(frozen=True)
class Spec:
    """What a model sees and how it is fitted."""

    char_ngrams: tuple[int, ...]
    word_ngrams: tuple[int, ...]
    lower: bool
    #: Scale each feature by its naive Bayes log-count ratio, or not.
    bayes_scaled: bool
    bits: int = 20
    #: Documented bound of the labelled sample.
    max_rows: int = 20_000
    l2: float = 4.0
    #: Evaluations after which the optimiser gives up; it ends when a step gains too little, after 25 to 40.
    steps: int = 100


@dataclass(frozen=True)
class Model:
    """A weight for every bucket, the intercept, and the calibration."""

    spec: Spec
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (margin + self.intercept) + self.shift, -500, 500)))


class Features:
    """Distinct buckets of texts.  Characters are code points, words as in the contracts."""

    def __init__(self, spec: Spec):
        self.spec = spec
        self.last = np.zeros(1 << spec.bits, np.int32)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The buckets of each row in turn."""
        spec = self.spec
        if spec.lower:
            data = tk.lower(data)
        shift = U(64 - spec.bits)
        parts: list[tuple[np.ndarray, np.ndarray, int]] = []  # buckets by position, row bounds, n
        if spec.char_ngrams:
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
            upto = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            code = np.zeros(len(points), np.uint64)
            for n in range(1, max(spec.char_ngrams) + 1):
                code = code[: max(0, len(points) - n + 1)] * _STEP + points[n - 1 :] + U(1)
                if n in spec.char_ngrams:
                    parts.append(((code * _SPREAD >> shift).astype(np.int32), upto[bounds], n))
        if spec.word_ngrams:
            starts, ends, first = tk.words(data, bounds)
            hashes = tk.span_hashes(data, starts, ends)
            for n in spec.word_ngrams:
                parts.append(((tk.sequence_hashes(hashes, n) >> shift).astype(np.int32), first, n))
        ends = [bound.tolist() for _, bound, _ in parts]
        for r in range(len(bounds) - 1):
            all_ = np.concatenate([bucket[e[r] : max(e[r], e[r + 1] - n + 1)] for (bucket, _, n), e in zip(parts, ends)])
            # Of equal buckets the last written keeps its place.
            place = np.arange(len(all_), dtype=np.int32)
            self.last[all_] = place
            yield all_[self.last[all_] == place]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, spec: Spec, fold_filter) -> DataFrame:
    """(doc_id, label, held, text) of at most ``spec.max_rows`` labelled ids outside the held-out fold.

    Of several texts under one id, or labels of one id, one is taken.  ``held`` marks a
    fifth of the rows, by id, for calibration.
    """
    by_hash = hash32(F.col("doc_id").cast("string"))
    chosen = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & fold_filter(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
        .orderBy(by_hash, "doc_id").limit(spec.max_rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    held = hash32(F.concat(F.lit("held|"), F.col("doc_id").cast("string"))) % 5 == 0
    return materialize(rows.select("doc_id", "label", held.alias("held"), "text").repartition(FIT_TASKS, by_hash), "linear-sample")


def _counts(sample: DataFrame, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """How many negative and positive texts have each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.forget()
        features, totals = Features(spec), np.zeros((2, 1 << spec.bits), np.int32)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for first, _, data, bounds in tk.slices(batch.column("text"), SLICE):
                for k, buckets in enumerate(features(data, bounds)):
                    totals[label[first + k], buckets] += 1
        seen = np.flatnonzero(totals.any(axis=0))
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(totals[0, seen]), pa.array(totals[1, seen])], ["bucket", "neg", "pos"])

    rows = sample.select("label", "text").mapInArrow(count, "bucket int, neg int, pos int")
    got = rows.groupBy("bucket").agg(F.sum("neg").cast("int").alias("neg"), F.sum("pos").cast("int").alias("pos")).toArrow()
    both = np.zeros((2, 1 << spec.bits), np.int32)
    for k, name in enumerate(("neg", "pos")):
        both[k, got["bucket"].to_numpy()] = got[name].to_numpy()
    return both[0], both[1]


def _blocks(sample: DataFrame, spec: Spec) -> DataFrame:
    """The sample as blocks of rows: label and held flag of each, and its buckets in ascending
    order, as how many share each upper part and two bytes of the lower part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.forget()
        features, uppers = Features(spec), 1 << max(0, spec.bits - 16)
        for batch in batches:
            label, held = batch.column("label").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            for first, end, data, bounds in tk.slices(batch.column("text"), SLICE):
                rows = [np.sort(x) for x in features(data, bounds)]
                upper = np.concatenate([np.bincount(x >> 16, minlength=uppers) for x in rows])
                block = (label[first:end].astype("u1"), held[first:end].astype("u1"), upper.astype("<i4"), np.concatenate(rows).astype("<u2"))
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in block], ["label", "held", "upper", "lower"])
        tk.tidy()

    rows = sample.select("label", "held", "text").mapInArrow(pack, "label binary, held binary, upper binary, lower binary")
    return materialize(rows, "linear-blocks")


def _read_blocks(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(label, held, number of buckets) of the rows of each block, and all their buckets."""
    uppers = 1 << max(0, spec.bits - 16)
    for batch in batches:
        for i in range(batch.num_rows):
            label, held, upper, lower = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("label", "u1"), ("held", "u1"), ("upper", "<i4"), ("lower", "<u2")))
            high = np.tile(np.arange(uppers, dtype=np.int32) << 16, len(label))
            yield label, held > 0, upper.reshape(-1, uppers).sum(axis=1), np.repeat(high, upper) + lower


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows meanwhile, read and sent: a block is a megabyte, and a batch is held several times over."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    usual = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, value in zip(names, usual):
            spark.conf.set(name, value)


def _row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes))
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], dtype=np.float64)
    return out


def _slope(margin: np.ndarray, label: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label


def _gradient(blocks: DataFrame, spec: Spec, weights: np.ndarray, intercept: float, skip_held: bool) -> tuple[float, float, np.ndarray]:
    """Log loss, and its slope in the intercept and in every weight, over the rows used."""
    size = len(weights)
    shared = blocks.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.forget()
        w, loss, first, pull = shared.value, 0.0, 0.0, np.zeros(size)
        for label, held, sizes, buckets in _read_blocks(batches, spec):
            margin = _row_sums(w[buckets], sizes) + intercept
            used = ~held if skip_held else np.ones(len(label), bool)
            off = _slope(margin, label) * used
            loss += float((np.logaddexp(0, np.where(label > 0, -margin, margin)) * used).sum())
            first += float(off.sum())
            pull += np.bincount(buckets, weights=np.repeat(off, sizes), minlength=size)
        at = np.flatnonzero(pull)
        yield pa.record_batch(
            [pa.array([loss]), pa.array([first]), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([pull[at].astype("<f4").tobytes()], pa.binary())],
            ["loss", "first", "at", "pull"],
        )
        tk.tidy()

    with _batches_of(blocks.sparkSession, BLOCKS_AT_ONCE):
        got = blocks.mapInArrow(run, "loss double, first double, at binary, pull binary").toArrow()
    shared.destroy()
    pull = np.zeros(size)
    for at, part in zip(got["at"], got["pull"]):
        pull[np.frombuffer(at.as_buffer(), "<i4")] += np.frombuffer(part.as_buffer(), "<f4")
    return float(np.sum(got["loss"].to_numpy())), float(np.sum(got["first"].to_numpy())), pull


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, bend: float | None = None, enough: float = 1e-4) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking, at most ``steps`` evaluations; ``bend`` bounds the curvature, if known."""
    x, (loss, slope) = start, evaluate(start)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    spent = 1
    while spent < steps:
        way, taken = slope.copy(), []
        for s, y, sy in reversed(past):
            taken.append(float(s @ way) / sy)
            way -= taken[-1] * y
        way *= past[-1][2] / float(past[-1][1] @ past[-1][1]) if past else 1 / (bend or max(1.0, float(np.linalg.norm(slope))))
        for (s, y, sy), a in zip(past, reversed(taken)):
            way += (a - float(y @ way) / sy) * s
        reach, fall = 1.0, float(slope @ way)
        while True:
            there = x - np.float32(reach) * way
            new_loss, new_slope = evaluate(there)
            spent += 1
            if new_loss <= loss - 1e-4 * reach * fall or spent >= steps:
                break
            reach *= 0.3
        if new_loss >= loss:
            break
        s, y = there - x, new_slope - slope
        if float(s @ y) > 1e-12:
            past = [*past, (s, y, float(s @ y))][-MEMORY:]
        gain = loss - new_loss
        x, loss, slope = there, new_loss, new_slope
        if gain < enough * loss:
            break
    return x


def fit(sample: DataFrame, spec: Spec, calibrate: bool = False, again: bool = False) -> Model:
    """Fit on (label, held, text) rows; without both labels the model is the rate of the one there is.

    L2-penalised logistic regression.  With ``calibrate`` the held rows stay out of the fit
    and set the slope and shift of the probability.  With ``again`` the fit then goes on
    over all rows, as an n-gram that only held rows have would weigh nothing.
    """
    sizes = {(r["label"], r["held"]): r["n"] for r in sample.groupBy("label", "held").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_neg, n_pos = (sum(n for (label, _), n in sizes.items() if label == k) for k in (0, 1))
    used = [sum(n for (label, held), n in sizes.items() if label == k and not (calibrate and held)) for k in (0, 1)]
    if not all(used):
        rate = (n_pos + 0.5) / (n_neg + n_pos + 1.0)
        return Model(spec, np.zeros(1 << spec.bits, np.float32), float(np.log(rate / (1 - rate))))
    neg, pos = _counts(sample, spec)
    live = np.flatnonzero(neg + pos)
    ratio = np.log((pos[live] + 1.0) / (n_pos + 2.0)) - np.log((neg[live] + 1.0) / (n_neg + 2.0))
    scale = (ratio if spec.bayes_scaled else np.ones(len(live))).astype(np.float32)
    blocks, n = _blocks(sample, spec), sum(used)
    # The optimiser's variables are the weights over ``pace``: features bend the loss by how often
    # they occur, all of them together no more than ``bend``.  Log-count ratios even that out.
    often = (neg[live] + pos[live]) / (n_neg + n_pos)
    pace, bend = np.ones(len(live), np.float32), None
    if not spec.bayes_scaled:
        pace, bend = (1 / np.sqrt(often + spec.l2 / n)).astype(np.float32), 0.25 * float(often.sum()) + 1
    del neg, pos, ratio, often

    def full(x: np.ndarray) -> np.ndarray:
        weights = np.zeros(1 << spec.bits, np.float32)
        weights[live] = scale * pace * x[:-1]
        return weights

    def objective(n: int, skip_held: bool) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
        def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
            loss, first, pull = _gradient(blocks, spec, full(x), float(x[-1]), skip_held)
            w = pace * x[:-1]
            slope = np.append(pace * (scale * (pull[live] / n).astype(np.float32) + np.float32(spec.l2 / n) * w), np.float32(first / n))
            return loss / n + 0.5 * spec.l2 / n * float(w @ w), slope

        return evaluate

    start = np.zeros(len(live) + 1, np.float32)
    start[-1] = np.log(used[1] / used[0])
    best = minimise(objective(n, calibrate), start, spec.steps, bend)
    slope, shift = 1.0, 0.0
    if calibrate:
        margin, label = _held_margins(blocks, spec, full(best))
        if len(np.unique(label)) == 2:
            slope, shift = _platt(margin + float(best[-1]), label)
    if calibrate and again:
        best = minimise(objective(n_neg + n_pos, False), best, spec.steps, bend)
    return Model(spec, full(best), float(best[-1]), slope, shift)


def _held_margins(blocks: DataFrame, spec: Spec, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margin, label) of the held rows: two numbers for each of a fifth of the sample."""
    shared = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, held, sizes, buckets in _read_blocks(batches, spec):
            margin = _row_sums(shared.value[buckets], sizes)
            yield pa.record_batch([pa.array(margin[held]), pa.array(label[held].astype(float))], ["margin", "label"])

    with _batches_of(blocks.sparkSession, BLOCKS_AT_ONCE):
        got = blocks.mapInArrow(run, "margin double, label double").toArrow()
    return got["margin"].to_numpy(), got["label"].to_numpy()


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that calibrates margins (Platt, smoothed targets, Newton)."""
    pos, neg = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target))
        theta = theta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


class Scorer:
    """A model laid out for scoring batches."""

    def __init__(self, model: Model):
        self.model, self.features = model, Features(model.spec)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        weights = self.model.weights
        return self.model.probability(np.array([weights[x].sum(dtype=np.float64) for x in self.features(data, bounds)]))
