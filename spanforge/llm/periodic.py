"""Periodic runs of words by recursive frequency splitting.

A run of smallest period q with at least ``EXPONENT`` periods holds every word of it at
least that often.  So a word that is rarer than that within its segment lies in no run
there, and cuts the segment; the parts are counted again, until nothing moves.  Prose is
gone after a few rounds.  The segments that survive are scanned at the lags at which
something of theirs repeats.

The lags: let a stretch have smallest period q and EXPONENT q words, and let w be between
(EXPONENT - 2) q and (EXPONENT - 1) q.  The w words at its start recur q words on, and no
sooner, since two periods that both fit into so long a stretch would make a smaller one.
So the distances from every w-gram to its next occurrence, for widths w that grow by half
(one of which fits each q), contain every period.  At such a lag the whole segment is compared with itself
shifted by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import textkernel as tk

#: A run has at least EXPONENT periods and LEAST_WORDS words.
EXPONENT, LEAST_WORDS = 4, 6
#: Words of several documents handled together; a longer document comes alone and whole.
SLICE_WORDS = 1 << 18
U = np.uint64


def frequent_segments(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments that frequency splitting leaves of the documents cut at ``bounds``.

    ``ids`` are word numbers.  Segments without a rare word are stable and set aside; the
    others are cut at theirs and go round again.
    """
    starts, ends = bounds[:-1], bounds[1:]
    stable: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = ends - starts >= LEAST_WORDS
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        size = ends - starts
        segment = np.repeat(np.arange(len(starts)), size)
        at = np.arange(len(segment)) + np.repeat(starts - np.append(0, np.cumsum(size)[:-1]), size)
        # Equal words of a segment side by side.
        order = np.lexsort((ids[at], segment))
        word, home = ids[at][order], segment[order]
        heads = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (home[1:] != home[:-1])))
        times = np.diff(np.append(heads, len(order)))
        rare = np.empty(len(order), bool)
        rare[order] = np.repeat(times < EXPONENT, times)
        touched = np.bincount(segment[rare], minlength=len(starts)) > 0
        stable.append((starts[~touched], ends[~touched]))
        # Of the others, stretches of words that are not rare.
        mine = touched[segment] & ~rare
        edge = np.append(True, segment[1:] != segment[:-1])
        opens = mine & (edge | np.append(True, ~mine[:-1]))
        closes = mine & (np.append(edge[1:], True) | np.append(~mine[1:], True))
        starts, ends = at[opens], at[closes] + 1
    starts, ends = (np.concatenate(x) for x in zip(*stable)) if stable else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(starts)
    return starts[order], ends[order]


def _lags(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distinct (segment, lag) pairs, the lags at which a run of the segment can repeat.

    Grams are compared by a 64-bit hash; one that is wrong adds a lag, and takes one away
    only where two different grams between an occurrence and the next have the same hash.
    """
    size = ends - starts
    bounds = np.append(0, np.cumsum(size))
    n = int(bounds[-1])
    segment = np.repeat(np.arange(len(starts)), size)
    code = tk.mix64(ids[np.arange(n) + np.repeat(starts - bounds[:-1], size)].astype(np.uint64) + U(1))
    up, down = tk.powers(n + 1)
    total = np.append(np.zeros(1, np.uint64), np.cumsum(code * up[:n]))
    longest = int(size.max())
    found = [np.zeros((0, 2), np.int64)]
    width = EXPONENT - 2
    while width <= (EXPONENT - 1) * (longest // EXPONENT):
        first = np.flatnonzero(np.arange(n) + width <= bounds[1:][segment])
        gram = (total[first + width] - total[first]) * down[first]
        order = np.argsort(gram, kind="stable")
        here, after = first[order[:-1]], first[order[1:]]
        again = (gram[order[:-1]] == gram[order[1:]]) & (segment[here] == segment[after])
        here, lag = here[again], (after - here)[again]
        # Only periods the width is meant for, and that fit.
        fit = ((EXPONENT - 2) * lag <= width) & (width <= (EXPONENT - 1) * lag) & (EXPONENT * lag <= size[segment[here]])
        found.append(np.unique(np.stack([segment[here[fit]], lag[fit]], axis=1), axis=0))
        width += max(1, width // 2)
    return np.unique(np.concatenate(found), axis=0)


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def runs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run, by start and period; starts count through all documents."""
    starts, ends = frequent_segments(ids, bounds)
    found: list[tuple[int, int, int]] = []
    if len(starts):
        for k, q in _lags(ids, starts, ends).tolist():
            lo, hi = int(starts[k]), int(ends[k])
            equal = np.zeros(hi - lo - q + 2, np.int8)
            equal[1:-1] = ids[lo : hi - q] == ids[lo + q : hi]
            step = np.diff(equal)
            a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + q
            long = b - a >= max(LEAST_WORDS, EXPONENT * q)
            for start, end in zip((lo + a[long]).tolist(), (lo + b[long]).tolist()):
                # A stretch that a part of q repeats in has that part for its period.
                if not any((ids[start : end - q // p] == ids[start + q // p : end]).all() for p in _primes(q)):
                    found.append((start, end - start, q))
    out = np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    return out


def repeat_tail(words: list[bytes], h: int) -> list[bytes]:
    """The words with a periodic tail where the checksum asks for one: the contract's planted repeats."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def collapse(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run repeats, joined by a space; ``found`` are the runs of this text."""
    if not len(found):
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, found[:, 0] + found[:, 2], 1)
    np.add.at(drop, found[:, 0] + found[:, 1], -1)
    return b" ".join([w for w, d in zip(words, np.cumsum(drop).tolist()) if not d])


_OUT = pa.schema(
    [("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary())]
)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False, digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period: sorted by start, then period) and collapsed.

    ``collapsed`` is the text without its repeats (binary UTF-8), or with ``digest`` only
    its sha256.  ``planted`` gives one document in ten, by the checksum of its id, a
    periodic tail first.  A null text has no words; a null id counts as an empty one and
    stays null; repeated rows are rows of their own; an empty table gives an empty result.
    Other columns are ignored.  No row leaves its task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("h"),
    )

    def scan(ids_of: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes = [len(t) for t in texts]
        ids = np.empty(sum(sizes), np.int64)
        bounds = np.append(0, np.cumsum(sizes)).astype(np.int64)
        for words, lo, hi in zip(texts, bounds, bounds[1:]):
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            ids[lo:hi] = np.fromiter(map(number.__getitem__, words), np.int64, hi - lo)
        found = runs(ids, bounds)
        cut = np.searchsorted(found[:, 0], bounds)
        told, kept = [], []
        for k, words in enumerate(texts):
            mine = found[cut[k] : cut[k + 1]] - np.array([bounds[k], 0, 0])
            told.append([{"start": a, "length": n, "period": q} for a, n, q in mine.tolist()])
            text = collapse(words, mine)
            kept.append(hashlib.sha256(text).hexdigest().encode() if digest else text)
        return pa.RecordBatch.from_arrays([ids_of, pa.array(sizes, pa.int64()), pa.array(told, _OUT.field("runs").type), pa.array(kept, pa.binary())], ["doc_id", *_OUT.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, texts = 0, 0, []
            for k, (text, h) in enumerate(zip(batch.column("text"), batch.column("h").to_pylist())):
                words = text.as_buffer().to_pybytes().split()  # the blanks of ASCII, as in the contracts
                texts.append(repeat_tail(words, h) if planted else words)
                held += len(words)
                if held >= SLICE_WORDS:
                    yield scan(batch.column("doc_id").slice(first, k + 1 - first), texts)
                    first, held, texts = k + 1, 0, []
            if texts:
                yield scan(batch.column("doc_id").slice(first), texts)
        tk.tidy()

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")


def summarise(found: DataFrame) -> DataFrame:
    """Per row of ``detect`` (with ``digest``): the longest run and the digests of all runs and of what is kept."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as back, -r.period as less)))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
        F.expr("(1000 * best.length) div (-best.less)").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").cast("string").alias("collapsed_sha256"),
    )
