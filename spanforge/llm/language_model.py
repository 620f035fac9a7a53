"""Language-model scores: context-tree weighting over bytes, and a word unigram base.

A byte is eight binary decisions, each in a tree of contexts of 0 to DEPTH preceding
bytes.  A tree node has Krichevsky-Trofimov counts; its weighted probability is half its
own estimate and half the product of its children's, computed from the deepest level up
by grouping.  The probability of the next bit mixes the estimates of all depths along
the context's path with the weights that follow from those.  Counts of (context, byte)
are all the tree needs, so the corpus is read once to count and once to score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import textkernel as tk
from spanforge.llm.stage import crc_fold, materialize

DEPTH = 4
#: Byte that ends every text.
END = 0xFF
FOLDS, HELD_OUT = 5, 1
#: Words scored from a broadcast table: the most frequent ones, never more than this.
COMMON_WORDS = 1 << 18
#: A model of at most this many (context, byte) entries (16 bytes each) is broadcast; a larger one is joined.
BROADCAST_ENTRIES = 1 << 23

U = np.uint64


def grams(data: np.ndarray, bounds: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """(context, byte) code of every position: the last byte lowest, zeros before a row's start."""
    code = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in range(1, depth + 1):
        earlier = np.zeros(len(data), np.uint64)
        earlier[back:] = data[:-back] if back < len(data) else 0
        earlier[place < back] = 0
        code |= earlier << U(8 * back)
    return code


def with_ends(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows each closed by the end byte, which UTF-8 never uses."""
    return np.insert(data, bounds[1:], END), bounds + np.arange(len(bounds))


def _log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1/2: Stirling's series after a shift by six."""
    shifted = x + 6.0
    rising = reduce(lambda a, k: a * (x + float(k)), range(1, 6), x)
    return (
        (shifted - 0.5) * F.log(shifted) - shifted + float(0.5 * np.log(2 * np.pi))
        + 1 / (12 * shifted) - 1 / (360 * F.pow(shifted, 3.0)) + 1 / (1260 * F.pow(shifted, 5.0)) - F.log(rising)
    )


def _log_estimate(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) + (-float(np.log(np.pi)) + _log_gamma(F.lit(1.0)))


def _bits(counts: DataFrame) -> DataFrame:
    """gram, ctx, node, bit, n: the eight decisions of each (context, byte)."""
    byte = F.col("gram").bitwiseAND(F.lit(255))
    return counts.select("gram", F.shiftright("gram", 8).alias("ctx"), byte.alias("byte"), "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("p")).select(
        "gram", "ctx", "n",
        (F.expr("cast(shiftleft(1, p) as bigint) | shiftright(byte, 8 - p)")).alias("node"),
        F.expr("shiftright(byte, 7 - p) & 1").alias("bit"),
    )


def _tree(counts: DataFrame, depth: int) -> list[DataFrame]:
    """Levels 0..depth of (ctx, node, p1, stop, weight): chance of a one as mixed down to
    this level (``stop``: mixed with an even chance below it), and the weight left below."""
    half = float(np.log(0.5))
    leaf = (
        _bits(counts.filter("n > 0")).groupBy("ctx", "node")
        .agg(F.sum(F.expr("if(bit = 0, n, 0)")).alias("n0"), F.sum(F.expr("if(bit = 1, n, 0)")).alias("n1"))
        .withColumn("own", _log_estimate(F.col("n0"), F.col("n1"))).withColumn("log_w", F.col("own"))
    )
    levels = [materialize(leaf, f"ctw-{depth}")]
    for d in range(depth - 1, -1, -1):
        up = (
            levels[-1].groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("ctx"), "node")
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("below"))
            .withColumn("own", _log_estimate(F.col("n0"), F.col("n1")))
            .withColumn("high", F.greatest("own", "below"))
            .withColumn("log_w", F.col("high") + F.log(F.exp(F.col("own") - F.col("high")) + F.exp(F.col("below") - F.col("high"))) + half)
            .drop("high", "below")
        )
        levels.append(materialize(up, f"ctw-{d}"))
    levels.reverse()
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    out: list[DataFrame] = []
    for d, level in enumerate(levels):
        share = F.lit(1.0) if d == depth else F.exp(F.col("own") - F.col("log_w") + half)
        level = level.withColumn("share", share).withColumn("one", one)
        if d == 0:
            mixed = level.withColumn("had", F.lit(0.0)).withColumn("left", F.lit(1.0))
        else:
            above = out[-1].select(F.col("ctx").alias("above"), "node", F.col("p1").alias("had"), F.col("weight").alias("left"))
            mixed = level.withColumn("above", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))).join(above, ["above", "node"])
        out.append(
            materialize(
                mixed.select(
                    "ctx", "node",
                    (F.col("had") + F.col("left") * F.col("share") * F.col("one")).alias("p1"),
                    (F.col("left") * (1.0 - F.col("share"))).alias("weight"),
                ),
                f"ctw-mixed-{d}",
            )
        )
    return out


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, log10 probability) of every counted (context, byte), also those with n = 0."""
    levels = _tree(counts, depth)
    chance = F.when(F.col("bit") == 1, F.col("q")).otherwise(1.0 - F.col("q"))

    def total(bits: DataFrame) -> DataFrame:
        return bits.groupBy("gram").agg(F.sum(F.log10(chance)).alias("logp"))

    leaf = levels[-1].select("ctx", "node", F.col("p1").alias("q"))
    seen = total(_bits(counts.filter("n > 0")).join(leaf, ["ctx", "node"]))
    # What training never met ends at the deepest level that knows the path.
    new = _bits(counts.filter("n = 0")).withColumn("q", F.lit(0.5))
    for d, level in enumerate(levels):
        known = level.select(F.col("ctx").alias("at"), "node", (F.col("p1") + F.col("weight") * 0.5).alias("deeper"))
        new = (
            new.withColumn("at", F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)))
            .join(known, ["at", "node"], "left").withColumn("q", F.coalesce("deeper", "q")).drop("at", "deeper")
        )
    return seen.unionByName(total(new))


def _counted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, n) over all texts with n counted in training rows, and (word, n) of training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {"gram": tk.Counts(), "word": tk.Counts()}
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for first, end, data, bounds in tk.slices(batch.column("text")):
                coded, ends_at = with_ends(data, bounds)
                used = np.repeat(~held[first:end], np.diff(ends_at))
                code = grams(coded, ends_at)
                for keys, n in ((code[used], 1), (np.unique(code[~used]), 0)):
                    keys, totals = np.unique(keys, return_counts=True)
                    found["gram"].add(keys, totals * n)
                starts, ends, at = tk.words(data, bounds)
                hashes = tk.span_hashes(tk.lower(data), starts, ends)
                found["word"].add(*np.unique(hashes[np.repeat(~held[first:end], np.diff(at))], return_counts=True))
        for kind, counts in found.items():
            keys, totals = counts.merge()
            for k in range(0, len(keys), 1 << 17):
                part = slice(k, k + (1 << 17))
                size = len(keys[part])
                yield pa.record_batch(
                    [pa.array([kind == "word"] * size), pa.array(keys[part].view(np.int64)), pa.array(totals[part])], ["is_word", "key", "n"]
                )

    rows = texts.mapInArrow(count, "is_word boolean, key long, n long")
    totals = materialize(rows.groupBy("is_word", "key").agg(F.sum("n").alias("n")), "lm-counts")
    return (
        totals.filter("not is_word").select(F.col("key").alias("gram"), "n"),
        totals.filter("is_word").select(F.col("key").alias("word"), "n"),
    )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    Every text is coded to its end byte, so scores of texts of any length compare; ``bits_per_byte``
    is the code length over the bytes and the end.  A null text is an empty one: only the end is scored.
    Repeated rows score alike; texts are read whole.  With no training rows every
    decision has chance 1/2.  Other columns are ignored.
    """
    held = crc_fold(F.col(id_col), FOLDS) == HELD_OUT
    texts = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, vocabulary = _counted(texts.select("held_out", "text"))
    ends = texts.filter("not held_out").count()
    sizes = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    train_tokens, distinct = int(sizes["n"]) + ends, int(sizes["v"]) + (ends > 0)
    floor = train_tokens + 0.5 * (distinct + 1)

    model = materialize(gram_scores(counts), "lm-model")
    small = model.count() <= BROADCAST_ENTRIES
    shared = texts.sparkSession.sparkContext.broadcast(
        {
            "words": _arrays(vocabulary.orderBy(F.desc("n"), "word").limit(COMMON_WORDS), "word", "n"),
            "model": _arrays(model, "gram", "logp") if small else None,
        }
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = tk.Lookup(*shared.value["words"])
        logp = tk.Lookup(*shared.value["model"]) if small else None
        for batch in batches:
            for first, end, data, bounds in tk.slices(batch.column("text")):
                n_rows = end - first
                starts, stops, at = tk.words(data, bounds)
                hashes = tk.span_hashes(tk.lower(data), starts, stops)
                row = np.repeat(np.arange(n_rows), np.diff(at))
                count, known = common(hashes, 0)
                base = np.bincount(row[known], weights=np.log10((count[known] + 0.5) / floor), minlength=n_rows)
                rare_at = np.searchsorted(row[~known], np.arange(n_rows + 1)).astype(np.int32)
                coded, ends_at = with_ends(data, bounds)
                code = grams(coded, ends_at)
                total, pieces = np.zeros(n_rows), np.zeros(n_rows + 1, np.int32)
                left, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if small:
                    value, _ = logp(code, 0.0)
                    total = np.diff(np.append(0.0, np.cumsum(value))[ends_at])
                else:  # each row's distinct codes and how often it has them
                    found = [np.unique(code[lo:hi], return_counts=True) for lo, hi in zip(ends_at, ends_at[1:])]
                    pieces[1:] = np.cumsum([len(keys) for keys, _ in found])
                    left, times = (np.concatenate(x) for x in zip(*found))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(first, n_rows),
                        batch.column("held_out").slice(first, n_rows),
                        pa.array(np.diff(at) + 1),
                        pa.array(np.bincount(row[known], minlength=n_rows) + int(ends > 0)),
                        pa.array(base + np.log10((ends + 0.5) / floor)),
                        pa.array(total),
                        pa.ListArray.from_arrays(pa.array(rare_at), pa.array(hashes[~known].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(pieces), pa.array(left.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(pieces), pa.array(times.astype(np.int64))),
                        pa.array(np.diff(ends_at)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "total", "rare", "codes", "times", "coded"],
                )

    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, total double, rare array<long>, codes array<long>, times array<long>, coded long"
    rows = materialize(texts.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "lm-rows")
    rare = (
        rows.select("uid", F.explode("rare").alias("word")).join(vocabulary, "word", "left").groupBy("uid")
        .agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / floor)).alias("rare_base"), F.count("n").alias("rare_known"))
    )
    out = rows.join(rare, "uid", "left")
    if not small:
        joined = rows.select("uid", F.explode(F.arrays_zip("codes", "times")).alias("c")).select("uid", F.col("c.codes").alias("gram"), "c.times")
        sums = joined.join(model, "gram").groupBy("uid").agg(F.sum(F.col("times") * F.col("logp")).alias("joined"))
        out = out.join(sums, "uid", "left").withColumn("total", F.coalesce("joined", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        F.col("total").alias("score"),
        (-F.col("total") / (float(np.log10(2)) * F.col("coded"))).alias("bits_per_byte"),
    )


def _arrays(table: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    got = table.select(key, value).toArrow()
    return got[key].to_numpy().view(np.uint64), got[value].to_numpy()
