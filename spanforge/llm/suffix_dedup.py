"""Exact removal of bytes covered by repeated 200-byte strings.

Sorting all suffixes externally carries tens of bytes a position through disk queues,
many times the text itself; the budgets here allow about twice the text.  So only
sampled suffixes are compared.  A window of ``LENGTH`` bytes holds LENGTH - ANCHOR + 1
anchors (ANCHOR-byte strings); the one of least hash is its sample, and equal windows
have equal samples at equal places.  The stages, each a shuffle on hashes:

1. sample positions; keep those whose anchor occurs at two positions or more;
2. hash what lies around each.  Every window reaches far from its sample to the left or
   to the right, so a sample falls into a left and a right group of suffixes that share
   that much.  Samples whose whole context recurs are settled: every window there does;
3. the rest are compared inside their group, window by window, from the text.

Equal texts are one text; a text that occurs twice is covered whole.  The README says
how far this departs from induced sorting of all suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import textkernel as tk
from spanforge.llm.stage import keep_keys, materialize, sized_broadcast

LENGTH = 200
ANCHOR = 48
#: Windows that reach at least this far left of their sample are the left group's.
REACH = (LENGTH - ANCHOR) // 2
#: Rows of one group compared in one place; larger groups are dealt out and settled by count.
GROUP_ROWS = 4096

U = np.uint64


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions in ``data`` and their anchor hashes."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.arange(n - ANCHOR + 1)
    hashes = tk.span_hashes(data, begin, begin + ANCHOR)
    # The position in the low bits breaks ties to the left and names the winner.
    low = U(int(n).bit_length())
    ranked = (hashes >> low << low) | begin.astype(np.uint64)
    width = LENGTH - ANCHOR + 1
    pad = -len(ranked) % width
    blocks = np.append(ranked, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    starts = n - LENGTH + 1
    least = np.minimum(ahead[:starts], behind[width - 1 : width - 1 + starts])
    inside = np.repeat(bounds[1:], np.diff(bounds))[:starts] - np.arange(starts) >= LENGTH
    at = np.unique((least[inside] & ((U(1) << low) - U(1))).astype(np.int64))
    return at, hashes[at]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("tid"), text.alias("text"))


def _sampled(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tids = batch.column("tid").to_numpy()
            for first, end, data, bounds in tk.slices(batch.column("text")):
                at, hashes = anchors(data, bounds)
                row = np.searchsorted(bounds, at, "right") - 1
                fresh = np.zeros(end - first, bool)
                for i in range(end - first):
                    if tids[first + i] not in seen:
                        seen.add(tids[first + i])
                        fresh[i] = True
                good = fresh[row]
                row, at, hashes = row[good], at[good], hashes[good]
                yield pa.record_batch(
                    [pa.array(tids[first + row]), pa.array((at - bounds[row]).astype(np.int32)), pa.array(hashes.view(np.int64))],
                    ["tid", "pos", "fp"],
                )

    return texts.select("tid", "text").mapInArrow(run, "tid long, pos int, fp long")


def _reaches(pos: np.ndarray, size: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of bytes before the sample among the windows of a side."""
    least = np.maximum(LENGTH - (size - pos), REACH if side == 0 else 0)
    most = np.minimum(pos, LENGTH - ANCHOR if side == 0 else REACH - 1)
    return least, most


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text, at[]) -> one row per sample and side, with hashes of group and context."""
    for batch in batches:
        tids, lists = batch.column("tid").to_numpy(), batch.column("at")
        for first, end, data, bounds in tk.slices(batch.column("text")):
            part = lists.slice(first, end - first)
            pos = part.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(end - first), part.value_lengths().to_numpy())
            size = np.diff(bounds)[row]
            for side in (0, 1):
                least, most = _reaches(pos, size, side)
                ok = least <= most
                p, r, lo, hi = pos[ok], row[ok], least[ok], most[ok]
                at = bounds[r] + p
                # What the group shares, then everything its windows can see.
                share = (at - REACH, at + ANCHOR) if side == 0 else (at, at + LENGTH - REACH + 1)
                group = tk.mix64(tk.span_hashes(data, *share) + U(side + 1))
                whole = tk.mix64(tk.span_hashes(data, at - hi, at - lo + LENGTH) + tk.mix64((hi * LENGTH + lo).astype(np.uint64)))
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(p), side, np.int8)), pa.array(group.view(np.int64)), pa.array(whole.view(np.int64)),
                        pa.array(tids[first + r]), pa.array(p.astype(np.int32)),
                        pa.array((p - hi).astype(np.int32)), pa.array((p - lo + LENGTH).astype(np.int32)),
                    ],
                    ["side", "grp", "ctx", "tid", "pos", "lo", "hi"],
                )


_CONTEXT = "side byte, grp long, ctx long, tid long, pos int, lo int, hi int"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text, at[] of struct) -> the bytes each undecided sample's windows can see."""
    for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
        tids, lists, texts = batch.column("tid").to_numpy(), batch.column("at"), batch.column("text")
        out: dict[str, list] = {k: [] for k in ("grp", "salt", "alone", "dealt", "tid", "pos", "lo", "bytes")}
        for i in range(batch.num_rows):
            text = texts[i].as_py().encode()
            for s in lists[i].as_py():
                for k in ("grp", "salt", "alone", "dealt", "pos", "lo"):
                    out[k].append(s[k])
                out["tid"].append(tids[i])
                out["bytes"].append(text[s["lo"] : s["hi"]])
        yield pa.record_batch(
            [pa.array(out["grp"], pa.int64()), pa.array(out["salt"], pa.int64()), pa.array(out["alone"], pa.bool_()), pa.array(out["dealt"], pa.bool_()),
             pa.array(out["tid"], pa.int64()), pa.array(out["pos"], pa.int32()), pa.array(out["lo"], pa.int32()), pa.array(out["bytes"], pa.binary())],
            list(out),
        )


_PIECES = "grp long, salt long, alone boolean, dealt boolean, tid long, pos int, lo int, bytes binary"
_WINDOWS = "grp long, window long, tid long, start int, stop int, n int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, salt): every window of every row, counted inside (grp, salt).

    Gives runs of covered windows [start, stop) of rows that are not settled yet (n = 0),
    and for groups dealt over several places the distinct windows found here with their
    count (n > 0).
    """
    empty = pa.RecordBatch.from_pylist([], pa.schema([("grp", pa.int64()), ("window", pa.int64()), ("tid", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("n", pa.int32())]))

    def settle(table: pa.Table) -> pa.RecordBatch:
        if table.num_rows == 0:
            return empty
        grp, salt = table["grp"].to_numpy(), table["salt"].to_numpy()
        tid, pos, lo = table["tid"].to_numpy(), table["pos"].to_numpy().astype(np.int64), table["lo"].to_numpy().astype(np.int64)
        same = np.zeros(len(grp), bool)
        same[1:] = (grp[1:] == grp[:-1]) & (salt[1:] == salt[:-1]) & (tid[1:] == tid[:-1]) & (pos[1:] == pos[:-1]) & (lo[1:] == lo[:-1])
        column = table["bytes"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        count = np.where(same, 0, np.maximum(np.diff(offsets) - LENGTH + 1, 0))
        row = np.repeat(np.arange(len(grp)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = lo[row] + nth
        at = offsets[row] + nth
        reach = (pos[row] - start).astype(np.uint64)  # same place relative to the sample
        window = tk.mix64(tk.span_hashes(data, at, at + LENGTH) + tk.mix64(reach + U(1)))
        local = tk.mix64(window ^ tk.mix64(grp.view(np.uint64)[row] + tk.mix64(salt.astype(np.uint64)[row])))
        _, head, back, n = np.unique(local, return_index=True, return_inverse=True, return_counts=True)
        alone, dealt = table["alone"].to_numpy(), table["dealt"].to_numpy()
        covered = (n[back] > 1) & alone[row]
        joined = covered[1:] & covered[:-1] & (row[1:] == row[:-1])
        begins = np.flatnonzero(covered & ~np.append(False, joined))
        ends = np.flatnonzero(covered & ~np.append(joined, False))
        told = np.zeros(len(row), np.int32)
        told[head] = n
        open_ = np.flatnonzero(dealt[row] & (told > 0))
        pick, last = np.concatenate([begins, open_]), np.concatenate([ends, open_])
        times = np.concatenate([np.zeros(len(begins), np.int32), told[open_]])
        return pa.record_batch(
            [pa.array(grp[row[pick]]), pa.array(window[pick].view(np.int64)), pa.array(tid[row[pick]]), pa.array(start[pick].astype(np.int32)), pa.array((start[last] + 1).astype(np.int32)), pa.array(times)],
            ["grp", "window", "tid", "start", "stop", "n"],
        )

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        # The last group may go on in the next batch.
        grp, salt = table["grp"].to_numpy(), table["salt"].to_numpy()
        last = np.flatnonzero((grp != grp[-1]) | (salt != salt[-1])) if len(grp) else np.zeros(0, int)
        cut = int(last[-1]) + 1 if len(last) else 0
        held = table.slice(cut)
        if cut:
            yield settle(table.slice(0, cut))
    if held is not None:
        yield settle(held)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, digest = [], [], [], []
        for text, copies, spans in zip(batch.column("text"), batch.column("copies").to_pylist(), batch.column("spans")):
            raw = text.as_py().encode()
            cover = np.zeros(len(raw) + 2, np.int32)
            if copies and copies > 1 and len(raw) >= LENGTH:
                cover[1], cover[-1] = 1, -1
            elif spans.is_valid:
                flat = spans.values
                np.add.at(cover, flat.field("lo").to_numpy() + 1, 1)
                np.add.at(cover, flat.field("hi").to_numpy() + 1, -1)
            gone = np.cumsum(cover)[:-1] > 0  # shifted by one: gone[0] is a sentinel
            data = np.frombuffer(raw, np.uint8)
            n_bytes.append(len(raw))
            n_removed.append(int(gone.sum()))
            n_spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])))
            digest.append(hashlib.sha256(data[~gone[1:]].tobytes()).hexdigest())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _read_again(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tid, text, at) for one document of every text in ``wanted`` (tid, rep, at).

    The keys alone, counted, may be broadcast to drop other documents before the shuffle
    that brings the lists to their texts.
    """
    wanted = materialize(wanted, "suffix-wanted")
    keys = sized_broadcast(wanted.select(F.col("tid").alias("w_tid"), "rep"), wanted.count())
    needed = texts.join(keys, (F.col("tid") == F.col("w_tid")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    return needed.join(wanted.hint("shuffle_merge"), "tid").select("tid", "text", "at")


def _differ(a: Column) -> tuple[Column, Column]:
    """Least and greatest of a hash: unequal where a group has two different members."""
    return F.min(a).alias("h_min"), F.max(a).alias("h_max")


def covered_spans(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tid, lo, hi) of covered bytes, texts that occur once; and (tid, rep, copies) of all texts."""
    known = materialize(
        texts.filter(F.octet_length("text") >= LENGTH).groupBy("tid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "suffix-texts"
    )
    sampled = materialize(_sampled(texts.filter(F.octet_length("text") >= LENGTH)), "suffix-samples")
    place = F.xxhash64("tid", "pos")
    counted = sampled.groupBy("fp").agg(*_differ(place), F.count(F.lit(1)).alias("n"))
    twice = materialize(counted.filter("h_min <> h_max").select("fp", "n"), "suffix-repeated")
    wanted = keep_keys(sampled, twice, ["fp"], "suffix-heavy").groupBy("tid").agg(F.collect_set("pos").alias("at")).join(known.select("tid", "rep"), "tid")
    rows = materialize(_read_again(texts, wanted).mapInArrow(_context, _CONTEXT), "suffix-contexts")

    classes = materialize(
        rows.groupBy("grp", "ctx").agg(*_differ(place), F.min(F.struct("tid", "pos", "lo", "hi")).alias("one"), F.count(F.lit(1)).alias("n"))
        .select("grp", "ctx", (F.col("h_min") == F.col("h_max")).alias("alone"), "n", "one.*"),
        "suffix-classes",
    )
    settled = keep_keys(rows, classes.filter("not alone").select("grp", "ctx", "n"), ["grp", "ctx"], "suffix-heavy-classes").select("tid", "lo", "hi")

    groups = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.bool_or("alone").alias("open")).filter("size > 1 and open").select("grp", "size")
    undecided = classes.join(groups, "grp").select(
        "tid",
        F.struct(
            "grp", F.pmod(F.xxhash64("tid", "pos", "grp"), F.expr(f"(size + {GROUP_ROWS - 1}) div {GROUP_ROWS}")).alias("salt"),
            "alone", (F.col("size") > GROUP_ROWS).alias("dealt"), "pos", "lo", "hi",
        ).alias("sample"),
    )
    wanted = undecided.groupBy("tid").agg(F.collect_list("sample").alias("at")).join(known.select("tid", "rep"), "tid")
    pieces = _read_again(texts, wanted).mapInArrow(_cut_out, _PIECES)
    found = materialize(
        pieces.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "tid", "pos").mapInArrow(_windows, _WINDOWS), "suffix-windows"
    )
    here = found.filter("n = 0").select("tid", F.col("start").alias("lo"), (F.col("stop") - 1 + LENGTH).alias("hi"))
    # Groups dealt over several places: a window is covered if its counts add up to two.
    dealt = found.filter("n > 0")
    twice = dealt.groupBy("grp", "window").agg(F.sum("n").alias("n")).filter("n > 1").select("grp", "window")
    there = dealt.join(twice, ["grp", "window"]).select("tid", F.col("start").alias("lo"), (F.col("start") + LENGTH).alias("hi"))
    return settled.unionByName(here).unionByName(there), known


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is an empty one.  Texts under 200 bytes lose nothing.  A text that
    occurs twice, repeated rows included, goes whole.  Null ids are kept; other columns
    are ignored; an empty table gives an empty result.
    """
    texts = _texts(docs, id_col, text_col)
    spans, known = covered_spans(texts)
    single = spans.groupBy("tid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    once = known.filter("copies = 1").select("tid")
    info = materialize(single.join(once, "tid"), "suffix-info")
    twice = materialize(known.filter("copies > 1").select("tid"), "suffix-copies")
    part = sized_broadcast(info.select("tid"), info.count())
    whole = sized_broadcast(twice, twice.count())

    none = F.lit(None).cast(info.schema["spans"].dataType).alias("spans")
    cut = texts.join(part, "tid", "left_semi").join(info.hint("shuffle_merge"), "tid").select("doc_id", "text", F.lit(1).alias("copies"), "spans")
    gone = texts.join(whole, "tid", "left_semi").select("doc_id", "text", F.lit(2).alias("copies"), none)
    rest = texts.join(part, "tid", "left_anti").join(whole, "tid", "left_anti").select("doc_id", "text", F.lit(1).alias("copies"), none)
    joined = cut.unionByName(gone).unionByName(rest)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_kept, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
