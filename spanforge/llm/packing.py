"""Bound-certified best-fit packing of token sequences.

Texts become token pieces (``token_pieces``); pieces shorter than a sequence are
dealt to partitions and packed best-fit decreasing.  Dual-feasible functions give
each partition a lower bound on its bins: where the bins meet the bound, the
partition is certified and done.  The loose bins of partitions with a gap, and the
loosest bin of every other, are opened, their pieces dealt anew across partitions,
and best-fit decreasing runs again; the new bins replace the old ones only if they
are fewer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import textkernel as tk
from spanforge.llm.stage import materialize

CAPACITY = 1024
END_ID = 2
#: Pieces packed together; a partition's memory and its share of the rounding loss follow from it.
PIECES_PER_PARTITION = 32768
#: Repacking goes on while a round saves at least one bin in this many of those it opened.
LEAST_GAIN = 1000
#: Stretches, and ids, remembered by a Python worker; beyond that all are dropped and learnt again.
MEMO_ENTRIES = 1 << 18
MEMO_IDS = 1 << 21
#: Words encoded as one text.
WORDS_AT_ONCE = 4096

#: What a byte says of its character: printed ASCII, surely no white space where a character
#: starts, ASCII letter, ASCII punctuation, last byte of a Latin-1 letter (after 0xC3).
_PRINTED, _SOLID, _LETTER, _PUNCTUATION, _LATIN = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] |= _PRINTED | _SOLID | _PUNCTUATION
_KIND[[0xC3, *range(0xC4, 0xE1), *range(0xE4, 0xF5)]] |= _SOLID
for _lo, _hi in ((0x41, 0x5B), (0x61, 0x7B)):
    _KIND[_lo:_hi] |= _LETTER
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _KIND[_lo:_hi] &= ~np.uint8(_PUNCTUATION)
_KIND[0x80:0xC0] |= _LATIN
_KIND[[0x97, 0xB7]] = 0


class _Memo:
    """Ids of stretches already encoded, by 64-bit hash, in flat arrays; emptied when full."""

    def __init__(self, entries: int) -> None:
        self.entries = entries
        self.clear()

    def clear(self) -> None:
        self.places = tk.Lookup(np.zeros(0, np.uint64), np.zeros(0, np.int32), room=self.entries)
        self.at, self.ids = np.zeros(self.entries + 1, np.int32), np.zeros(4 * self.entries, "<u4")
        self.known = 0

    def add(self, keys: np.ndarray, encoded: list[list[int]]) -> None:
        ends = self.at[self.known] + np.cumsum([len(x) for x in encoded], dtype=np.int64)
        if ends[-1] > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(int(ends[-1]), "<u4"))
        self.ids[self.at[self.known] : ends[-1]] = np.fromiter(chain.from_iterable(encoded), "<u4", int(ends[-1] - self.at[self.known]))
        self.at[self.known + 1 : self.known + 1 + len(keys)] = ends
        self.places.add(keys, np.arange(self.known, self.known + len(keys), dtype=np.int32))
        self.known += len(keys)


class _Encoder:
    """Token ids of whole texts through the ``tokenizers`` file, a slice of texts at a time.

    The file's pattern looks ahead only, and only past white space.  So a text may be cut
    wherever a pre-token surely ends, and the stretches between are encoded alone: before a
    blank that no white space follows, around a lone newline, between a letter and ASCII
    punctuation.  Each distinct stretch is encoded once and remembered by its hash.
    Added tokens (one id each, as the file gives by default) are stretches of their own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens.values()):
            raise ValueError(f"{path}: added tokens that look at their neighbours are not supported")
        self.added = [t.content.encode() for t in tokens.values()]
        # Leftmost, then longest, as the library matches them.
        self.find_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).finditer
        self.memo = _Memo(MEMO_ENTRIES)

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where stretches start."""
        kind = _KIND[data]
        before, after = np.append(np.uint8(0), kind[:-1]), np.append(kind[1:], np.uint8(0))
        # A letter of two bytes (those of Latin-1) is told by its first byte.
        lead = np.append(np.zeros(2, np.uint8), data[:-2])[: len(data)]
        letter = (before & _LETTER > 0) | (before & _LATIN > 0) & (lead == 0xC3)
        cut = (data == 0x20) & (after & _SOLID > 0)
        cut |= (data == 0x0A) & (before & _PRINTED > 0)
        cut |= (kind & _PUNCTUATION > 0) & letter
        lone = np.append(False, (cut & (data == 0x0A))[:-1])
        cut |= lone & (kind & _SOLID > 0)
        full = bounds[1:] > bounds[:-1]
        cut[bounds[1:][full] - 1] = False  # what follows a row's last byte is not its neighbour
        cut[bounds[:-1][full]] = True
        blob = data.tobytes()
        if any(token in blob for token in self.added):
            spans = []
            for row in np.unique(np.searchsorted(bounds, [x for m in self.find_added(blob) for x in (m.start(), m.end() - 1)], "right") - 1):
                at = int(bounds[row])
                spans += [(at + m.start(), at + m.end()) for m in self.find_added(blob[at : bounds[row + 1]])]
            for lo, hi in spans:  # white space before a token ends its run there
                cut[max(lo - 1, 0) : hi] = False
            cut[bounds[:-1][full]] = True
            cut[[x for span in spans for x in span if x < len(cut)]] = True
        return np.flatnonzero(cut)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        blob = data.tobytes()
        texts = [blob[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        out: list[list[int] | None] = [None] * len(texts)
        # A blank and a letter start a new pre-token after any letter, so many such words are
        # encoded as one text and told apart by their word numbers.
        joint = [i for i, w in enumerate(texts) if len(w) > 1 and w[0] == " " and w[1:].isalpha()]
        for k in range(0, len(joint), WORDS_AT_ONCE):
            part = joint[k : k + WORDS_AT_ONCE]
            enc = self.tokenizer.encode("".join([texts[i] for i in part]), add_special_tokens=False)
            ids, words = enc.ids, enc.word_ids
            if words[-1] == len(part) - 1:
                at = np.searchsorted(words, np.arange(len(part) + 1)).tolist()
                for i, lo, hi in zip(part, at, at[1:]):
                    out[i] = ids[lo:hi]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, enc in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = enc.ids
        return out

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every row one after another, each row closed by the end id, and where rows begin."""
        starts = self._cuts(data, bounds)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, memo = tk.span_hashes(data, starts, ends), self.memo
        place, found = memo.places(keys, 0)
        if not found.all():
            fresh, first = np.unique(keys[~found], return_index=True)
            first = np.flatnonzero(~found)[first]
            if memo.known + len(fresh) > memo.entries or memo.at[memo.known] > MEMO_IDS:
                memo.clear()
                fresh, first = np.unique(keys, return_index=True)
            if len(fresh) > memo.entries:
                memo.entries = len(fresh)
                memo.clear()
            memo.add(fresh, self._encode(data, starts[first], ends[first]))
            place, _ = memo.places(keys, 0)
        # Row ends come in as stretches of their own, after the last known one.
        stops = np.searchsorted(starts, bounds[1:])
        place = np.insert(place, stops, memo.known)
        first = memo.at[place]
        n = np.where(place == memo.known, 1, memo.at[np.minimum(place + 1, memo.known)] - first)
        upto = np.append(0, np.cumsum(n))
        at = np.repeat(first - upto[:-1], n) + np.arange(upto[-1])
        ids = memo.ids[np.minimum(at, len(memo.ids) - 1)]
        row_ends = upto[stops + np.arange(len(stops)) + 1]
        ids[row_ends - 1] = END_ID
        return ids, np.append(0, row_ends)


def _encoder(path: str) -> _Encoder:
    return tk.keep(f"encoder {path}", lambda: _Encoder(path))


def cut(n_ids: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents: whole sequences, the rest in front."""
    head = n_ids % capacity
    pieces = np.maximum(n_ids // capacity + (head > 0), 1)
    first = np.where((head > 0) | (n_ids == 0), head, capacity)
    doc = np.repeat(np.arange(len(n_ids)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.where(nth == 0, 0, first[doc] + (nth - 1) * capacity)
    return doc, nth, start, np.where(nth == 0, first[doc], capacity)


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A null text is an empty one and gives the single end id.  Ids keep their type, null ids
    are kept; repeated rows give repeated pieces.  Other columns are ignored.
    """
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for first, end, data, bounds in tk.slices(batch.column("text")):
                ids, at = encoder(data, bounds)
                doc, piece, start, length = cut(np.diff(at), capacity)
                raw, lo = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * (at[doc] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist())]
                doc_id = batch.column("doc_id").slice(first, end - first).take(pa.array(doc))
                yield pa.record_batch(
                    [doc_id, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        tk.tidy()

    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_PIECE}")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins any packing needs, by dual-feasible functions (Fekete and Schepers).

    Works on the histogram of lengths.  The family: for each k the stepped function
    that rounds (k+1)x down, alone and after raising pieces above capacity - e to
    whole bins and dropping those below e, for every e up to half a bin.
    """
    if len(lengths) == 0:
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ size) // capacity)
    below = np.cumsum(count * size)
    above = np.cumsum(count[::-1])[::-1]  # above[s]: pieces of length >= s
    for e in np.unique(np.minimum(lengths, capacity - lengths)):
        e = int(e)
        if not 0 < e <= capacity // 2:
            continue
        big = int(above[capacity - e + 1]) if e > 0 else 0
        middle = int(below[capacity - e] - below[e - 1])
        best = max(best, big + -(-middle // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        # value * (k * capacity), kept in integers
        value = np.where(whole, k * size, (scaled // capacity) * capacity)
        best = max(best, -(-int(count @ value) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece.  Open bins are stacked by room; a bit set finds the tightest."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            stack = stacks[room]
            where = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, where = capacity, opened
            opened += 1
        bins[i], offsets[i] = where, capacity - room
        left = room - need
        if left:
            stacks[left].append(where)
            rooms |= 1 << left
    return bins, offsets, opened


_PIECE = "piece int, start long, length long, ids_crc32 long"
_PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


def _pack_round(pieces: DataFrame, rows: int, round_no: int, capacity: int, per_partition: int) -> DataFrame:
    """Deal ``pieces`` to ceil(rows / per_partition) partitions and pack each of them."""
    parts = max(1, -(-rows // per_partition))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "ascending"), ("uid", "ascending")])
        lengths = group["length"].to_numpy()
        bins, offsets, opened = best_fit_decreasing(lengths, capacity)
        gap = opened > lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=opened).astype(np.int64)
        base = ((round_no << 34) + group["part"][0].as_py()) << 24
        # Certified partitions open their loosest bin alone, so that it can meet those of others.
        loose = fill < capacity if gap else (np.arange(opened) == fill.argmin()) & (fill < capacity)
        out = group.drop_columns(["part"])
        for name, column in (("sequence_id", base + bins), ("offset", offsets), ("fill", fill[bins]), ("loose", loose[bins])):
            out = out.append_column(name, pa.array(column))
        return out

    dealt = pieces.select("uid", *_PIECE_COLUMNS, F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(parts)).alias("part"))
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"uid long, doc_id {id_type}, {_PIECE}, sequence_id long, offset long, fill long, loose boolean"
    return materialize(dealt.groupBy("part").applyInArrow(pack, schema), f"pack-round{round_no}")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """Place every piece: the piece columns plus sequence_id and offset.

    Each row of ``pieces`` is placed on its own, repeated rows too.  A piece as long
    as a sequence is one.  Rounds of repacking end when every partition but the last
    loose bins is certified, or a round saves less than one opened bin in ``LEAST_GAIN``.
    An empty table gives an empty result.
    """
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    columns = [*_PIECE_COLUMNS, "sequence_id", "offset"]
    done = pieces.filter(F.col("length") >= capacity).select(
        *_PIECE_COLUMNS, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = pieces.filter(F.col("length") < capacity)
    packed, round_no = _pack_round(short, short.count(), 0, capacity, per_partition), 0
    while True:
        loose = packed.filter("loose")
        old = loose.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("offset") == 0).alias("bins")).first()
        if old["bins"] < 2:
            break
        round_no += 1
        again = _pack_round(loose, old["rows"], round_no, capacity, per_partition)
        saved = old["bins"] - again.filter("offset = 0").count()
        if saved <= 0:
            break
        done = done.unionByName(packed.filter("not loose").select(*columns))
        packed = again
        if saved * LEAST_GAIN < old["bins"]:
            break
    return done.unionByName(packed.select(*columns))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize ``docs`` and pack all of it; see ``token_pieces`` and ``pack_pieces``."""
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), capacity)
