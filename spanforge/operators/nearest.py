"""The greatest weighted set similarity of each probe to any row of an index, by falling bounds.

Both sides are kinds: (kind, set0, set1, ...), distinct sets of 64-bit tokens.  Tokens are
put in one order, rarest first.  Two sets that share at least s tokens share l of them
among the first n - s + l of each, so each round looks for similarities of a level t
through keys of l tokens from those prefixes alone: l is s, and MANY at most, so that few
rows have a key in common even where all tokens are frequent.  A probe whose best has
reached the level is done, the others go on at the next, lower one, with prefixes cut by
their own best.  A group is one key: its probes meet its index rows, bounds by length and by
place leave few pairs, the most promising are compared first, and the rest stop where their
bound does not beat the best.  A group returns one number per probe, never pairs.

Sets of more than WIDE tokens have too many choices of several; they meet in single tokens.
A key of many rows is cut into tiles.  Index tiles are ranges of set sizes, and a probe
visits those its length bound admits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.sources.shared import materialize

#: Similarities looked for, round by round; the last finds whatever shares a token.
LEVELS = (0.8, 0.65, 0.5, 0.32, 0.0)
#: Tokens of a key at most, and the size of sets beyond which keys are single tokens.
MANY, WIDE = 3, 16
#: Rows of one side of a key that are kept together; one kind in TILE_SAMPLE is counted to lay them out (layout alone, no decision).
TILE, TILE_SAMPLE = 2048, 16
#: Rows, and pairs, handled at once inside a task; kinds whose keys are made at once.
CHUNK_ROWS, CHUNK_PAIRS, KEY_ROWS = 20_000, 1 << 18, 1000
#: Beyond so many kinds a sketch of at most 2^SKETCH_BITS bits keeps back keys that the other side lacks, before they are shuffled.
SKETCH_ROWS, SKETCH_BITS = 20_000, 27
#: Pairs of a probe compared before its bound is asked again; doubled each time.
FIRST_LOOK = 4
#: Rounding never loses a pair.
SLACK = 1e-9
#: A table of at most so many rows, counted, is broadcast.
BROADCAST_ROWS = 400_000
#: What a group of rows has in common.
KEY = ["lane", "tab", "many", "token"]


def table_bounds(weights: tuple[float, ...], level: float) -> list[tuple[int, float, float, float]]:
    """(table, share, offset, one), the heaviest first: pairs of similarity b >= level are seen in one of these tables.

    Where the lighter tables cannot reach the level by themselves the heaviest one must
    help with what they leave: there Jaccard >= share b - offset.  Below, a pair shares two
    tokens of the heaviest table; with one at most this gives ``one`` / size, and the others
    make up the rest: Jaccard >= share (b - one / size) in one of them.
    """
    main = max(range(len(weights)), key=lambda k: weights[k])
    others = sum(weights) - weights[main]
    if level > others or len(weights) == 1:
        return [(main, 1 / weights[main], others / weights[main], 0.0)]
    return [(main, 0.0, 0.0, weights[main]), *((k, 1 / others, 0.0, weights[main]) for k in range(len(weights)) if k != main)]


def _tokens(kinds: DataFrame, n_sets: int) -> DataFrame:
    """(kind, tab, size, token) of every set."""
    sets = F.array(*[F.struct(F.lit(k).alias("tab"), F.col(f"set{k}").alias("s")) for k in range(n_sets)])
    return kinds.select("kind", F.explode(sets).alias("t")).select("kind", "t.tab", F.size("t.s").alias("size"), F.explode("t.s").alias("token"))


def _ordered(kinds: DataFrame, stat: DataFrame, n_sets: int) -> DataFrame:
    """(kind, set0, live0, ...): tokens rarest first, and whether the other side has them at all."""
    place = F.struct("often", "token", ((F.col("often") > 0) & (F.col("asked") > 0)).alias("live"))
    rows = _tokens(kinds, n_sets).join(stat, ["tab", "token"])
    packed = rows.groupBy("kind").agg(*[F.sort_array(F.collect_list(F.when(F.col("tab") == k, place))).alias(f"p{k}") for k in range(n_sets)])
    return packed.select("kind", *[x for k in range(n_sets) for x in (F.col(f"p{k}.token").alias(f"set{k}"), F.col(f"p{k}.live").alias(f"live{k}"))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class _Round:
    """What the keys of a round depend on.  ``wide``: of every table, whether there are probes and index rows of more than ``size`` tokens."""

    bounds: list[tuple[int, float, float, float]]
    level: float
    wide: dict[int, tuple[bool, bool]]
    n_sets: int
    many: int
    size: int

    def keys(self, batch: pa.RecordBatch, real: bool) -> dict[str, np.ndarray]:
        """The keys of a batch's rows (``row``), live tokens alone.

        Lane 0 is for two sets of at most ``size`` tokens, which meet in keys of several;
        lanes 1 and 2 are for wide index rows with any probe, and for wide probes with the
        other index rows, by single tokens.
        """
        found: list[dict[str, np.ndarray]] = []
        reached = np.maximum(batch["best"].to_numpy(), self.level)
        n_main = batch[f"set{self.bounds[0][0]}"].value_lengths().to_numpy()
        for k, share, offset, one in self.bounds:
            sets = batch[f"set{k}"]
            n, flat = sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy().view(np.uint64)
            live = batch[f"live{k}"].flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            rest = reached - one / n_main
            least = np.maximum(rest * share - offset, 0)
            # In the heaviest table: one shared token and nothing else does not do.
            need = np.where(rest > SLACK, 2, 1) if one and share == 0 else np.maximum(np.ceil((least - SLACK) * n), 1).astype(np.int64)
            near = n >= (least - SLACK) * (self.size + 1)
            wide_probes, wide_rows = self.wide[k]
            lanes = [(0, many, (n <= self.size) & (many >= np.minimum(self.many, need))) for many in range(1, self.many + 1)]
            lanes += [(1, 1, n > self.size if real else near)] if wide_rows else []
            lanes += [(2, 1, (n <= self.size) & near if real else n > self.size)] if wide_probes else []
            for lane, many, on in lanes:
                cut = n - np.maximum(need, many) + many
                at = np.flatnonzero(live & on[owner] & (place < cut[owner]))
                has = np.bincount(owner[at], minlength=len(n))
                start = np.cumsum(has) - has
                # Rows with equally many live tokens have the same choices of several.
                for c in np.unique(has[has >= many]):
                    who = np.flatnonzero(has == c)
                    choice = np.array(list(combinations(range(c), many)), np.int64)
                    chosen = at[start[who][:, None, None] + choice[None]].reshape(-1, many)
                    token = flat[chosen[:, 0]]
                    for j in range(1, many):
                        token = _mixed(token + np.uint64(j)) ^ flat[chosen[:, j]]
                    row = np.repeat(who, len(choice))
                    found.append({"row": row, "token": token, "pos": place[chosen[:, -1]], "size": n[row], "least": least[row], **{name: np.full(len(row), x) for name, x in zip(KEY, (lane, k, many))}})
        if not found:
            return {name: np.zeros(0, np.uint64 if name == "token" else np.int64) for name in ("row", "pos", "size", "least", *KEY)}
        return {name: np.concatenate([x[name] for x in found]) for name in found[0]}


def _slot(keys: dict[str, np.ndarray], bits: int) -> np.ndarray:
    """A key's place in a sketch of 2^bits bits."""
    group = ((keys["lane"] * 64 + keys["tab"]) * 16 + keys["many"]).astype(np.uint64)
    return _mixed(_mixed(keys["token"]) + group) >> np.uint64(64 - bits)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, KEY_ROWS):
            yield batch.slice(at, KEY_ROWS)


def _sketch(kinds: DataFrame, of: _Round, real: bool, bits: int) -> np.ndarray:
    """Bits of the keys that the rows have: a table of fixed size, merged piece by piece."""
    piece = min(1 << bits >> 3, 1 << 20)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.zeros(1 << bits >> 3, np.uint8)
        for batch in _pieces(batches):
            slot = np.unique(_slot(of.keys(batch, real), bits))
            np.bitwise_or.at(here, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        for at in range(0, len(here), piece):
            if here[at : at + piece].any():
                yield pa.record_batch([pa.array([at]), pa.array([here[at : at + piece].tobytes()])], ["at", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_py(), np.uint8) for x in table["bits"]]
        return pa.table({"at": table["at"].slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()])})

    got = kinds.mapInArrow(mark, "at long, bits binary").groupBy("at").applyInArrow(merge, "at long, bits binary").toArrow()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for at, part in zip(got["at"].to_pylist(), got["bits"].to_pylist()):
        out[at : at + piece] = np.frombuffer(part, np.uint8)
    return out


def _keyed(kinds: DataFrame, of: _Round, real: bool, other: Broadcast | None, bits: int) -> DataFrame:
    """One row per key of every kind (kind, best, sets, live): KEY, pos, size, least, kind, best and sets; without keys that the other side's sketch lacks."""
    sets = [f"set{k}" for k in range(of.n_sets)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            keys = of.keys(batch, real)
            if other is not None:
                slot = _slot(keys, bits)
                there = (other.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                keys = {name: x[there] for name, x in keys.items()}
            row = pa.array(keys["row"])
            made = [pa.array(keys[c].astype(np.int32)) for c in ("lane", "tab", "many")] + [pa.array(keys["token"].view(np.int64))]
            made += [pa.array(keys[c].astype(np.int32)) for c in ("pos", "size")] + [pa.array(keys["least"].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(made + [batch[c].take(row) for c in ("kind", "best", *sets)], [*KEY, "pos", "size", "least", "kind", "best", *sets])

    schema = "lane int, tab int, many int, token long, pos int, size int, least double, kind long, best double" + "".join(f", {c} array<long>" for c in sets)
    return kinds.mapInArrow(make, schema)


def _tiled(asked: DataFrame, there: DataFrame, some_asked: DataFrame, some_there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with probe_tile and tile: a key of many rows is cut, its index rows by size, and a probe visits what its length bound admits.

    The keys of a sample of the kinds tell such keys and the sizes to cut at; every row has
    its tile, whatever the sample.
    """
    step = max(1, TILE // TILE_SAMPLE)
    both = some_asked.select(*KEY, F.lit(None).cast("int").alias("n")).unionByName(some_there.select(*KEY, F.col("size").alias("n")))
    heavy = both.groupBy(*KEY).agg(F.count_if(F.col("n").isNull()).alias("asked"), F.sort_array(F.collect_list("n")).alias("sizes")).filter(f"asked > {step} or size(sizes) > {step}")
    cuts = f"if(size(sizes) >= {step}, transform(sequence({step}, size(sizes), {step}), i -> sizes[i - 1]), cast(array() as array<int>))"
    heavy = materialize(heavy.select(*KEY, F.expr(f"greatest((asked * {TILE_SAMPLE} + {TILE - 1}) div {TILE}, 1)").alias("probe_tiles"), F.expr(cuts).alias("cuts")), "nearest-tiles")
    n_heavy = heavy.count()
    if not n_heavy:
        return tuple(x.withColumn("probe_tile", F.lit(0)).withColumn("tile", F.lit(0)) for x in (asked, there))
    heavy = F.broadcast(heavy) if n_heavy <= BROADCAST_ROWS else heavy
    below, upto = "size(filter(cuts, c -> c < size))", "size(filter(cuts, c -> c <= size))"
    there = there.join(heavy, KEY, "left").withColumn("tile", F.expr(f"if(cuts is null, 0, {below} + pmod(hash(kind), {upto} - {below} + 1))"))
    there = there.withColumn("probe_tile", F.explode(F.expr("sequence(0, cast(coalesce(probe_tiles, 1) as int) - 1)")))
    fits = f"(i = size(cuts) or get(cuts, i) >= (least - {SLACK}) * size) and (i = 0 or (least - {SLACK}) * get(cuts, i - 1) <= size)"
    asked = asked.join(heavy, KEY, "left").withColumn("probe_tile", F.expr("cast(pmod(hash(kind), coalesce(probe_tiles, 1)) as int)"))
    asked = asked.withColumn("tile", F.explode(F.expr(f"if(cuts is null, array(0), filter(sequence(0, size(cuts)), i -> {fits}))")))
    return asked, there


class _Rows:
    """Rows of whole groups as arrays: key bounds, sides, sizes, places and the sets of every table."""

    def __init__(self, batch: pa.Table, n_sets: int) -> None:
        def column(name: str) -> np.ndarray:
            return batch[name].to_numpy()

        keys = np.stack([column(c).astype(np.int64) for c in (*KEY, "probe_tile", "tile")])
        self.group = np.cumsum(np.append(0, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        self.real, self.kind, self.tab, self.many = column("real"), column("kind"), column("tab"), column("many").astype(np.int64)
        # Two sets that share more tokens than such a key has also meet in a key of more.
        self.all = (column("lane") == 0) & (self.many < MANY)
        self.size, self.pos, self.best, self.least = column("size").astype(np.int64), column("pos").astype(np.int64), column("best").copy(), column("least")
        self.length, self.first, self.flat = [], [], []
        for k in range(n_sets):
            sets = batch[f"set{k}"].combine_chunks()
            self.length.append(sets.value_lengths().to_numpy().astype(np.int64))
            self.first.append(np.append(0, np.cumsum(self.length[k])))
            self.flat.append(sets.flatten().to_numpy())


def _ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of the concatenated ranges [start, start + count)."""
    which = np.repeat(np.arange(len(starts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _best_of(rows: _Rows, weights: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(kind, best) of the probes of these groups; ``best`` starts from what they had."""
    probes, index = np.flatnonzero(~rows.real), np.flatnonzero(rows.real)
    names, name_of = np.unique(rows.kind[probes], return_inverse=True)
    best = np.zeros(len(names))
    np.maximum.at(best, name_of, rows.best[probes])
    if not len(probes) or not len(index):
        return names, best
    # Within a group index rows by size, so a length bound is a range.
    index = index[np.lexsort((rows.size[index], rows.group[index]))]
    wide = int(rows.size.max()) + 2
    code = rows.group[index] * wide + rows.size[index]
    n, least = rows.size[probes], np.maximum(rows.least[probes] - SLACK, 0)
    lo = np.searchsorted(code, rows.group[probes] * wide + np.ceil(least * n).astype(np.int64))
    shared = rows.many[probes] + np.where(rows.all[probes], 0, n - rows.pos[probes] - 1)
    most = np.minimum(np.floor(shared / np.maximum(least, SLACK) + shared - n + SLACK), wide - 1).astype(np.int64)
    count = np.maximum(np.searchsorted(code, rows.group[probes] * wide + most, "right") - lo, 0)
    # Sets of the index rows as sorted (row, token) codes, for membership.
    words, held = [], []
    for k, flat in enumerate(rows.flat):
        names_k, word = np.unique(flat, return_inverse=True)
        words.append(word)
        owner = np.repeat(np.arange(len(rows.kind)), rows.length[k])
        held.append(np.sort((owner * len(names_k) + word)[rows.real[owner]]))
        rows.first[k] = (rows.first[k], len(names_k))
    cuts = np.append(0, np.cumsum(count))
    at = 0
    while at < len(probes):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + CHUNK_PAIRS, "right")) - 1)
        which, value = _ragged(lo[at:end], count[at:end])
        p, r, name = probes[at:end][which], index[value], name_of[at:end][which]
        at = end
        bound = np.zeros(len(p))
        for k, w in enumerate(weights):
            a, b = rows.length[k][p], rows.length[k][r]
            both = np.minimum(a, b)
            here = rows.tab[p] == k
            # These tokens are the first the two share, or another group sees the pair better.
            behind = np.where(rows.all[p[here]], 0, np.minimum(a[here] - rows.pos[p[here]], b[here] - rows.pos[r[here]]) - 1)
            both[here] = np.minimum(both[here], rows.many[p[here]] + behind)
            bound += w * both / np.maximum(a + b - both, 1)
        keep = bound > best[name] + SLACK * 1e-3
        p, r, name, bound = p[keep], r[keep], name[keep], bound[keep]
        order = np.lexsort((-bound, name))
        p, r, name, bound = p[order], r[order], name[order], bound[order]
        look = FIRST_LOOK
        while len(p):
            head = np.append(True, name[1:] != name[:-1])
            start = np.flatnonzero(head)
            nth = np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p))))
            now = nth < look
            np.maximum.at(best, name[now], _similarity(rows, words, held, p[now], r[now], weights))
            left = ~now & (bound > best[name] + SLACK * 1e-3)
            p, r, name, bound = p[left], r[left], name[left], bound[left]
            look *= 2
    return names, best


def _similarity(rows: _Rows, words: list[np.ndarray], held: list[np.ndarray], p: np.ndarray, r: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    total = np.zeros(len(p))
    for k, w in enumerate(weights):
        first, vocabulary = rows.first[k]
        which, value = _ragged(first[p], rows.length[k][p])
        code = r[which] * vocabulary + words[k][value]
        place = np.searchsorted(held[k], code)
        hit = place < len(held[k])
        hit[hit] = held[k][place[hit]] == code[hit]
        both = np.bincount(which[hit], minlength=len(p))
        total += w * both / np.maximum(rows.length[k][p] + rows.length[k][r] - both, 1)
    return total


def _look(probes: DataFrame, index: DataFrame, sides: "_Sides", level: float, weights: tuple[float, ...]) -> DataFrame:
    """(kind, nearest): the best of each probe (kind, best, sets) that has a similarity of at least ``level`` and above its best."""
    n_sets = len(weights)
    # No probe looks below the least of what they have.
    least = probes.agg(F.min("best")).first()[0]
    of = _Round(table_bounds(weights, level), level if least is None else max(level, least), sides.wide, n_sets, MANY, WIDE)
    index = index.withColumn("best", F.lit(0.0))
    shown, bits = [None, None], 0
    if sides.rows > SKETCH_ROWS:
        bits = min(SKETCH_BITS, int(sides.rows * 256).bit_length())
        shown = [probes.sparkSession.sparkContext.broadcast(_sketch(x, of, real, bits)) for x, real in ((index, True), (probes, False))]
    asked, there = _keyed(probes, of, False, shown[0], bits), _keyed(index, of, True, shown[1], bits)
    if sides.rows > TILE:
        some = F.pmod(F.xxhash64("kind"), F.lit(TILE_SAMPLE)) == 0
        asked, there = _tiled(asked, there, _keyed(probes.filter(some), of, False, shown[0], bits), _keyed(index.filter(some), of, True, shown[1], bits))
    else:
        asked, there = (x.withColumn("probe_tile", F.lit(0)).withColumn("tile", F.lit(0)) for x in (asked, there))
    key = [*KEY, "probe_tile", "tile"]
    columns = [*key, "real", "kind", "size", "pos", "best", "least", *[f"set{k}" for k in range(n_sets)]]
    both = asked.withColumn("real", F.lit(False)).select(*columns).unionByName(there.withColumn("real", F.lit(True)).select(*columns))
    parts = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                # Most keys have rows of one side alone.
                last = np.stack([table[c].to_numpy().astype(np.int64) for c in key])
                group, real = np.cumsum(np.append(0, (last[:, 1:] != last[:, :-1]).any(axis=0))), table["real"].to_numpy()
                rows = np.bincount(group)
                reals = np.bincount(group[real], minlength=len(rows))
                table = table.filter(pa.array(((reals > 0) & (reals < rows))[group]))
            if table.num_rows:
                names, best = _best_of(_Rows(table, n_sets), weights)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(best)], ["kind", "nearest"])

        for batch in batches:
            waiting.append(batch)
            if sum(len(b) for b in waiting) < CHUNK_ROWS:
                continue
            table = pa.Table.from_batches(waiting)
            # The last group may go on in the next batch.
            last = np.stack([table[c].to_numpy().astype(np.int64) for c in key])
            whole = int(np.flatnonzero((last != last[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            yield from search(table.slice(0, whole))
            waiting = table.slice(whole).combine_chunks().to_batches()
        if waiting:
            yield from search(pa.Table.from_batches(waiting))

    found = dealt.mapInArrow(run, "kind long, nearest double")
    return found.groupBy("kind").agg(F.max("nearest").alias("nearest"))


@dataclass
class _Sides:
    """Kinds of the larger side; whether a table has wide probes, and wide index rows."""

    rows: int
    wide: dict[int, tuple[bool, bool]]


def _ready(probes: DataFrame, index: DataFrame, n_sets: int) -> tuple[DataFrame, DataFrame, _Sides]:
    both = _tokens(probes, n_sets).withColumn("real", F.lit(0)).unionByName(_tokens(index, n_sets).withColumn("real", F.lit(1)))
    stat = materialize(both.groupBy("tab", "token").agg(F.sum("real").alias("often"), F.sum(1 - F.col("real")).alias("asked")), "nearest-tokens")
    ready = [materialize(_ordered(x, stat, n_sets), "nearest-ordered") for x in (probes, index)]
    told = [x.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.max(F.size(f"set{k}")), F.lit(0)).alias(f"size{k}") for k in range(n_sets)]).first() for x in ready]
    return ready[0], ready[1], _Sides(max(x["rows"] for x in told), {k: tuple(x[f"size{k}"] > WIDE for x in told) for k in range(n_sets)})


def greatest_similarity(probes: DataFrame, index: DataFrame, weights: tuple[float, ...], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(kind, nearest) of every probe: max over the index of the weighted sum of set similarities, 0 if nothing is shared.

    ``probes`` and ``index``: (kind, set0, ...), distinct kinds, one array of distinct longs
    per weight, none empty.
    """
    asked, there, sides = _ready(probes, index, len(weights))
    left = asked.withColumn("best", F.lit(0.0))
    done = None
    for level in levels:
        found = _look(left, there, sides, level, weights)
        best = F.greatest("best", F.coalesce("nearest", F.lit(0.0)))
        state = materialize(left.select("kind", "best").join(found, "kind", "left").select("kind", best.alias("best")), "nearest-best")
        reached = state.filter(F.col("best") >= level).select("kind", F.col("best").alias("nearest"))
        done = reached if done is None else done.unionByName(reached)
        rest = state.filter(F.col("best") < level)
        if level == levels[-1] or rest.isEmpty():
            break
        left = materialize(asked.join(rest, "kind"), "nearest-left")
    return done


def reaching(probes: DataFrame, index: DataFrame, threshold: float, weights: tuple[float, ...]) -> DataFrame:
    """(kind,) of the probes with a similarity of at least ``threshold``, which is above 0, to some index row: one round at that level."""
    asked, there, sides = _ready(probes, index, len(weights))
    # A pair must beat what a probe starts from, so that is just below the threshold.
    found = _look(asked.withColumn("best", F.lit(threshold - SLACK)), there, sides, threshold, weights)
    return found.filter(F.col("nearest") >= threshold).select("kind")
