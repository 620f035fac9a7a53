"""Choosing edges from scores of (parent service, child service) pairs.

A graph's node pairs are never listed.  They are blocks: all pairs from the nodes of one
service to the nodes of another have one score.  A block is taken or left whole by a
threshold, sampled by skipping ahead geometrically, or walked lazily in order of score.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.draws import SPACE, draw
from spanforge.sources.shared import materialize

#: A table of at most so many rows, counted, is broadcast.
BROADCAST_ROWS = 400_000


def service_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, ps, cs, score, n_src, n_dst) of every ordered pair of services that meet in a graph.

    The score is the smoothed P(child service | parent service) of ``edges``; a pair that
    has no edge anywhere scores 1 / (edges of the parent service + number of services).
    """
    at = nodes.select("graph_id", "node_idx", "service_name")
    ends = edges.join(at.select("graph_id", F.col("node_idx").alias("src"), F.col("service_name").alias("ps")), ["graph_id", "src"]).join(
        at.select("graph_id", F.col("node_idx").alias("dst"), F.col("service_name").alias("cs")), ["graph_id", "dst"]
    )
    seen = materialize(ends.groupBy("ps", "cs").agg(F.count(F.lit(1)).alias("n")), "edge-seen")
    few = seen.count() <= BROADCAST_ROWS
    of_parent = seen.groupBy("ps").agg(F.sum("n").alias("total"))
    if few:
        seen, of_parent = F.broadcast(seen), F.broadcast(of_parent)
    k = at.agg(F.count_distinct("service_name").alias("k"))
    held = at.groupBy("graph_id", "service_name").agg(F.count(F.lit(1)).alias("n_held"))
    blocks = held.select("graph_id", F.col("service_name").alias("ps"), F.col("n_held").alias("n_src")).join(
        held.select("graph_id", F.col("service_name").alias("cs"), F.col("n_held").alias("n_dst")), "graph_id"
    )
    scored = blocks.join(seen, ["ps", "cs"], "left").join(of_parent, "ps", "left").crossJoin(F.broadcast(k))  # one row
    score = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.col("k"))
    return scored.select("graph_id", "ps", "cs", score.alias("score"), "n_src", "n_dst")


def _normal(seed: int, purpose: str, *ids: Column) -> Column:
    u, v = ((draw(seed, f"{purpose}-{x}", *ids) + 0.5) / SPACE for x in "uv")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def dropped(edges: DataFrame, dropout: float, seed: int) -> DataFrame:
    """Edges that survive a seeded dropout."""
    if dropout <= 0:
        return edges
    return edges.filter(draw(seed, "dropout", F.col("graph_id"), F.col("src"), F.col("dst")) / SPACE > dropout)


def threshold_edges(nodes: DataFrame, blocks: DataFrame, level: float, seed: int = 0, jitter: float = 0.0, dropout: float = 0.0) -> DataFrame:
    """(graph_id, src, dst) with src < dst, scored above ``level``; with ``jitter`` each graph has its own level, normal around it, within 0.05 and 0.95.

    Blocks above the level are listed whole, the others not at all.
    """
    cut = F.lit(level)
    if jitter > 0:
        cut = F.least(F.greatest(F.lit(level) + jitter * _normal(seed, "jitter", F.col("graph_id")), F.lit(0.05)), F.lit(0.95))
    at = nodes.select("graph_id", "node_idx", "service_name")
    taken = blocks.filter(F.col("score") > cut).select("graph_id", "ps", "cs")
    pairs = taken.join(at.select("graph_id", F.col("service_name").alias("ps"), F.col("node_idx").alias("src")), ["graph_id", "ps"]).join(
        at.select("graph_id", F.col("service_name").alias("cs"), F.col("node_idx").alias("dst")), ["graph_id", "cs"]
    )
    return dropped(pairs.filter("src < dst").select("graph_id", "src", "dst"), dropout, seed)


def bernoulli_edges(nodes: DataFrame, blocks: DataFrame, seed: int, dropout: float = 0.0) -> DataFrame:
    """(graph_id, src, dst) with src < dst, each with its block's score for chance, independently.

    A block's pairs stand in a row, source by source.  The gap before the next pair taken
    is geometric, so one draw leads from hit to hit and nothing is asked of the others.
    A round draws somewhat more gaps than a block is expected to need; blocks that did not
    reach their end go on in the next.
    """
    key = ["graph_id", "ps", "cs"]
    total = F.col("n_src") * F.col("n_dst")
    state = blocks.select(*key, "score", "n_dst", total.alias("pairs"), F.lit(0).cast("long").alias("k0"), F.lit(-1).cast("long").alias("at"))
    u = (draw(seed, "skip", *[F.col(c) for c in key], F.col("k")) + 0.5) / SPACE
    gap = F.when(F.col("score") >= 1, F.lit(0).cast("long")).otherwise(F.floor(F.log(u) / F.log(1 - F.col("score"))))
    expected = (F.col("pairs") - 1 - F.col("at")) * F.col("score")
    need = F.ceil(expected + 4 * F.sqrt(expected) + 4).cast("long")
    upto = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    hits = None
    while True:
        drawn = state.withColumn("k", F.explode(F.sequence(F.col("k0"), F.col("k0") + need - 1)))
        placed = materialize(drawn.withColumn("place", F.col("at") + F.sum(gap + 1).over(upto)).select(*key, "score", "n_dst", "pairs", "k", "place"), "edge-skips")
        found = placed.filter("place < pairs")
        hits = found if hits is None else hits.unionByName(found)
        last = placed.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("score", "n_dst", "pairs")], (F.max("k") + 1).alias("k0"), F.max("place").alias("at"))
        state = last.filter("at < pairs - 1")
        if state.isEmpty():
            break
    nth = F.row_number().over(Window.partitionBy("graph_id", "service_name").orderBy("node_idx")) - 1
    at = nodes.select("graph_id", "node_idx", "service_name", nth.alias("nth"))
    edges = (
        hits.select("graph_id", "ps", "cs", F.expr("place div n_dst").alias("i"), F.expr("place % n_dst").alias("j"))
        .join(at.select("graph_id", F.col("service_name").alias("ps"), F.col("nth").alias("i"), F.col("node_idx").alias("src")), ["graph_id", "ps", "i"])
        .join(at.select("graph_id", F.col("service_name").alias("cs"), F.col("nth").alias("j"), F.col("node_idx").alias("dst")), ["graph_id", "cs", "j"])
    )
    return dropped(edges.filter("src < dst").select("graph_id", "src", "dst"), dropout, seed)


def _walked(nodes: DataFrame, blocks: DataFrame, walk: Callable[[dict, list, int], list[tuple[int, int]]], targets: DataFrame | None = None) -> DataFrame:
    """(graph_id, src, dst) chosen by ``walk(nodes by service, [(score, [(ps, cs)])] best first, target)`` in every graph.

    A row is one graph: its nodes by service, and the scores of its pairs of services.
    """
    lists = nodes.groupBy("graph_id", "service_name").agg(F.sort_array(F.collect_list("node_idx")).alias("held"))
    rows = lists.groupBy("graph_id").agg(F.collect_list(F.struct("service_name", "held")).alias("services"))
    rows = rows.join(blocks.groupBy("graph_id").agg(F.collect_list(F.struct("score", "ps", "cs")).alias("scores")), "graph_id")
    if targets is None:
        rows = rows.withColumn("target", F.lit(0).cast("long"))
    else:
        rows = rows.join(targets.select("graph_id", F.col("target").cast("long").alias("target")), "graph_id")
    kind = nodes.schema["node_idx"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph in batch.to_pylist():
                held = {s["service_name"]: s["held"] for s in graph["services"]}
                ranked = sorted(graph["scores"], key=lambda r: -r["score"])
                levels = [(score, [(r["ps"], r["cs"]) for r in same]) for score, same in groupby(ranked, key=lambda r: r["score"])]
                chosen = walk(held, levels, graph["target"])
                yield pa.RecordBatch.from_pydict({
                    "graph_id": pa.array([graph["graph_id"]] * len(chosen), batch.schema.field("graph_id").type),
                    "src": pa.array([s for s, _ in chosen], batch.schema.field("services").type.value_type.field("held").type.value_type),
                    "dst": pa.array([d for _, d in chosen], batch.schema.field("services").type.value_type.field("held").type.value_type),
                })

    return rows.select("graph_id", "services", "scores", "target").mapInArrow(run, f"graph_id {nodes.schema['graph_id'].dataType.simpleString()}, src {kind}, dst {kind}")


def _sources(held: dict, pairs: list[tuple]) -> Iterator[tuple[int, list]]:
    """(source, services of its children) of the pairs of one level, lowest source first."""
    children: dict[object, list] = {}
    for ps, cs in pairs:
        children.setdefault(ps, []).append(cs)
    order = {ps: k for k, ps in enumerate(children)}
    named = list(children.values())
    for src, k in heapq.merge(*[[(i, order[ps]) for i in held[ps]] for ps in children]):
        yield src, named[k]


def _after(nodes: list[int], src: int) -> Iterator[int]:
    """The nodes behind ``src``, one at a time."""
    for i in range(bisect_right(nodes, src), len(nodes)):
        yield nodes[i]


def _best_forward(held: dict, levels: list, target: int) -> list[tuple[int, int]]:
    """The first ``target`` pairs with src < dst by score, then source, then child: blocks of a level are merged, and the merge stops."""
    chosen: list[tuple[int, int]] = []
    for _, pairs in levels:
        for src, services in _sources(held, pairs):
            for dst in heapq.merge(*[_after(held[cs], src) for cs in services]):
                if len(chosen) >= target:
                    return chosen
                chosen.append((src, dst))
    return chosen


def top_edges(nodes: DataFrame, blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """The ``target`` best pairs with src < dst per graph (graph_id, target); ties by (src, dst)."""
    return _walked(nodes, blocks, _best_forward, targets)


def best_parents(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(graph_id, dst, src, score): the best parent of each node but itself; ties go to the lower index.

    A node looks at the services of its graph, not at its nodes: of each service the lowest
    index counts, or the second lowest for the node that is the lowest itself.
    """
    own = Window.partitionBy("graph_id", "service_name").orderBy("node_idx")
    low = nodes.select("graph_id", F.col("service_name").alias("ps"), "node_idx", F.row_number().over(own).alias("nth")).filter("nth <= 2")
    low = low.groupBy("graph_id", "ps").agg(F.min("node_idx").alias("first"), F.max("node_idx").alias("last"), F.count(F.lit(1)).alias("n"))
    child = nodes.select("graph_id", F.col("node_idx").alias("dst"), F.col("service_name").alias("cs"))
    src = F.when(F.col("first") != F.col("dst"), F.col("first")).when(F.col("n") > 1, F.col("last"))
    met = blocks.select("graph_id", "ps", "cs", "score").join(low, ["graph_id", "ps"])
    rows = child.join(met, ["graph_id", "cs"]).withColumn("src", src).filter("src is not null")
    best = F.max(F.struct("score", (-F.col("src")).alias("back")))
    return rows.groupBy("graph_id", "dst").agg(best.alias("b")).select("graph_id", "dst", (-F.col("b.back")).alias("src"), "b.score")


def parent_argmax(best: DataFrame, keep: DataFrame | None = None, root_score: float | None = None) -> DataFrame:
    """The best parent of each child (``best_parents``); then the ``k`` best children per graph, k at most n - 1.

    With ``root_score`` a child whose best parent scores no higher becomes a root.
    """
    if root_score is not None:
        best = best.filter(F.col("score") > root_score)
    if keep is None:
        return best.select("graph_id", "src", "dst")
    order = Window.partitionBy("graph_id").orderBy(F.desc("score"), "dst")
    return best.withColumn("nth", F.row_number().over(order)).join(keep, "graph_id").filter("nth <= k").select("graph_id", "src", "dst")


def first_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_idx, parent): the lowest-index parent, -1 for a root."""
    up = edges.groupBy("graph_id", F.col("dst").alias("node_idx")).agg(F.min("src").alias("parent"))
    return nodes.select("graph_id", "node_idx").join(up, ["graph_id", "node_idx"], "left").withColumn("parent", F.coalesce("parent", F.lit(-1)))


def _forest(held: dict, levels: list, _: int) -> list[tuple[int, int]]:
    """n - 1 edges, best first, one parent a child, without cycles as long as that goes.

    A child without a parent is the top of its tree, so only the top of the source's own
    tree closes a cycle: a source takes all other open children of a level at once, and
    they are settled for good.
    """
    top = {i: i for nodes in held.values() for i in nodes}
    most = len(top) - 1
    chosen: list[tuple[int, int]] = []
    open_ = {s: list(nodes) for s, nodes in held.items()}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for acyclic in (True, False):
        for _, pairs in levels:
            live = [(ps, cs) for ps, cs in pairs if open_[cs]]
            for src, services in _sources(held, live):
                barred = find(src) if acyclic else src
                free = sorted(d for cs in services for d in open_[cs] if d != barred)[: most - len(chosen)]
                if not free:
                    continue
                taken = set(free)
                for cs in services:
                    open_[cs] = [d for d in open_[cs] if d not in taken]
                for dst in free:
                    top[dst] = barred if acyclic else top[dst]
                    chosen.append((src, dst))
                if len(chosen) >= most:
                    return chosen
                if not any(open_[cs] for _, cs in live):
                    break
    return chosen


def spanning_forest(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Greedy spanning forest: best pairs first, one parent per child, no cycle.

    A graph left with more than one root gives the best pairs that remain, cycles or not,
    until n - 1 edges are there.
    """
    return _walked(nodes, blocks, _forest)
