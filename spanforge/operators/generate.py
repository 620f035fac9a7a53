"""Synthetic trace corpora by seeded bootstrap and label-conditional draws.

Every draw is a hash of (seed, purpose, graph, node), so executors generate their own
graphs and a rerun gives the same corpus.  Pools are real rows under a 0-based index;
drawing a row is an equi-join on the index.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.draws import SPACE, draw
from spanforge.operators.graphs import filter_by_size
from spanforge.operators.metrics import duration_clip, duration_stats
from spanforge.operators.sampling import edge_counts_for, indexed, nearest_key, stratified_sizes
from spanforge.sources.shared import materialize

#: Up to this many nodes all ordered pairs of a graph are listed.
PAIR_NODES = 64
#: The largest weight of a service's ops in an alias table.
WEIGHT = 1 << 30
#: A table of at most so many rows, counted, is broadcast.
BROADCAST_ROWS = 400_000


def blank_graphs(pool: DataFrame, n_graphs: int, seed: int) -> DataFrame:
    """(gen_id, num_nodes): ``n_graphs`` sizes bootstrapped from (graph_id, num_nodes)."""
    sizes = indexed(pool.withColumn("all", F.lit(0)), ["all"], seed, "graph_id").select("all", "pool", "idx", "num_nodes")
    total = sizes.select("all", "pool").limit(1)
    ids = pool.sparkSession.range(n_graphs).select(F.col("id").alias("gen_id"), F.lit(0).alias("all"))
    drawn = ids.join(F.broadcast(total), "all").withColumn("idx", draw(seed, "nodes", F.col("gen_id")) % F.col("pool"))
    return drawn.join(sizes.drop("pool"), ["all", "idx"]).select("gen_id", "num_nodes")


def empirical_counts(graphs: DataFrame, pool: DataFrame, column: str, seed: int) -> DataFrame:
    """(gen_id, column): a value of a real graph drawn for each generated one."""
    values = indexed(pool.withColumn("all", F.lit(0)), ["all"], seed, "graph_id").select("all", "pool", "idx", column)
    size = values.groupBy("all").agg(F.first("pool").alias("pool"))
    drawn = graphs.select("gen_id", F.lit(0).alias("all")).join(F.broadcast(size), "all").withColumn("idx", draw(seed, "edge-count", F.col("gen_id")) % F.col("pool"))
    return drawn.join(values.drop("pool"), ["all", "idx"]).select("gen_id", column)


def blank_nodes(graphs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return graphs.select("gen_id", "num_nodes", *(keep or []), F.explode(F.expr("sequence(0, cast(num_nodes as int) - 1)")).alias("node_idx"))


def _bootstrap(rows: DataFrame, pool: DataFrame, keys: list[str], seed: int, purpose: str, take: list[str]) -> DataFrame:
    """``rows`` with ``take`` columns of a pool row drawn per (gen_id, node_idx) inside ``keys``."""
    base = indexed(pool, keys, seed, "pool_id")
    sizes = base.groupBy(*keys).agg(F.first("pool").alias("pool"))
    drawn = rows.join(sizes, keys).withColumn("idx", draw(seed, purpose, F.col("gen_id"), F.col("node_idx")) % F.col("pool"))
    return drawn.join(base.select(*keys, "idx", *take), [*keys, "idx"]).drop("pool", "idx")


def _pool(nodes: DataFrame) -> DataFrame:
    return nodes.select("service_name", "operation_name", "duration", F.concat_ws("#", "graph_id", "node_idx").alias("pool_id"), F.lit(0).alias("all"))


def random_nodes(blank: DataFrame, bounds: DataFrame, nodes: DataFrame, seed: int, clip: float = 0.99) -> DataFrame:
    """Independent uniform service and op ids within their bounds; durations from the clipped log pool."""
    upper = duration_clip(nodes.withColumn("all", F.lit(0)), ["all"], clip).select(F.col("log_clip").alias("upper"))
    rows = blank.crossJoin(F.broadcast(bounds)).crossJoin(F.broadcast(upper)).withColumn("all", F.lit(0))
    drawn = _bootstrap(rows, nodes.select(F.col("duration").alias("pool_duration"), F.concat_ws("#", "graph_id", "node_idx").alias("pool_id"), F.lit(0).alias("all")), ["all"], seed, "duration", ["pool_duration"])

    def uniform(lo: str, hi: str, purpose: str) -> Column:
        return F.col(lo) + draw(seed, purpose, F.col("gen_id"), F.col("node_idx")) % (F.col(hi) - F.col(lo) + 1)

    log = F.least(F.log1p(F.greatest("pool_duration", F.lit(0.0))), F.col("upper"))
    return drawn.select(
        "gen_id", "node_idx", uniform("min_service", "max_service", "service").alias("service_id"), uniform("min_op", "max_op", "op").alias("op_id"), F.expm1(log).alias("duration")
    )


def random_edges(graphs: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """``wanted`` (gen_id, num_edges) distinct directed edges per graph, no loops, by hash rank.

    Counts are clipped to [0, n (n - 1)].  Small or crowded graphs rank all ordered pairs;
    the others draw twice as many pairs as they need and keep the first distinct ones, so
    the rows looked at stay in proportion to the edges or to ``PAIR_NODES`` squared.
    """
    n = F.col("num_nodes").cast("long")
    sized = graphs.join(wanted, "gen_id").filter("num_nodes > 1").withColumn("all", n * (n - 1))
    sized = sized.withColumn("k", F.least(F.greatest(F.col("num_edges").cast("long"), F.lit(0)), F.col("all"))).filter("k > 0")
    listed = (F.col("num_nodes") <= PAIR_NODES) | (4 * F.col("k") > F.col("all"))
    draws = F.when(listed, F.col("all")).otherwise(2 * F.col("k") + 32)
    tried = sized.withColumn("listed", listed).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), draws - 1)))
    # Pair number p: source p div (n - 1), and the p mod (n - 1)-th of the other nodes.
    number = F.when(F.col("listed"), F.col("t")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "gen_id", "t"), F.col("all")))
    src = F.expr("p div (num_nodes - 1)").cast("int")
    dst = F.expr("cast(p % (num_nodes - 1) as int)")
    pairs = tried.withColumn("p", number).withColumn("src", src).withColumn("dst", dst + (dst >= F.col("src")).cast("int"))
    h = F.when(F.col("listed"), draw(seed, "edge", F.col("gen_id"), F.col("src"), F.col("dst"))).otherwise(F.col("t"))
    once = pairs.groupBy("gen_id", "src", "dst").agg(F.min(h).alias("h"), F.first("k").alias("k"))
    nth = F.row_number().over(Window.partitionBy("gen_id").orderBy("h", "src", "dst"))
    return once.withColumn("nth", nth).filter("nth <= k").select("gen_id", "src", "dst")


def empirical_nodes(blank: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """Service from its marginal, op given service, duration from any node."""
    pool = _pool(nodes)
    rows = _bootstrap(blank.withColumn("all", F.lit(0)), pool, ["all"], seed, "service", ["service_name"])
    rows = _bootstrap(rows, pool, ["service_name"], seed, "op", ["operation_name"])
    return _bootstrap(rows, pool, ["all"], seed, "duration", ["duration"]).select("gen_id", "node_idx", "service_name", "operation_name", "duration")


def chain_edges(blank: DataFrame) -> DataFrame:
    return blank.filter("node_idx > 0").select("gen_id", (F.col("node_idx") - 1).alias("src"), F.col("node_idx").alias("dst"))


def tree_edges(blank: DataFrame, seed: int) -> DataFrame:
    """A parent drawn uniformly among earlier nodes."""
    parent = draw(seed, "parent", F.col("gen_id"), F.col("node_idx")) % F.col("node_idx")
    return blank.filter("node_idx > 0").select("gen_id", parent.cast("int").alias("src"), F.col("node_idx").alias("dst"))


def dag_edges(blank: DataFrame, seed: int, extra: float = 0.25) -> DataFrame:
    """Parent among the first min(child, width) nodes, width 1 to 4; past it, with chance ``extra``, a second edge."""
    width = F.least(F.greatest(F.col("num_nodes") - 1, F.lit(1)), F.lit(4))
    reach = F.least(F.col("node_idx"), width)
    child = blank.filter("node_idx > 0").withColumn("reach", reach).withColumn("width", width)
    g, d = F.col("gen_id"), F.col("node_idx")
    first = child.select("gen_id", (draw(seed, "parent", g, d) % F.col("reach")).cast("int").alias("src"), d.alias("dst"))
    second = child.filter((d > F.col("width")) & (draw(seed, "extra", g, d) < int(extra * SPACE))).select("gen_id", (draw(seed, "second", g, d) % d).cast("int").alias("src"), d.alias("dst"))
    return first.union(second).distinct()


def reuse_edges(graphs: DataFrame, patterns: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """The edges of a real graph, drawn per generated graph among those whose largest index is below n.

    ``patterns``: (graph_id, ...), graphs without edges included.  Where none fits, any
    pattern is drawn and edges past n are masked; without patterns the graph is a random
    tree.  Graphs of one node get no edges.
    """
    reach = edges.groupBy("graph_id").agg((F.max(F.greatest("src", "dst")) + 1).alias("need"))
    sized = patterns.select("graph_id").join(reach, "graph_id", "left").select("graph_id", F.coalesce("need", F.lit(0)).alias("need"))
    pool = materialize(indexed(sized, ["need"], seed, "graph_id"), "generate-patterns")
    # Patterns in order of need: those that fit n are the first so many.  One row per size.
    sizes = pool.groupBy("need").agg(F.first("pool").alias("pool"))
    line = Window.orderBy("need", "asked").rowsBetween(Window.unboundedPreceding, 0)
    both = sizes.select("need", "pool", F.lit(False).alias("asked")).unionByName(
        graphs.select(F.col("num_nodes").alias("need")).distinct().select("need", F.lit(0).cast("long").alias("pool"), F.lit(True).alias("asked"))
    )
    running = both.withColumn("upto", F.sum("pool").over(line))
    total = sizes.agg(F.coalesce(F.sum("pool"), F.lit(0)).alias("total"))
    fitting = running.filter("asked").select(F.col("need").alias("num_nodes"), F.col("upto").alias("fit"))
    starts = running.filter("not asked").select("need", (F.col("upto") - F.col("pool")).alias("start"))
    numbered = pool.join(starts, "need").select("graph_id", (F.col("start") + F.col("idx")).alias("number"))
    asked = graphs.filter("num_nodes > 1").join(fitting, "num_nodes").crossJoin(F.broadcast(total))
    number = draw(seed, "pattern", F.col("gen_id")) % F.when(F.col("fit") > 0, F.col("fit")).otherwise(F.col("total"))
    picked = asked.filter("total > 0").withColumn("number", number).join(numbered, "number")
    reused = picked.join(edges, "graph_id").filter("src < num_nodes and dst < num_nodes").select("gen_id", "src", "dst")
    return reused.unionByName(tree_edges(blank_nodes(asked.filter("total = 0")), seed))


def template_graphs(graphs: DataFrame, patterns: DataFrame, seed: int) -> DataFrame:
    """(gen_id, num_nodes, graph_id, template_nodes): a real template of the nearest observed size per generated graph."""
    near = nearest_key(graphs, patterns)
    pool = indexed(patterns, ["num_nodes"], seed, "graph_id").select(F.col("num_nodes").alias("nearest_nodes"), "pool", "idx", "graph_id")
    sizes = pool.groupBy("nearest_nodes").agg(F.first("pool").alias("pool"))
    drawn = graphs.join(near, "num_nodes").join(sizes, "nearest_nodes").withColumn("idx", draw(seed, "template", F.col("gen_id")) % F.col("pool"))
    picked = drawn.join(pool.drop("pool"), ["nearest_nodes", "idx"])
    return picked.select("gen_id", "num_nodes", "graph_id", F.col("nearest_nodes").alias("template_nodes"))


def template_nodes(templates: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """(gen_id, node_idx, service_name, operation_name, duration): the template's nodes, cut off at
    num_nodes; missing ones are drawn from the template with replacement."""
    asked = blank_nodes(templates.select("gen_id", "num_nodes", "graph_id", "template_nodes"), ["graph_id", "template_nodes"])
    extra = draw(seed, "extra", F.col("gen_id"), F.col("node_idx")) % F.col("template_nodes")
    origin = F.when(F.col("node_idx") < F.col("template_nodes"), F.col("node_idx")).otherwise(extra).cast("int")
    real = nodes.select("graph_id", F.col("node_idx").alias("origin"), "service_name", "operation_name", "duration")
    return asked.withColumn("origin", origin).join(real, ["graph_id", "origin"]).select("gen_id", "node_idx", "service_name", "operation_name", "duration")


def template_edges(templates: DataFrame, edges: DataFrame) -> DataFrame:
    """(gen_id, src, dst): the template's edges whose ends fit."""
    return templates.join(edges, "graph_id").filter("src < num_nodes and dst < num_nodes").select("gen_id", "src", "dst")


def allowed_pairs(rows: DataFrame, fit: DataFrame, columns: tuple[str, str] = ("service_name", "operation_name")) -> DataFrame:
    """Rows whose (service, op) pair the fit data has."""
    return rows.join(fit.select(*columns).distinct(), list(columns), "left_semi")


def alias_tables(nodes: DataFrame, temperature: float) -> DataFrame:
    """(service_name, slots, slot, operation_name, other, cut): ops of a service drawn in proportion to counts^(1/T) in one step.

    A slot, each as likely, gives its own op where a 32-bit draw is below ``cut`` and the
    ``other`` one else.  Weights are whole numbers, so the tables are exact and the same
    everywhere.  A group is one service's list of ops.
    """
    counts = nodes.groupBy("service_name", "operation_name").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("service_name").agg(F.max("n").alias("most"))
    share = F.exp((F.log("n") - F.log("most")) / temperature)
    weights = counts.join(most, "service_name").select("service_name", "operation_name", F.greatest(F.round(share * WEIGHT), F.lit(1)).cast("long").alias("weight"))

    def build(ops: pd.DataFrame) -> pd.DataFrame:
        ops = ops.sort_values("operation_name", ignore_index=True)
        n, total = len(ops), int(ops["weight"].sum())
        left = [int(w) * n for w in ops["weight"]]
        other, cut = list(range(n)), [total] * n
        small, large = deque(k for k in range(n) if left[k] < total), deque(k for k in range(n) if left[k] >= total)
        while small and large:
            poor, rich = small.popleft(), large[0]
            other[poor], cut[poor] = rich, left[poor]
            left[rich] -= total - left[poor]
            if left[rich] < total:
                small.append(large.popleft())
        names = ops["operation_name"]
        return pd.DataFrame({"service_name": ops["service_name"], "slots": n, "slot": range(n), "operation_name": names, "other": names[other].to_numpy(), "cut": [c * SPACE // total for c in cut]})

    return weights.groupBy("service_name").applyInPandas(build, "service_name string, slots long, slot long, operation_name string, other string, cut long")


def label_draws(rows: DataFrame, nodes: DataFrame, temperature: float, seed: int) -> DataFrame:
    """An op per (gen_id, node_idx, service_name), drawn from counts^(1/T) among the service's valid ops: one slot of an alias table a node."""
    table = materialize(alias_tables(nodes, temperature), "generate-alias")
    sizes = table.filter("slot = 0").select("service_name", "slots")
    if table.count() <= BROADCAST_ROWS:
        table, sizes = F.broadcast(table), F.broadcast(sizes)
    g, d = F.col("gen_id"), F.col("node_idx")
    asked = rows.join(sizes, "service_name").withColumn("slot", draw(seed, "op-slot", g, d) % F.col("slots")).drop("slots")
    op = F.when(draw(seed, "op-cut", g, d) < F.col("cut"), F.col("operation_name")).otherwise(F.col("other"))
    return asked.join(table, ["service_name", "slot"]).select("gen_id", "node_idx", "service_name", op.alias("operation_name"))


def noisy_durations(rows: DataFrame, stats: DataFrame, seed: int) -> DataFrame:
    """expm1(mean + sd z), at least 0, z standard normal from two hashes."""
    u = (draw(seed, "u", F.col("gen_id"), F.col("node_idx")) + 0.5) / SPACE
    v = (draw(seed, "v", F.col("gen_id"), F.col("node_idx")) + 0.5) / SPACE
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
    return rows.crossJoin(F.broadcast(stats)).withColumn("duration", F.greatest(F.expm1(F.col("log_mean") + F.col("log_sd") * z), F.lit(0.0))).drop("log_mean", "log_sd")


def generation_summary(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    per = edges.groupBy("gen_id").agg(F.count(F.lit(1)).alias("e"))
    return graphs.join(per, "gen_id", "left").agg(
        F.count(F.lit(1)).alias("graphs"), F.avg("num_nodes").alias("mean_nodes"), F.max("num_nodes").alias("max_nodes"), F.avg(F.coalesce("e", F.lit(0))).alias("mean_edges")
    )


@dataclass(frozen=True)
class CorpusPlan:
    """What a generated corpus looks like."""

    n_graphs: int
    label: int
    seed: int = 42
    #: Real graphs outside these sizes teach nothing.
    least_nodes: int = 1
    most_nodes: int | None = None
    #: Size ranges with equal shares; without them sizes are drawn as they come.
    strata: tuple[tuple[int, int | None], ...] | None = None
    temperature: float = 1.0
    #: tree, chain, dag, reuse (patterns of real graphs) or counts (as many random edges as real graphs of that size).
    edges: str = "tree"


def generate_corpus(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, plan: CorpusPlan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes, edges) of a synthetic corpus after real graphs (graph_id, num_nodes, num_edges), their nodes and edges.

    Sizes, services, ops at a temperature, normal log durations and edges, each by seeded
    draws; gen_id names a graph.
    """
    known = filter_by_size(graphs, plan.least_nodes, plan.most_nodes)
    taught, wired = nodes.join(known.select("graph_id"), "graph_id", "left_semi"), edges.join(known.select("graph_id"), "graph_id", "left_semi")
    if plan.strata:
        made = stratified_sizes(known, list(plan.strata), plan.n_graphs, plan.seed).select(F.col("draw_id").alias("gen_id"), "num_nodes")
    else:
        made = blank_graphs(known.select("graph_id", "num_nodes"), plan.n_graphs, plan.seed).withColumn("gen_id", F.col("gen_id").cast("string"))
    made = materialize(made, "corpus-sizes")
    blank = blank_nodes(made)
    services = empirical_nodes(blank, taught, plan.seed).select("gen_id", "node_idx", "service_name")
    labelled = noisy_durations(label_draws(services, taught, plan.temperature, plan.seed), duration_stats(taught), plan.seed)
    if plan.edges == "tree":
        joined = tree_edges(blank, plan.seed)
    elif plan.edges == "chain":
        joined = chain_edges(blank)
    elif plan.edges == "dag":
        joined = dag_edges(blank, plan.seed)
    elif plan.edges == "reuse":
        joined = reuse_edges(made, known, wired, plan.seed)
    elif plan.edges == "counts":
        joined = random_edges(made, edge_counts_for(made, known, plan.seed), plan.seed)
    else:
        raise ValueError(f"no edges are made by {plan.edges}")
    return made.withColumn("label", F.lit(plan.label)), labelled, joined
