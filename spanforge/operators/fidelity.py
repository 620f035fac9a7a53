"""Fidelity of synthetic corpora: one row per (system, generator, class), and for both classes together.

Every comparison is a cell.  Graph features and label bags are counted once per corpus,
generator and label; a cell then adds up the counts of the groups that belong to it, so
the real corpus is not repeated row by row for every generator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators import distributions, graphs, sampling
from spanforge.sources.shared import materialize

CELL = ["system", "generator", "trace_class"]
GROUP = ["system", "corpus", "generator", "label"]
BAGS = ("all_degrees", "all_durations")
LABELS = ("service", "operation", "service_operation")
WASSERSTEIN = ("node_count", "edge_count", "density", "mean_degree")
#: Features that enter the kernel as log1p.
LOGGED = ("node_count", "edge_count", "mean_duration", "std_duration")
STRUCTURE = ("node_count", "edge_count", "density", "mean_degree", "max_degree", "all_degrees")
TIMING = ("mean_duration", "all_durations")
MMD_CAP = 800
MEANS = ("structure_mean", "timing_mean", "semantic_mean", "overall_fidelity")


def to_cells(groups: DataFrame, generators: DataFrame) -> DataFrame:
    """Rows of corpora (A real, B synthetic) in every cell they belong to, with their side.

    Real rows meet each of the (few) ``generators`` of their system; each class has a cell
    and both share ``combined``.
    """
    named = generators.select(F.col("system").alias("_system"), F.col("generator").alias("_generator"))
    mine = (F.col("system") == F.col("_system")) & ((F.col("corpus") == "A") | (F.col("generator") == F.col("_generator")))
    classes = F.array(F.when(F.col("label") == 1, "abnormal").otherwise("normal"), F.lit("combined"))
    return (
        groups.join(F.broadcast(named), mine)
        .withColumn("generator", F.col("_generator")).withColumn("trace_class", F.explode(classes)).withColumn("side", F.col("corpus"))
        .drop("_system", "_generator", "corpus", "label")
    )


def generators_of(corpora: DataFrame) -> DataFrame:
    return materialize(corpora.filter("corpus = 'B'").select("system", "generator").distinct(), "fidelity-generators")


def value_counts(stats: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, metric, value, n): the features of graphs and the bags of node degrees and durations.

    ``stats`` and ``nodes`` carry the group columns.
    """
    stack = ", ".join(f"'{c}', cast({c} as double)" for c in graphs.FEATURES)
    per_graph = stats.select(*GROUP, F.expr(f"stack({len(graphs.FEATURES)}, {stack}) as (metric, value)"))
    total = (F.col("indegree") + F.col("outdegree")).cast("double")
    where = nodes.select("graph_id", "node_idx", *GROUP)
    degree = graphs.degrees(nodes, edges).join(where, ["graph_id", "node_idx"]).select(*GROUP, F.lit("all_degrees").alias("metric"), total.alias("value"))
    duration = nodes.select(*GROUP, F.lit("all_durations").alias("metric"), F.col("duration").alias("value"))
    rows = per_graph.unionByName(degree).unionByName(duration).withColumn("value", F.round("value", 9))
    return materialize(rows.groupBy(*GROUP, "metric", "value").agg(F.count(F.lit(1)).alias("n")), "fidelity-values")


def label_counts(nodes: DataFrame) -> DataFrame:
    """(group, metric, value, n) of services, operations and their pairs."""
    pair = graphs.node_label()
    c = nodes.groupBy(*GROUP, "service_name", "operation_name").agg(F.count(F.lit(1)).alias("n")).withColumn("pair", pair)
    long = c.select(*GROUP, "n", F.expr("stack(3, 'service', service_name, 'operation', operation_name, 'service_operation', pair) as (metric, value)"))
    return materialize(long.groupBy(*GROUP, "metric", "value").agg(F.sum("n").alias("n")), "fidelity-labels")


def cell_counts(counted: DataFrame, generators: DataFrame) -> DataFrame:
    """(cell, metric, value, na, nb) from group counts."""
    rows = to_cells(counted, generators)

    def side(name: str):
        return F.sum(F.when(F.col("side") == name, F.col("n")).otherwise(0))

    return materialize(rows.groupBy(*CELL, "metric", "value").agg(side("A").alias("na"), side("B").alias("nb")), "fidelity-cells")


def kernel_similarity(stats: DataFrame, generators: DataFrame, seed: int, cap: int = MMD_CAP) -> DataFrame:
    """(cell, mmd_similarity, mmd) on the eleven graph features; at most ``cap`` graphs a side by seeded draw."""
    logged = [F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(c) if c in LOGGED else F.col(c).cast("double").alias(c) for c in graphs.FEATURES]
    rows = materialize(to_cells(stats.select("graph_id", *GROUP, *logged), generators), "fidelity-features")
    capped = sampling.take_count(rows.select(*CELL, "side", "graph_id"), [*CELL, "side"], cap, seed, "mmd").select(*CELL, "graph_id")
    return distributions.mmd_similarity(rows, CELL, list(graphs.FEATURES), capped)


def cap_graphs(stats: DataFrame, tables: list[DataFrame], most: int, seed: int) -> list[DataFrame]:
    """``stats`` and ``tables`` with at most ``most`` graphs of each system, corpus, generator and class, by seeded draw."""
    group = stats.select("graph_id", "system", "corpus", F.coalesce("generator", F.lit("")).alias("made_by"), "label")
    kept = materialize(sampling.take_count(group, ["system", "corpus", "made_by", "label"], most, seed, "max-graphs").select("graph_id"), "fidelity-kept")
    return [t.join(kept, "graph_id", "left_semi") for t in (stats, *tables)]


def compare(stats: DataFrame, nodes: DataFrame, edges: DataFrame, seed: int, cap: int = MMD_CAP, max_graphs: int | None = None) -> DataFrame:
    """The full comparison row of every cell.

    ``stats`` (one row per graph) and ``nodes`` carry system, corpus (A real, B synthetic),
    generator (null for real graphs) and label (1 abnormal).  ``max_graphs`` caps the graphs
    of each side of a class before anything is compared.
    """
    if max_graphs is not None:
        stats, nodes, edges = cap_graphs(stats, [nodes, edges], max_graphs, seed)
    gens = generators_of(stats)
    ecdf = distributions.ecdf_distances(cell_counts(value_counts(stats, nodes, edges), gens), [*CELL, "metric"])
    labels = cell_counts(label_counts(nodes), gens)
    js = distributions.js_similarity(labels, [*CELL, "metric"])

    def picked(metric: str, column: str):
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    ks = [(f"{m}_ks_similarity", picked(m, "ks_similarity")) for m in (*graphs.FEATURES, *BAGS)]
    ws = [(f"{m}_wasserstein_{x}", picked(m, f"wasserstein_{x}")) for m in WASSERSTEIN for x in ("similarity", "distance")]
    numbers = ecdf.groupBy(*CELL).agg(*[c.alias(n) for n, c in ks + ws])
    spread = js.groupBy(*CELL).agg(*[picked(m, "js_similarity").alias(f"{m}_js_similarity") for m in LABELS])
    pair = F.col("metric") == "service_operation"
    valid = F.sum(F.when(pair & (F.col("na") > 0), F.col("nb")).otherwise(0)) / F.nullif(F.sum(F.when(pair, F.col("nb")).otherwise(0)), F.lit(0))
    mass = labels.groupBy(*CELL).agg(F.coalesce(valid, F.lit(0.0)).alias("service_operation_valid_mass"))
    sizes = to_cells(stats.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")), gens).groupBy(*CELL).agg(
        F.sum(F.when(F.col("side") == "A", F.col("n")).otherwise(0)).alias("real_graphs"),
        F.sum(F.when(F.col("side") == "B", F.col("n")).otherwise(0)).alias("synthetic_graphs"),
    )
    rows = sizes.join(numbers, CELL).join(spread, CELL).join(mass, CELL).join(kernel_similarity(stats, gens, seed, cap), CELL)
    rows = rows.withColumns({f"{m}_ks_stat": 1 - F.col(f"{m}_ks_similarity") for m in (*graphs.FEATURES, *BAGS)})
    return roll_up(rows.withColumnsRenamed({"mmd_similarity": "graph_feature_mmd_similarity", "mmd": "graph_feature_mmd"}))


def roll_up(rows: DataFrame) -> DataFrame:
    """The structure, timing and semantic means of comparison rows, and the mean of the three."""

    def mean(names: list[str]):
        return sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)

    parts = {
        "structure_mean": mean([*[f"{m}_ks_similarity" for m in STRUCTURE], "graph_feature_mmd_similarity"]),
        "timing_mean": mean([f"{m}_ks_similarity" for m in TIMING]),
        "semantic_mean": mean([*[f"{m}_js_similarity" for m in LABELS], "service_operation_valid_mass"]),
    }
    return rows.withColumns(parts).withColumn("overall_fidelity", mean(list(parts)))
