"""Spans to directed graphs in long form, and per-graph statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.ranking import running

#: Parent texts that mean "no parent" (fixed values).
ROOT_PARENTS = ("", "root", "none", "nan")
FEATURES = (
    "node_count", "edge_count", "density", "mean_degree", "max_degree", "root_share", "leaf_share",
    "mean_duration", "std_duration", "n_services", "n_ops",
)


def graph_key() -> Column:
    """Trace ids repeat across runs; the run makes them unique."""
    return F.concat_ws("::", "source_run", "trace_id")


def is_root_parent(parent: Column) -> Column:
    return F.lower(F.trim(F.coalesce(parent, F.lit("")))).isin(*ROOT_PARENTS)


def index_nodes(spans: DataFrame) -> DataFrame:
    """Spans plus graph_id and a 0-based node_idx in time order; rows without a trace id go."""
    order = Window.partitionBy("graph_id").orderBy("timestamp", "span_seq", "span_id")
    keyed = spans.filter(F.col("trace_id").isNotNull()).withColumn("graph_id", graph_key())
    return keyed.withColumn("node_idx", F.row_number().over(order) - 1)


def parent_edges(nodes: DataFrame) -> DataFrame:
    """parent -> child for parents present in the same graph; of equal span ids the last counts."""
    ids = nodes.groupBy("graph_id", F.col("span_id").alias("parent_id")).agg(F.max("node_idx").alias("src"))
    children = nodes.filter(~is_root_parent(F.col("parent_id"))).select("graph_id", "parent_id", F.col("node_idx").alias("dst"))
    return children.join(ids, ["graph_id", "parent_id"]).select("graph_id", "src", "dst")


def parent_service(nodes: DataFrame) -> DataFrame:
    """node with the service of its parent span, ``no_parent`` without one."""
    up = nodes.groupBy("graph_id", F.col("span_id").alias("parent_id")).agg(F.max_by("service_name", "node_idx").alias("parent_service_name"))
    return nodes.select("graph_id", "node_idx", "parent_id").join(up, ["graph_id", "parent_id"], "left").select(
        "graph_id", "node_idx", F.coalesce("parent_service_name", F.lit("no_parent")).alias("parent_service_name")
    )


def vocabulary(frames: list[DataFrame], column: str) -> DataFrame:
    """(name, id): dense 0-based ids of the sorted distinct names, by running counts over ranges of names."""
    names = reduce(DataFrame.union, [f.select(F.col(column).alias("name")) for f in frames]).distinct()
    return running(names.withColumn("n", F.lit(1)), [], "name", ["n"]).select("name", (F.col("n_upto") - 1).alias("id"))


def encode(nodes: DataFrame, services: DataFrame, ops: DataFrame) -> DataFrame:
    """nodes(graph_id, node_idx, service_id, op_id, duration)."""
    s = services.select(F.col("name").alias("service_name"), F.col("id").alias("service_id"))
    o = ops.select(F.col("name").alias("operation_name"), F.col("id").alias("op_id"))
    return nodes.join(s, "service_name").join(o, "operation_name").select("graph_id", "node_idx", "service_id", "op_id", "duration")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_idx, indegree, outdegree) of every node; repeated edges and loops count."""
    n = F.count(F.lit(1))
    into = edges.groupBy("graph_id", F.col("dst").alias("node_idx")).agg(n.alias("indegree"))
    out = edges.groupBy("graph_id", F.col("src").alias("node_idx")).agg(n.alias("outdegree"))
    at = ["graph_id", "node_idx"]
    return nodes.select(*at).join(into, at, "left").join(out, at, "left").select(*at, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("indegree", "outdegree")])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The eleven features of every graph (population deviation of duration)."""
    full = nodes.select("graph_id", "node_idx", "service_name", "operation_name", "duration").join(degrees(nodes, edges), ["graph_id", "node_idx"])
    total = F.col("indegree") + F.col("outdegree")
    n, e = F.count(F.lit(1)), F.sum("indegree")
    return full.groupBy("graph_id").agg(
        n.alias("node_count"),
        e.alias("edge_count"),
        (e / F.greatest(n * (n - 1), F.lit(1))).alias("density"),
        F.avg(total).alias("mean_degree"),
        F.max(total).alias("max_degree"),
        F.avg((F.col("indegree") == 0).cast("double")).alias("root_share"),
        F.avg((F.col("outdegree") == 0).cast("double")).alias("leaf_share"),
        F.avg("duration").alias("mean_duration"),
        F.stddev_pop("duration").alias("std_duration"),
        # A graph's own names, held while it is counted: distinct counts would copy every row for each of them.
        F.size(F.collect_set("service_name")).alias("n_services"),
        F.size(F.collect_set("operation_name")).alias("n_ops"),
    )


def node_label() -> Column:
    """(service, op) as a JSON array: names may hold any character, and a missing one is not a name."""
    return F.to_json(F.array("service_name", "operation_name"))


def edge_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, edge_label): the node labels of both ends, as a JSON array of the two."""
    at = nodes.select("graph_id", "node_idx", node_label().alias("label"))
    return (
        edges.join(at.select("graph_id", F.col("node_idx").alias("src"), F.col("label").alias("from_label")), ["graph_id", "src"])
        .join(at.select("graph_id", F.col("node_idx").alias("dst"), F.col("label").alias("to_label")), ["graph_id", "dst"])
        .select("graph_id", F.concat(F.lit("["), "from_label", F.lit(","), "to_label", F.lit("]")).alias("edge_label"))
    )


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["graph_id", "src", "dst"])


def resize(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges whose ends fit the graph's new node count (graph_id, new_count)."""
    return edges.join(sizes, "graph_id").filter("src < new_count and dst < new_count").select("graph_id", "src", "dst")


def filter_by_size(graphs: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    if least is not None:
        graphs = graphs.filter(F.col("num_nodes") >= least)
    return graphs if most is None else graphs.filter(F.col("num_nodes") <= most)


def keep_sizes(graphs: DataFrame, tables: list[DataFrame], least: int | None = None, most: int | None = None) -> list[DataFrame]:
    """``tables`` (nodes, edges) without the graphs outside the size range."""
    kept = filter_by_size(graphs, least, most).select("graph_id")
    return [t.join(kept, "graph_id", "left_semi") for t in tables]


def vocabulary_sizes(encoded: DataFrame) -> DataFrame:
    """Largest service and op id plus one; 1 without nodes."""
    return encoded.agg(*[(F.coalesce(F.max(f"{c}_id"), F.lit(0)) + 1).alias(f"num_{n}") for c, n in (("service", "services"), ("op", "operations"))])


def metadata(graphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per system: vocabulary sizes, the vocabularies as name -> id, and graphs per class."""
    maps = []
    for column, short in (("service_name", "service"), ("operation_name", "op")):
        names = nodes.groupBy("system").agg(F.sort_array(F.collect_set(column)).alias("names"))
        maps.append(names.select("system", F.size("names").alias(f"num_{'services' if short == 'service' else 'operations'}"), F.map_from_arrays("names", F.sequence(F.lit(0), F.size("names") - 1)).alias(f"{short}_to_id")))
    classes = graphs.groupBy("system").agg(F.count_if(F.col("label") == 0).alias("normal_graphs"), F.count_if(F.col("label") == 1).alias("abnormal_graphs"))
    return classes.join(maps[0], "system").join(maps[1], "system")


def size_sensitivity(graphs: DataFrame, thresholds: list[int]) -> DataFrame:
    """Per system, corpus and node cap: total, kept, filtered, percent kept."""
    caps = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    return (
        graphs.withColumn("threshold", caps).groupBy("system", "corpus", "threshold")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("num_nodes") <= F.col("threshold")).alias("kept"))
        .withColumn("filtered", F.col("total") - F.col("kept"))
        .withColumn("percent_kept", F.round(100.0 * F.col("kept") / F.col("total"), 6))
    )


def clip_ids(nodes: DataFrame, n_services: int, n_ops: int) -> DataFrame:
    """Ids forced into the vocabulary's range."""

    def clip(name: str, n: int) -> Column:
        return F.least(F.greatest(F.col(name), F.lit(0)), F.lit(n - 1)).alias(name)

    return nodes.select("graph_id", "node_idx", clip("service_id", n_services), clip("op_id", n_ops), "duration")
