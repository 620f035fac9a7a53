"""How close one corpus is to another: signatures, nearest set similarity, filtering.

Graphs with equal sets are one kind, and only kinds are compared (``operators.nearest``).
The empty set has a token of its own.  Labels are JSON texts of their parts, so names may
hold any character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.nearest import greatest_similarity, reaching
from spanforge.operators.ranking import running
from spanforge.sources.shared import materialize

#: No label looks like this: labels are JSON arrays.
EMPTY = "<empty>"
#: Shares of edge labels and node labels in the combined similarity (fixed values).
WEIGHTS = (0.7, 0.3)


def token_sets(graphs: DataFrame, tokens: DataFrame, token: str) -> DataFrame:
    """(graph_id, token): distinct tokens of every graph, the sentinel for none."""
    return graphs.select("graph_id").join(tokens.select("graph_id", F.col(token).alias("token")).distinct(), "graph_id", "left").select(
        "graph_id", F.coalesce("token", F.lit(EMPTY)).alias("token")
    )


def signatures(graphs: DataFrame, node_labels: DataFrame, edge_labels: DataFrame) -> DataFrame:
    """(graph_id, sig): hash of the sorted node label multiset and the sorted edge label multiset."""

    def bag(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.groupBy("graph_id").agg(F.array_join(F.sort_array(F.collect_list(column)), ",").alias(name))

    empty = F.lit("")
    return (
        graphs.select("graph_id").join(bag(node_labels, "label", "n"), "graph_id", "left").join(bag(edge_labels, "edge_label", "e"), "graph_id", "left")
        .select("graph_id", F.md5(F.concat_ws("#", F.coalesce("n", empty), F.coalesce("e", empty))).alias("sig"))
    )


def _kinds(sets: list[DataFrame]) -> DataFrame:
    """(graph_id, kind, set0, set1, ...) from (graph_id, token) tables: sorted 64-bit token hashes."""
    names = [f"set{k}" for k in range(len(sets))]
    out = None
    for name, s in zip(names, sets):
        packed = s.groupBy("graph_id").agg(F.sort_array(F.collect_set(F.xxhash64("token"))).alias(name))
        out = packed if out is None else out.join(packed, "graph_id")
    return out.withColumn("kind", F.xxhash64(*[x for n in names for x in (F.size(n), n)]))


def _distinct(kinds: DataFrame) -> DataFrame:
    sets = [c for c in kinds.columns if c.startswith("set")]
    return kinds.groupBy("kind").agg(*[F.first(c).alias(c) for c in sets])


def nearest_similarity(synth: list[DataFrame], real: list[DataFrame], weights: tuple[float, ...]) -> DataFrame:
    """(graph_id, nearest): the greatest weighted sum of set similarities to any real graph, 0 without real graphs.

    ``synth`` and ``real`` are lists of (graph_id, token) tables, one for each weight.  Kinds
    that occur on both sides are done at once; the others are searched for by falling bounds.
    """
    s, r = materialize(_kinds(synth), "nearest-synthetic"), materialize(_distinct(_kinds(real)), "nearest-real")
    kinds = _distinct(s)
    same = kinds.join(r.select("kind"), "kind", "left_semi").select("kind", F.lit(float(sum(weights))).alias("nearest"))
    fresh = materialize(kinds.join(r.select("kind"), "kind", "left_anti"), "nearest-fresh")
    nearest = same.unionByName(greatest_similarity(fresh, r, weights))
    return s.select("graph_id", "kind").join(nearest, "kind").select("graph_id", "nearest")


def nearest_jaccard(synth_sets: DataFrame, real_sets: DataFrame) -> DataFrame:
    """(graph_id, nearest): the greatest similarity to any real graph, 0 if nothing is shared."""
    return nearest_similarity([synth_sets], [real_sets], (1.0,))


def combined_similarity(synth: tuple[DataFrame, DataFrame], real: tuple[DataFrame, DataFrame], weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """(graph_id, nearest): max over real of 0.7 J(edge labels) + 0.3 J(node labels); each side is (edge sets, node sets)."""
    return nearest_similarity(list(synth), list(real), weights)


def similar_graphs(synth: tuple[DataFrame, DataFrame], real: tuple[DataFrame, DataFrame], threshold: float, weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """(graph_id,) of synthetic graphs whose combined similarity to some real graph reaches ``threshold``, which is above 0."""
    if threshold <= 0:
        raise ValueError("every graph reaches a threshold of 0")
    s = materialize(_kinds(list(synth)), "similar-synthetic")
    hits = reaching(_distinct(s), materialize(_distinct(_kinds(list(real))), "similar-real"), threshold, weights)
    return s.select("graph_id", "kind").join(hits, "kind", "left_semi").select("graph_id")


def duplicates(synth_sigs: DataFrame, real_sigs: DataFrame) -> DataFrame:
    """(graph_id, sig, exact): whether the signature occurs in the real corpus."""
    real = real_sigs.select("sig").distinct().withColumn("hit", F.lit(True))
    return synth_sigs.join(real, "sig", "left").select("graph_id", "sig", F.coalesce("hit", F.lit(False)).alias("exact"))


def report(dups: DataFrame, nearest: DataFrame, threshold: float) -> DataFrame:
    """One row: unique, exact-duplicate, novel and near-duplicate rates and the mean nearest similarity."""
    rows = dups.join(nearest, "graph_id")

    def rate(x: Column) -> Column:
        return F.coalesce(F.avg(x.cast("double")), F.lit(0.0))

    return rows.agg(
        F.count(F.lit(1)).alias("graphs"),
        F.coalesce(F.countDistinct("sig") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("unique_rate"),
        rate(F.col("exact")).alias("exact_rate"), rate(~F.col("exact")).alias("novel_rate"),
        rate(F.col("nearest") >= threshold).alias("near_rate"), F.coalesce(F.avg("nearest"), F.lit(0.0)).alias("mean_nearest"),
    )


def report_by(graphs: DataFrame, node_labels: DataFrame, edge_labels: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """One row per ``keys`` (system and class, say): graphs of both corpora, unique, duplicate, novel and near rates, mean nearest, and both coverages.

    ``graphs``: graph_id, corpus (A real, B synthetic), keys.  Labels carry their cell, so
    graphs of different cells share nothing and one search serves all.  A cell without
    graphs of one corpus has rates of 0.
    """
    of = materialize(graphs.select("graph_id", "corpus", *keys, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("cell")), "memory-graphs")

    def keyed(labels: DataFrame, column: str) -> DataFrame:
        items = labels.select("graph_id", F.col(column).alias("item")).join(of.select("graph_id", "corpus", "cell"), "graph_id")
        return items.select("graph_id", "corpus", "cell", F.to_json(F.array("cell", "item")).alias("token"))

    items = {"node": materialize(keyed(node_labels, "label"), "memory-nodes"), "edge": materialize(keyed(edge_labels, "edge_label"), "memory-edges")}
    sets = []
    for side in "BA":
        mine = of.filter(F.col("corpus") == side)
        made = items["edge"].filter(F.col("corpus") == side).select("graph_id", "token").distinct()
        sets.append(mine.select("graph_id", "cell").join(made, "graph_id", "left").select("graph_id", F.coalesce("token", F.concat(F.lit(EMPTY), "cell")).alias("token")))
    nearest = nearest_jaccard(*sets)
    sigs = signatures(of, items["node"].withColumnRenamed("token", "label"), items["edge"].withColumnRenamed("token", "edge_label"))
    sigs = sigs.join(of.select("graph_id", "corpus", "cell"), "graph_id").select("graph_id", "corpus", F.md5(F.concat("cell", "sig")).alias("sig"))
    dups = duplicates(sigs.filter("corpus = 'B'"), sigs.filter("corpus = 'A'"))
    synth = F.col("corpus") == "B"
    rows = of.join(dups, "graph_id", "left").join(nearest, "graph_id", "left")
    n = F.nullif(F.count_if(synth), F.lit(0))

    def rate(hits: Column) -> Column:
        return F.coalesce(hits / n, F.lit(0.0))

    out = rows.groupBy("cell").agg(
        *[F.first(k).alias(k) for k in keys], F.count_if(~synth).alias("real_graphs"), F.count_if(synth).alias("synthetic_graphs"),
        rate(F.countDistinct("sig")).alias("unique_rate"), rate(F.count_if("exact")).alias("exact_rate"), rate(F.count_if(~F.col("exact"))).alias("novel_rate"),
        rate(F.count_if(F.col("nearest") >= threshold)).alias("near_rate"), rate(F.sum("nearest")).alias("mean_nearest"),
    )
    for name, table in items.items():
        seen = table.groupBy("cell", "token").agg(F.max((F.col("corpus") == "A").cast("int")).alias("real"), F.max((F.col("corpus") == "B").cast("int")).alias("made"))
        share = seen.filter("real = 1").groupBy("cell").agg(F.avg(F.col("made").cast("double")).alias(f"{name}_coverage"))
        out = out.join(share, "cell", "left").withColumn(f"{name}_coverage", F.coalesce(f"{name}_coverage", F.lit(0.0)))
    return out.drop("cell")


def coverage(synth_items: DataFrame, real_items: DataFrame, item: str) -> DataFrame:
    """Share of distinct real items that the synthetic corpus has."""
    seen = synth_items.select(item).distinct().withColumn("hit", F.lit(1))
    real = real_items.select(item).distinct()
    return real.join(seen, item, "left").agg(
        F.count(F.lit(1)).alias("real_items"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), F.lit(0.0)).alias("coverage")
    )


def valid_mass(synth_nodes: DataFrame, real_nodes: DataFrame) -> DataFrame:
    """Share of synthetic nodes whose (service, op) pair occurs in the real corpus."""
    pairs = real_nodes.select("service_name", "operation_name").distinct().withColumn("hit", F.lit(1))
    return synth_nodes.join(pairs, ["service_name", "operation_name"], "left").agg(
        F.count(F.lit(1)).alias("nodes"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), F.lit(0.0)).alias("valid_mass")
    )


def filter_corpus(dups: DataFrame, similar: DataFrame | None) -> DataFrame:
    """(graph_id, status): exact, near or kept; without ``similar`` graphs only exact ones are told."""
    rows = dups.select("graph_id", "exact")
    near = F.lit(False)
    if similar is not None:
        rows, near = rows.join(similar.select("graph_id", F.lit(True).alias("hit")), "graph_id", "left"), F.coalesce("hit", F.lit(False))
    return rows.select("graph_id", F.when(F.col("exact"), "exact").when(near, "near").otherwise("kept").alias("status"))


def nearest_rank_percentile(values: DataFrame, column: str, share: float, keys: list[str] | None = None) -> DataFrame:
    """Per key the value at 0-based position round-half-even(share * (n - 1)) in ascending order."""
    by = keys or ["all"]
    counted = (values if keys else values.withColumn("all", F.lit(1))).groupBy(*by, column).agg(F.count(F.lit(1)).alias("times"))
    n = counted.groupBy(*by).agg(F.sum("times").alias("n"))
    place = running(counted, by, column, ["times"]).join(n, by)
    out = place.filter(F.col("times_upto") > F.bround(F.lit(share) * (F.col("n") - 1), 0)).groupBy(*by).agg(F.min(column).alias("percentile"))
    return out if keys else out.drop("all")


def filter_report(dups: DataFrame, nearest: DataFrame, threshold: float, exact_only: bool = False) -> DataFrame:
    """Per phase (before, after filtering): graphs, rejected, retention and the duplicate rates of what is there."""
    near = F.lit(False) if exact_only else F.col("nearest") >= threshold
    rows = dups.join(nearest, "graph_id").withColumn("near", near & ~F.col("exact"))
    phases = F.when(F.col("exact") | F.col("near"), F.array(F.lit("before"))).otherwise(F.array(F.lit("before"), F.lit("after")))
    rows = materialize(rows.withColumn("phase", F.explode(phases)), "filter-phases")
    found = rows.groupBy("phase").agg(
        F.count(F.lit(1)).alias("graphs"), F.count_if("exact").alias("exact_graphs"), F.count_if("near").alias("near_graphs"),
        (F.countDistinct("sig") / F.count(F.lit(1))).alias("unique_rate"), F.avg(F.col("exact").cast("double")).alias("exact_rate"),
        F.avg((F.col("nearest") >= threshold).cast("double")).alias("near_rate"), F.avg("nearest").alias("mean_nearest"),
    )
    zero = dups.sparkSession.createDataFrame([("before",), ("after",)], "phase string")
    out = zero.join(found, "phase", "left").join(nearest_rank_percentile(rows, "nearest", 0.95, ["phase"]).withColumnRenamed("percentile", "p95_nearest"), "phase", "left")
    return out.fillna(0).fillna(0.0)
