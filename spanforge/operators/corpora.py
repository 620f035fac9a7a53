"""Mixing real and synthetic corpora for training, and assigning roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.draws import draw, half_even
from spanforge.operators.graphs import distinct_edges, filter_by_size
from spanforge.operators.ranking import hash_rank
from spanforge.operators.sampling import split, split_by_class, take_count, take_fraction
from spanforge.sources.shared import materialize


@dataclass(frozen=True)
class Recipe:
    """How corpora become training, validation and test graphs."""

    seed: int = 42
    #: Graphs with fewer nodes go before anything is counted.
    min_nodes: int = 1
    #: At most so many synthetic graphs of each label.
    max_synth_per_class: int | None = None
    synth_val: float = 0.2
    real_holdout: float = 0.2
    real_val: float = 0.1
    test_fraction: float = 1.0
    #: Share of real graphs that train where no percentage is asked for; the rest test.
    real_train_ratio: float = 0.1


def label_by_corpus(graphs: DataFrame, label: int) -> DataFrame:
    """Graphs of one class file: the label is what the corpus says, whatever the rows say."""
    return graphs.withColumn("label", F.lit(label))


def mix_targets(pools: DataFrame, percents: list[int]) -> DataFrame:
    """(synth_pool, real_pool) -> per real percentage: total, train_real, train_synth.

    total = int(min(synth / (s/100), real / (r/100))); each side is rounded half to even.
    0 takes all synthetic and no real, 100 all real and no synthetic.
    """
    if any(not 0 <= p <= 100 for p in percents):
        raise ValueError("real percentages lie between 0 and 100")
    # The double arithmetic keeps its order: the rounding of published totals hangs on it.
    r = F.col("percent").cast("double")
    s = 100.0 - r
    mixed = F.least(F.col("synth_pool") / F.nullif(s / 100.0, F.lit(0.0)), F.col("real_pool") / F.nullif(r / 100.0, F.lit(0.0))).cast("long")
    rows = pools.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    none, full = F.col("percent") == 0, F.col("percent") == 100
    total = F.when(none, F.col("synth_pool")).when(full, F.col("real_pool")).otherwise(mixed)
    rows = rows.withColumn("total", total)
    real = F.when(none, F.lit(0)).when(full, F.col("real_pool")).otherwise(F.least(half_even(F.col("total") * r / 100.0), F.col("real_pool")))
    synth = F.when(full, F.lit(0)).when(none, F.col("synth_pool")).otherwise(F.least(half_even(F.col("total") * s / 100.0), F.col("synth_pool")))
    return rows.withColumn("train_real", real.cast("long")).withColumn("train_synth", synth.cast("long"))


def assign_pools(graphs: DataFrame, recipe: Recipe, by_percent: bool = True) -> DataFrame:
    """Graphs (graph_id, corpus, label, num_nodes) plus pool: train, val or test, drawn per corpus and label.

    Synthetic graphs give a validation share.  Real ones give a held-out test share and,
    of the rest, a validation share; without percentages a plain training share, the rest tests.
    """
    if recipe.min_nodes > 1:
        graphs = filter_by_size(graphs, least=recipe.min_nodes)
    graphs = materialize(graphs, "corpora-graphs")
    synth, real = graphs.filter("corpus = 'B'"), graphs.filter("corpus = 'A'")
    if recipe.max_synth_per_class is not None:
        synth = take_count(synth, ["label"], recipe.max_synth_per_class, recipe.seed, "cap")

    def pooled(df: DataFrame, ratio: float, purpose: str, seed: int, rest: str) -> DataFrame:
        return split(df, ["label"], ratio, seed, purpose).withColumn("pool", F.when(F.col("kept"), "train").otherwise(rest)).drop("kept")

    synth = pooled(synth, 1.0 - recipe.synth_val, "synth-val", recipe.seed, "val")
    real = pooled(real, 1.0 - recipe.real_holdout if by_percent else recipe.real_train_ratio, "holdout", recipe.seed, "test")
    real = materialize(real, "corpora-real")
    test, rest = real.filter("pool = 'test'"), real.filter("pool = 'train'")
    if by_percent:
        rest = pooled(rest.drop("pool"), 1.0 - recipe.real_val, "real-val", recipe.seed + 1, "val")
    if recipe.test_fraction < 1:
        test = take_fraction(test, ["label"], recipe.test_fraction, recipe.seed, "test") if recipe.test_fraction > 0 else test.limit(0)
    return synth.unionByName(rest).unionByName(test)


def _targets(pools: DataFrame, percents: list[int]) -> DataFrame:
    """One row per percentage: how many graphs of each corpus and label train and validate."""

    def n(corpus: str, pool: str, label: int) -> Column:
        return F.count_if((F.col("corpus") == corpus) & (F.col("pool") == pool) & (F.col("label") == label))

    names = {f"{c}{p}{label}": n(c, p, label) for c in "AB" for p in ("train", "val") for label in (0, 1)}
    counted = pools.agg(*[c.alias(k) for k, c in names.items()])
    sums = counted.withColumn("synth_pool", F.col("Btrain0") + F.col("Btrain1")).withColumn("real_pool", F.col("Atrain0") + F.col("Atrain1"))
    rows = mix_targets(sums, percents)
    r = F.col("percent").cast("double")
    wanted = half_even((F.col("Bval0") + F.col("Bval1")) * r / F.nullif(100.0 - r, F.lit(0.0)))
    val_real = F.when(F.col("percent") == 0, F.lit(0)).when(F.col("percent") == 100, F.col("Aval0") + F.col("Aval1")).otherwise(wanted)
    shares = {"Atrain": F.col("train_real"), "Btrain": F.col("train_synth"), "Aval": val_real}
    for part, target in shares.items():
        normal, abnormal = split_by_class(F.col(f"{part}0"), F.col(f"{part}1"), target)
        rows = rows.withColumn(f"take_{part}0", normal).withColumn(f"take_{part}1", abnormal)
    synth_val = [F.when(F.col("percent") == 100, F.lit(0)).otherwise(F.col(f"Bval{label}")).alias(f"take_Bval{label}") for label in (0, 1)]
    return rows.select("percent", *[f"take_{part}{label}" for part in shares for label in (0, 1)], *synth_val)


def prepare(graphs: DataFrame, percents: list[int], recipe: Recipe = Recipe()) -> DataFrame:
    """(percent, graph_id, corpus, label, num_nodes, role) of the whole sweep in one job.

    Pools are drawn and ranked once; a percentage is a cut of the ranks.  Targets are shared
    between the labels in proportion, room spilling over.  Validation is synthetic at 0 %,
    real at 100 %, and between them all synthetic plus real graphs in proportion.
    """
    pools = materialize(assign_pools(graphs, recipe), "corpora-pools")
    tests = pools.filter("pool = 'test'")
    h = F.when(F.col("pool") == "val", draw(recipe.seed + 99, "mix-val", F.col("graph_id"))).otherwise(draw(recipe.seed, "mix", F.col("graph_id")))
    ranked = hash_rank(pools.filter("pool <> 'test'"), ["corpus", "label", "pool"], h, "graph_id")
    limit = F.lit(0)
    for corpus in "AB":
        for pool in ("train", "val"):
            for label in (0, 1):
                mine = (F.col("corpus") == corpus) & (F.col("pool") == pool) & (F.col("label") == label)
                limit = F.when(mine, F.col(f"take_{corpus}{pool}{label}")).otherwise(limit)
    columns = ["percent", "graph_id", "corpus", "label", "num_nodes", F.col("pool").alias("role")]
    mixed = ranked.crossJoin(F.broadcast(_targets(pools, percents))).filter(F.col("rank") <= limit).select(*columns)
    every = F.explode(F.array(*[F.lit(p) for p in percents]))
    return mixed.unionByName(tests.withColumn("percent", every).select(*columns))


def prepare_plain(graphs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """As ``prepare`` without percentages (percent is null): all synthetic training graphs and
    ``real_train_ratio`` of the real ones train, synthetic graphs validate, the other real ones test."""
    return assign_pools(graphs, recipe, by_percent=False).select(
        F.lit(None).cast("int").alias("percent"), "graph_id", "corpus", "label", "num_nodes", F.col("pool").alias("role")
    )


def split_summary(prepared: DataFrame) -> DataFrame:
    """Thirteen counts per percentage, graphs by role, the validation source, and graphs that are in two roles."""
    classes, sides = {"normal": 0, "abnormal": 1}, {"synth": "B", "real": "A"}
    counts = {
        f"{role}_{name}_{side}": F.count_if((F.col("role") == role) & (F.col("label") == label) & (F.col("corpus") == corpus))
        for role in ("train", "val", "test") for side, corpus in sides.items() for name, label in classes.items() if (role, side) != ("test", "synth")
    }
    for side, corpus in sides.items():
        counts[f"train_{side}_total"] = F.count_if((F.col("role") == "train") & (F.col("corpus") == corpus))
    out = prepared.groupBy("percent").agg(*[c.alias(k) for k, c in counts.items()], (F.count(F.lit(1)) - F.countDistinct("graph_id")).alias("leaked"))
    source = F.when(F.col("percent").isNull() | (F.col("percent") == 0), "synthetic").when(F.col("percent") == 100, "real").otherwise("mixed")
    return out.withColumn("val_source", source)


def prepare_dense(graphs: DataFrame, edges: DataFrame, percents: list[int], recipe: Recipe = Recipe(min_nodes=3)) -> tuple[DataFrame, DataFrame]:
    """The variant for small dense traces: graphs of at least ``min_nodes``, repeated edges once.

    Gives the prepared table and the edges of its graphs.
    """
    prepared = materialize(prepare(graphs, percents, recipe), "corpora-prepared")
    used = prepared.select("graph_id").distinct()
    return prepared, distinct_edges(edges.join(used, "graph_id", "left_semi"))


def filtered_summary(prepared: DataFrame, min_nodes: int) -> DataFrame:
    """Counts per percentage after the size filter: each role, and its labels (all corpora)."""
    kept = F.col("num_nodes") >= min_nodes
    aggs = [F.lit(min_nodes).alias("min_nodes_filter")]
    for role in ("train", "val", "test"):
        aggs.append(F.count_if((F.col("role") == role) & kept).alias(f"{role}_total_after_filter"))
        aggs += [F.count_if((F.col("role") == role) & kept & (F.col("label") == k)).alias(f"{role}_{n}_after_filter") for k, n in enumerate(("normal", "abnormal"))]
    return prepared.groupBy("percent").agg(*aggs)


def check_zero_real(summary: DataFrame) -> None:
    """A 0 % mix trains on no real graph and validates on synthetic ones; no graph is in two roles."""
    if not summary.filter("(percent = 0 and (train_real_total > 0 or val_source <> 'synthetic')) or leaked > 0").isEmpty():
        raise ValueError("training mix leaks real or held-out graphs")
