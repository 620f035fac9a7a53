"""Classification metrics, weights and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.ranking import running


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion_report(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """tn, fp, fn, tp, accuracy, per-class and support-weighted P/R/F1, false-alarm rate."""
    y, p = F.col("y"), F.col("pred")
    cells = predictions.groupBy(*keys).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    return derived_metrics(cells)


def derived_metrics(cells: DataFrame) -> DataFrame:
    """Metrics from tn, fp, fn, tp columns."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = cells
    for name, hit, wrong, missed in (("normal", tn, fn, fp), ("abnormal", tp, fp, fn)):
        out = out.withColumn(f"{name}_precision", _ratio(hit, hit + wrong)).withColumn(f"{name}_recall", _ratio(hit, hit + missed))
        pr, rc = F.col(f"{name}_precision"), F.col(f"{name}_recall")
        out = out.withColumn(f"{name}_f1", _ratio(2 * pr * rc, pr + rc))
    n, a = tn + fp, tp + fn
    for m in ("precision", "recall", "f1"):
        out = out.withColumn(f"weighted_{m}", _ratio(F.col(f"normal_{m}") * n + F.col(f"abnormal_{m}") * a, n + a))
    return out.withColumn("accuracy", _ratio(tn + tp, n + a)).withColumn("false_alarm_rate", _ratio(fp, n))


def average_precision(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over distinct scores, descending, of recall gain times precision; 0 without positives."""
    by_score = predictions.groupBy(*keys, (-F.col("score")).alias("down")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    totals = by_score.groupBy(*keys).agg(F.sum("pos").alias("all_pos"))
    steps = running(by_score, keys, "down", ["pos", "n"]).join(totals, keys)
    gain = _ratio(F.col("pos"), F.col("all_pos")) * F.col("pos_upto") / F.col("n_upto")
    return steps.groupBy(*keys).agg(F.sum(gain).alias("average_precision"))


def aggregate_seeds(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Runs, and mean and sample deviation (0 under two) of each metric; blanks are skipped."""
    aggs = [F.count(F.lit(1)).alias("runs")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_sd")]
    return results.groupBy(*keys).agg(*aggs)


def latest(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return results.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def pivot_metrics(results: DataFrame, row: str, column: str, values: list[str], metrics: list[str]) -> DataFrame:
    """Rows ``row``, columns ``column`` x metric."""
    return results.groupBy(row).pivot(column, values).agg(*[F.avg(m).alias(m) for m in metrics])


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """total / count per class, divided by the mean over classes."""
    counts = labels.groupBy(label).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per class
    raw = F.sum("n").over(everything) / F.col("n")
    return counts.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.avg("raw").over(everything)).select(label, "n", "weight")


def label_weights(nodes: DataFrame, id_col: str) -> DataFrame:
    """Inverse-frequency weights over 0..max id (missing: 1), mean 1, capped at five lower medians."""
    counts = nodes.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    spine = counts.agg(F.explode(F.sequence(F.lit(0), F.max(id_col).cast("int"))).alias(id_col))
    full = spine.join(counts, id_col, "left")
    everything = Window.partitionBy()  # the vocabulary
    raw = F.coalesce(F.sum("n").over(everything) / F.col("n"), F.lit(1.0))
    mean = full.withColumn("raw", raw).withColumn("scaled", F.col("raw") / F.avg("raw").over(everything))
    median = mean.agg(F.expr("percentile_disc(0.5) within group (order by scaled)").alias("median"))
    return mean.crossJoin(F.broadcast(median)).select(id_col, F.coalesce("n", F.lit(0)).alias("n"), F.least("scaled", 5 * F.col("median")).alias("weight"))


def duration_stats(nodes: DataFrame) -> DataFrame:
    """Mean and sample deviation of log1p duration; deviation 0 becomes 1."""
    x = F.log1p(F.greatest("duration", F.lit(0.0)))
    sd = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    return nodes.agg(F.avg(x).alias("log_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("log_sd"))


def duration_clip(nodes: DataFrame, keys: list[str], share: float = 0.99) -> DataFrame:
    """Upper clip of log1p duration: the linear quantile at ``share``, from counted values."""
    x = nodes.filter("duration is not null").select(*keys, F.log1p(F.greatest("duration", F.lit(0.0))).alias("x"))
    counted = x.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("times"))
    sizes = counted.groupBy(*keys).agg(F.sum("times").alias("n"))
    steps = running(counted, keys, "x", ["times"]).join(sizes, keys)
    at = F.lit(share) * (F.col("n") - 1)
    lower = F.floor(at)

    def value(place):
        return F.min(F.when(F.col("times_upto") > place, F.col("x")))

    out = steps.groupBy(*keys).agg(value(lower).alias("low"), value(lower + 1).alias("high"), F.first("n").alias("n"), F.first(at - lower).alias("part"))
    clip = F.col("low") + F.col("part") * (F.coalesce("high", "low") - F.col("low"))
    return out.select(*keys, clip.alias("log_clip"), "n")


def corpus_bounds(stats: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Least and greatest node and edge counts and durations of a corpus."""
    a = stats.groupBy(*keys).agg(F.min("node_count").alias("min_nodes"), F.max("node_count").alias("max_nodes"), F.min("edge_count").alias("min_edges"), F.max("edge_count").alias("max_edges"))
    b = nodes.groupBy(*keys).agg(F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"))
    return a.join(b, keys)


def reconstruction(observed_nodes: DataFrame, predicted_nodes: DataFrame, observed_edges: DataFrame, predicted_edges: DataFrame, directed: bool = True) -> DataFrame:
    """Service and op accuracy, log-duration error, edge precision, recall and F1."""
    at = ["graph_id", "node_idx"]
    p = predicted_nodes.select(*at, F.col("service_name").alias("ps"), F.col("operation_name").alias("po"), F.col("duration").alias("pd"))
    node = observed_nodes.join(p, at).agg(
        F.avg((F.col("service_name") == F.col("ps")).cast("double")).alias("service_accuracy"),
        F.avg((F.col("operation_name") == F.col("po")).cast("double")).alias("op_accuracy"),
        F.avg(F.abs(F.log1p(F.greatest("duration", F.lit(0.0))) - F.log1p(F.greatest("pd", F.lit(0.0))))).alias("log_duration_mae"),
    )

    def ends(e: DataFrame) -> DataFrame:
        e = e.filter("src <> dst")
        if directed:
            return e.select("graph_id", "src", "dst").distinct()
        return e.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    o, q = ends(observed_edges).withColumn("o", F.lit(1)), ends(predicted_edges).withColumn("q", F.lit(1))
    edge = o.join(q, ["graph_id", "src", "dst"], "full").agg(
        F.count_if(F.col("o").isNotNull() & F.col("q").isNotNull()).alias("tp"), F.count_if(F.col("o").isNull()).alias("fp"), F.count_if(F.col("q").isNull()).alias("fn")
    )
    edge = edge.withColumn("edge_precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("edge_recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    pr, rc = F.col("edge_precision"), F.col("edge_recall")
    return node.crossJoin(edge.withColumn("edge_f1", _ratio(2 * pr * rc, pr + rc)))
