"""Labelling traces against fault windows, and ingest summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.ranking import carried, running
from spanforge.sources.shared import materialize

#: A table of at most so many rows, counted, is broadcast.
BROADCAST_ROWS = 400_000


def root_spans(spans: DataFrame) -> DataFrame:
    """One root per (run, trace): the span whose id is the trace id, with its end in seconds."""
    first = Window.partitionBy("source_run", "trace_id").orderBy("timestamp", "span_seq")
    roots = spans.filter(F.col("span_id") == F.col("trace_id")).withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return roots.select("source_run", "trace_id", "timestamp", (F.col("timestamp") + F.col("duration") / 1e6).alias("end_sec"))


def _ancestors(at: str, levels: int) -> Column:
    """The dyadic blocks that hold a position: (level, block) up to ``levels``."""
    return F.expr(f"transform(sequence(0, {levels}), j -> struct(j as level, shiftright({at}, j) as block))")


def _cover(lo: str, hi: str, levels: int) -> Column:
    """The few dyadic blocks that make up the positions lo to hi."""
    left, right = f"shiftright({lo} + shiftleft(1L, j) - 1, j)", f"shiftright({hi} + 1, j)"
    return F.expr(f"""flatten(transform(sequence(0, {levels}), j -> filter(array(
      if({left} < {right} and {left} % 2 = 1, named_struct('level', j, 'block', {left}), null),
      if({left} < {right} and {right} % 2 = 1, named_struct('level', j, 'block', {right} - 1), null)), b -> b is not null)))""")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def label_roots(roots: DataFrame, windows: DataFrame) -> DataFrame:
    """Interval join with the run's fault windows, both ends inclusive; the first listed window wins.

    The ends of a run's windows cut its time into positions: a point at every end, and the
    stretch behind it.  A window is a range of positions; so is a root, which finds its two
    positions in one merge with the points.  The winner of a root is the least of the
    winner at its first position, which the points bring along, and of the windows that
    start later but before its end, which stand in dyadic blocks of positions.  A root is
    two rows however long it is, and no run is one task.  An end that is not a number or
    infinite lies behind everything; without an end there is no overlap.  A root that ends
    before it starts overlaps the windows that hold both its ends.  No window, no overlap:
    (normal, none).
    """
    key, first = ["source_run", "trace_id"], F.struct("fault_idx", "fault")
    listed = materialize(windows.filter("w_end >= w_start").withColumns({c: F.col(c).cast("double") for c in ("w_start", "w_end")}), "windows")
    points = listed.select("source_run", F.explode(F.array("w_start", "w_end")).alias("t")).groupBy("source_run", "t").agg(F.lit(1).alias("n"))
    points = materialize(running(points, ["source_run"], "t", ["n"]).select("source_run", "t", (2 * (F.col("n_upto") - 1)).alias("pos")), "window-points")
    levels = int(points.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0] + 2).bit_length()
    placed = (
        listed.select("source_run", "w_start", "w_end", first.alias("win"))
        .join(points.select("source_run", F.col("t").alias("w_start"), F.col("pos").alias("lo")), ["source_run", "w_start"])
        .join(points.select("source_run", F.col("t").alias("w_end"), F.col("pos").alias("hi")), ["source_run", "w_end"])
    )
    placed = materialize(placed.select("source_run", "win", "lo", "hi"), "window-positions")
    covering = placed.select("source_run", "win", "lo", F.explode(_cover("lo", "hi", levels)).alias("b")).select("source_run", "win", "lo", "b.level", "b.block")
    # Winners by position: of a point, and of the stretch behind it.
    block = ["source_run", "level", "block"]
    best = covering.groupBy(*block).agg(F.min("win").alias("win"))
    each = points.select("source_run", "t", "pos", F.posexplode(F.array(F.col("pos"), F.col("pos") + 1)).alias("behind", "p"))
    each = each.select("source_run", "t", "pos", "behind", F.explode(_ancestors("p", levels)).alias("b")).select("source_run", "t", "pos", "behind", "b.level", "b.block")
    won = each.join(best, block, "left").groupBy("source_run", "t", "pos").agg(
        F.min(F.when(F.col("behind") == 0, F.col("win"))).alias("at"), F.min(F.when(F.col("behind") == 1, F.col("win"))).alias("after")
    )
    # One merge of points and the ends of roots; points come first where times are equal.
    ends = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("timestamp").cast("double").alias("t")), F.struct(F.lit(1).alias("which"), F.col("end_sec").alias("t"))))
    asked = roots.filter("end_sec is not null and timestamp is not null").select(*key, ends.alias("e")).select(*key, "e.which", "e.t")
    point = F.struct("t", "pos", "at", "after")
    both = asked.select(*key, "which", "t", F.lit(1).alias("rank")).unionByName(won.select("source_run", "t", F.lit(0).alias("rank"), point.alias("point")), allowMissingColumns=True)
    seen = carried(both, ["source_run"], ["t", "rank"], "point").filter("rank = 1")
    behind = F.col("point_seen.t") < F.col("t")
    seen = seen.select(*key, "which", F.coalesce(F.col("point_seen.pos") + behind.cast("int"), F.lit(-1)).alias("pos"), F.when(behind, F.col("point_seen.after")).otherwise(F.col("point_seen.at")).alias("win"))
    spans = seen.groupBy(*key).agg(
        F.max(F.when(F.col("which") == 0, F.col("pos"))).alias("lo"), F.max(F.when(F.col("which") == 1, F.col("pos"))).alias("hi"), F.min(F.when(F.col("which") == 0, F.col("win"))).alias("win")
    )
    spans = materialize(spans, "root-positions")
    starts = placed.select("source_run", "win", F.explode(_ancestors("lo", levels)).alias("b")).groupBy("source_run", "b.level", "b.block").agg(F.min("win").alias("win"))
    later = spans.filter("hi > lo").withColumn("from", F.col("lo") + 1)
    later = later.select(*key, F.explode(_cover("from", "hi", levels)).alias("b")).select(*key, "b.level", "b.block")
    # Ends before starts are broken rows; their candidates are the windows over the start.
    backward = spans.filter("hi < lo").select(*key, "hi", F.explode(_ancestors("lo", levels)).alias("b")).select(*key, "hi", "b.level", "b.block")
    found = (
        spans.filter("hi >= lo and win is not null").select(*key, "win")
        .unionByName(later.join(_sized(materialize(starts, "window-starts")), block).select(*key, "win"))
        .unionByName(backward.join(covering.withColumnRenamed("lo", "from"), block).filter("from <= hi").select(*key, "win"))
    )
    hits = found.groupBy(*key).agg(F.min("win").alias("win"))
    fault = F.col("win.fault")
    return roots.join(hits, key, "left").select(
        *key, "timestamp", F.when(F.col("win").isNull(), "normal").otherwise("abnormal").alias("trace_label"), F.coalesce(fault, F.lit("none")).alias("fault_type")
    )


def label_spans(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """Every span with its trace's label; a trace without a root keeps a null label."""
    return spans.join(labels.select("source_run", "trace_id", "trace_label", "fault_type"), ["source_run", "trace_id"], "left")


def without_archived_runs(spans: DataFrame, archived: DataFrame) -> DataFrame:
    """Spans of runs that no archive holds."""
    return spans.join(archived.select("source_run").distinct(), "source_run", "left_anti")


def ingest_summary(labelled: DataFrame) -> DataFrame:
    """Counts per system and fault type, a trace counted once."""
    return labelled.groupBy("system", F.coalesce("fault_type", F.lit("unlabelled")).alias("fault_type")).agg(
        F.count(F.lit(1)).alias("span_rows"),
        F.countDistinct("source_run", "trace_id").alias("traces"),
        F.count_if(F.col("trace_label") == "normal").alias("normal_spans"),
        F.count_if(F.col("trace_label") == "abnormal").alias("abnormal_spans"),
    )


def split_by_label(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normal, abnormal) spans; traces without a root are in neither."""
    return labelled.filter("trace_label = 'normal'"), labelled.filter("trace_label = 'abnormal'")


def trace_value_counts(labelled: DataFrame) -> DataFrame:
    """(system, kind, value, traces): how many traces have each fault type and each source kind."""
    traces = labelled.filter("trace_label is not null").select("system", "source_run", "trace_id", "fault_type", "source_kind").distinct()
    long = traces.select("system", F.expr("stack(2, 'fault_type', fault_type, 'source_kind', source_kind) as (kind, value)"))
    return long.groupBy("system", "kind", "value").agg(F.count(F.lit(1)).alias("traces"))
