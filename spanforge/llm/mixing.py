"""Mixing sources to target weights by systematic sampling.

Targets are shared by weight and capped at ``max_repeat`` times a source's size
(water-filling in closed form over the table of sources).  Inside a source every
document has the same expected number of copies, target / size.  Documents are laid
out in an order fixed by their own values, the expected copies are prefix-summed,
one offset per source is added, and a document is emitted once per integer the
running sum crosses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.stage import WORD_PATTERN, hash32, materialize, sized_broadcast

MAX_REPEAT = 3
WEIGHT_CYCLE = (1, 2, 3)
SEED = "mix-1"
#: Rows per run of the layout are about max(RUN_ROWS, sqrt(all rows)): neither the runs
#: nor the table of runs then outgrows a task.
RUN_ROWS = 2048


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets per source from (source, size): source, n_rows, source_size, weight, num, den, target = num / den.

    Sources are ordered by code point, null last, and weigh 1, 2, 3, 1, ...  The
    shares add up to the size of everything.  A source of size 0 gets target 0.
    """
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in WEIGHT_CYCLE])
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = stats.withColumn("weight", F.element_at(cycle, (nth - 1) % len(WEIGHT_CYCLE) + 1)).withColumn(
        "cap", F.col("source_size") * max_repeat
    )
    # cap/weight compared exactly: 6 is a multiple of every weight.
    fill = Window.orderBy(F.expr("cap * (6 div weight)"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.expr("cap * weights_left <= weight * (total - caps_before)"))
        .withColumn("caps", F.coalesce(F.sum(F.expr("if(capped, cap, 0)")).over(everything), F.lit(0)))
        .withColumn("weights", F.coalesce(F.sum(F.expr("if(capped, 0, weight)")).over(everything), F.lit(0)))
    )
    num, den = F.expr("cast(if(capped, cap, weight * (total - caps)) as decimal(20,0))"), F.expr("cast(if(capped, 1, weights) as decimal(20,0))")
    ratio = level.withColumn("num", num).withColumn("den", den)
    return ratio.select("source", "n_rows", "source_size", "weight", "num", "den", (F.col("num").cast("double") / F.col("den").cast("double")).alias("target"))


def copies_by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, copies (plus ``keep``).

    ``copies`` is at most ``MAX_REPEAT``.  Size counts words of the whole text; a null
    text has none.  Null ids and sources are values of their own.  Rows that tie in
    every ordering value are interchangeable.  An empty table gives an empty result.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
            F.col(source_col).alias("source"),
            *[F.col(c).alias(f"kept_{c}") for c in keep],
        ),
        "mix-sizes",
    )
    targets = materialize(source_targets(sized), "mix-targets")
    found = targets.agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows")).first()
    run_rows = max(RUN_ROWS, int((found["rows"] or 0) ** 0.5))
    targets = targets.withColumn("runs", F.expr(f"greatest(1, (n_rows + {run_rows - 1}) div {run_rows})"))

    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    laid = sized.alias("d").join(
        sized_broadcast(targets, found["n"]).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))
    ).select("d.*", "t.source_size", "t.target", "t.num", "t.den", (hash32(key) % F.col("t.runs")).alias("run"))

    # Every other run is laid out backwards, so sizes rise and fall smoothly along the source.
    ride = F.when(F.col("run") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    nth = F.row_number().over(Window.partitionBy("source", "run").orderBy(ride, "doc_id"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        laid.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("source").alias("b_source"), F.col("run").alias("b_run"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    placed = laid.withColumn("nth", nth).join(
        bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("run") == F.col("b_run"))
    )
    offset = hash32(F.concat(F.lit(f"{seed}|offset|"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))))
    # floor(upto * num / (den * size) + offset / 2^32) in whole numbers: no rounding step can give a copy too many.
    whole = placed.withColumn("whole", F.expr("cast(den * source_size as decimal(28,0))")).withColumn("shift", offset).withColumn("upto", (F.col("base") + F.col("nth")).cast("long"))

    def crossed(upto: str) -> str:
        return f"((cast({upto} as decimal(18,0)) * num * 4294967296BD + shift * whole) div (whole * 4294967296BD))"

    copies = F.expr(f"if(source_size = 0, 0, {crossed('upto')} - {crossed('upto - 1')})").cast("long")
    return whole.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), *[F.col(f"kept_{c}") for c in keep])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as it was drawn, columns unchanged.

    Rows that agree in id, text and source are drawn together: one of them stands for
    the copies of all.
    """
    # The caller's columns travel as one, so their names meet none of ours.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = docs.select(F.col(id_col).alias("row_id"), F.col(source_col).alias("row_source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_key"), F.col(text_col).alias("row_text"), row)
    drawn = copies_by_source(whole.drop("row"), "row_id", "row_text", "row_source", seed, keep=("row_key",))
    totals = materialize(
        drawn.groupBy("doc_id", "source", "kept_row_key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0"),
        "mix-copies",
    )
    size = totals.count()

    def with_copies(part: DataFrame) -> DataFrame:
        part = sized_broadcast(part.toDF("m_id", "m_source", "m_key", "m_copies", "m_rows"), size)
        on = (F.col("row_key") == F.col("m_key")) & F.col("row_id").eqNullSafe(F.col("m_id")) & F.col("row_source").eqNullSafe(F.col("m_source"))
        return whole.drop("row_text").join(part, on)

    single = with_copies(totals.filter("rows = 1"))
    several = with_copies(totals.filter("rows > 1")).dropDuplicates(["m_id", "m_source", "m_key"])
    each = single.unionByName(several).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m_copies"))).alias("nth"))
    return each.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
