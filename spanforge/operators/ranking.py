"""Exact ranks and running sums without one task per group.

All work in two levels: rows fall into ranges of the ordering key, totals of the ranges
give every range its start, and a window inside the range does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.sources.shared import materialize

HASH_BUCKET = 1 << 16
#: Rows of one range, about: there are as many ranges as the rows ask for.
RANGE_ROWS = 1 << 20


def hash_rank(df: DataFrame, keys: list[str], h: Column, tie: str, name: str = "rank") -> DataFrame:
    """``df`` plus the 1-based rank by (h, tie) inside ``keys``; h is a 32-bit hash."""
    rows = df.withColumn("_h", h).withColumn("_bucket", F.expr(f"_h div {HASH_BUCKET}"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_h", tie))
    return rows.withColumn("_nth", inside).join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_start") + F.col("_nth")).drop("_h", "_bucket", "_nth", "_start")


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, written once, with the number ``_range`` of the range of ``order`` they fall in."""
    rows = materialize(rows, "ranked")
    ranges = -(-rows.count() // RANGE_ROWS)
    if ranges <= 1:
        return rows.withColumn("_range", F.lit(0))
    return materialize(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(counts: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counts`` (distinct values per key) plus ``<s>_upto`` for each sum and ``next_value``."""
    rows = in_ranges(counts, [*keys, value])
    order = Window.partitionBy(*keys).orderBy("_range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_range").agg(F.min(value).alias("_min"), *[F.sum(s).alias(f"_{s}") for s in sums])
    totals = totals.select(
        *keys, "_range", F.lead("_min").over(order).alias("_next"), *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}") for s in sums]
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{s}_in": F.sum(s).over(upto) for s in sums} | {"_lead": F.lead(value).over(inside)})
    out = rows.join(totals, [*keys, "_range"])
    out = out.withColumns({f"{s}_upto": F.col(f"{s}_in") + F.col(f"_{s}") for s in sums} | {"next_value": F.coalesce("_lead", "_next")})
    return out.drop("_range", "_lead", "_next", *[f"_{s}" for s in sums], *[f"{s}_in" for s in sums])


def carried(rows: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """``rows`` plus ``<column>_seen``: the last ``column`` that is not null at or before each row in ``order`` within ``keys``."""
    rows = in_ranges(rows, [*keys, *order])
    known = F.col(column).isNotNull()
    ends = rows.groupBy(*keys, "_range").agg(F.max_by(F.when(known, F.col(column)), F.when(known, F.struct(*order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_range", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_inside", F.last(column, ignorenulls=True).over(inside)).join(ends, [*keys, "_range"])
    return out.withColumn(f"{column}_seen", F.coalesce("_inside", "_carried")).drop("_range", "_inside", "_carried")
