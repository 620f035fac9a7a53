"""Seeded sampling: exact counts, fractions, splits, strata and bootstrap draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.draws import draw, half_even
from spanforge.operators.ranking import hash_rank


def take_count(df: DataFrame, keys: list[str], k: int | Column, seed: int, purpose: str, id_col: str = "graph_id") -> DataFrame:
    """Exactly k rows per key without replacement; all if k >= n, none if k <= 0."""
    limit = F.lit(k) if isinstance(k, int) else k
    return hash_rank(df, keys, draw(seed, purpose, F.col(id_col)), id_col).filter(F.col("rank") <= limit).drop("rank")


def take_fraction(df: DataFrame, keys: list[str], fraction: float, seed: int, purpose: str, id_col: str = "graph_id") -> DataFrame:
    """max(1, int(n * fraction)) rows per key."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    ranked = hash_rank(df, keys, draw(seed, purpose, F.col(id_col)), id_col)
    limit = F.greatest(F.lit(1), (F.col("_size") * F.lit(fraction)).cast("long"))
    return ranked.join(sizes, keys).filter(F.col("rank") <= limit).drop("rank", "_size")


def split(df: DataFrame, keys: list[str], ratio: float, seed: int, purpose: str, id_col: str = "graph_id") -> DataFrame:
    """``df`` plus kept: the first int(n * ratio) per key in draw order, the rest not."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    ranked = hash_rank(df, keys, draw(seed, purpose, F.col(id_col)), id_col).join(sizes, keys)
    return ranked.withColumn("kept", F.col("rank") <= (F.col("_size") * F.lit(ratio)).cast("long")).drop("rank", "_size")


def split_by_class(normal: Column, abnormal: Column, target: Column) -> tuple[Column, Column]:
    """How many of each class make ``target``: in proportion (half to even), room spilling over."""
    ratio = normal / F.nullif(normal + abnormal, F.lit(0)).cast("double")
    first = F.coalesce(F.least(half_even(target * ratio), normal), F.lit(0))
    second = F.least(abnormal, target - first)
    more = F.least(normal - first, target - first - second)
    rest = target - first - second - more
    return first + more, second + F.least(abnormal - second, rest)


def allocate(counts: DataFrame, target: Column) -> DataFrame:
    """(normal, abnormal) pool sizes plus take_normal and take_abnormal."""
    wanted = F.least(target, F.col("normal") + F.col("abnormal"))
    normal, abnormal = split_by_class(F.col("normal"), F.col("abnormal"), wanted)
    return counts.withColumn("take_normal", normal).withColumn("take_abnormal", abnormal)


def proportional_target(graphs: DataFrame, normal_count: int, keys: list[str]) -> DataFrame:
    """Per key: for ``normal_count`` normal graphs the abnormal count in the corpus's proportion, at least 1."""
    n, a = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    ratio = F.coalesce(a / F.nullif(n, F.lit(0)), F.lit(0.0))
    return graphs.groupBy(*keys).agg(F.lit(normal_count).cast("long").alias("normal"), F.greatest(F.lit(1).cast("long"), half_even(F.lit(normal_count) * ratio)).alias("abnormal"))


def draw_counts(graphs: DataFrame, column: str, target: int, seed: int, purpose: str) -> DataFrame:
    """(draw_id, column): ``target`` values of real graphs, without replacement if there are so many, else with."""
    pool = indexed(graphs.withColumn("all", F.lit(0)), ["all"], seed, "graph_id").select("all", "pool", "idx", column)
    ids = graphs.sparkSession.range(target).select(F.col("id").alias("draw_id"), F.lit(0).alias("all"))
    size = pool.groupBy("all").agg(F.first("pool").alias("pool"))
    idx = F.when(F.lit(target) <= F.col("pool"), F.col("draw_id")).otherwise(draw(seed, purpose, F.col("draw_id")) % F.col("pool"))
    return ids.join(F.broadcast(size), "all").withColumn("idx", idx).join(pool.drop("pool"), ["all", "idx"]).select("draw_id", column)


def edge_counts_for(wanted: DataFrame, graphs: DataFrame, seed: int, id_col: str = "gen_id") -> DataFrame:
    """(id, num_edges): for each wanted num_nodes the edge count of a real graph of the nearest observed size."""
    near = nearest_key(wanted, graphs)
    pool = indexed(graphs, ["num_nodes"], seed, "graph_id").select(F.col("num_nodes").alias("nearest_nodes"), "pool", "idx", "num_edges")
    sizes = pool.groupBy("nearest_nodes").agg(F.first("pool").alias("pool"))
    drawn = wanted.join(near, "num_nodes").join(sizes, "nearest_nodes").withColumn("idx", draw(seed, "edges", F.col(id_col)) % F.col("pool"))
    return drawn.join(pool.drop("pool"), ["nearest_nodes", "idx"]).select(id_col, "num_edges")


def size_buckets(graphs: DataFrame, bounds: list[tuple[int, int | None]]) -> DataFrame:
    """Graphs with the index of the size range they fall in; others go."""
    index = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(bounds))):
        inside = F.col("num_nodes") >= lo
        index = F.when(inside if hi is None else inside & (F.col("num_nodes") <= hi), k).otherwise(index)
    return graphs.withColumn("bucket", index).filter("bucket is not null")


def indexed(df: DataFrame, keys: list[str], seed: int, id_col: str) -> DataFrame:
    """``df`` plus a 0-based index per key in draw order, and the key's size."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("pool"))
    return hash_rank(df, keys, draw(seed, "index", F.col(id_col)), id_col).join(sizes, keys).withColumn("idx", F.col("rank") - 1).drop("rank")


def stratified_sizes(graphs: DataFrame, bounds: list[tuple[int, int | None]], target: int, seed: int) -> DataFrame:
    """``target`` bootstrap draws of num_nodes, an equal share per non-empty size range.

    The remainder goes to the first ranges.  (draw_id, bucket, num_nodes).
    """
    pool = indexed(size_buckets(graphs, bounds).withColumn("all", F.lit(0)), ["bucket"], seed, "graph_id")
    shares = pool.groupBy("bucket").agg(F.first("pool").alias("pool"))
    order = Window.orderBy("bucket")  # one row per range
    shares = shares.withColumn("nth", F.row_number().over(order) - 1).withColumn("ranges", F.count(F.lit(1)).over(Window.partitionBy()))
    draws = shares.withColumn("j", F.explode(F.expr(f"sequence(1, cast({target} div ranges + if(nth < {target} % ranges, 1, 0) as int))")))
    draws = draws.withColumn("draw_id", F.concat_ws("-", "bucket", "j")).withColumn("idx", draw(seed, "size", F.col("draw_id")) % F.col("pool"))
    return draws.join(pool.select("bucket", "idx", "num_nodes"), ["bucket", "idx"]).select("draw_id", "bucket", "num_nodes")


def nearest_key(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """For each wanted num_nodes the closest observed one; ties go to the smaller.

    The distinct sizes are at most the node cap, so the range join is by neighbours: the
    nearest key below and the nearest above.
    """
    known = keys.select(F.col("num_nodes").alias("key")).distinct().withColumn("wanted", F.lit(False))
    asked = wanted.select(F.col("num_nodes").alias("key")).distinct().withColumn("wanted", F.lit(True))
    line = known.unionByName(asked)
    order = Window.orderBy("key", "wanted")  # distinct sizes only
    key = F.when(~F.col("wanted"), F.col("key"))
    placed = line.withColumn("below", F.last(key, True).over(order)).withColumn(
        "above", F.first(key, True).over(Window.orderBy("key", F.col("wanted").desc()).rowsBetween(0, Window.unboundedFollowing))
    )
    up, down = F.col("above") - F.col("key"), F.col("key") - F.col("below")
    return placed.filter("wanted").select(
        F.col("key").alias("num_nodes"), F.when(F.col("below").isNull() | (up < down), F.col("above")).otherwise(F.col("below")).alias("nearest_nodes")
    )
