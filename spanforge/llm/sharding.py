"""Contiguous byte-balanced shards from global prefix sums (DataFrame operations only).

Rows are range-partitioned by (text checksum, id), so equal texts are neighbours
while a text that a third of all rows share is still split by id.  Each partition
contributes one total; the running sum of those few totals gives every partition
its global start, a window inside the partition gives every row its own, and the
byte axis is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.stage import materialize

ROW_OVERHEAD = 16


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_overhead: int = ROW_OVERHEAD
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes and checksum 0 and still costs ``row_overhead``.  A null
    id is kept.  Repeated rows get slots of their own.  A row belongs to the shard
    its middle byte falls in, so shard sizes differ by at most about one document; a
    document longer than a shard takes the shard of its middle and may leave
    neighbours empty.  An empty table gives an empty result.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(row_overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        rows.repartitionByRange(parts, "text_crc32", "doc_id").withColumn("part", F.spark_partition_id()), "shard-parts"
    )

    # One row per partition: a window over all of them is a window over that few rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        placed.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_base"),
            F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("part").orderBy("text_crc32", "doc_id", "size")
    running = placed.select(
        "*",
        F.row_number().over(inside).alias("nth"),
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    sharded = running.join(F.broadcast(totals), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.lit(n_shards - 1), F.expr(f"({n_shards} * (2 * (byte_base + upto) - size)) div (2 * all_bytes)")).cast("int").alias("shard"),
        (F.col("row_base") + F.col("nth") - 1).alias("rank"),
    )
    firsts = sharded.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
