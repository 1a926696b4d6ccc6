"""Contiguous shards of near-equal bytes from global prefix sums. DataFrame operations only.

Rows are put in id order by a range partitioning, whose outcome is written once. Each partition
contributes one row of totals (bytes, rows); their running sums, a table as long as the number of
partitions, turn a partition's own running sums into global ones. A row belongs to the shard in
which the middle of its bytes falls, so each cut lies within half a row of its equal target and
every shard is contiguous in id order, whatever the order or skew of the input.

Null text has no bytes (size is the fixed overhead). Null ids sort first; repeated rows are
separate rows of the order. Equal texts get no special treatment: keeping them together would
break the law of equal bytes once they hold more than a shard's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsieve.session import ensure_checkpoint, materialize

#: Fixed bytes that a row costs beside its text.
OVERHEAD = 16


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + F.lit(OVERHEAD)


def shard_by_bytes(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard.

    Only (id, size, checksum) are shuffled, never texts. What is broadcast has one row per
    range partition (totals) or per shard (first rows).
    """
    spark = df.sparkSession
    ensure_checkpoint(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    narrow = df.select(F.col(id_col), row_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    order = [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    dealt = materialize(narrow.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per range partition
    bases = totals.select("part", F.sum("part_bytes").over(Window.partitionBy()).alias("total_bytes"), (F.sum("part_bytes").over(so_far) - F.col("part_bytes")).alias("base_bytes"), (F.sum("part_rows").over(so_far) - F.col("part_rows")).alias("base_rows"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.select("*", (F.sum("size").over(within) - F.col("size")).alias("own_bytes"), (F.count(F.lit(1)).over(within) - 1).alias("own_rows"))
        .join(F.broadcast(bases), "part")
        .withColumn("middle", F.col("base_bytes") + F.col("own_bytes") + F.expr("size div 2"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"middle * {shards} div total_bytes")).cast("int"))
        .withColumn("row", F.col("base_rows") + F.col("own_rows"))
        .select(id_col, "size", "text_crc32", "shard", "row")
    )
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(starts), "shard").select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
