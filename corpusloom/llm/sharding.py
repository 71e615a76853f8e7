"""Sharding by global byte-size prefix sums.

Rows are put in one global order, every range partition is totalled, and the
running sum of the totals gives each partition the bytes that lie before it.
A row's global byte offset then needs only a running sum inside its own
partition, and equal targets cut the offsets into contiguous shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.storage import materialize

#: Bytes that a row takes besides its text (its id).
ROW_OVERHEAD = 8


def shard_by_bytes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 24,
    partitions: int | None = None,
) -> DataFrame:
    """Contiguous shards of nearly equal bytes, in ascending order of the id.

    Returns one row per input row: id, size (UTF-8 bytes plus 8), text_crc32,
    shard (0 to shards - 1) and slot (gapless from 0 within a shard).

    A row belongs to the shard in which the middle byte of its span lies, so a
    boundary misses its target by at most half a row. Null text has no bytes and
    the checksum of nothing (0); a null id sorts first; repeated rows keep their
    number and get slots of their own; equal ids are ordered by size, checksum
    and place of reading; an empty table gives an empty result. A row longer than
    a shard's target leaves some shards empty. Other columns are ignored.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("read_at"),
    )
    order = ["id", "size", "text_crc32", "read_at"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Only ids, sizes and checksums move. The table is written once, so that the
    # totals and the rows see the same range boundaries.
    ranged = materialize(
        rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "shard-rows"
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per partition: the only data in a single task or a broadcast.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("bytes").over(whole).alias("total"),
    )
    own = Window.partitionBy("part").orderBy(*order)
    running = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(running))
        .withColumn("nth", F.row_number().over(own))
        .join(F.broadcast(bases), "part")
        .withColumn("twice_middle", 2 * (F.col("base_bytes") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast((twice_middle * {int(shards)}) div (2 * total) as int)"))
        .withColumn("row", F.col("base_rows") + F.col("nth") - 1)
        .select("id", "size", "text_crc32", "shard", "row")
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
    )
