"""Contiguous shards of near equal bytes from global prefix sums.

Rows are put in id order by one range exchange of slim rows (never of texts). Per-partition totals give each partition
its global offset, a running sum inside the partition gives each row its own, and the shard is the equal target in
which the middle of the row's bytes lies. DataFrame functions only.

Defined results: a null text has size 1 and checksum 0; rows that are alike in id, size and checksum are
interchangeable and each gets its own slot; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _util


def assign(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard`` (0 up to ``n_shards``) and ``slot`` (gapless from 0 in its shard)."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = _util.text_or_empty(text_col)
    slim = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["_id", "text_crc32", "size"]
    count = _util.partitions(docs.sparkSession)
    # Saved, as the bounds of a range exchange are sampled and may differ when planned again.
    placed = _util.save(slim.repartitionByRange(count, *order).withColumn("part", F.spark_partition_id()), "sizes")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    rows = (
        placed.withColumns({
            "_upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "_nth": F.row_number().over(inside).cast("long") - 1,
        })
        .join(F.broadcast(offsets), "part")  # as many rows as shuffle partitions
        .withColumns({"_row": F.col("rows_before") + F.col("_nth")})
        .withColumn("shard", F.expr(f"least({n_shards - 1}, ((bytes_before + _upto) * 2 - size) * {n_shards} div (total * 2))").cast("int"))
    )
    firsts = rows.groupBy("shard").agg(F.min("_row").alias("_first")).withColumnRenamed("shard", "_shard")  # n_shards rows
    return rows.join(F.broadcast(firsts), F.col("shard") == F.col("_shard")).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
