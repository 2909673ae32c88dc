"""Counters and size predicates over logs and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payload_bytes(columns: Sequence[str]) -> Column:
    """Bytes of the columns as text or binary; null counts nothing."""
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return total


def size(ops: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Distinct keys, deleted ones included."""
    return ops.agg(F.countDistinct(*keys).alias("n_keys"))


def memory_usage(entries: DataFrame, columns: Sequence[str], per_entry: int = 0) -> DataFrame:
    """Payload bytes of resolved entries plus a constant for each."""
    return entries.agg(F.coalesce(F.sum(payload_bytes(columns) + per_entry), F.lit(0)).cast("long").alias("bytes"))


def is_full(entries: DataFrame, columns: Sequence[str], capacity: int) -> DataFrame:
    return memory_usage(entries, columns).select((F.col("bytes") >= capacity).alias("is_full"))


def flush_epochs(ops: DataFrame, columns: Sequence[str], capacity: int, order: str = "seq", block: int = 65_536) -> DataFrame:
    """Each row with the number of full buffers before it: the running payload bytes divided by the capacity.

    The running sum is taken in blocks of ``block`` sequence numbers with the blocks' totals added, so no task holds
    the whole log.
    """
    sized = ops.withColumns({"_b": payload_bytes(columns), "_block": F.expr(f"{order} div {block}")})
    totals = sized.groupBy("_block").agg(F.sum("_b").alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    offsets = totals.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("_b").over(inside) - F.col("_b")
    return sized.join(offsets, "_block").withColumn("_upto", upto).withColumn("epoch", F.expr(f"_upto div {capacity}")).drop("_b", "_block", "_before", "_upto")


def run_stats(runs: DataFrame, keys: Sequence[str], values: Sequence[str], run: str = "run_id") -> DataFrame:
    """Entries, key range, tombstones and payload bytes of every run."""
    return runs.groupBy(run).agg(
        F.count("*").alias("num_entries"), F.min(keys[0]).alias("min_key"), F.max(keys[0]).alias("max_key"),
        F.sum(F.col("is_tombstone").cast("long")).alias("tombstones"), F.sum(payload_bytes([*keys, *values])).alias("bytes"),
    )


def should_compact(n_runs: int, threshold: int) -> bool:
    return n_runs >= threshold


def with_provenance(rows: DataFrame) -> DataFrame:
    """Rows read from files, with the path of each."""
    return rows.select("*", F.col("_metadata.file_path").alias("path"))
