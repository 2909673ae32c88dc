"""Structured Streaming into and over keyed logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolve
from ..plans.table import KeyedTable
from ..schema import SEQ, TOMBSTONE


def upsert_stream(ops: DataFrame, table: KeyedTable, checkpoint: str, trigger: dict | None = None):
    """Writes a streaming change log into ``table``. The manifest holds the last batch, so restarts are exact.

    Rows may arrive in any order: the greatest ``seq`` of a key wins. A batch with rows so old that tombstones newer than
    they may have been dropped stops the query with ``ValueError``; nothing is left out.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table.apply(resolve.latest_per_key(batch, table.options.keys), late=True, batch=(checkpoint, number))

    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_stream(ops: DataFrame, keys=("key",), values=("value",)) -> DataFrame:
    """A streaming aggregate that keeps each key's newest version (update or complete mode); arrival order is irrelevant."""
    newest = F.max_by(F.struct(*values, TOMBSTONE), SEQ).alias("_newest")
    return ops.groupBy(*keys).agg(newest, F.max(SEQ).alias(SEQ)).select(*keys, "_newest.*", SEQ)
