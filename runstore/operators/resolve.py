"""Resolution of an ordered log: which version of each key is the latest, and whether it lives.

All functions are lazy. ``row_number() = 1`` is planned with a partial group limit before the shuffle, so only one
row per key and task travels; filters on keys are pushed below it and into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEQ, TOMBSTONE


def latest_per_key(ops: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[Column | str] | None = None) -> DataFrame:
    """The newest version of every key, tombstones kept. ``order`` lists columns, the greatest first (default: seq)."""
    by = [F.col(o).desc() if isinstance(o, str) else o for o in (order or [SEQ])]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return ops.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def live(resolved: DataFrame) -> DataFrame:
    """Without deleted keys. Only ever applied after resolution: the other way round deleted keys would come back."""
    return resolved.filter(~F.col(TOMBSTONE))


def snapshot(ops: DataFrame, keys: Sequence[str] = ("key",), order=None) -> DataFrame:
    """The latest live version of every key."""
    return live(latest_per_key(ops, keys, order))


def lookup(ops: DataFrame, key, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Three-state lookup: no row (unknown), a tombstone row, or the live row."""
    values = key if isinstance(key, tuple) else (key,)
    if len(values) != len(keys):
        raise ValueError("one value for each key column is needed")
    match = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(keys, values)])
    return ops.filter(match).orderBy(F.col(SEQ).desc()).limit(1)


def get(ops: DataFrame, key, keys: Sequence[str] = ("key",)) -> DataFrame:
    """The live row of one key, if any: the newest version is found first, then dropped if deleted."""
    return live(lookup(ops, key, keys))


def multi_get(ops: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """The live rows of all keys in ``wanted``; the semi-join runs before resolution, so other keys are never shuffled for it."""
    return snapshot(ops.join(wanted.select(*keys).distinct(), list(keys), "left_semi"), keys)


def lookup_many(ops: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Every wanted key with its ``state``: live, deleted or unknown."""
    want = wanted.select(*keys).distinct()
    newest = latest_per_key(ops.join(want, list(keys), "left_semi"), keys).select(*keys, TOMBSTONE)
    state = F.when(F.col(TOMBSTONE).isNull(), "unknown").when(F.col(TOMBSTONE), "deleted").otherwise("live")
    return want.join(newest, list(keys), "left").select(*keys, state.alias("state"))


def sorted_scan(resolved: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Rows in key order (bytes compare unsigned)."""
    return resolved.orderBy(*keys)


def range_scan(ops: DataFrame, low=None, high=None, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Live rows with low <= first key < high. An extension."""
    first, rows = F.col(keys[0]), ops
    if low is not None:
        rows = rows.filter(first >= F.lit(low))
    if high is not None:
        rows = rows.filter(first < F.lit(high))
    return snapshot(rows, keys)


def union_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """All versions of several runs."""
    if not runs:
        raise ValueError("no runs")
    return reduce(DataFrame.unionByName, runs)


def merge_runs(versions: DataFrame, keys: Sequence[str] = ("key",), order=None, drop_tombstones: bool = True) -> DataFrame:
    """Merge of runs to the newest version per key. Tombstones may go only if the oldest run takes part."""
    newest = latest_per_key(versions, keys, order)
    return live(newest) if drop_tombstones else newest


def remove_physical(rows: DataFrame, gone: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Rows whose key is not in ``gone``: removal without a tombstone."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def existed(rows: DataFrame, gone: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Every key of ``gone`` and whether ``rows`` had it, as a physical removal reports."""
    have = rows.select(*keys).distinct().withColumn("existed", F.lit(True))
    return gone.select(*keys).distinct().join(have, list(keys), "left").select(*keys, F.coalesce("existed", F.lit(False)).alias("existed"))


def layered(tail: DataFrame, runs: DataFrame | None, keys: Sequence[str] = ("key",), order=None) -> DataFrame:
    """Latest per key over the unflushed tail and the runs."""
    return latest_per_key(tail if runs is None else tail.unionByName(runs), keys, order)
