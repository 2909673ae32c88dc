"""Names, options and validation shared by the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SEQ = "seq"
TOMBSTONE = "is_tombstone"


@dataclass(frozen=True)
class Options:
    """``keys`` and ``values`` name the columns; sizes decide when a tail is flushed and runs are merged."""

    keys: tuple[str, ...] = ("key",)
    values: tuple[str, ...] = ("value",)
    memtable_capacity: int = 4 * 1024 * 1024  # payload bytes of the unflushed log
    compaction_threshold: int = 4  # runs of one level that are merged into one of the next
    bloom: bool = True
    bloom_fpp: float = 0.01
    run_partitions: int | None = None  # default: spark.sql.shuffle.partitions
    retain: int = field(default=2)  # manifest versions whose files ``vacuum`` keeps
    vacuum_age: float = 3600.0  # seconds that a file nobody names yet is left alone

    def __post_init__(self):
        if self.compaction_threshold < 2:
            raise ValueError("compaction_threshold must be at least 2")
        if self.memtable_capacity < 1:
            raise ValueError("memtable_capacity must be positive")
        if not self.keys or set(self.keys) & {SEQ, TOMBSTONE} or set(self.values) & {SEQ, TOMBSTONE}:
            raise ValueError(f"keys are needed, and {SEQ} and {TOMBSTONE} are reserved names")

    @property
    def columns(self) -> list[str]:
        return [SEQ, *self.keys, *self.values, TOMBSTONE]


def check_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
