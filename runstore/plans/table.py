"""``KeyedTable``: upserts, deletes, lookups, flush, compaction and recovery of one keyed table.

Batches are the unit of work. An append writes one Parquet log segment and publishes a manifest; a flush resolves the
unflushed tail into a run sorted by key; compaction merges runs of one level into one of the next, so a row is written once
for each level. Every query pins the newest manifest when it starts. Several handles may write: one that loses the race for
a version reads the newest and plans again.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import metrics, resolve
from ..schema import SEQ, TOMBSTONE, Options, check_columns
from .manifest import Conflict, Manifest, Run, Segment, Store


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, options: Options = Options()):
        """``schema`` types the key and value columns."""
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.store, self.compacting = Store(spark, path), False
        self.on_compaction: list[Callable[[str, list[str]], None]] = []
        self.on_flush: list[Callable[[Run], None]] = []
        types = {f.name: f.dataType for f in schema.fields}
        self.schema = T.StructType([
            T.StructField(SEQ, T.LongType()), *[T.StructField(c, types[c]) for c in (*options.keys, *options.values)], T.StructField(TOMBSTONE, T.BooleanType()),
        ])
        self.manifest = self.store.read()

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: T.StructType, options: Options = Options()) -> KeyedTable:
        """Opening runs the compaction policy on what was left behind."""
        table = cls(spark, path, schema, options)
        table.maybe_compact()
        return table

    def __enter__(self) -> KeyedTable:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()

    def close(self) -> None:
        """Flushes the tail."""
        self.flush()

    def refresh(self) -> Manifest:
        """The newest manifest, with what other handles have published."""
        self.manifest = self.store.read(known=self.manifest)
        return self.manifest

    # --- writing ------------------------------------------------------------------------------------------------

    def put(self, key, value) -> None:
        """One upsert; a convenience over ``write``."""
        self._append(self.spark.createDataFrame([(*_tuple(key), *_tuple(value))], self._named([*self.options.keys, *self.options.values])), False, None)

    def remove(self, key) -> None:
        """One delete; keys that were never put may be deleted."""
        self.delete(self.spark.createDataFrame([_tuple(key)], self._named(self.options.keys)))

    def write(self, rows: DataFrame, order_by: str | None = None) -> None:
        """A batch of upserts. Keys must be unique in it, or ``order_by`` tells which row of a key is the last."""
        check_columns(rows, [*self.options.keys, *self.options.values])
        self._append(rows, False, order_by)

    def delete(self, keys: DataFrame) -> None:
        check_columns(keys, self.options.keys)
        self._append(keys.select(*self.options.keys).distinct(), True, None)

    def apply(self, ops: DataFrame, late: bool = False, batch: tuple[str, int] | None = None) -> None:
        """A batch of a change log with its own ``seq`` (unique for a key) and tombstones.

        ``seq`` must be above all written before, or, if ``late`` rows are welcome, above those up to which tombstones may
        have been dropped: such a row could bring a deleted key back. ``batch`` names a stream and the number of its batch,
        which is taken in once only.
        """
        check_columns(ops, self.options.columns)
        seen = lambda m: batch is not None and m.applied.get(batch[0], -1) >= batch[1]
        if seen(self.refresh()):
            return
        low, high, nulls, n, distinct = ops.agg(
            F.min(SEQ), F.max(SEQ), F.sum(F.col(SEQ).isNull().cast("long")), F.count("*"), F.countDistinct(SEQ, *self.options.keys)
        ).first()
        if not n:
            return
        segment = None
        while True:
            m = self.refresh()
            if seen(m) or nulls or distinct != n or low <= (m.dropped_seq if late else m.last_seq):
                if segment:
                    self.store.delete(segment.path)
                if seen(m):
                    return
                raise ValueError("seq must be set, unique for each key and above " + ("those whose tombstones may be gone" if late else "all earlier ones"))
            segment = segment or self._segment(self._shape(ops), high)
            try:
                applied = m.applied | ({batch[0]: batch[1]} if batch else {})
                self._publish(m.with_(last_seq=max(m.last_seq, high), log=(*m.log, segment), applied=applied))
                break
            except Conflict:
                continue
        self.maybe_flush()

    def _append(self, rows: DataFrame, dead: bool, order_by: str | None) -> None:
        if order_by:
            rows = resolve.latest_per_key(rows, self.options.keys, [order_by])
        values = {c: F.lit(None) for c in self.options.values} if dead else {}
        while True:
            m = self.refresh()
            seq = m.last_seq + 1
            segment = self._segment(self._shape(rows.withColumns({**values, SEQ: F.lit(seq), TOMBSTONE: F.lit(dead)})), seq, not order_by and not dead)
            try:
                self._publish(m.with_(last_seq=seq, log=(*m.log, segment)))
                break
            except Conflict:  # written again, with the next number
                self.store.delete(segment.path)
        self.maybe_flush()

    def _shape(self, rows: DataFrame) -> DataFrame:
        """Typed columns in table order; the value of a tombstone is null."""
        def cell(f):
            c = F.col(f.name).cast(f.dataType)
            return (F.when(~F.col(TOMBSTONE), c) if f.name in self.options.values else c).alias(f.name)

        return rows.select(*[cell(f) for f in self.schema.fields])

    def _segment(self, rows: DataFrame, last: int, check_unique: bool = False) -> Segment:
        path = f"{self.path}/log/{last:020d}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        written = self.spark.read.schema(self.schema).parquet(path)
        bad = F.lit(False)
        for k in self.options.keys:
            bad = bad | F.col(k).isNull()
        size = metrics.payload_bytes([*self.options.keys, *self.options.values])
        n, low, total, nulls = written.agg(F.count("*"), F.min(SEQ), F.sum(size), F.sum(bad.cast("long"))).first()
        problem = "null key" if nulls else None
        if not problem and check_unique and written.groupBy(*self.options.keys).count().filter("count > 1").limit(1).count():
            problem = "keys are not unique in the batch; give order_by"
        if problem:
            self.store.delete(path)
            raise ValueError(problem)
        return Segment(last, path, total or 0, n, low or 0)

    # --- reading ------------------------------------------------------------------------------------------------

    def replay(self, after: int | None = None) -> DataFrame:
        """Log records not yet in runs, in the order of ``seq`` once sorted; torn or unpublished files are never seen."""
        rows = self._read([s.path for s in self.refresh().log])
        return rows if after is None else rows.filter(F.col(SEQ) > after)

    def run(self, run_id: int) -> DataFrame:
        """All entries of one run, tombstones included."""
        return self._read([r.path for r in self.refresh().runs if r.run_id == run_id])

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def versions(self, low=None, high=None) -> DataFrame:
        """All versions in runs whose key range meets [low, high], and in the tail."""
        m = self.refresh()
        runs = [r for r in m.runs if r.num_entries and (high is None or r.min_key <= high) and (low is None or r.max_key >= low)]
        return self._read([*(r.path for r in runs), *(s.path for s in m.log)])

    def entries(self) -> DataFrame:
        """The latest version of every key, deleted ones included."""
        return resolve.latest_per_key(self.versions(), self.options.keys)

    def snapshot(self) -> DataFrame:
        """The latest live rows."""
        return self._user(resolve.live(self.entries()))

    def scan(self) -> DataFrame:
        return resolve.sorted_scan(self.snapshot(), self.options.keys)

    def iterate(self, low=None, high=None) -> Iterator[Row]:
        """A forward cursor over live rows in key order, from ``low``: one partition at a time reaches the driver."""
        return resolve.sorted_scan(self.range(low, high), self.options.keys).toLocalIterator()

    def range(self, low=None, high=None) -> DataFrame:
        """Live rows with low <= first key < high."""
        return self._user(resolve.range_scan(self.versions(low, high), low, high, self.options.keys))

    def lookup(self, key) -> DataFrame:
        first = _tuple(key)[0]
        return resolve.lookup(self.versions(first, first), _tuple(key), self.options.keys)

    def get(self, key):
        """The live value (a tuple if there are several value columns), or None."""
        row = resolve.live(self.lookup(key)).first()
        if row is None:
            return None
        values = tuple(row[c] for c in self.options.values)
        return values[0] if len(values) == 1 else values

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Live rows of many keys, from the runs that their range meets."""
        return self._user(resolve.multi_get(self._near(keys), keys, self.options.keys))

    def lookup_many(self, keys: DataFrame) -> DataFrame:
        """The state of every wanted key: live, deleted or unknown."""
        return resolve.lookup_many(self._near(keys), keys, self.options.keys)

    def _near(self, keys: DataFrame) -> DataFrame:
        first = self.options.keys[0]
        low, high = keys.agg(F.min(first), F.max(first)).first()
        return self.versions(low, high) if low is not None else self._read([])

    def create_view(self, name: str) -> None:
        """The snapshot as a temporary view, for SQL."""
        self.snapshot().createOrReplaceTempView(name)

    def _user(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.options.keys, *self.options.values)

    def _named(self, names) -> T.StructType:
        return T.StructType([self.schema[n] for n in names])

    # --- maintenance --------------------------------------------------------------------------------------------

    def tail_bytes(self) -> int:
        """Payload bytes of the unflushed segments, as the manifest has them: what a recovery would replay."""
        return sum(s.bytes for s in self.manifest.log)

    def maybe_flush(self) -> None:
        if self.tail_bytes() >= self.options.memtable_capacity:
            self.flush()

    def flush(self) -> Run | None:
        """The tail becomes a run, tombstones kept; then the log segments leave the manifest."""
        while True:
            m = self.refresh()
            if not m.log:
                return None
            run = self._write_run(self._read([s.path for s in m.log]), sum(s.rows for s in m.log), 0)
            try:
                self._publish(m.with_(next_run=run.run_id + 1, flushed_seq=m.last_seq, log=(), runs=(*m.runs, run)))
                break
            except Conflict:
                self.store.delete(run.path)
        for call in self.on_flush:
            call(run)
        if not self.on_flush:  # else maintenance beside it was told
            self.maybe_compact()
        return run

    def due(self) -> tuple[Run, ...]:
        """Neighbouring runs of one level, as many as the threshold at least, the newest such; none if there are not."""
        runs, end = self.manifest.runs, len(self.manifest.runs)
        while end:
            start = end
            while start and runs[start - 1].level == runs[end - 1].level:
                start -= 1
            if metrics.should_compact(end - start, self.options.compaction_threshold):
                return runs[start:end]
            end = start
        return ()

    def should_compact(self) -> bool:
        return bool(self.due())

    def maybe_compact(self) -> None:
        self.refresh()
        while runs := self.due():
            if self.compact(runs) is None:
                return

    def compact(self, runs: tuple[Run, ...] | None = None) -> Run | None:
        """Neighbouring runs (all by default) become one. On failure nothing changes; runs added meanwhile stay.

        Tombstones go if the oldest run takes part, but for those that something older outside the merge may still need.
        """
        m = self.refresh()
        inputs = m.runs if runs is None else runs
        if not inputs:
            return None
        ids, self.compacting = [r.run_id for r in inputs], True
        try:
            rest = [x.min_seq for x in (*(r for r in m.runs if r.run_id not in ids and r.num_entries), *m.log)]
            droppable = min([*rest, max(r.max_seq for r in inputs) + 1]) if m.runs[0].run_id == ids[0] else None
            run = self._write_run(self._read([r.path for r in inputs]), sum(r.num_entries for r in inputs), max(r.level for r in inputs) + 1, droppable)
            while True:
                now = self.refresh()
                at = next((k for k, r in enumerate(now.runs) if r.run_id == ids[0]), -1)
                late = droppable is not None and any(s.min_seq < droppable for s in now.log) or any(r.min_seq < (droppable or 0) and r.run_id not in ids for r in now.runs if r.num_entries)
                if at < 0 or [r.run_id for r in now.runs[at : at + len(ids)]] != ids or late:
                    self.store.delete(run.path)  # another handle merged them, or took in what a dropped tombstone hid
                    return None
                try:
                    dropped = now.dropped_seq if droppable is None else max(now.dropped_seq, droppable - 1)
                    self._publish(now.with_(next_run=max(now.next_run, run.run_id + 1), dropped_seq=dropped, runs=(*now.runs[:at], run, *now.runs[at + len(ids) :])))
                    break
                except Conflict:
                    continue
        finally:
            self.compacting = False
        for call in self.on_compaction:
            call(run.path, [r.path for r in inputs])
        return run

    def is_compacting(self) -> bool:
        return self.compacting

    def _write_run(self, versions: DataFrame, rows: int, level: int, droppable: int | None = None) -> Run:
        """The newest version of each key, in key order; tombstones below ``droppable`` stay out.

        Versions are dealt by range of key first: that one exchange serves the window as well as the order of the files.
        """
        o, run_id = self.options, max([self.manifest.next_run, *(r.run_id + 1 for r in self.manifest.runs)])
        path, key = f"{self.path}/runs/{run_id:012d}-{uuid.uuid4().hex}", o.keys[0]
        parts = o.run_partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        newest = resolve.latest_per_key(versions.repartitionByRange(parts, *[F.col(k) for k in o.keys]), o.keys)
        if droppable is not None:
            newest = newest.filter(~F.col(TOMBSTONE) | (F.col(SEQ) >= droppable))
        writer = newest.sortWithinPartitions(*o.keys).write
        if o.bloom:  # Parquet sizes the filter of each row group by the expected number of keys
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.fpp#{key}", str(o.bloom_fpp))
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(1, rows // parts * 2)))
        writer.parquet(path)
        n, low, high, least, most = self._read([path]).agg(F.count("*"), F.min(key), F.max(key), F.min(SEQ), F.max(SEQ)).first()
        return Run(run_id, path, n, low, high, most or 0, level, least or 0)

    def _publish(self, m: Manifest) -> None:
        self.manifest = self.store.publish(m)

    def vacuum(self, min_age: float | None = None) -> list[str]:
        """Deletes files and manifests that the last ``retain`` versions do not need; returns what files went.

        Files younger than ``min_age`` seconds stay: a writer may be about to publish them.
        """
        age = self.options.vacuum_age if min_age is None else min_age
        versions = self.store.versions()
        kept = versions[-self.options.retain :]
        named = {p.rsplit("/", 1)[1] for v in kept for m in [self.store.read(v)] for p in [*(r.path for r in m.runs), *(s.path for s in m.log)]}
        fs, gone, before = self.store.fs(), [], (time.time() - age) * 1000
        for folder in ("log", "runs"):
            where = self.store.path(folder)
            for s in fs.listStatus(where) if fs.exists(where) else []:
                if s.getPath().getName() not in named and s.getModificationTime() <= before:
                    gone.append(s.getPath().toString())
                    self.store.delete(gone[-1])
        for v in versions[: -self.options.retain]:
            self.store.delete(f"{self.path}/manifest/v{v:012d}.json")
        return gone


class Maintenance:
    """Compaction beside reads and writes: a thread of the driver that a table's flushes wake."""

    def __init__(self, table: KeyedTable):
        self.table = KeyedTable(table.spark, table.path, T.StructType(table.schema.fields), table.options)
        self.table.on_compaction = table.on_compaction
        self.source, self.error = table, None
        self.wanted, self.stopping, self.idle = threading.Event(), False, threading.Event()
        self.thread = threading.Thread(target=self._loop, daemon=True)

    def start(self) -> Maintenance:
        self.source.on_flush.append(self.notify)
        self.idle.set()
        self.thread.start()
        return self

    def notify(self, _: Run | None = None) -> None:
        self.idle.clear()
        self.wanted.set()

    def _loop(self) -> None:
        while True:
            self.wanted.wait()
            self.wanted.clear()
            try:
                self.table.maybe_compact()
            except Exception as e:  # told to whoever waits
                self.error = e
            if not self.wanted.is_set():
                self.idle.set()
            if self.stopping:
                return

    def wait(self, timeout: float | None = None) -> bool:
        """Whether what was asked for is done; an error of it is raised."""
        done = self.idle.wait(timeout)
        if self.error:
            error, self.error = self.error, None
            raise error
        return done

    def stop(self) -> None:
        self.source.on_flush.remove(self.notify)
        self.stopping = True
        self.notify()
        self.thread.join()


def _tuple(x) -> tuple:
    return x if isinstance(x, tuple) else (x,)
