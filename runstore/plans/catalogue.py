"""Registered queries of the engine over the driver's tables, with SQL for the same rows.

The op log is ``events``: seq = event_id, key = user_id, 'error' events delete, a run is 1,000 events. Queries named
``table_…`` go through a ``KeyedTable`` that they write, flush, merge or reopen; ``binary_…`` through the binary layouts;
``stream_…`` through a streaming query.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..functions import bloom
from ..operators import metrics, resolve
from ..schema import Options
from ..sources import formats
from ..streaming.upsert import latest_stream, upsert_stream
from .table import KeyedTable

RUN_SIZE, CAPACITY, THRESHOLD = 1000, 4096, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = F.coalesce(F.col("event_type") == "error", F.lit(False))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.when(~dead, F.col("value")).alias("value"), dead.alias("is_tombstone"), F.expr(f"event_id div {RUN_SIZE}").alias("run_id")
    )


def snapshot_latest(spark, d):
    return resolve.snapshot(log(spark, d)).select("key", "value")


def memtable_entries(spark, d):
    return resolve.latest_per_key(log(spark, d)).select("key", "value", "is_tombstone", "seq")


def memtable_size(spark, d):
    return metrics.size(log(spark, d))


def memtable_usage(spark, d):
    entries = resolve.latest_per_key(log(spark, d))
    full = metrics.is_full(entries, ["key"], CAPACITY)
    return metrics.memory_usage(entries, ["key"], per_entry=8).crossJoin(full)  # one row each


def point_get_hit(spark, d):
    return resolve.get(log(spark, d), 7).select("key", "value")


def point_get_miss(spark, d):
    return resolve.get(log(spark, d), -1).select("key", "value")


def point_get_deleted(spark, d):
    """Three-state lookup of the least deleted key: the tombstone is found, so ``get`` has no row."""
    ops = log(spark, d)
    key = resolve.latest_per_key(ops).filter("is_tombstone").agg(F.min("key")).first()[0]
    found = resolve.lookup(ops, key).select("key", "seq", "is_tombstone")
    return found.join(resolve.get(ops, key).select("key"), "key", "left_anti")


def lookup_states(spark, d):
    """Every customer's key is live, deleted or unknown."""
    return resolve.lookup_many(log(spark, d), customers(spark, d)).select("key", "state")


def customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"))


def multi_get(spark, d):
    wanted = customers(spark, d)
    return resolve.multi_get(log(spark, d), wanted).select("key", "value")


def range_scan(spark, d):
    return resolve.range_scan(log(spark, d), 10, 60).select("key", "value")


def sorted_scan(spark, d):
    return resolve.sorted_scan(resolve.snapshot(log(spark, d))).select("key", "value")


def ordered_search(spark, d):
    """String keys in byte order: k_10 comes before k_2."""
    ops = log(spark, d).withColumn("skey", F.concat(F.lit("k_"), F.col("key").cast("string")))
    live = resolve.snapshot(ops, ["skey"])
    return live.filter((F.col("skey") >= "k_10") & (F.col("skey") < "k_2")).select("skey", "value")


def log_replay(spark, d):
    return log(spark, d).select("seq", "key", "value", "is_tombstone")


def run_flush(spark, d):
    return resolve.latest_per_key(log(spark, d), ["run_id", "key"]).select("run_id", "key", "value", "is_tombstone")


def run_scan(spark, d):
    return resolve.latest_per_key(log(spark, d), ["run_id", "key"]).select("run_id", "key", "value", "is_tombstone")


def run_stats(spark, d):
    stats = metrics.run_stats(run_flush(spark, d), ["key"], [])
    return stats.select("run_id", "num_entries", "min_key", "max_key", "tombstones", "bytes")


def compaction_merge(spark, d):
    runs = resolve.latest_per_key(log(spark, d), ["run_id", "key"])
    return resolve.merge_runs(runs, ["key"], ["run_id"]).select("key", "value")


def partial_compaction(spark, d):
    """Merge of all runs but the oldest: tombstones must stay."""
    runs = resolve.latest_per_key(log(spark, d).filter("run_id > 0"), ["run_id", "key"])
    return resolve.merge_runs(runs, ["key"], ["run_id"], drop_tombstones=False).select("key", "value", "is_tombstone")


def compaction_savings(spark, d):
    runs = resolve.latest_per_key(log(spark, d), ["run_id", "key"])
    newest = resolve.latest_per_key(runs, ["key"], ["run_id"]).agg(F.count("*").alias("keys"), F.sum(F.col("is_tombstone").cast("long")).alias("dropped_tombstones"))
    both = runs.agg(F.count("*").alias("input_rows")).crossJoin(newest)  # one row each
    return both.select("input_rows", (F.col("input_rows") - F.col("keys")).alias("dropped_superseded"), "dropped_tombstones", (F.col("keys") - F.col("dropped_tombstones")).alias("output_rows"))


def layered_get(spark, d):
    """The unflushed tail (the last run's events) over the runs."""
    ops = log(spark, d)
    tail, runs = ops.filter("run_id >= 5"), resolve.latest_per_key(ops.filter("run_id < 5"), ["run_id", "key"])
    return resolve.live(resolve.layered(tail, runs.select(*tail.columns))).select("key", "value")


def should_compact(spark, d):
    n = log(spark, d).agg(F.countDistinct("run_id").alias("n_runs"))
    return n.select("n_runs", (F.col("n_runs") >= THRESHOLD).alias("should_compact"))


def flush_epochs(spark, d):
    ops = log(spark, d).withColumn("payload", F.concat(F.lit("user-"), F.col("key").cast("string")))
    return metrics.flush_epochs(ops, ["payload"], CAPACITY).select("seq", "epoch")


def resurrected_keys(spark, d):
    from pyspark.sql import Window

    before = F.lag("is_tombstone").over(Window.partitionBy("key").orderBy("seq"))
    return log(spark, d).withColumn("was", before).filter("was and not is_tombstone").select("key", "seq")


def orders_upsert(spark, d):
    newest = resolve.latest_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return newest.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")


def remove_physical(spark, d):
    return resolve.remove_physical(table(spark, d, "customer"), gone(spark, d).withColumnRenamed("key", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


def remove_existed(spark, d):
    """What a removal reports: whether the log's entries had the key."""
    return resolve.existed(resolve.latest_per_key(log(spark, d)), gone(spark, d)).select("key", "existed")


def gone(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))


def union_of_runs(spark, d):
    """All versions of runs that are read one by one."""
    ops = log(spark, d)
    low, high = ops.agg(F.min("run_id"), F.max("run_id")).first()
    middle = (low + high) // 2
    runs = [resolve.latest_per_key(ops.filter(p), ["run_id", "key"]) for p in (f"run_id <= {middle}", f"run_id > {middle}")]
    return resolve.union_runs(runs).select("run_id", "key", "value", "is_tombstone")


def bloom_params(spark, d):
    rows = [(n, *bloom.parameters(n, 0.01)) for n in (1, 100, 1000, 10000)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["n", "num_bits", "num_hashes"])).withColumn("num_bytes", F.expr("(num_bits + 7) div 8"))


def part_keys(spark, d, prefix: str = "key_"):
    return table(spark, d, "part").select(F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("key"))


def bloom_fnv(spark, d):
    keys = table(spark, d, "part").select(F.col("p_name").cast("binary").alias("key"), "p_partkey")
    return keys.select("p_partkey", bloom.fnv1a_column(F.col("key")).alias("fnv1a"))


def bloom_murmur(spark, d):
    keys = table(spark, d, "part").select(F.col("p_name").cast("binary").alias("key"), "p_partkey")
    return keys.select("p_partkey", bloom.murmur3_column(F.col("key")).alias("murmur3"))


def bloom_bits(spark, d):
    """The bits that all part keys set."""
    keys = part_keys(spark, d)
    bits, hashes = bloom.parameters(keys.count(), 0.01)
    return bloom.build(keys, "key", bits, hashes)


def bloom_probe(spark, d):
    """All keys that were added, and as many that were not, of which a few may be found."""
    keys = part_keys(spark, d)
    bits, hashes = bloom.parameters(keys.count(), 0.01)
    return bloom.probe(keys.unionByName(part_keys(spark, d, "absent_")), "key", bloom.build(keys, "key", bits, hashes), bits, hashes)


# --- through a table ------------------------------------------------------------------------------------------------

LONGS = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.DoubleType())])


def _table(spark, name: str, **options) -> KeyedTable:
    return KeyedTable.open(spark, scratch.folder(spark, name), LONGS, Options(**options))


def _batches(spark, d, parts: int = 3):
    """The log in batches of rising seq."""
    ops = log(spark, d).select("seq", "key", "value", "is_tombstone")
    low, high = ops.agg(F.min("seq"), F.max("seq")).first()
    edges = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
    return [ops.filter((F.col("seq") >= a) & (F.col("seq") < b)).withColumn("seq", F.col("seq") + 1) for a, b in zip(edges, edges[1:])]


def _flushed(spark, d, name: str, tail: bool = False, **options) -> KeyedTable:
    """The log in a table of three runs, or of two and an unflushed tail."""
    t = _table(spark, name, **({"compaction_threshold": 99, "memtable_capacity": 1 << 40} | options))
    batches = _batches(spark, d)
    for k, ops in enumerate(batches):
        t.apply(ops)
        if not tail or k < len(batches) - 1:
            t.flush()
    return t


def table_put_get(spark, d):
    """Upserts of customers, deletes of suppliers' keys, upserts of some again: what ``multi_get`` finds of all keys."""
    t = _table(spark, "put")
    t.write(customers(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")), "key"))
    t.delete(gone(spark, d))
    t.write(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_regionkey").cast("double").alias("value")))
    return t.multi_get(customers(spark, d)).select("key", "value")


def table_flush_reopen(spark, d):
    """Flushed, closed and opened anew: the snapshot is that of the log."""
    t = _flushed(spark, d, "reopen", tail=True)
    t.close()
    return KeyedTable.open(spark, t.path, LONGS, t.options).snapshot()


def table_entries(spark, d):
    """Runs and tail together, tombstones included."""
    return _flushed(spark, d, "entries", tail=True).entries().select("key", "value", "is_tombstone", (F.col("seq") - 1).alias("seq"))


def table_recover_tail(spark, d):
    """What a handle that opens after a crash replays: all that was not flushed."""
    t = _table(spark, "tail", memtable_capacity=1 << 40)
    for ops in _batches(spark, d):
        t.apply(ops)
    return KeyedTable.open(spark, t.path, LONGS, t.options).replay().select((F.col("seq") - 1).alias("seq"), "key", "value", "is_tombstone")


def table_multi_run_get(spark, d):
    return _flushed(spark, d, "multi", tail=True).multi_get(customers(spark, d))


def table_lookup_states(spark, d):
    return _flushed(spark, d, "states", tail=True).lookup_many(customers(spark, d))


def table_scan(spark, d):
    return _flushed(spark, d, "scan", tail=True).scan()


def table_range(spark, d):
    return _flushed(spark, d, "range", tail=True).range(10, 60)


def table_compact(spark, d):
    """The one run that is left: no tombstones, the newest of each key."""
    t = _flushed(spark, d, "compact")
    return t.run(t.compact().run_id).select("key", "value", "is_tombstone")


def table_partial_compact(spark, d):
    """The newest two runs merged: their tombstones stay, as the oldest run does."""
    t = _flushed(spark, d, "partial")
    merged = t.compact(t.refresh().runs[1:])
    return t.run(merged.run_id).select("key", "value", "is_tombstone")


def table_levels(spark, d):
    """Automatic flushes and merges of two runs of a level at a time."""
    t = _flushed(spark, d, "levels", compaction_threshold=2, memtable_capacity=1)
    return t.snapshot()


def table_run_sizes(spark, d):
    """Entries of each run by the files they lie in, and as the manifest counts them."""
    t = _flushed(spark, d, "sizes")
    rows = metrics.with_provenance(t._read([r.path for r in t.refresh().runs]))
    counted = rows.groupBy(F.regexp_extract("path", "/runs/(\\d+)-", 1).cast("long").alias("run_id")).agg(F.count("*").alias("num_entries"))
    listed = spark.createDataFrame([(r.run_id, r.num_entries) for r in t.manifest.runs], "run_id long, in_manifest long")
    return counted.join(listed, "run_id").select("run_id", "num_entries", "in_manifest")


# --- binary layouts and streams ----------------------------------------------------------------------------------------


def _text(c: str):
    return F.col(c).cast("string")


def binary_log_replay(spark, d):
    """The log written as binary files and read back."""
    where = scratch.folder(spark, "binary-log")
    ops = log(spark, d)
    formats.write_log(ops.select("seq", _text("key").alias("key"), _text("seq").alias("value"), "is_tombstone"), where)
    return formats.read_log(spark, where).select(_text("key").alias("key"), _text("value").alias("value"), "is_tombstone")


def _binary_runs(spark, d) -> str:
    where = scratch.folder(spark, "binary-run")
    entries = resolve.latest_per_key(log(spark, d))
    formats.write_runs(entries.select(_text("key").alias("key"), _text("seq").alias("value"), "is_tombstone"), where)
    return where


def binary_run_scan(spark, d):
    return formats.read_runs(spark, _binary_runs(spark, d)).select(_text("key").alias("key"), _text("value").alias("value"), "is_tombstone")


def binary_run_index(spark, d):
    """Every index entry leads to the record before which all others of its file lie: offsets are sums of record sizes."""
    return formats.read_run_index(spark, _binary_runs(spark, d)).groupBy("path").agg(F.count("*").alias("n"), F.min("offset").alias("low")).agg(F.sum("n").cast("long").alias("entries"), F.max("low").alias("first_offset"))


def binary_run_footers(spark, d):
    """Bits and hashes of every file's filter follow from its number of entries."""
    where = _binary_runs(spark, d)
    n = formats.read_runs(spark, where).groupBy("path").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(1), F.floor(-F.col("n") * F.log(F.lit(0.01)) / F.pow(F.log(F.lit(2.0)), F.lit(2.0))))
    return formats.read_run_footers(spark, where).join(n, "path").filter("n > 0").agg(F.sum("n").cast("long").alias("entries"), F.min(F.col("num_bits") == bits).alias("sized"), F.min(F.octet_length("bloom") == F.ceil(F.col("num_bits") / 8)).alias("whole"))


def binary_run_lookup(spark, d):
    """Nations' keys by bloom filter, index and one record of each file."""
    keys = [str(r[0]).encode() for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 rows at every size
    return formats.lookup_runs(spark, _binary_runs(spark, d), keys).select(_text("key").alias("key"), _text("value").alias("value"), "is_tombstone")


def _stream(spark, d, name: str):
    """The log as files of a stream, out of order."""
    where = scratch.folder(spark, name)
    ops = log(spark, d).select("seq", "key", "value", "is_tombstone").withColumn("seq", F.col("seq") + 1)
    ops.repartition(4, F.pmod("seq", F.lit(7))).write.parquet(where)
    return where, spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 2).parquet(where)


def stream_upsert(spark, d):
    """The log streamed into a table, batches out of order."""
    where, stream = _stream(spark, d, "stream")
    t = _table(spark, "streamed", memtable_capacity=1 << 40)
    upsert_stream(stream, t, f"{where}-checkpoint").awaitTermination()
    return t.snapshot()


def stream_latest(spark, d):
    """A streaming aggregate of the newest version of each key, in complete mode."""
    where, stream = _stream(spark, d, "newest")
    out = f"{where}-out"
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n:06d}")
    q = latest_stream(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{where}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.parquet(f"{out}/{last:06d}").select("key", "value", "is_tombstone", (F.col("seq") - 1).alias("seq"))


_QUERIES = (
    snapshot_latest, memtable_entries, memtable_size, memtable_usage, point_get_hit, point_get_miss, point_get_deleted, multi_get, range_scan, sorted_scan, ordered_search, log_replay,
    run_flush, run_scan, run_stats, compaction_merge, partial_compaction, compaction_savings, layered_get, should_compact, flush_epochs, resurrected_keys, orders_upsert,
    remove_physical, remove_existed, union_of_runs, lookup_states, bloom_params, bloom_fnv, bloom_murmur, bloom_bits, bloom_probe,
    table_put_get, table_flush_reopen, table_entries, table_recover_tail, table_multi_run_get, table_lookup_states, table_scan, table_range, table_compact, table_partial_compact, table_levels, table_run_sizes,
    binary_log_replay, binary_run_scan, binary_run_index, binary_run_footers, binary_run_lookup, stream_upsert, stream_latest,
)

_LOG = f"""log AS (
  SELECT event_id AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
         coalesce(event_type = 'error', false) AS is_tombstone, event_id // {RUN_SIZE} AS run_id FROM events
), latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1
), runs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) AS rr FROM log) WHERE rr = 1
), merged AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC) AS rm FROM runs) WHERE rm = 1
)"""

LIVE = "SELECT key, value FROM latest WHERE NOT is_tombstone"
ENTRIES = "SELECT key, value, is_tombstone, seq FROM latest"
STATES = "SELECT c_custkey AS key, CASE WHEN key IS NULL THEN 'unknown' WHEN is_tombstone THEN 'deleted' ELSE 'live' END AS state FROM customer LEFT JOIN latest ON key = c_custkey"
BINARY = "SELECT key::VARCHAR AS key, CASE WHEN NOT is_tombstone THEN seq::VARCHAR END AS value, is_tombstone FROM latest"
#: The third of the log that a row lies in, by the edges of its batches.
THIRDS = """SELECT log.*, (CASE WHEN seq < low + (high + 1 - low) // 3 THEN 0 WHEN seq < low + (high + 1 - low) * 2 // 3 THEN 1 ELSE 2 END)::BIGINT AS third
  FROM log, (SELECT min(seq) AS low, max(seq) AS high FROM log)"""
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(generate_series(1, strlen({k})), lambda i: ord({k}[i])::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


def _times(a: str, c: int) -> str:
    return f"((({a})::HUGEINT * {c}) % 4294967296)::BIGINT"


def _turn(a: str, n: int) -> str:
    return f"(((({a}) << {n}) | (({a}) >> {32 - n})) & 4294967295)"


def _murmur(k: str) -> str:
    """MurmurHash3 of an ASCII string in SQL: words of four characters, a tail, and the last mixing."""
    word = lambda at, n: f"list_reduce(list_prepend(0::BIGINT, list_reverse(list_transform(generate_series(1, {n}), lambda b: ord({k}[{at} + b])::BIGINT))), lambda x, b: x * 256 + b)"
    mixed = lambda w: _times(_turn(_times(w, bloom.C1), 15), bloom.C2)
    whole = f"(strlen({k}) // 4)"
    words = f"list_transform(generate_series(0, {whole} - 1), lambda i: {mixed(word('4 * i', 4))})"
    body = f"list_reduce(list_prepend(0::BIGINT, {words}), lambda h, w: ({_turn('xor(h, w)', 13)} * 5 + {bloom.N}) & 4294967295)"
    tail = f"CASE WHEN strlen({k}) % 4 > 0 THEN {mixed(word(f'4 * {whole}', f'(strlen({k}) % 4)'))} ELSE 0 END"
    start = f"xor(xor({body}, {tail}), strlen({k})::BIGINT)"
    steps = [_times("xor(h, h >> 16)", bloom.F1), _times("xor(h, h >> 13)", bloom.F2), "xor(h, h >> 16)"]
    return f"list_reduce([{start}, 0, 1, 2], lambda h, s: CASE s WHEN 0 THEN {steps[0]} WHEN 1 THEN {steps[1]} ELSE {steps[2]} END)"


MURMUR = _murmur("k")
ADDED = "SELECT 'key_' || p_partkey AS k FROM part"
PROBED = f"{ADDED} UNION ALL SELECT 'absent_' || p_partkey FROM part"
#: Every key's bits in a filter for as many keys as there are parts.
POSITIONS = f"""SELECT k, (a + unnest(generate_series(0, hashes - 1)) * b) % bits AS position FROM (
  SELECT k, {MURMUR} AS a, {FNV.format(k="k")} AS b, bits, greatest(1, floor(bits / n * ln(2)))::BIGINT AS hashes
  FROM ({{keys}}), (SELECT count(*) AS n, greatest(1, floor(-count(*) * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS bits FROM part))"""

_SQL = {
    "snapshot_latest": "SELECT key, value FROM latest WHERE NOT is_tombstone",
    "memtable_entries": "SELECT key, value, is_tombstone, seq FROM latest",
    "memtable_size": "SELECT count(DISTINCT key) AS n_keys FROM log",
    "memtable_usage": f"SELECT sum(strlen(key::VARCHAR) + 8)::BIGINT AS bytes, sum(strlen(key::VARCHAR)) >= {CAPACITY} AS is_full FROM latest",
    "point_get_hit": "SELECT key, value FROM latest WHERE key = 7 AND NOT is_tombstone",
    "point_get_miss": "SELECT key, value FROM latest WHERE key = -1 AND NOT is_tombstone",
    "point_get_deleted": "SELECT key, seq, is_tombstone FROM latest WHERE key = (SELECT min(key) FROM latest WHERE is_tombstone)",
    "lookup_states": STATES,
    "multi_get": "SELECT key, value FROM latest WHERE NOT is_tombstone AND key IN (SELECT c_custkey FROM customer)",
    "range_scan": "SELECT key, value FROM latest WHERE NOT is_tombstone AND key >= 10 AND key < 60",
    "sorted_scan": "SELECT key, value FROM latest WHERE NOT is_tombstone ORDER BY key",
    "ordered_search": "SELECT 'k_' || key AS skey, value FROM latest WHERE NOT is_tombstone AND 'k_' || key >= 'k_10' AND 'k_' || key < 'k_2'",
    "log_replay": "SELECT seq, key, value, is_tombstone FROM log",
    "run_flush": "SELECT run_id, key, value, is_tombstone FROM runs",
    "run_scan": "SELECT run_id, key, value, is_tombstone FROM runs",
    "run_stats": "SELECT run_id, count(*) AS num_entries, min(key) AS min_key, max(key) AS max_key, sum(is_tombstone::INT)::BIGINT AS tombstones, sum(strlen(key::VARCHAR))::BIGINT AS bytes FROM runs GROUP BY run_id",
    "compaction_merge": "SELECT key, value FROM merged WHERE NOT is_tombstone",
    "partial_compaction": "SELECT key, value, is_tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC) AS rp FROM runs WHERE run_id > 0) WHERE rp = 1",
    "compaction_savings": "SELECT i AS input_rows, i - k AS dropped_superseded, t AS dropped_tombstones, k - t AS output_rows FROM (SELECT count(*) AS i FROM runs), (SELECT count(*) AS k, sum(is_tombstone::INT)::BIGINT AS t FROM merged)",
    "layered_get": "SELECT key, value FROM latest WHERE NOT is_tombstone",
    "should_compact": f"SELECT count(DISTINCT run_id) AS n_runs, count(DISTINCT run_id) >= {THRESHOLD} AS should_compact FROM log",
    "flush_epochs": f"SELECT seq, ((sum(strlen('user-' || key)) OVER (ORDER BY seq) - strlen('user-' || key))::BIGINT // {CAPACITY}) AS epoch FROM log",
    "resurrected_keys": "SELECT key, seq FROM (SELECT *, lag(is_tombstone) OVER (PARTITION BY key ORDER BY seq) AS was FROM log) WHERE was AND NOT is_tombstone",
    "orders_upsert": "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS ro FROM orders) WHERE ro = 1",
    "remove_physical": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "remove_existed": "SELECT s_suppkey AS key, s_suppkey IN (SELECT key FROM log) AS existed FROM supplier",
    "union_of_runs": "SELECT run_id, key, value, is_tombstone FROM runs",
    "bloom_params": "SELECT n, b AS num_bits, greatest(1, floor(b / n * ln(2)))::BIGINT AS num_hashes, (b + 7) // 8 AS num_bytes FROM (SELECT n::BIGINT AS n, greatest(1, floor(-n * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS b FROM (VALUES (1), (100), (1000), (10000)) v(n))",
    "bloom_fnv": f"SELECT p_partkey, {FNV.format(k='p_name')} AS fnv1a FROM part",
    "bloom_murmur": f"SELECT p_partkey, {MURMUR} AS murmur3 FROM (SELECT p_partkey, p_name AS k FROM part)",
    "bloom_bits": f"SELECT DISTINCT position FROM ({POSITIONS.format(keys=ADDED)})",
    "bloom_probe": f"SELECT k AS key, bool_and(position IN (SELECT position FROM ({POSITIONS.format(keys=ADDED)}))) AS may_contain FROM ({POSITIONS.format(keys=PROBED)}) GROUP BY k",
    "table_put_get": """SELECT c_custkey AS key, coalesce(n_regionkey::DOUBLE, c_acctbal) AS value FROM customer LEFT JOIN nation ON n_nationkey = c_custkey
      WHERE n_nationkey IS NOT NULL OR c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "table_flush_reopen": LIVE, "table_scan": LIVE, "table_levels": LIVE, "stream_upsert": LIVE,
    "table_entries": ENTRIES, "stream_latest": ENTRIES,
    "table_recover_tail": "SELECT seq, key, value, is_tombstone FROM log",
    "table_multi_run_get": f"{LIVE} AND key IN (SELECT c_custkey FROM customer)",
    "table_lookup_states": STATES,
    "table_range": f"{LIVE} AND key >= 10 AND key < 60",
    "table_compact": f"SELECT *, false AS is_tombstone FROM ({LIVE})",
    "table_partial_compact": f"SELECT key, value, is_tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM ({THIRDS}) WHERE third > 0) WHERE r = 1",
    "table_run_sizes": f"SELECT third AS run_id, count(DISTINCT key) AS num_entries, count(DISTINCT key) AS in_manifest FROM ({THIRDS}) GROUP BY third",
    "binary_log_replay": "SELECT key::VARCHAR AS key, CASE WHEN NOT is_tombstone THEN seq::VARCHAR END AS value, is_tombstone FROM log",
    "binary_run_scan": BINARY,
    "binary_run_index": "SELECT count(*) AS entries, 0::BIGINT AS first_offset FROM latest",
    "binary_run_footers": "SELECT count(*) AS entries, true AS sized, true AS whole FROM latest",
    "binary_run_lookup": f"SELECT * FROM ({BINARY}) WHERE key IN (SELECT n_nationkey::VARCHAR FROM nation)",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: f"WITH {_LOG}\n{v}" for k, v in _SQL.items()}
