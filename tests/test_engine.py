"""Behaviour of keyed tables, logs, runs, compaction, recovery and bloom filters."""

import random
import struct
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runstore.functions import bloom
from runstore.operators import metrics, resolve
from runstore.plans import catalogue
from runstore.plans.manifest import Conflict, Manifest, Run, Segment, dumps, loads
from runstore.plans.table import KeyedTable, Maintenance
from runstore.schema import Options
from runstore.sources import formats

S = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
B = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
OPS = "seq long, key string, value string, is_tombstone boolean"
DATA = Path("/root/testdata/sf0.001")


def ops(spark, rows):
    return spark.createDataFrame([(i, k, v, v is None) for i, (k, v) in enumerate(rows, 1)], OPS)


def as_dict(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_last_write_wins_delete_and_resurrection(spark):
    log = ops(spark, [("alpha", "100"), ("beta", None), ("gamma", "300"), ("alpha", None), ("delta", "400")])
    assert as_dict(resolve.snapshot(log)) == {"gamma": "300", "delta": "400"}
    again = ops(spark, [("k", "1"), ("k", None), ("k", "2")])
    assert as_dict(resolve.snapshot(again)) == {"k": "2"}


def test_tombstones_stay_in_resolved_entries_and_lookup_is_three_state(spark):
    log = ops(spark, [("a", "1"), ("b", "2"), ("a", None)])
    assert {(r["key"], r["is_tombstone"]) for r in resolve.latest_per_key(log).collect()} == {("a", True), ("b", False)}
    assert resolve.lookup(log, "a").first()["is_tombstone"] is True
    assert resolve.lookup(log, "none").count() == 0 and resolve.get(log, "a").count() == 0
    assert resolve.get(log, "b").first()["value"] == "2"


def test_key_order_is_unsigned_bytes(spark):
    keys = [b"\x00", b"\x7f", b"\x80", b"\xff", b"a", b"a\x00", b""]
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    assert [bytes(r["key"]) for r in resolve.sorted_scan(rows).collect()] == sorted(keys)


def test_partial_merge_keeps_tombstones(spark):
    old, new = ops(spark, [("x", "alive"), ("y", "keep")]), spark.createDataFrame([(3, "x", None, True)], OPS)
    partial = resolve.merge_runs(new, drop_tombstones=False)
    assert as_dict(resolve.snapshot(old.unionByName(partial))) == {"y": "keep"}
    assert as_dict(resolve.merge_runs(resolve.union_runs([old, new]))) == {"y": "keep"}


def test_newest_run_wins(spark):
    runs = [ops(spark, [("a", "1"), ("b", "2"), ("c", "3")]), ops(spark, [("b", "20"), ("d", "4")]).withColumn("seq", F.col("seq") + 10), ops(spark, [("c", "30"), ("e", "5")]).withColumn("seq", F.col("seq") + 20)]
    assert as_dict(resolve.merge_runs(resolve.union_runs(runs))) == {"a": "1", "b": "20", "c": "30", "d": "4", "e": "5"}


def test_multi_get_range_and_physical_removal(spark):
    log = ops(spark, [("a", "1"), ("b", "2"), ("c", "3"), ("b", None)])
    wanted = spark.createDataFrame([("a",), ("b",), ("z",)], "key string")
    assert as_dict(resolve.multi_get(log, wanted)) == {"a": "1"}
    assert as_dict(resolve.range_scan(log, "b", "d")) == {"c": "3"}
    assert {r["key"] for r in resolve.remove_physical(log, wanted).collect()} == {"c"}


def test_metrics(spark):
    log = ops(spark, [("a", "1"), ("b", "22"), ("a", None)])
    assert metrics.size(log).first()["n_keys"] == 2
    assert metrics.memory_usage(log, ["key", "value"]).first()["bytes"] == 6
    assert metrics.is_full(log, ["key"], 3).first()["is_full"] and not metrics.should_compact(3, 4)
    epochs = metrics.flush_epochs(log, ["key"], 2, block=2).orderBy("seq").collect()
    assert [r["epoch"] for r in epochs] == [0, 0, 1]


def test_bloom_golden_values():
    assert [bloom.parameters(n, 0.01) for n in (1, 100, 1000, 10000)] == [(9, 6), (958, 6), (9585, 6), (95850, 6)]
    assert [bloom.murmur3_32(k) for k in (b"", b"a", b"abc", b"abcd", b"key_0")] == [0, 1009084850, 3017643002, 1139631978, 1357352656]
    assert [bloom.fnv1a_32(k) for k in (b"", b"a", b"abc")] == [2166136261, 3826002220, 440920331]


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("key_"), F.col("id")).alias("key"))
    absent = spark.range(2000, 4000).select(F.concat(F.lit("key_"), F.col("id")).alias("key"))
    bits, hashes = bloom.parameters(2000, 0.01)
    built = bloom.build(keys, "key", bits, hashes)
    back = bloom.deserialize(spark, bloom.serialize(built, bits))
    assert bloom.probe(keys, "key", back, bits, hashes).filter("not may_contain").count() == 0
    assert bloom.probe(absent, "key", back, bits, hashes).filter("may_contain").count() < 40
    assert spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),)], "k binary").select(bloom.fnv1a_column(F.col("k")).alias("h")).collect() == [(440920331,), (2166136261,)]


def test_formats_round_trip_and_torn_tail(spark, tmp_path):
    records = [(b"good1", b"v1", False), (b"", b"", False), (b"dead", None, True), (b"good3", b"v3", False)]
    data = b"".join(formats.log_bytes(records))
    assert list(formats.parse_log(data)) == records and list(formats.parse_log(data[:-4])) == records[:-1]
    entries = [(f"key_{i:04d}".encode(), None if i % 7 == 0 else b"v", i % 7 == 0) for i in range(100)]
    assert list(formats.parse_run(formats.run_bytes(entries))) == entries and list(formats.parse_run(formats.run_bytes([]))) == []
    with pytest.raises(ValueError):
        formats.run_bytes([(b"k", b"\xff", False)])
    (tmp_path / "wal.log").write_bytes(data[:-1])
    rows = formats.read_log(spark, str(tmp_path / "wal.log")).orderBy("seq").collect()
    assert [(bytes(r["key"]), r["is_tombstone"]) for r in rows] == [(b"good1", False), (b"", False), (b"dead", True)]
    (tmp_path / "a.run").write_bytes(formats.run_bytes(entries))
    assert formats.read_runs(spark, str(tmp_path / "a.run")).filter("is_tombstone").count() == 15


def test_table_reopens_flushes_compacts_and_calls_back(spark, tmp_path):
    calls = []
    with KeyedTable.open(spark, str(tmp_path / "t"), S, Options(compaction_threshold=2)) as t:
        t.on_compaction.append(lambda new, old: calls.append((new, old)))
        t.write(spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "0")], S).withColumn("o", F.when(F.col("value") == "1", 9).otherwise(1)), order_by="o")
        t.remove("never")
        assert t.get("a") == "1" and t.get("never") is None
        t.flush()
        t.remove("a")
        t.put("ff", "")
    assert len(calls) == 1 and len(calls[0][1]) == 2
    again = KeyedTable.open(spark, str(tmp_path / "t"), S)
    assert as_dict(again.scan()) == {"b": "2", "ff": ""} and len(again.manifest.runs) == 1
    assert again.run(again.manifest.runs[0].run_id).filter("is_tombstone").count() == 0
    assert again.vacuum() is not None and as_dict(again.snapshot()) == {"b": "2", "ff": ""}
    assert again.flush() is None and not again.is_compacting()


def test_byte_ff_value_lives(spark, tmp_path):
    t = KeyedTable.open(spark, str(tmp_path / "t"), B)
    t.put(bytearray(b"k"), bytearray(b"\xff"))
    t.flush()
    assert bytes(t.get(bytearray(b"k"))) == b"\xff"


def test_bad_batches_and_options_are_refused(spark, tmp_path):
    t = KeyedTable.open(spark, str(tmp_path / "t"), S)
    with pytest.raises(ValueError):
        t.write(spark.createDataFrame([("a", "1"), ("a", "2")], S))
    with pytest.raises(ValueError):
        t.write(spark.createDataFrame([(None, "1")], S))
    t.apply(ops(spark, [("a", "1")]))
    with pytest.raises(ValueError):
        t.apply(ops(spark, [("a", "2")]))
    assert as_dict(t.snapshot()) == {"a": "1"}
    for bad in ({"compaction_threshold": 1}, {"memtable_capacity": 0}, {"keys": ()}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_run_added_during_compaction_stays(spark, tmp_path):
    t = KeyedTable.open(spark, str(tmp_path / "t"), S, Options(compaction_threshold=9))
    for k in "ab":
        t.put(k, k)
        t.flush()
    write = t._write_run

    def meanwhile(*args):
        run = write(*args)
        t._write_run = write
        other = KeyedTable(spark, str(tmp_path / "t"), S, Options(compaction_threshold=9))
        other.manifest = other.store.read()
        other.put("c", "c")
        return run

    t._write_run = meanwhile
    t.compact()
    assert as_dict(KeyedTable.open(spark, str(tmp_path / "t"), S).snapshot()) == {"a": "a", "b": "b", "c": "c"}
    with pytest.raises(Conflict):
        t.store.publish(Manifest(version=1))


def test_manifest_round_trip():
    import datetime
    from decimal import Decimal

    for low, high in ((b"\x00", b"\xff"), ("a", "z"), (1, 9), (datetime.date(2024, 1, 2), datetime.date(2025, 1, 2)), (datetime.datetime(2024, 1, 2, 3, 4, 5, 6), None), (Decimal("1.50"), Decimal(7)), (1.5, True)):
        m = Manifest(3, 2, 9, 8, 4, (Segment(9, "p", 10, 2, 9),), (Run(1, "q", 4, low, high, 8, 1, 3),), {"s": 4})
        assert loads(dumps(m)) == m


def test_tables_by_dates_timestamps_and_decimals(spark, tmp_path):
    for kind, values in (("date", ["2024-01-01", "2024-03-01"]), ("timestamp", ["2024-01-01 10:00:00", "2024-03-01 00:00:00"]), ("decimal(9,2)", ["1.50", "22.00"])):
        schema = T.StructType([T.StructField("key", spark.range(1).selectExpr(f"cast(null as {kind}) k").schema["k"].dataType), T.StructField("value", T.StringType())])
        t = KeyedTable.open(spark, str(tmp_path / kind[:4]), schema)
        t.write(spark.createDataFrame([(v, v) for v in values], "key string, value string").withColumn("key", F.col("key").cast(kind)))
        t.flush()
        again = KeyedTable.open(spark, str(tmp_path / kind[:4]), schema)
        assert {r["value"] for r in again.multi_get(again.snapshot()).collect()} == set(values)
        low = again.manifest.runs[0].min_key
        assert again.get(low) == values[0] and again.versions(low, low).count() == 2


def test_handles_see_each_other_and_conflicts_are_planned_again(spark, tmp_path):
    one, two = (KeyedTable.open(spark, str(tmp_path / "t"), S, Options(compaction_threshold=9)) for _ in range(2))
    one.put("a", "1")
    assert two.get("a") == "1"
    two.put("a", "2")
    one.put("b", "1")
    assert as_dict(one.snapshot()) == as_dict(two.snapshot()) == {"a": "2", "b": "1"}
    publish, races = one.store.publish, []

    def lose_once(m):
        if not races:
            races.append(m.version)
            two.put("c", "from two")
        return publish(m)

    one.store.publish = lose_once
    one.put("c", "from one")  # comes after, so it counts
    assert races and one.get("c") == two.get("c") == "from one" and one.refresh().last_seq == 5
    races.clear()
    one.flush()
    assert races and as_dict(two.snapshot())["c"] == "from two" and not two.refresh().log
    races.clear()
    one.compact()
    assert races and as_dict(one.snapshot()) == {"a": "2", "b": "1", "c": "from two"}
    assert len(list((tmp_path / "t" / "log").iterdir())) == 7  # segments of lost races are deleted


def test_versions_are_taken_once(spark, tmp_path):
    t = KeyedTable.open(spark, str(tmp_path / "t"), S)
    t.put("a", "1")
    t.store.versions = lambda: [0]  # as if both had looked at once
    with pytest.raises(Conflict):
        t.store.publish(Manifest(version=1))
    assert [p.name for p in (tmp_path / "t" / "manifest").iterdir() if not p.name.startswith(".")] == ["v000000000001.json"]


def test_vacuum_leaves_young_files_and_drops_old_manifests(spark, tmp_path):
    t = KeyedTable.open(spark, str(tmp_path / "t"), S, Options(compaction_threshold=9))
    for k in "abcd":
        t.put(k, k)
        t.flush()
    t.compact()
    assert t.vacuum() == [] and len(t.store.versions()) == 2
    assert len(t.vacuum(0)) == 4  # the segments: the version before the last still names the runs
    assert as_dict(t.snapshot()) == {k: k for k in "abcd"}


def test_levels(spark, tmp_path):
    t = KeyedTable.open(spark, str(tmp_path / "t"), S, Options(compaction_threshold=2, memtable_capacity=1))
    for i in range(7):
        t.put(f"k{i % 3}", str(i))
    assert [r.level for r in t.manifest.runs] == [2, 1, 0]
    t.remove("k0")
    assert [r.level for r in t.manifest.runs] == [3] and as_dict(t.snapshot()) == {"k1": "4", "k2": "5"}
    assert t.run(t.manifest.runs[0].run_id).count() == 2  # the oldest run took part, so the tombstone went
    plan = resolve.latest_per_key(t.versions().repartitionByRange(4, "key"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_partial_merges_keep_tombstones_and_late_rows_are_told(spark, tmp_path):
    t = KeyedTable.open(spark, str(tmp_path / "t"), S, Options(compaction_threshold=9))
    row = lambda seq, key, value: ops(spark, [(key, value)]).withColumn("seq", F.lit(seq).cast("long"))
    for seq, key, value in ((10, "a", "1"), (20, "a", None), (30, "b", "2")):
        t.apply(row(seq, key, value))
        t.flush()
    t.compact(t.refresh().runs[1:])
    assert t.entries().filter("is_tombstone").count() == 1 and as_dict(t.snapshot()) == {"b": "2"}
    t.apply(row(15, "c", "late"), late=True)
    t.flush()
    t.compact(t.refresh().runs[:2])  # the tombstone of 20 may hide something as old as 15
    assert t.entries().filter("is_tombstone").count() == 1
    t.compact()
    assert t.entries().filter("is_tombstone").count() == 0 and as_dict(t.snapshot()) == {"b": "2", "c": "late"}
    with pytest.raises(ValueError):
        t.apply(row(18, "a", "back"), late=True)
    t.apply(row(40, "a", "new"), batch=("s", 3))
    t.apply(row(50, "a", "again"), batch=("s", 3))
    assert t.get("a") == "new"


def test_maintenance_beside_writes(spark, tmp_path):
    t = KeyedTable.open(spark, str(tmp_path / "t"), S, Options(compaction_threshold=2, memtable_capacity=1))
    calls = []
    t.on_compaction.append(lambda new, old: calls.append(len(old)))
    m = Maintenance(t).start()
    for i in range(4):
        t.put(f"k{i}", str(i))
    assert m.wait(60)
    m.stop()
    assert calls and len(t.refresh().runs) < 4 and as_dict(t.snapshot()) == {f"k{i}": str(i) for i in range(4)}


def test_cursor_and_states(spark, tmp_path):
    t = KeyedTable.open(spark, str(tmp_path / "t"), S)
    t.write(spark.createDataFrame([(k, k) for k in ("k_2", "k_10", "a", "Z")], S))
    t.remove("a")
    assert [r["key"] for r in t.iterate()] == ["Z", "k_10", "k_2"] and [r["key"] for r in t.iterate("k_10")] == ["k_10", "k_2"]
    wanted = spark.createDataFrame([("a",), ("Z",), ("none",)], "key string")
    assert {(r["key"], r["state"]) for r in t.lookup_many(wanted).collect()} == {("a", "deleted"), ("Z", "live"), ("none", "unknown")}
    assert {(r["key"], r["existed"]) for r in resolve.existed(t.snapshot(), wanted).collect()} == {("a", False), ("Z", True), ("none", False)}


def test_hash_columns_against_the_definitions(spark):
    rng = random.Random(5)
    keys = [b"", b"a", b"abc", b"abcd", b"key_0", *(bytes(rng.randrange(256) for _ in range(n)) for n in range(1, 24))]
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select("k", bloom.murmur3_column(F.col("k")).alias("m"), bloom.fnv1a_column(F.col("k")).alias("f"), bloom.positions(F.col("k"), 958, 6).alias("p"))
    for r in rows.collect():
        key = bytes(r["k"])
        a, b = bloom.murmur3_32(key), bloom.fnv1a_32(key)
        assert (r["m"], r["f"], r["p"]) == (a, b, [(a + i * b) % 958 for i in range(6)])


def test_binary_sinks_and_lookups(spark, tmp_path):
    log = ops(spark, [(f"k{i % 40:03d}", None if i % 5 == 0 else f"v{i}") for i in range(200)])
    formats.write_log(log, str(tmp_path / "log"))
    rows = sorted(formats.read_log(spark, str(tmp_path / "log")).collect(), key=lambda r: (r["path"], r["seq"]))
    assert [(bytes(r["key"]).decode(), None if r["is_tombstone"] else bytes(r["value"]).decode()) for r in rows] == [(r["key"], r["value"]) for r in log.orderBy("seq").collect()]
    entries = resolve.latest_per_key(log)
    formats.write_runs(entries, f"file://{tmp_path}/runs")
    want = {r["key"]: r["value"] for r in entries.collect()}
    got = formats.read_runs(spark, str(tmp_path / "runs"))
    assert {bytes(r["key"]).decode(): None if r["value"] is None else bytes(r["value"]).decode() for r in got.collect()} == want
    found = formats.lookup_runs(spark, str(tmp_path / "runs"), [b"k003", b"k005", b"zzz", b""]).collect()
    assert {bytes(r["key"]).decode() for r in found} == {"k003", "k005"} and {r["is_tombstone"] for r in found} == {want["k003"] is None, want["k005"] is None}
    assert formats.read_run_index(spark, str(tmp_path / "runs")).count() == 40
    footers = formats.read_run_footers(spark, str(tmp_path / "runs")).collect()
    files = [p for p in (tmp_path / "runs").iterdir() if p.suffix == ".run"]
    assert len(footers) == len(files) and all(len(r["bloom"]) == (r["num_bits"] + 7) // 8 for r in footers)
    f = formats.RunFile(max(files, key=lambda p: p.stat().st_size).read_bytes())
    assert all(f.get(k)[0] == k for k, _ in f.index) and f.get(b"none") is None
    for broken in (b"", f.data[:-1], f.data[: len(f.data) // 2]):
        with pytest.raises((ValueError, struct.error)):
            formats.RunFile(broken)


def test_binary_sinks_bound_their_files_and_hide_unfinished_ones(spark, tmp_path):
    log = ops(spark, [(f"k{i:03d}", None if i % 5 == 0 else f"v{i}") for i in range(200)])
    formats.write_log(log, str(tmp_path / "log"), file_bytes=500)
    formats.write_runs(resolve.latest_per_key(log), str(tmp_path / "run"), file_bytes=500)
    for kind, read, at in (("log", formats.read_log, "seq"), ("run", formats.read_runs, "entry")):
        files = sorted((tmp_path / kind).iterdir())
        assert len(files) >= 20 and all(p.suffix == f".{kind}" and not p.name.startswith(".") for p in files)
        (tmp_path / kind / f".part-000000-lost-000000.{kind}").write_bytes(files[0].read_bytes()[:-3])  # of an attempt that was lost
        rows = sorted(read(spark, str(tmp_path / kind)).collect(), key=lambda r: (r["path"], r[at]))
        assert [bytes(r["key"]).decode() for r in rows] == [f"k{i:03d}" for i in range(200)]
    empty = spark.createDataFrame([], "seq long, key string, value string, is_tombstone boolean")
    formats.write_log(empty, str(tmp_path / "none"))
    assert formats.read_log(spark, str(tmp_path / "none")).count() == 0


def test_binary_sinks_clear_up_after_failures(spark, tmp_path):
    where = tmp_path / "runs"
    bad = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"), False), (bytearray(b"z"), bytearray(b"\xff"), False)], "key binary, value binary, is_tombstone boolean")
    with pytest.raises(Exception, match="cannot hold"):
        formats.write_runs(bad, str(where), file_bytes=1)
    assert not where.exists() or not [p for p in where.iterdir() if not p.name.startswith(".")]
    writer = formats._Writer(str(tmp_path), "log", 1)
    (tmp_path / ".one.log").write_bytes(b"")
    (tmp_path / "two.log").write_bytes(b"")  # renamed before the commit failed
    writer.abort([formats._Wrote(["one.log", "two.log"]), None])
    assert not list(tmp_path.glob("*.log")) and not list(tmp_path.glob(".*.log"))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_layout_gives_the_same_snapshot(spark, tmp_path, seed):
    rng, model = random.Random(seed), {}
    t = KeyedTable.open(spark, str(tmp_path / "t"), S, Options(compaction_threshold=3))
    for step in range(6):
        rows = []
        for i in range(20):
            key, dead = f"k{rng.randrange(12)}", rng.random() < 0.3
            rows.append((step * 100 + i + 1, key, None if dead else f"{step}.{i}", dead))
            model[key] = None if dead else f"{step}.{i}"
        t.apply(spark.createDataFrame(rows, OPS))
        if rng.random() < 0.6:
            t.flush()
        if rng.random() < 0.3:
            t.compact()
        if rng.random() < 0.4:
            t = KeyedTable.open(spark, str(tmp_path / "t"), S, Options(compaction_threshold=3))
    assert as_dict(t.snapshot()) == {k: v for k, v in model.items() if v is not None}


def test_streaming_upsert_and_latest(spark, tmp_path):
    from runstore.streaming.upsert import latest_stream, upsert_stream

    source = tmp_path / "in"
    ops(spark, [("a", "1"), ("b", "2"), ("a", None)]).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(OPS).parquet(str(source))
    t = KeyedTable.open(spark, str(tmp_path / "t"), S)
    q = upsert_stream(stream, t, str(tmp_path / "c"))
    q.awaitTermination(120)
    assert as_dict(t.snapshot()) == {"b": "2"}
    q = latest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["key"], r["is_tombstone"]) for r in spark.table("newest").collect()} == {("a", True), ("b", False)}


def test_parquet_bloom_and_pushdown(spark, tmp_path):
    t = KeyedTable.open(spark, str(tmp_path / "t"), S)
    t.write(spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit("v").alias("value")))
    t.flush()
    plan = t.lookup("k5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,k5)" in plan and "Exchange" not in plan.replace("TakeOrdered", "")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_catalogue_against_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got = catalogue.queries()[name](spark, str(DATA)).toPandas()
    want = con.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    flat = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert flat(got).equals(flat(want))


def test_entry(spark):
    import __spark_entry__ as e

    if DATA.exists():
        assert e.entry(spark).count() == 12
    assert set(catalogue.queries()) <= set(e.queries())
