"""Helpers shared by the training-data operators: inputs, shared scratch tables, Arrow row maps."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
#: The folders' names of tables made by ``save``: no other folder is ever deleted.
_SAVED: set[str] = set()
#: Held while a table is saved, and no longer. Both the JVM and a Python worker hold a few Arrow batches at once, outside
#: the JVM's heap; and a finished write needs its shuffle files no more.
_WHILE_SAVING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark's own readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests, one machine) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="runstore-"))
    return where.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings with ``values``, and as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_SCOPE: contextvars.ContextVar[list | None] = contextvars.ContextVar("scope", default=None)


def save(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Within ``scratch`` the table goes when that ends, unless it ``stays``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/runstore-{name}-{uuid.uuid4().hex}"
    _SAVED.add(path.rpartition("/")[2])
    if (scope := _SCOPE.get()) is not None and not stays:
        scope.append((spark, path))
    with settings(spark, _WHILE_SAVING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch():
    """Tables saved inside are deleted at the end: what leaves must be saved to stay, and read no other."""
    held: list = []
    token = _SCOPE.set(held)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for spark, path in held:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _SAVED.discard(path.rpartition("/")[2])
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``save`` that no later plan reads; other tables stay, wherever they are."""
    for df in tables:
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root.rpartition("/")[2] in _SAVED:
                _delete(df.sparkSession, root)


def ship(spark: SparkSession) -> None:
    """Make the package's modules known to Python workers, sent once for each application."""
    key = f"shipped {spark.sparkContext.applicationId}"
    if key not in _OWN:
        package = Path(__file__).resolve().parent.parent
        to = Path(tempfile.mkdtemp(prefix="runstore-py-")) / "runstore_modules.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(to))
        _OWN[key] = str(to)


def col(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


KEPT = "_kept_row"


def packed(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The caller's columns as the one struct ``KEPT``, so that none of their names can meet one of an operator's."""
    return df.select(F.struct(*[col(c).alias(c) for c in columns]).alias(KEPT), *more)


def unpacked(df: DataFrame, columns: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """The caller's columns again and what was made; a made name that the caller has gets underscores in front."""
    taken, out = {c.lower() for c in columns}, []
    for name, c in (made or {}).items():
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(c.alias(name))
    fields = [F.col(KEPT).getField(c).alias(c) for c in columns]
    return df.select(*fields, *out)


def row_hash(text: Column) -> Column:
    """With the id it tells a row from others of its id whose text differs, and rows without an id apart."""
    return F.xxhash64(text.cast("string"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(col(column).cast("string"), F.lit(""))


def map_texts(
    df: DataFrame,
    fn: Callable[..., list[pa.Array]],
    fields: list[T.StructField],
    keep: list[str],
    column: str = "text",
    also: tuple[Column, ...] = (),
) -> DataFrame:
    """``KEPT``, a struct of the ``keep`` columns of every row, followed by ``fields``, which ``fn`` makes from the texts.

    ``fn`` gets a list of texts, and one of the values of each further column. Rows are independent, so a lost task is simply run again. Nulls reach ``fn`` as ``None``.
    """
    ship(df.sparkSession)
    inside = column in keep and df.schema[column].dataType == T.StringType()
    work = packed(df, keep, *[c.alias(f"also{i}") for i, c in enumerate(also)], *([] if inside else [col(column).cast("string").alias("t")]))
    place = keep.index(column) if inside else -1
    schema = T.StructType([T.StructField(KEPT, work.schema[KEPT].dataType), *fields])
    names, further = [f.name for f in schema.fields], len(also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(0).field(place) if inside else batch.column(batch.num_columns - 1)
                made = fn(texts.to_pylist(), *[batch.column(1 + i).to_pylist() for i in range(further)])
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)
        pa.default_memory_pool().release_unused()  # the worker stays for later tasks

    return work.mapInArrow(run, schema)


def map_columns(df: DataFrame, fn: Callable[[list], list[pa.Array]], fields: list[T.StructField], keep: list[str], column: str = "text") -> DataFrame:
    """As ``map_texts``, with the kept columns in their own right."""
    made = map_texts(df, fn, [T.StructField(f"_made{i}", f.dataType) for i, f in enumerate(fields)], keep, column)
    return unpacked(made, keep, {f.name: F.col(f"_made{i}") for i, f in enumerate(fields)})


def id_remainder(column: str, modulus: int):
    """crc32 of the id written in decimal, modulo ``modulus``."""
    return F.crc32(col(column).cast("string").cast("binary")) % F.lit(modulus)


def py_remainder(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus
