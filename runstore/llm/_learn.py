"""Bounded samples of labelled documents for the classifiers, which are trained on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util


def _training_rows(labels: DataFrame, label: str, modulus: int, held_out: int, id_col: str) -> DataFrame:
    return (
        labels.select(_util.col(id_col).alias("id"), _util.col(label).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (_util.id_remainder("id", modulus) != held_out))
        .groupBy("id").agg(F.max("y").alias("y"))
    )


def label_rate(labels: DataFrame, label: str, modulus: int, held_out: int, id_col: str = "doc_id") -> float:
    """The share of ones among all labels that may be learnt from; one half without any."""
    rate = _training_rows(labels, label, modulus, held_out, id_col).agg(F.avg("y")).first()[0]
    return 0.5 if rate is None else float(rate)


def sample_labels(labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, id_col: str = "doc_id") -> list[tuple]:
    """At most ``per_class`` (id, label) of each class whose id's remainder is not ``held_out``, chosen by a hash of the id.

    Rows with a null id or label are left out. An id with contradicting labels counts once, with the larger.
    """
    rows = _training_rows(labels, label, modulus, held_out, id_col)
    found = []
    for y in (0, 1):
        found += rows.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()
    return [(r.id, r.y) for r in found]


def texts_of(docs: DataFrame, ids: list, most_bytes: int, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """``id`` and ``columns`` of the sampled ids, one row each (an id's shortest text), of ``most_bytes`` of text together.

    Where the texts are longer than that, ids stay out from the end of the list. The list is bounded by the sample, so it
    is broadcast; texts reach the driver only within ``most_bytes``.
    """
    spark = docs.sparkSession
    sampled = spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("sampled", docs.schema[id_col].dataType)]))
    rows = docs.select(_util.col(id_col).alias("id"), F.struct(F.octet_length(F.col("text").cast("string")).alias("size"), *columns).alias("row"))
    rows = rows.join(F.broadcast(sampled), F.col("id") == F.col("sampled")).groupBy("id").agg(F.min("row").alias("row"))
    rows = _util.save(rows.select("id", "row.*"), "sample")
    size = {r.id: r["size"] or 0 for r in rows.select("id", "size").collect()}
    chosen, total = [], 0
    for i in ids:
        if i in size and total + size[i] <= most_bytes:
            chosen.append(i)
            total += size[i]
    return rows.filter(F.col("id").isin(chosen)).select("id", *columns) if len(chosen) < len(size) else rows.select("id", *columns)
