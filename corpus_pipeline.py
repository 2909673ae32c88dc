"""The corpus pipeline: quality rules, quality classifier, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it back as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runstore.llm import _util, dart_minhash, line_dedup, packing, quality_fm, quality_rules

#: The classifier is trained, so SQL cannot express the rows; tests compare with brute force instead.
ORACLE_SQL = None


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    return quality_rules.keep_good(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7; learnt from labelled documents that passed the rules and those that did not."""
    machine = quality_fm.fit(_util.table(spark, sf_dir, "documents"), _util.table(spark, sf_dir, "labels"))
    return quality_fm.keep_good(docs, machine)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has, or has but for a word in five; remnants of copies go."""
    return line_dedup.rewrite(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return dart_minhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("line dedup", lines_stage),
    ("near dedup", near_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = _util.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with _util.scratch():
            docs = _util.save(stage(spark, before, sf_dir), f"stage-{name.replace(' ', '-')}", stays=True)
        _util.drop(before)  # the input itself is no scratch table
        before = docs
    return docs
