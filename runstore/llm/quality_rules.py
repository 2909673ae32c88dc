"""Host-level quality rules.

Every document is tested against simple rules; failures are summed by host (``source``), each host's failure rate is
shrunk by a beta prior fitted to all hosts by the method of moments, and the host's verdict is joined back.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; repeated rows are
judged one by one and all count; an empty table gives no rows. Other columns pass through, whatever their names; where
the caller keeps a column named like one that is made, the made one gets an underscore in front.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50  # of words, in repeated three-word windows
    max_symbols_percent: int = 25  # symbols to words
    max_dup_lines_percent: int = 30  # repeated lines to words-bearing lines
    max_host_rate: float = 0.6  # a host above this shrunken failure rate is rejected as a whole
    broadcast_bytes: int = 8 << 20  # host verdicts up to this size are broadcast; beyond, they are joined by salted keys
    salts: int = 32


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() parts at \x20 and \x09-\x0D exactly
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return n, chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    pairs = codes[:-1] * len(ids) + codes[1:]
    if len(ids) > 2_000_000:  # keeps the product below 2**63
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + codes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(windows), dtype=bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _batch(texts: list) -> list[pa.Array]:
    rows = np.array([measure(t) for t in texts], dtype=np.int64).reshape(len(texts), len(_MEASURES))
    return [pa.array(rows[:, i]) for i in range(len(_MEASURES))]


def document_measures(docs: DataFrame, keep: list[str], host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row per input row: the ``keep`` columns packed, ``host``, the measures, ``base_failed`` and ``failed``."""
    columns = list(dict.fromkeys([*keep, host]))
    made = _util.map_texts(docs, _batch, [T.StructField(c, T.LongType()) for c in _MEASURES], columns)
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    failed = (
        base
        | (100 * F.col("n_symbols") > rules.max_symbols_percent * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > rules.max_dup_lines_percent * F.col("n_lines"))
    )
    return made.select(_util.KEPT, F.col(_util.KEPT).getField(host).alias("host"), *_MEASURES, base.alias("base_failed"), failed.alias("failed"))


def host_rates(measured: DataFrame) -> DataFrame:
    """Per ``host``: documents, failures and the failure rate shrunk by the empirical beta prior.

    The prior's mean is the corpus rate and its strength a+b comes from the variance of host rates beyond what
    binomial sampling explains (method of moments); no such variance means complete pooling.
    """
    per = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    total = per.agg(
        F.sum("n").alias("nn"), F.sum("failures").alias("ff"), F.count("*").alias("k"),
        F.sum(F.col("failures") * rate).alias("fr"), F.sum(F.col("n") * F.col("n")).alias("n2"),
    ).withColumns({"mean": F.col("ff") / F.col("nn")})
    within = F.col("mean") * (1 - F.col("mean"))
    # Weighted between-host scatter: sum n (rate - mean)^2 = sum f * rate - mean * sum f.
    scatter = F.col("fr") - F.col("mean") * F.col("ff")
    effective = F.col("nn") - F.col("n2") / F.col("nn")
    between = F.when(effective > 0, (scatter - (F.col("k") - 1) * within) / F.nullif(effective, F.lit(0.0)))
    strength = F.when((between > 0) & (within > 0), F.greatest(within / F.nullif(between, F.lit(0.0)) - 1, F.lit(1.0))).otherwise(F.lit(1e9))
    prior = total.select("mean", strength.alias("strength"))  # one row, so its broadcast is bounded
    return per.crossJoin(F.broadcast(prior)).select(
        "host", "n", "failures", ((F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("host_rate")
    )


def judged(docs: DataFrame, keep: list[str], host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The ``keep`` columns packed, the measures, ``base_failed``, ``failed``, ``host_rate``, ``host_rejected`` and ``kept``.

    The measures are saved to the shared folder, as both the host sums and the final rows read them.
    """
    measured = _util.save(document_measures(docs, keep, host, rules), "rules")
    rates = host_rates(measured).select(F.col("host").alias("of"), "host_rate", (F.col("host_rate") > rules.max_host_rate).alias("host_rejected"))
    rates = _util.save(rates, "hosts")
    count, size = rates.agg(F.count("*"), F.sum(F.octet_length(F.col("of").cast("string")))).first()
    if 64 * count + (size or 0) <= rules.broadcast_bytes:
        joined = measured.join(F.broadcast(rates), F.col("host").eqNullSafe(F.col("of")), "left")
    else:  # one host may hold a third of the rows: spread each host's rows over several keys
        left = measured.withColumn("salt", F.pmod(F.xxhash64(_util.KEPT, *_MEASURES), F.lit(rules.salts)))
        right = rates.select("*", F.explode(F.expr(f"sequence(0L, {rules.salts - 1}L)")).alias("salt_of"))
        joined = left.join(right, F.col("host").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")), "left")
    return joined.withColumn("kept", ~F.col("failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))


def judge(docs: DataFrame, keep: list[str], host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``keep`` columns, measures, ``base_failed``, ``rule_failed``, ``host_rate``, ``host_rejected`` and ``kept``."""
    made = {c: F.col(c) for c in _MEASURES} | {"base_failed": F.col("base_failed"), "rule_failed": F.col("failed"), "host_rate": F.col("host_rate")}
    return _util.unpacked(judged(docs, keep, host, rules), keep, made | {"host_rejected": F.col("host_rejected"), "kept": F.col("kept")})


def keep_good(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged."""
    return _util.unpacked(judged(docs, docs.columns, host, rules).filter("kept"), docs.columns)
