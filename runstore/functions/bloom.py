"""A bloom filter over keys with two 32-bit hashes: sizing, hashes, building, probing.

Parquet's own bloom filters do the skipping in runs; this one is for exact control of size and bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the public hash definitions (MurmurHash3 x86 32-bit, FNV-1a 32-bit).
C1, C2, N = 0xCC9E2D51, 0x1B873593, 0xE6546B64
F1, F2 = 0x85EBCA6B, 0xC2B2AE35
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
MASK = 0xFFFFFFFF


def parameters(n: int, p: float) -> tuple[int, int]:
    """Bits and hash count for ``n`` keys at false-positive rate ``p``."""
    bits = max(1, math.floor(-n * math.log(p) / math.log(2) ** 2)) if n > 0 else 1
    return bits, max(1, math.floor(bits / n * math.log(2))) if n > 0 else 1


def murmur3_32(key: bytes, seed: int = 0) -> int:
    h, whole = seed, len(key) & ~3
    for word in np.frombuffer(key[:whole], dtype="<u4").tolist():
        word = word * C1 & MASK
        word = (word << 15 | word >> 17) & MASK
        h ^= word * C2 & MASK
        h = ((h << 13 | h >> 19) & MASK) * 5 + N & MASK
    if tail := int.from_bytes(key[whole:], "little"):
        tail = tail * C1 & MASK
        tail = (tail << 15 | tail >> 17) & MASK
        h ^= tail * C2 & MASK
    h ^= len(key)
    h = (h ^ h >> 16) * F1 & MASK
    h = (h ^ h >> 13) * F2 & MASK
    return h ^ h >> 16


def fnv1a_32(key: bytes) -> int:
    h = FNV_BASIS
    for b in key:
        h = (h ^ b) * FNV_PRIME & MASK
    return h


def _bytes(key: Column) -> Column:
    """The bytes of a binary column, as numbers."""
    each = lambda i: F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("long")
    return F.when(F.octet_length(key) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(key)), each)).otherwise(F.array().cast("array<bigint>"))


def fnv1a_column(key: Column) -> Column:
    """FNV-1a of a binary column as an expression, without Python."""
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK))
    return F.aggregate(_bytes(key), F.lit(FNV_BASIS).cast("long"), step)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it may name several times but that is computed once: held in an array of one."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _times(a: Column, c: int) -> Column:
    """A product modulo 2**32 that stays below 2**63 on the way; ``a`` is named twice."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(c), F.shiftright(a, 16) * F.lit(c)
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))


def _turned(a: Column, bits: int) -> Column:
    return F.shiftleft(a, bits).bitwiseOR(F.shiftright(a, 32 - bits)).bitwiseAND(F.lit(MASK))


def murmur3_column(key: Column, seed: int = 0) -> Column:
    """MurmurHash3 (x86, 32 bits) of a binary column as an expression, without Python.

    Every step is held by ``_let``: nested instead, each would double the work of the one before.
    """
    def word(at: Column, count: Column) -> Column:
        """Up to four bytes as a little-endian number: one conversion, then a swap of its bytes."""
        number = F.coalesce(F.conv(F.hex(F.substring(key, at + 1, count)), 16, 10).cast("long"), F.lit(0).cast("long"))
        byte = lambda w, up: F.shiftleft(F.shiftright(w, up).bitwiseAND(F.lit(0xFF)), 24 - up)
        return _let(number * F.element_at(F.array(*[F.lit(256 ** (4 - n)) for n in range(5)]), count + 1), lambda w: byte(w, 0) + byte(w, 8) + byte(w, 16) + byte(w, 24))

    def mixed(k: Column) -> Column:
        return _let(_let(_let(k, lambda x: _times(x, C1)), lambda x: _turned(x, 15)), lambda x: _times(x, C2))

    def step(h: Column, at: Column) -> Column:
        return _let(h.bitwiseXOR(mixed(word(at, F.lit(4)))), lambda x: (_turned(x, 13) * F.lit(5) + F.lit(N)).bitwiseAND(F.lit(MASK)))

    size = F.octet_length(key)
    tail = F.pmod(size, F.lit(4))
    starts = F.when(size >= 4, F.sequence(F.lit(0), size - tail - 4, F.lit(4))).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(starts, F.lit(seed).cast("long"), step)
    h = h.bitwiseXOR(mixed(word(size - tail, tail))).bitwiseXOR(size.cast("long"))
    h = _let(_let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 16))), lambda x: _times(x, F1))
    h = _let(_let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 13))), lambda x: _times(x, F2))
    return _let(h, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a binary key, as an array: h1 + i * h2 modulo the number of bits."""
    both = F.struct(murmur3_column(key).alias("a"), fnv1a_column(key).alias("b"))
    return _let(both, lambda h: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h["a"] + i.cast("long") * h["b"], F.lit(bits).cast("long"))))


def build(keys: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """The set bits, one row each: a filter of any size stays distributed."""
    return keys.select(F.explode(positions(F.col(column).cast("binary"), bits, hashes)).alias("position")).distinct()


def serialize(bits_set: DataFrame, bits: int) -> bytes:
    """Packed bytes, least significant bit first; for filters of a size meant for one file."""
    out = np.zeros((bits + 7) // 8, dtype=np.uint8)
    byte = (F.col("position") / 8).cast("long")
    packed = bits_set.groupBy(byte.alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(position % 8 as int))")).alias("value"))
    for r in packed.toLocalIterator():
        out[r["at"]] = r["value"]
    return out.tobytes()


def deserialize(spark, data: bytes) -> DataFrame:
    at = np.nonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little"))[0]
    return spark.createDataFrame(pd.DataFrame({"position": at.astype(np.int64)}), "position long")


def probe(wanted: DataFrame, column: str, bits_set: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``column`` and ``may_contain`` for every distinct wanted key: all its bits are set."""
    want = wanted.select(column).distinct()
    want = want.select(column, F.explode(F.array_distinct(positions(F.col(column).cast("binary"), bits, hashes))).alias("position"))
    return want.join(bits_set.withColumn("_set", F.lit(True)), "position", "left").groupBy(column).agg(F.min(F.coalesce("_set", F.lit(False))).alias("may_contain"))
