"""Byte-level BPE in numpy.

A text is parted by the tokenizer's pattern; each distinct part is merged once. Parts of one length bucket lie in a
padded matrix of token ids; in every round each row merges its leftmost pair of minimum rank, found through an open
addressing hash table of pairs, and rows are compacted to the left. Finished rows leave the matrix. A part beyond the
buckets is a matrix of one row, in which a round merges all places of the least pair, left to right, unless a token it
makes has a pair of lesser rank beside it; then the leftmost only, so the result is that of one merge a round. Only ranks
beside a merge are looked up again, and the row is compacted when half of it is gone. Results are kept in a bounded
memory of parts, which only saves time.

Defined results: a null text is empty and has no tokens; every row is encoded on its own, whole, so repeated rows have
equal results; an empty table gives no rows; extra columns pass through or are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util

BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512, 1024, 2048)
MEMORY = 250_000  # parts remembered by a worker
GROUP = 1_500_000  # characters of text whose new parts are merged together
NONE = np.int64(1 << 40)


class PairTable:
    """Hash table from (left id, right id) to the id of the merged token, probed for whole arrays at once."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        get = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = get(token[:cut])
                if left is not None and (right := get(token[cut:])) is not None:
                    keys.append((left << 32) | right)
                    values.append(rank)
        self.bits = max(4, (len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)
        k, v = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
        slot = self._slot(k)
        while len(k):  # of the keys that want one free slot the last takes it, the others go one further
            free = self.keys[slot] == -1
            self.keys[slot[free]] = k[free]
            self.values[slot[free]] = v[free]
            won = self.keys[slot] == k
            self.values[slot[won]] = v[won]
            k, v, slot = k[~won], v[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, ``NONE`` where the pair has none. Negative ids are padding."""
        keys = (left << 32) | right
        out = np.full(keys.shape, NONE, dtype=np.int64)
        todo = np.nonzero((left >= 0) & (right >= 0))
        want = keys[todo]
        slot = self._slot(want)
        flat = np.arange(len(want))
        result = np.full(len(want), NONE, dtype=np.int64)
        while len(flat):
            there = self.keys[slot]
            hit = there == want
            result[flat[hit]] = self.values[slot[hit]]
            go = ~hit & (there != -1)
            flat, want, slot = flat[go], want[go], (slot[go] + 1) & (len(self.keys) - 1)
        out[todo] = result
        return out


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find_all = ranks, regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.memory: dict[str, tuple[int, str, bytes]] = {}

    def merge_matrix(self, parts: list[bytes], width: int) -> list[list[int]]:
        rows = len(parts)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), dtype=np.uint8).reshape(rows, width)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=rows)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], -1)
        done: list = [None] * rows
        alive = np.arange(rows)
        while len(alive):
            best = self.pairs.find(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(alive), 1), NONE)
            at = best.argmin(axis=1)  # the first of equal ranks
            rank = best[np.arange(len(alive)), at]
            stop = rank == NONE
            if stop.any():
                ended = ids[stop]
                for k, row, n in zip(alive[stop].tolist(), ended.tolist(), (ended >= 0).sum(axis=1).tolist(), strict=True):
                    done[k] = row[:n]
            go = ~stop
            ids, at, rank, alive = ids[go], at[go], rank[go], alive[go]
            if not len(alive):
                break
            ids[np.arange(len(alive)), at] = rank
            columns = np.arange(ids.shape[1] - 1)
            source = columns[None, :] + (columns[None, :] > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
        return done

    def merge_row(self, part: bytes) -> list[int]:
        """The merges of one long part."""
        ids = np.append(self.byte_ids[np.frombuffer(part, dtype=np.uint8)], -1)  # the last is no token
        n = len(ids) - 1
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # places of the neighbours; n is the end
        best = np.append(self.pairs.find(ids[:-1], ids[1:]), NONE)  # of each token and the one after it
        alive = n
        while True:
            rank = best.min()
            if rank == NONE:
                return ids[:n][ids[:n] >= 0].tolist()
            at = np.nonzero(best == rank)[0]
            if len(at) > 1 and (touching := after[at[:-1]] == at[1:]).any():  # of places in a row every second one
                first = np.concatenate([[True], ~touching])
                run = np.cumsum(first) - 1
                at = at[(np.arange(len(at)) - np.nonzero(first)[0][run]) % 2 == 0]
            right = after[at]
            beyond, ahead = after[right], before[at]
            if len(at) > 1:
                made = np.full(len(at), rank)
                # A token made here stands beside its old neighbours or, where these merge as well, beside their new tokens.
                left_old, right_old = np.where(ahead >= 0, ids[ahead], -1), ids[beyond]
                left_new = np.where(np.isin(ahead, right), rank, left_old)
                least = np.minimum(np.minimum(self.pairs.find(left_old, made), self.pairs.find(made, right_old)), self.pairs.find(left_new, made))
                if (least < rank).any():
                    at, right, beyond, ahead = at[:1], right[:1], beyond[:1], ahead[:1]
            ids[at], ids[right], best[right] = rank, -1, NONE
            after[at] = beyond
            before[beyond[beyond < n]] = at[beyond < n]
            alive -= len(at)
            for place in (at, ahead[ahead >= 0]):
                place = place[ids[place] >= 0]
                best[place] = self.pairs.find(ids[place], ids[after[place]])
            if 2 * alive < n:
                ids = np.append(ids[:n][ids[:n] >= 0], -1)
                n = alive
                after, before = np.arange(1, n + 2), np.arange(-1, n)
                best = np.append(self.pairs.find(ids[:-1], ids[1:]), NONE)

    def encode_parts(self, parts: list[bytes]) -> list[list[int]]:
        """Token ids of every part, in order."""
        out: list = [None] * len(parts)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            whole = self.ranks.get(p)  # as the tokenizer does, before any merge
            if whole is not None:
                out[i] = [whole]
            elif len(p) > BUCKETS[-1]:
                out[i] = self.merge_row(p)
            else:
                by.setdefault(next(b for b in BUCKETS if b >= len(p)), []).append(i)
        for width, members in by.items():
            step = max(1, 262_144 // width)
            for k in range(0, len(members), step):
                some = members[k : k + step]
                for i, ids in zip(some, self.merge_matrix([parts[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def learn(self, parts: set[str]) -> None:
        new = sorted(p for p in parts if p not in self.memory)
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
            new = sorted(parts)
        for p, ids in zip(new, self.encode_parts([p.encode() for p in new]), strict=True):
            self.memory[p] = len(ids), ",".join(map(str, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_parts([p.encode() for p in self.find_all(text)]) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: token count, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes.

        The new parts of several texts are merged together, as large matrices cost less for each row.
        """
        out: list[tuple[int, str, str]] = []
        at = 0
        while at < len(texts):
            found, size = [], 0
            while at < len(texts) and (not found or size < GROUP):
                found.append(self.find_all(texts[at]))
                size += len(texts[at])
                at += 1
            self.learn(set().union(*found))
            for parts in found:
                got = [self.memory[p] for p in parts]
                out.append((
                    sum([g[0] for g in got]),
                    hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest(),
                    hashlib.sha256(b"".join([g[2] for g in got])).hexdigest(),
                ))
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each rank file and worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, keep: list[str], name: str = "token_ids") -> DataFrame:
    """``keep`` columns and the token ids of the text as ``array<int>``."""

    def run(texts: list) -> list[pa.Array]:
        c = codec(path, pattern)
        return [pa.array([c.encode(t or "") for t in texts], type=pa.list_(pa.int32()))]

    return _util.map_columns(docs, run, [T.StructField(name, T.ArrayType(T.IntegerType()))], keep)


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", name: str = "text") -> DataFrame:
    """The UTF-8 text of a column of token ids; null stays null."""

    _util.ship(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def run(lists):
        c = codec(path, pattern)
        return lists.map(lambda x: None if x is None else c.decode([int(i) for i in x]).decode("utf-8", "replace"))

    return df.withColumn(name, run(F.col(ids)))


def digests(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole text."""

    def run(texts: list) -> list[pa.Array]:
        c = codec(path, pattern)
        rows = c.digests([t or "" for t in texts])
        return [pa.array([r[0] for r in rows], type=pa.int64()), *(pa.array([r[i] for r in rows], type=pa.string()) for i in (1, 2))]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _util.map_columns(docs, run, fields, keep)
