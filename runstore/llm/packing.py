"""Best-fit packing of token pieces into sequences of bounded length.

Bounded-space online best-fit: a task keeps a fixed number of open sequences in a bitset keyed by free space, puts each
piece into the fullest one that still holds it, and closes the fullest when too many are open. Pieces are slim rows
(no texts, no ids), dealt by a hash of their row over as many tasks as the measured token total asks for, so each task
packs about ``task_tokens``, however alike the rows are, and only its last open sequences stay part empty. A task takes
its pieces by falling length, as the short ones then fill what the long ones leave.

Defined results: a null or empty text is one piece that holds the end id only; a text that holds the string of one of the
file's added tokens has that token's id there, as the library has; repeated rows are packed one by one, each with pieces
of its own; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util


@dataclass(frozen=True)
class Packing:
    length: int = 1024
    open_bins: int = 512
    end_id: int = 2
    task_tokens: int = 32_000_000


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable ones themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class _Known(dict):
    """Ids of parts, asked of the model when first met."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, part: str) -> bytes:
        ids = [t.id for t in self.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        self[part] = made = struct.pack(f"<{len(ids)}I", *ids)
        return made


class TextIds:
    """Little-endian 32-bit ids of whole texts by a ``tokenizers`` file.

    A text is cut at the strings of the file's added tokens, the longest first, and between them by ``pattern`` as the
    file's byte-level pre-tokenizer does. Where the file's merges are in the order of their tokens' ids, ``tiktoken`` encodes
    what is between in less than half of the time, with the same ids; it takes a token's whole text for that token, so the
    file's model is asked beforehand whether it does as well. Else the model is asked, once for each distinct part.
    """

    MEMORY = 250_000

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: the task's core is all there is
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added, model = file.get("added_tokens") or [], Tokenizer.from_file(path).model
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
            raise ValueError("added tokens that take spaces with them, stand for whole words or are normalised are not supported")
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in added if t["content"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.find_all, self.memory = regex.compile(pattern).findall, _Known(model)
        ranks = ranks_of(file["model"], model)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        cut = self.cut(text) if any(map(text.__contains__, self.added)) else [text]
        return b"".join([self.added[part] if k % 2 else self.between(part) for k, part in enumerate(cut)])  # every second one is added

    def between(self, text: str) -> bytes:
        if self.fast is not None:
            return np.array(self.fast(text), dtype="<u4").tobytes()
        if len(self.memory) > self.MEMORY:
            self.memory.clear()
        return b"".join(map(self.memory.__getitem__, self.find_all(text)))


def ranks_of(described: dict, model) -> dict[bytes, int] | None:
    """Ids by the bytes of the tokens, if merging the pair of least id first is what the file's model does; else None."""
    vocabulary, merges = described.get("vocab") or {}, described.get("merges") or []
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    first = len(vocabulary) - len(merges)
    if described.get("type") != "BPE" or any(described.get(k) for k in odd) or first != 256:
        return None
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
    if any(vocabulary.get(m) != first + k for k, m in enumerate(joined)) or any([t.id for t in model.tokenize(t)] != [i] for t, i in vocabulary.items()):
        return None
    byte_of = {c: bytes([b]) for b, c in enumerate(byte_letters())}
    return {b"".join(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items()}


_ENCODERS: dict[tuple[str, str], TextIds] = {}


def pieces_of(ids: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's little-endian ids; only the first piece may be shorter."""
    n = len(ids) // 4
    first = n % length or min(n, length)
    bounds = [0, *range(first, n + 1, length)] if n else [0]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


_PIECE = (("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64()))


def token_pieces(docs: DataFrame, path: str, pattern: str, packing: Packing = Packing(), id_col: str = "doc_id") -> DataFrame:
    """``_id``, ``row`` (a number of the document's row, as rows may be alike), ``piece``, ``start``, ``length``, ``ids_crc32``."""

    def run(texts: list) -> list[pa.Array]:
        if (path, pattern) not in _ENCODERS:
            _ENCODERS[path, pattern] = TextIds(path, pattern)
        encode, end = _ENCODERS[path, pattern].encode, struct.pack("<I", packing.end_id)
        found = [pieces_of(encode(t or "") + end, packing.length) for t in texts]
        edges = np.cumsum([0, *map(len, found)]).astype(np.int32)
        columns = list(zip(*[p for d in found for p in d], strict=True)) or [()] * len(_PIECE)
        items = pa.StructArray.from_arrays([pa.array(c, type=k) for c, (_, _, k) in zip(columns, _PIECE, strict=True)], names=[n for n, _, _ in _PIECE])
        return [pa.ListArray.from_arrays(pa.array(edges), items)]

    item = T.StructType([T.StructField(n, k) for n, k, _ in _PIECE])
    made = _util.map_texts(docs.select(_util.col(id_col).alias("_id"), F.col("text")), run, [T.StructField("p", T.ArrayType(item))], ["_id"])
    numbered = made.select(F.col(_util.KEPT)["_id"].alias("_id"), F.monotonically_increasing_id().alias("row"), "p")
    return numbered.select("_id", "row", F.explode("p").alias("p")).select("_id", "row", "p.*")


class OpenBins:
    """Open sequences keyed by free space; ``mask`` has bit f set when one with f free tokens is open."""

    def __init__(self, length: int, most: int, first_number: int):
        self.length, self.most, self.number = length, most, first_number
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.mask, self.count = 0, 0

    def place(self, size: int) -> tuple[int, int]:
        """Sequence number and offset for a piece of ``size`` tokens."""
        fitting = self.mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = self.free[room]
            number = stack.pop()
            if not stack:
                self.mask &= ~(1 << room)
            self.count -= 1
        else:
            room, number = self.length, self.number
            self.number += 1
        if left := room - size:
            self.free[left].append(number)
            self.mask |= 1 << left
            self.count += 1
            if self.count > self.most:  # the fullest closes first
                least = (self.mask & -self.mask).bit_length() - 1
                self.free[least].pop()
                if not self.free[least]:
                    self.mask &= ~(1 << least)
                self.count -= 1
        return number, self.length - room


def pack(pieces: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """``pieces`` (saved, as it is read twice) with ``sequence_id`` and ``offset``."""
    _util.ship(pieces.sparkSession)
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // packing.task_tokens))
    rounds = max(1, round(total / (packing.open_bins * packing.length)))
    columns = ["_id", "piece", "start", "length", "ids_crc32"]
    # The order inside a task is fixed by the saved rows alone: a task that is run again packs alike.
    dealt = (
        pieces.select(*columns, "row", F.pmod(F.xxhash64("row", "piece"), F.lit(rounds)).alias("round"))
        .repartition(tasks, "round")
        .sortWithinPartitions("round", F.desc("length"), "row", "piece")
        .select(*columns)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        bins = OpenBins(packing.length, packing.open_bins, (context.partitionId() if context else 0) << 40)
        for b in batches:
            spots = [bins.place(n) for n in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([s[0] for s in spots], type=pa.int64()), pa.array([s[1] for s in spots], type=pa.int64())],
                names=[*columns, "sequence_id", "offset"],
            )

    return dealt.mapInArrow(run, T.StructType([*[pieces.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, path: str, pattern: str, packing: Packing = Packing(), id_col: str = "doc_id") -> DataFrame:
    """One row per piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    pieces = _util.save(token_pieces(docs, path, pattern, packing, id_col), "pieces")  # the row numbers are fixed by this
    return pack(pieces, packing).select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
