"""Factorisation machine for document quality.

Inputs are hashed words, one-hot bins of structure statistics of the text, and one-hot metadata (the bin of the
``n_chars`` column, else of the text's length). Ids, labels, language and source are never inputs. The pairwise part
is scored in linear time: half of the sum over factors of (sum v x)^2 - sum (v x)^2.

Trained in numpy on the driver on at most ``per_class`` documents of each label, with ``sample_bytes`` of text together;
applied to every row by executors.
Defined results: null and empty texts are scored from their statistics; repeated rows get equal scores; without
labels of both classes the score is the smoothed label rate; an empty table gives no rows; extra columns pass through,
whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _learn, _util

STATS = 12
BINS = 12


@dataclass(frozen=True)
class Settings:
    per_class: int = 2000  # bound of the training sample, for each label
    sample_bytes: int = 64 << 20  # and of its texts together
    word_slots: int = 1 << 16
    factors: int = 8
    epochs: int = 14
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7
    threshold: float = 0.7


def statistics(text: str, words: list[str]) -> np.ndarray:
    """Structure statistics, each between 0 and 1."""
    chars, n = max(1, len(text)), max(1, len(words))
    sampled = text.encode("utf-8", "replace")
    codes = np.frombuffer(sampled, dtype=np.uint8)
    counts = np.bincount(codes, minlength=256)
    size = max(1, len(codes))
    letters_low, letters_up = counts[97:123].sum(), counts[65:91].sum()
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    marks = counts[[35, 36, 37, 38, 42, 60, 62, 124]].sum()
    return np.array([
        min(1.0, marks / n),
        min(1.0, counts[124] / n),
        letters_up / max(1, letters_low + letters_up),
        min(1.0, counts[33] / n),
        counts[48:58].sum() / size,
        len(set(words)) / n,
        1 - len(set(filled)) / max(1, len(filled)),
        min(1.0, (chars / n) / 20),
        min(1.0, n / 100) if words else 0.0,
        min(1.0, len(filled) / n * 4),
        min(1.0, (counts[44] + counts[46]) / n),
        min(1.0, (counts[123] + counts[125] + counts[59] + counts[61] + counts[47] + counts[95]) / n),
    ])


def _bin(stats: np.ndarray) -> np.ndarray:
    """Bins that are finer near 0."""
    return np.minimum(BINS - 1, (np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64))


class Features:
    """Sparse inputs of one text: slots and values."""

    MEMORY = 200_000

    def __init__(self, word_slots: int):
        self.word_slots, self.memory = word_slots, {}
        self.size = word_slots + STATS * BINS + 32

    def slots(self, words: list[str]) -> np.ndarray:
        memory = self.memory
        for w in set(words).difference(memory):
            if len(memory) >= self.MEMORY:
                memory.clear()
            memory[w] = zlib.crc32(w.encode("utf-8", "replace")) % self.word_slots
        try:
            return np.fromiter(map(memory.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:  # the memory was emptied above
            return np.array([zlib.crc32(w.encode("utf-8", "replace")) % self.word_slots for w in words], dtype=np.int64)

    def __call__(self, text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        hashed = self.slots(words)
        slot, count = np.unique(hashed, return_counts=True)
        value = np.log1p(count)
        norm = np.sqrt((value**2).sum())
        value = value / norm if norm else value
        stats = self.word_slots + np.arange(STATS) * BINS + _bin(statistics(text, words))
        length = max(0, n_chars if n_chars is not None else len(text))
        meta = self.word_slots + STATS * BINS + min(31, int(length).bit_length())
        return np.concatenate([slot, stats, [meta]]), np.concatenate([value, np.full(STATS + 1, 1.0)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of many rows of (slots, values), none of them empty, at once."""
        starts = np.cumsum([0, *[len(r[0]) for r in rows[:-1]]])
        slots, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        vx = self.factors[slots] * values[:, None]
        pairs = 0.5 * (np.add.reduceat(vx, starts, axis=0) ** 2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + pairs

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -40, 40))) if rows else np.zeros(0)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, rate_of_ones: float, s: Settings = Settings()) -> Machine:
    """AdaGrad on the logistic loss, the classes weighted to ``rate_of_ones``. ``rows`` in a fixed order give a fixed machine."""
    rng = np.random.default_rng(s.seed)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, s.factors))
    gw, gv = np.full(size, 1e-2), np.full((size, s.factors), 1e-2)
    prior = min(max(rate_of_ones, 0.02), 0.98)
    ones = labels.mean() if len(labels) else 0.5
    if not 0 < ones < 1:
        return Machine(float(np.log(prior / (1 - prior))), w, v * 0)
    weight = np.where(labels == 1, prior / ones, (1 - prior) / (1 - ones))
    b, gb = float(np.log(prior / (1 - prior))), 1e-2
    for _ in range(s.epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), s.batch):
            some = order[k : k + s.batch]
            lens = np.array([len(rows[i][0]) for i in some])
            slots = np.concatenate([rows[i][0] for i in some])
            x = np.concatenate([rows[i][1] for i in some])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            vx = v[slots] * x[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
            z = b + np.add.reduceat(w[slots] * x, starts) + pairs
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[some]) * weight[some] / len(some)
            per = np.repeat(g, lens)
            dw = per * x + s.decay * w[slots] / len(some)
            dv = (per * x)[:, None] * (np.repeat(total, lens, axis=0) - vx) + s.decay * v[slots] / len(some)
            unique, inverse = np.unique(slots, return_inverse=True)
            sw = np.bincount(inverse, weights=dw)
            sv = np.stack([np.bincount(inverse, weights=dv[:, f]) for f in range(s.factors)], axis=1)
            gw[unique] += sw**2
            gv[unique] += sv**2
            w[unique] -= s.rate * sw / np.sqrt(gw[unique])
            v[unique] -= s.rate * sv / np.sqrt(gv[unique])
            gb += g.sum() ** 2
            b -= s.rate * g.sum() / np.sqrt(gb)
    return Machine(b, w, v)


def _with_length(docs: DataFrame):
    """The bin of ``n_chars``, or of the text's length, as metadata."""
    return (F.col("n_chars") if "n_chars" in docs.columns else F.length(_util.text_or_empty())).cast("long")


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, s: Settings = Settings()) -> Machine:
    """Learn ``labels.quality`` from a bounded sample whose id remainder is not ``held_out``."""
    wanted = dict(_learn.sample_labels(labels, "quality", modulus, held_out, s.per_class))
    rate = _learn.label_rate(labels, "quality", modulus, held_out)
    features = Features(s.word_slots)

    def run(texts: list, lengths: list) -> list[pa.Array]:
        made = [features(t, n) for t, n in zip(texts, lengths, strict=True)]
        return [pa.array([m[0].astype(np.int32).tobytes() for m in made], type=pa.binary()), pa.array([m[1].astype(np.float32).tobytes() for m in made], type=pa.binary())]

    with _util.scratch():
        some = _learn.texts_of(docs.select("doc_id", "text", _with_length(docs).alias("n_chars")), list(wanted), s.sample_bytes, ["text", "n_chars"])
        made = _util.map_texts(some, run, [T.StructField("slots", T.BinaryType()), T.StructField("x", T.BinaryType())], ["id"], also=(F.col("n_chars"),))
        got = sorted((r.id, bytes(r.slots), bytes(r.x)) for r in made.select(F.col(_util.KEPT)["id"].alias("id"), "slots", "x").collect())
    rows = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64)) for _, a, x in got]
    return train(rows, np.array([wanted[i] for i, _, _ in got], dtype=np.float64), features.size, rate, s)


def _scored(docs: DataFrame, machine: Machine, keep: list[str], s: Settings) -> DataFrame:
    """The ``keep`` columns packed, and ``score``. The machine is of fixed size and goes out as a broadcast variable."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)))
    found: list = []

    def run(texts: list, lengths: list) -> list[pa.Array]:
        if not found:
            found.extend([Machine(*sent.value), Features(s.word_slots)])
        m, features = found
        out = [m.scores([features(t, n) for t, n in zip(texts[k : k + 64], lengths[k : k + 64], strict=True)]) for k in range(0, len(texts), 64)]
        return [pa.array(np.concatenate([np.zeros(0), *out]), type=pa.float64())]

    return _util.map_texts(docs, run, [T.StructField("score", T.DoubleType())], keep, also=(_with_length(docs),))


def score(docs: DataFrame, machine: Machine, keep: list[str], s: Settings = Settings(), name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every row."""
    return _util.unpacked(_scored(docs, machine, keep, s), keep, {name: F.col("score")})


def keep_good(docs: DataFrame, machine: Machine, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with their columns unchanged."""
    return _util.unpacked(_scored(docs, machine, docs.columns, s).filter(F.col("score") >= s.threshold), docs.columns)
