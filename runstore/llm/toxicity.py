"""Toxicity by subword bags and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams, a passage's vector the mean of its
words' vectors, and a linear softmax turns it into a probability. A text's score is that of its most toxic passage
(windows of ``window`` words from every word on, over the whole text), so length does not thin out what a passage says. A
word that also stands less than a window before adds nothing: a harmless word said over and over stays harmless.
Unseen misspellings share n-grams with the words they come from.

Trained on the driver on at most ``per_class`` documents of each label, with ``sample_bytes`` of text together; n-grams
of fewer than ``min_documents`` of them stay at zero. Applied to every row by executors. Defined results: null and empty
texts score as the softmax's bias alone; repeated rows get equal scores; without labels of both classes the score is the
smoothed label rate; an empty table gives no rows; extra columns pass through, whatever their names.
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


@dataclass(frozen=True)
class Settings:
    per_class: int = 1500  # bound of the training sample, for each label
    sample_bytes: int = 32 << 20  # and of its texts together
    slots: int = 1 << 17
    width: int = 12
    low: int = 3
    high: int = 5
    window: int = 16
    rounds: int = 32
    whole_rounds: int = 12  # the first rounds average whole texts
    batch: int = 16
    rate: float = 16.0
    decay: float = 0.01
    balance: float = 0.25  # 0: each text counts alike, 1: each class does
    min_documents: int = 5
    seed: int = 11
    threshold: float = 0.5
    max_word: int = 64  # longer words are split into words of this length, so nothing is left out


def words_of(text: str | None, s: Settings) -> list[str]:
    words = (text or "").lower().split()
    if all(len(w) <= s.max_word for w in words):
        return words
    return [w[i : i + s.max_word] for w in words for i in range(0, len(w), s.max_word)]


def bags(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of each ``<word>`` (outer punctuation off) and of the whole, end to end, and their numbers."""
    marked = [f"<{w.strip('.,;:!?*#$%&|') or w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    owner = np.repeat(np.arange(len(marked)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(chars))  # characters from here to the word's end
    value = (chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    slots, owners, rolled = [], [], np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, s.high + 1):
        ahead = value[n - 1 :]
        rolled = rolled[: len(ahead)] * np.uint64(0x100000001B3) + (ahead ^ (ahead >> np.uint64(29)))
        if n >= s.low:
            at = np.nonzero(left[: len(rolled)] >= n)[0]
            slots.append(rolled[at] ^ np.uint64(n))
            owners.append(owner[at])
    # the whole word: a sum of its characters' hashes, each turned by its place
    place = (lens[owner] - left).astype(np.uint64)
    mixed = (value + place) * (np.uint64(2) * place + np.uint64(0xD6E8FEB86659FD93))
    slots.append(np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), np.cumsum(lens) - lens) if len(lens) else np.zeros(0, np.uint64))
    owners.append(np.arange(len(marked)))
    h = np.concatenate(slots) * np.uint64(0xFF51AFD7ED558CCD)
    order = np.argsort(np.concatenate(owners), kind="stable")
    return ((h ^ (h >> np.uint64(33))) % np.uint64(s.slots)).astype(np.int64)[order], np.bincount(np.concatenate(owners), minlength=len(marked))


def passages(n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all windows over ``n`` words."""
    if n <= window:
        return np.array([0]), np.array([n])
    starts = np.arange(n - window + 1)
    return starts, starts + window


def fresh(ids: np.ndarray, window: int) -> np.ndarray:
    """Whether the same word does not stand less than ``window`` words before; every word's first place is fresh."""
    made = np.ones(len(ids), dtype=bool)
    order = np.argsort(ids, kind="stable")
    made[order[1:]] = (ids[order][1:] != ids[order][:-1]) | (np.diff(order) >= window)
    return made


def best_passage(word_logits: np.ndarray, window: int) -> tuple[int, int, float]:
    """Start, end and mean of the window with the greatest mean."""
    if not len(word_logits):
        return 0, 0, 0.0
    a, b = passages(len(word_logits), window)
    sums = np.concatenate([[0.0], np.cumsum(word_logits)])
    means = (sums[b] - sums[a]) / (b - a)
    k = int(means.argmax())
    return int(a[k]), int(b[k]), float(means[k])


@dataclass
class Model:
    grams: np.ndarray  # slots x width
    softmax: np.ndarray  # width x 2
    bias: np.ndarray  # 2

    def gram_logits(self) -> np.ndarray:
        """Each n-gram's share in the log odds: the model is linear, so a passage's log odds are means of these."""
        return self.grams @ (self.softmax[:, 1] - self.softmax[:, 0])

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: np.ndarray, rate_of_ones: float, s: Settings = Settings()) -> Model:
    """Softmax loss by stochastic gradient descent, embeddings and softmax jointly.

    The first rounds average whole texts, which lets the words that mark toxic documents stand out; after that each
    document is represented by its most toxic passage by the current model, refreshed every round. Plain steps, not
    adaptive ones: a gram moves as much as it has evidence, so words of single documents stay near zero.
    """
    rng = np.random.default_rng(s.seed)
    model = Model(rng.uniform(-1e-3, 1e-3, (s.slots, s.width)), rng.normal(0, 0.5, (s.width, 2)), np.zeros(2))
    if not len(labels) or not 0 < labels.mean() < 1:
        p = min(max(rate_of_ones, 0.01), 0.99)
        model.softmax[:], model.bias[:] = 0, (0, np.log(p / (1 - p)))
        return model
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t, s)], dtype=np.int64) for t in texts]
    new = [fresh(d, s.window) for d in docs]
    flat, lens = bags(list(vocabulary), s)
    starts = np.cumsum(lens) - lens
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) ** s.balance
    # n-grams of too few documents say nothing about unseen ones: they stay at zero
    seen = np.zeros(s.slots, dtype=np.int64)
    for d in docs:
        words = np.unique(d)
        number = lens[words]
        seen[np.unique(flat[np.repeat(starts[words] - (np.cumsum(number) - number), number) + np.arange(number.sum())])] += 1
    model.grams[seen < s.min_documents] = 0
    pulled = (seen >= s.min_documents).astype(np.float64)
    cells = model.grams.reshape(-1)  # the same memory
    for turn in range(s.rounds):
        whole = turn < s.whole_rounds
        logits = np.add.reduceat(model.gram_logits()[flat], starts) / lens if len(flat) else np.zeros(0)
        rate = s.rate * (1 - 0.9 * turn / s.rounds)
        order = rng.permutation(len(docs))
        for k in range(0, len(order), s.batch):
            some = [i for i in order[k : k + s.batch] if len(docs[i])]
            if not some:
                continue
            spans = [slice(None) if whole else slice(*best_passage(logits[docs[i]] * new[i], s.window)[:2]) for i in some]
            lists = [np.unique(docs[i][a]) for i, a in zip(some, spans, strict=True)]
            y, sizes = labels[some].astype(int), np.array([len(x) for x in lists])
            total = sizes if whole else np.array([len(docs[i][a]) for i, a in zip(some, spans, strict=True)])
            ids = np.concatenate(lists)
            number = lens[ids]
            grams = flat[np.repeat(starts[ids] - (np.cumsum(number) - number), number) + np.arange(number.sum())]
            share = np.repeat(np.repeat(1.0 / total, sizes) / number, number)
            edges = np.concatenate([[0], np.cumsum(np.add.reduceat(number, np.cumsum(sizes) - sizes))[:-1]])
            vec = np.add.reduceat(model.grams[grams] * share[:, None], edges, axis=0)
            z = vec @ model.softmax + model.bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[some][:, None]
            pull = np.repeat(p @ model.softmax.T, np.diff(np.append(edges, len(grams))), axis=0) * (share * pulled[grams])[:, None]
            model.softmax -= rate * 0.02 * (vec.T @ p) / len(y)
            model.bias -= rate * 0.02 * p.sum(axis=0) / len(y)
            for a in range(0, len(grams), 1 << 16):  # by flat index, which numpy adds up much faster than rows
                part = slice(a, a + (1 << 16))
                np.subtract.at(cells, (grams[part, None] * s.width + np.arange(s.width)).ravel(), (rate * pull[part]).ravel())
        model.grams *= 1 - s.decay
    # The sample has another share of ones than the labels, and classes were weighted: the bias returns to their share.
    odds = lambda p: np.log(p / (1 - p))
    mean = labels.mean()
    model.bias[1] += odds(np.clip(rate_of_ones, 0.01, 0.99)) - (1 - s.balance) * odds(mean)
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, s: Settings = Settings()) -> Model:
    """Learn ``labels.toxic`` from a bounded sample whose id remainder is not ``held_out``."""
    wanted = dict(_learn.sample_labels(labels, "toxic", modulus, held_out, s.per_class))
    with _util.scratch():
        got = sorted((r.id, r.text or "") for r in _learn.texts_of(docs, list(wanted), s.sample_bytes, ["text"]).collect())
    y = np.array([wanted[i] for i, _ in got], dtype=np.int64)
    return train([t for _, t in got], y, _learn.label_rate(labels, "toxic", modulus, held_out), s)


class Scorer:
    """Scores of texts, with the log odds of each distinct word kept (bounded; it only saves time)."""

    MEMORY = 300_000

    def __init__(self, gram_logits: np.ndarray, offset: float, s: Settings):
        self.gram_logits, self.offset, self.s, self.memory = gram_logits, offset, s, {}

    def __call__(self, text: str | None) -> float:
        return float(self.scores([text])[0])

    def scores(self, texts: list) -> np.ndarray:
        """Of many texts at once: their words lie end to end."""
        lists, memory, window = [words_of(t, self.s) for t in texts], self.memory, self.s.window
        lens = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        place = {w: k for k, w in enumerate(set().union(*lists))}
        if new := [w for w in place if w not in memory]:
            slots, sizes = bags(new, self.s)
            memory.update(zip(new, (np.add.reduceat(self.gram_logits[slots], np.cumsum(sizes) - sizes) / sizes).tolist(), strict=True))
        of_word = np.fromiter(map(memory.__getitem__, place), dtype=np.float64, count=len(place))
        ids = np.fromiter((place[w] for words in lists for w in words), dtype=np.int64, count=int(lens.sum()))
        owner = np.repeat(np.arange(len(lists)), lens)
        again = np.zeros(len(ids), dtype=bool)  # the same word stands less than a window before
        for back in range(1, min(window, len(ids))):
            again[back:] |= (ids[back:] == ids[:-back]) & (owner[back:] == owner[:-back])
        sums = np.concatenate([[0.0], np.cumsum(np.where(again, 0.0, of_word[ids]))])
        starts = np.cumsum(lens) - lens
        means = np.zeros(len(lists))
        short = (lens > 0) & (lens <= window)
        means[short] = (sums[starts + lens] - sums[starts])[short] / lens[short]
        if (long := np.nonzero(lens > window)[0]).size:
            number = lens[long] - window + 1
            edges = np.cumsum(number) - number
            a = np.arange(number.sum()) + np.repeat(starts[long] - edges, number)
            means[long] = np.maximum.reduceat(sums[a + window] - sums[a], edges) / window
        if len(memory) > self.MEMORY:
            memory.clear()
        return 1 / (1 + np.exp(-np.clip(means + self.offset, -40, 40)))


def score(docs: DataFrame, model: Model, keep: list[str], s: Settings = Settings(), name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every row. The table of n-gram log odds is of fixed size and is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast((model.gram_logits(), model.offset))
    found: list[Scorer] = []

    def run(texts: list) -> list[pa.Array]:
        if not found:
            found.append(Scorer(*sent.value, s))
        return [pa.array(np.concatenate([np.zeros(0), *[found[0].scores(texts[k : k + 128]) for k in range(0, len(texts), 128)]]), type=pa.float64())]

    return _util.map_columns(docs, run, [T.StructField(name, T.DoubleType())], keep)


def flag(scored: DataFrame, s: Settings = Settings()) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))
