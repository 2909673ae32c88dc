"""Hierarchical Pitman-Yor language model over the corpus, and perplexity scores by it.

Every context has a restaurant in which each word's customers sit at tables; a table is a customer of the parent
restaurant, which all contexts share, and the parent's own base is uniform over the vocabulary and one unknown word.
Contexts are the text's start and every word that one follows. Seating is sampled by Gibbs: a sweep takes each word's
customers out of each restaurant and seats them anew. Their number of tables is drawn from its exact distribution given
everything else in the restaurant and its parent (generalised Stirling numbers; for words with more than ``exact``
customers a distribution of the same mode and width), where everything else is as the sweep before left it, so words need not wait for each other. Discounts
are fitted to the numbers of pairs seen once and twice. Scores use the predictive probabilities averaged over the sweeps
after ``burn_in``. Random numbers are hashes of word, context and sweep, so results do not depend on partitioning or on
tasks being run again; words are known by 64-bit hashes, and so are pairs of context and word.

Texts are read once for chunks: about ``chunk_mb`` of text with its own word list and token numbers. Chunks send hashes
and counts, packed by range of hash, and get back what the whole corpus has: once for pairs (the training count, and
which chunk's pair counts for all), and for words after each sweep. Equal pairs are seated alike in every chunk, so
pairs do not travel again. There is one range for each ``range_tokens`` tokens of the corpus, so a range holds about as much
at every size; a chunk and a range exchange at most one blob, and never more blobs than keys. The driver gets sums of the
whole corpus only.

Defined results: a null or empty text is one end token; a null id is a training text; repeated rows are scored and
counted one by one; ids may be of any type; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util
from .dart_minhash import _steps, mix, unit

START = np.uint64(1)  # the hash of the context before a text
END = b"\n"  # no word holds it


@dataclass(frozen=True)
class Model:
    chunk_mb: float = 8.0
    range_tokens: int = 3_000_000
    sweeps: int = 3
    burn_in: int = 1
    discount: float | None = None  # None: fitted to the corpus
    strength: float = 20.0
    root_discount: float | None = None
    root_strength: float = 20.0
    exact: int = 32  # up to so many customers of a word their tables are drawn exactly
    modulus: int = 7
    held_out: int = 2


def tokens_of(text: str | None) -> list[bytes]:
    """Words in ASCII lower case, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def is_held_out(doc_id, m: Model) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % m.modulus == m.held_out


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def pair_hash(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mix(words + mix(contexts + np.uint64(77)))


@cache
def stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways for c customers (row) to sit at t tables (column)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - discount * t)
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


def seat(customers: np.ndarray, others: np.ndarray, base: np.ndarray, strength: float, discount: float, seeds: np.ndarray, exact: int) -> np.ndarray:
    """Tables of each dish's customers, seated anew: ``others`` tables have other dishes, ``base`` is the parent's probability.

    Up to ``exact`` customers the number is drawn from its distribution given the rest: the Stirling number of t tables
    times what the t new tables weigh, one after the other. Beyond, see ``_seat_many``.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    draw = unit(mix(seeds))
    few = np.nonzero((customers > 1) & (customers <= exact))[0]
    few = few[np.argsort(customers[few], kind="stable")]
    ways = stirling(discount, exact)
    for c, at in zip(*_runs(customers[few], few), strict=True):
        for k in range(0, len(at), 1 << 15):
            i = at[k : k + (1 << 15)]
            weight = np.log((strength + discount * (others[i, None] + np.arange(c))) * base[i, None]).cumsum(axis=1) + ways[c, 1 : c + 1]
            weight = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
            tables[i] = 1 + (weight < draw[i, None] * weight[:, -1:]).sum(axis=1).clip(max=c - 1)
    many = np.nonzero(customers > exact)[0]
    tables[many] = _seat_many(customers[many], (strength + discount * others[many]) * base[many], base[many], discount, seeds[many])
    return tables


def _expected(customers: np.ndarray, pull: np.ndarray, discount: float) -> np.ndarray:
    """Tables to expect of customers who come one by one, where the i-th new table weighs ``pull`` + ``discount`` * i."""
    return (1 + pull / discount) * ((customers + pull) / (1 + pull)) ** discount - pull / discount


def _seat_many(customers: np.ndarray, pull: np.ndarray, base: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Tables of dishes with many customers, whose i-th new table weighs ``pull`` + ``base`` * ``discount`` * i.

    The next number of tables is as likely as this one where customers who come one by one, to new tables of the same
    weight, would take this number; that gives the mode, and how the weight changes around it gives the variance. The draw is
    from a gamma distribution of both, rounded at random.
    """
    if not customers.size:
        return np.zeros(0, dtype=np.int64)
    floor = 1e-6 - discount
    low, high = np.ones(len(customers)), customers.astype(np.float64)
    for _ in range(40):
        middle = (low + high) / 2
        more = _expected(customers, np.maximum(pull - (1 - base) * discount * middle, floor), discount) > middle
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    line = np.maximum(pull - (1 - base) * discount * high, floor)
    step = 1e-4 * (line + discount) + 1e-9
    slope = (_expected(customers, line + step, discount) - _expected(customers, line, discount)) / step
    variance = (pull + base * discount * high) / (1 / np.maximum(slope, 1e-12) + (1 - base) * discount)
    mean = np.maximum(high - 1, 1e-6)  # beyond the first table
    shape = np.maximum(mean**2 / np.maximum(variance, 1e-12), 1e-3)
    u, v, w = (np.maximum(unit(mix(seeds + _steps(k))), 1e-12) for k in (1, 2, 3))
    normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    gamma = np.where(shape < 0.5, -mean * np.log(u), mean * np.maximum(0, 1 - 1 / (9 * shape) + normal / (3 * np.sqrt(shape))) ** 3)
    return np.minimum(customers, 1 + np.floor(gamma + w)).astype(np.int64)


def _runs(sorted_values: np.ndarray, of: np.ndarray) -> tuple[list, list]:
    """Distinct values and, for each, the entries of ``of``."""
    values, starts = np.unique(sorted_values, return_index=True)
    return values.tolist(), np.split(of, starts[1:]) if len(values) else []


def fitted(ones: int, twos: int) -> float:
    """The discount that the numbers of things seen once and twice suggest."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


@dataclass
class Totals:
    """What is known of all restaurants after a sweep: tables and customers by context, and of the root."""

    tables: np.ndarray
    customers: np.ndarray
    root_tables: float
    root_customers: float

    def root(self, customers, tables, base: float, m: Model):
        pull = m.root_strength + m.root_discount * self.root_tables
        return (np.maximum(customers - m.root_discount * tables, 0) + pull * base) / (m.root_strength + self.root_customers)

    def leaf(self, count, tables, context, root, m: Model):
        pull = (m.strength + m.discount * self.tables)[context]
        return (np.maximum(count - m.discount * tables, 0) + pull * root) / (m.strength + self.customers[context])

    def seat(self, count, tables, context, root, seeds, m: Model) -> np.ndarray:
        """Tables of pairs after a sweep, given those before it."""
        return seat(count, self.tables[context] - tables, root, m.strength, m.discount, seeds, m.exact)

    def seat_root(self, words: np.ndarray, customers: np.ndarray, s: int, base: float, m: Model) -> np.ndarray:
        others = np.full(len(words), max(0.0, self.root_tables - 1))
        return seat(customers, others, np.full(len(words), base), m.root_strength, m.root_discount, mix(words) + _steps(1000 * (s + 1) + 500), m.exact)


def sweeps(words: np.ndarray, starts: np.ndarray, contexts: np.ndarray, counts: np.ndarray, base: float, m: Model, marks: np.ndarray | None = None):
    """Yield (totals, tables by pair, root customers and tables by word) before the first sweep and after each.

    Pairs of one word lie together; ``starts`` has each word's first pair. ``marks`` are the contexts' hashes, by default
    their numbers. This holds all of a word's pairs at once; ``score`` does the same by chunks.
    """
    size = int(contexts.max()) + 1
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(contexts))))
    seeds = pair_hash(words[owner], contexts.astype(np.uint64) if marks is None else marks[contexts])
    tables, customers, root_tables, totals = np.minimum(counts, 1), np.bincount(contexts, counts, size), None, None
    for s in range(-1, m.sweeps):
        if s >= 0:
            p = totals.root(root_customers, root_tables, base, m)
            tables = totals.seat(counts, tables, contexts, p[owner], seeds + _steps(1000 * (s + 1)), m)
        root_customers = np.add.reduceat(tables, starts)
        root_tables = np.minimum(root_customers, 1) if s < 0 else totals.seat_root(words, root_customers, s, base, m)
        totals = Totals(np.bincount(contexts, tables, size), customers, float(root_tables.sum()), float(root_customers.sum()))
        yield totals, tables, root_customers, root_tables


def pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of each array, compressed: of sorted or small numbers most planes are zeros."""
    parts = []
    for x in arrays:
        parts += [np.int64(len(x)).tobytes(), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in map(np.dtype, kinds):
        n, at = int(np.frombuffer(raw, np.int64, 1, at)[0]), at + 8
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def chunk_table(docs: DataFrame, m: Model, id_col: str = "doc_id") -> DataFrame:
    """``chunk``, its number of tokens, its ids, and its packed held-out flags, lengths, word hashes and token numbers."""
    _util.ship(docs.sparkSession)
    kind = docs.select(_util.col(id_col).alias("id")).schema["id"].dataType

    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 24
        ids, held, lens, parts, numbers, size = [], [], [], [], _Numbers(), 0

        def out():
            nonlocal number
            hashes = np.fromiter((word_hash(w) for w in numbers), dtype=np.uint64, count=len(numbers))
            raw = b"".join([np.array([len(ids), len(hashes)], dtype=np.int64).tobytes(), np.array(held, dtype=bool).tobytes(), np.array(lens, dtype=np.int64).tobytes(), hashes.tobytes(), np.concatenate(parts).astype(np.int32).tobytes()])
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids))
            made = pa.RecordBatch.from_arrays([pa.array([number], type=pa.int64()), pa.array([sum(lens)], type=pa.int64()), listed, pa.array([zstandard.compress(raw, 1)], type=pa.binary())], names=["chunk", "tokens", "ids", "payload"])
            number += 1
            return made

        for whole in batches:
            for at, (i, t) in enumerate(zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True)):
                words = tokens_of(t)
                parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                ids.append(whole.column(0).slice(at, 1))
                held.append(is_held_out(i, m))
                lens.append(len(words))
                size += len(t or "") + 1
                if size > m.chunk_mb * 1e6:
                    yield out()
                    ids, held, lens, parts, numbers, size = [], [], [], [], _Numbers(), 0
        if ids:
            yield out()
        pa.default_memory_pool().release_unused()

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("payload", T.BinaryType())])
    return _util.save(docs.select(_util.col(id_col).alias("id"), F.col("text").cast("string")).mapInArrow(run, schema), "chunks")


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Chunk:
    """An unpacked chunk: texts, and the distinct (word, context) pairs of its tokens, in that order.

    Words are in the order of their hashes, the start among them; ``order`` is that of the pairs' hashes.
    """

    def __init__(self, payload: bytes):
        raw, at = zstandard.decompress(payload), 16
        n, v = np.frombuffer(raw, np.int64, 2)

        def take(kind, count):
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        self.held, self.lens, hashes = take(bool, n), take(np.int64, n), take(np.uint64, v)
        self.hashes, place = np.unique(np.append(hashes, START), return_inverse=True)
        tokens = place[take(np.int32, int(self.lens.sum()))].astype(np.int64)
        context = np.empty(len(tokens), dtype=np.int64)
        context[1:] = tokens[:-1]
        self.starts = np.cumsum(self.lens) - self.lens
        context[self.starts] = place[-1]
        keys, pair_of = np.unique(tokens << 32 | context, return_inverse=True)
        self.pair_of, self.word, self.context = pair_of, keys >> 32, keys & 0xFFFFFFFF
        self.key = pair_hash(self.hashes[self.word], self.hashes[self.context])
        self.order = np.argsort(self.key, kind="stable")
        self.trained = np.bincount(pair_of, weights=np.repeat(~self.held, self.lens), minlength=len(keys)).astype(np.int64)

    def counted(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """What the ranges say of the pairs: training counts, and whether this chunk's pair counts for all."""
        _, _, (n, own) = received(replies, np.int64, bool)
        out = np.empty_like(n), np.empty_like(own)
        out[0][self.order], out[1][self.order] = n, own
        return out


BLOBS = "to long, source long, blob binary"


def sent(number: int, keys: np.ndarray, values: list[np.ndarray], buckets: int) -> pa.Table:
    """Sorted ``keys`` and their values, a row for each range of keys that has some."""
    step = (1 << 64) // buckets + 1
    edges = np.searchsorted(keys, np.array([k * step for k in range(1, buckets)], dtype=np.uint64))
    edges = np.concatenate([[0], edges, [len(keys)]])
    to = np.nonzero(np.diff(edges))[0]
    blobs = [pack(np.diff(keys[a:b], prepend=np.uint64(0)), *[v[a:b] for v in values]) for a, b in zip(edges[to], edges[to + 1], strict=True)]
    return pa.table({"to": pa.array(to, pa.int64()), "source": pa.array(np.full(len(to), number), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def received(rows: pa.Table, *kinds) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Sources, lengths and joined arrays of the blobs, in the order of their sources."""
    rows = rows.sort_by("source")
    got = [unpack(b, *kinds) for b in rows.column("blob").to_pylist()]
    return rows.column("source").to_pylist(), [len(g[0]) for g in got], [np.concatenate(x) for x in zip(*got, strict=True)]


def merged(rows: pa.Table, values: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sources, edges of their rows, distinct keys, each row's number among these, and the rows' values."""
    rows = rows.sort_by("source")
    got = [unpack(b, np.uint64, *[np.int64] * values) for b in rows.column("blob").to_pylist()]
    keys, number = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), return_inverse=True)
    edges = np.cumsum([0, *[len(g[0]) for g in got]])
    return rows.column("source").to_pylist(), edges, keys, number, [np.concatenate(x) for x in list(zip(*got, strict=True))[1:]]


def pair_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """To each chunk, for its pairs in order: the training count in all chunks, and whether it is the first with the pair."""

    def send(batches):
        for b in batches:
            for number, payload in zip(b.column(0), b.column(1), strict=True):
                c = Chunk(payload.as_py())
                yield from sent(number.as_py(), c.key[c.order], [c.trained[c.order]], buckets).to_batches()

    def count(rows: pa.Table) -> pa.Table:
        bucket = rows.column("to")[0].as_py()
        sources, edges, keys, number, (n,) = merged(rows, 1)
        total = np.bincount(number, weights=n).astype(np.int64)[number]
        first = np.zeros(len(number), dtype=bool)
        first[np.unique(number, return_index=True)[1]] = True
        blobs = [pack(total[a:b], first[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.table({"to": pa.array(sources, pa.int64()), "source": pa.array([bucket] * len(sources), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return _util.save(chunks.select("chunk", "payload").mapInArrow(send, BLOBS).groupBy("to").applyInArrow(count, BLOBS), "counts")


STATE = (np.uint64, *[np.int64] * 6, np.int32, np.int32, np.int64, bool)
OWN = -1  # the source of what a chunk keeps for itself


def states(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """What sweeps need of each chunk: words and sums over the pairs that count for all; pairs seen twice or more.

    Beside it how many of the pairs that count for all were seen once and twice.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = left.column("chunk").to_pylist()
        blobs, ones, twos = [], [], []
        for payload in left.column("payload").to_pylist():
            c = Chunk(payload)
            n, own = c.counted(right)
            v, many = len(c.hashes), n > 1
            add = lambda at, x, v=v: np.bincount(at, weights=x, minlength=v).astype(np.int64)
            once, own_n, t = (n == 1) & own, n * own, np.minimum(n, 1) * own
            sums = [add(at, x) for x in (once, own_n, t) for at in (c.word, c.context)]
            blobs.append(pack(c.hashes, *sums, np.diff(c.word[many].astype(np.int32), prepend=np.int32(0)), c.context[many].astype(np.int32), n[many], own[many]))
            ones.append(int(once.sum()))
            twos.append(int(((n == 2) & own).sum()))
        return pa.table({"to": pa.array(numbers, pa.int64()), "source": pa.array([OWN] * len(numbers), pa.int64()), "blob": pa.array(blobs, pa.binary()), "ones": pa.array(ones, pa.int64()), "twos": pa.array(twos, pa.int64())})

    return _util.save(chunks.select("chunk", "payload").groupBy("chunk").cogroup(counts.groupBy("to")).applyInArrow(run, f"{BLOBS}, ones long, twos long"), "states")


REPLY = f"{BLOBS}, rt double, rc double, v long, n long, ones long, twos long"


def word_round(state: DataFrame, before: DataFrame | None, known: tuple, s: int, base: float, buckets: int, m: Model) -> tuple[DataFrame, tuple]:
    """To each chunk, for its words: tables and customers as a context, training count, root customers and tables.

    Before any sweep each pair has one table. A chunk also keeps the tables of its pairs (source ``OWN``). Beside it
    the sums of root tables and customers, vocabulary, tokens, and words with one and two root customers.
    """

    def send(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        number = left.column("to")[0].as_py()
        hashes, once_w, once_c, n_w, n_c, t_w, t_c, word, context, n, own = unpack(left.column("blob")[0].as_py(), *STATE)
        if right is None:
            t, values = np.ones(len(n), dtype=np.int32), [t_c, t_w, n_c, n_w]
            customers = counts = np.zeros(0, dtype=np.int64)
        else:
            word = np.cumsum(word)
            t, customers, counts, tables, rc, rt = kept(right)
            totals = Totals(tables, customers, *known)
            p = totals.root(rc, rt, base, m)
            t = totals.seat(n, t, context, p[word], pair_hash(hashes[word], hashes[context]) + _steps(1000 * (s + 1)), m)
            values = [once + np.bincount(at, weights=t * own, minlength=len(hashes)).astype(np.int64) for once, at in ((once_c, context), (once_w, word))]
        # What is its own goes by a number of its own beyond the ranges.
        mine = pa.table({"to": pa.array([buckets + number], pa.int64()), "source": pa.array([number], pa.int64()), "blob": pa.array([pack(t.astype(np.int32), customers, counts)], pa.binary())})
        return pa.concat_tables([sent(number, hashes, values, buckets), mine])

    def reply(rows: pa.Table) -> pa.Table:
        bucket = rows.column("to")[0].as_py()
        if bucket >= buckets:
            sources, blobs, sums = [bucket - buckets], rows.column("blob").to_pylist(), (0.0, 0.0, 0, 0, 0, 0)
            bucket = OWN
        else:
            sources, edges, keys, number, values = merged(rows, 4 if s < 0 else 2)
            tables, rc, *more = (np.bincount(number, weights=x).astype(np.int64) for x in values)
            rt = np.minimum(rc, 1) if s < 0 else Totals(tables, tables, *known).seat_root(keys, rc, s, base, m)
            blobs = [pack(*[x[number[a:b]] for x in (tables, rc, rt, *more)]) for a, b in zip(edges, edges[1:])]
            n = more[1] if more else np.zeros(0, np.int64)
            sums = float(rt.sum()), float(rc.sum()), int((n > 0).sum()), int(n.sum()), int((rc == 1).sum()), int((rc == 2).sum())
        only = lambda x: pa.array([x] + [type(x)(0)] * (len(blobs) - 1), pa.float64() if isinstance(x, float) else pa.int64())
        head = {"to": pa.array(sources, pa.int64()), "source": pa.array([bucket] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())}
        return pa.table(head | {k: only(x) for k, x in zip(("rt", "rc", "v", "n", "ones", "twos"), sums, strict=True)})

    first = before is None
    rows = state.select("to", "blob").groupBy("to").applyInArrow(lambda t: send(t), BLOBS) if first else state.select("to", "blob").groupBy("to").cogroup(before.select("to", "source", "blob").groupBy("to")).applyInArrow(lambda a, b: send(a, b), BLOBS)
    made = _util.save(rows.groupBy("to").applyInArrow(reply, REPLY), f"words-{s + 1}")
    return made, tuple(x or 0 for x in made.agg(*[F.sum(x) for x in ("rt", "rc", "v", "n", "ones", "twos")]).first())


def kept(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """A chunk's own tables; and for its words customers as a context, training counts, tables as a context, root customers and tables.

    Customers and counts come from the ranges once, and are a chunk's own from then on.
    """
    own = rows.column("source").to_numpy() == OWN
    mine, sent_here = rows.filter(pa.array(own)).column("blob")[0].as_py(), rows.filter(pa.array(~own))
    t, *known = unpack(mine, np.int32, *[np.int64] * 2)
    _, _, (tables, rc, rt, *first) = received(sent_here, *[np.int64] * (3 if len(known[0]) else 5))
    customers, counts = first or known
    return t.astype(np.int64), customers, counts, tables, rc, rt


def score(docs: DataFrame, m: Model = Model(), id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``."""
    if not 0 <= m.burn_in < m.sweeps:
        raise ValueError("burn_in must be below sweeps")
    chunks = chunk_table(docs, m, id_col)
    buckets = max(1, -(-(chunks.agg(F.sum("tokens")).first()[0] or 0) // m.range_tokens))
    counts = pair_counts(chunks, buckets)
    state = states(chunks, counts)
    made, (rt, rc, vocabulary, n_tokens, ones, twos) = word_round(state, None, (0.0, 0.0), -1, 0.0, buckets, m)
    seen = state.agg(F.sum("ones"), F.sum("twos")).first()
    m = replace(
        m, discount=fitted(seen[0] or 0, seen[1] or 0) if m.discount is None else m.discount,
        root_discount=fitted(ones, twos) if m.root_discount is None else m.root_discount,
    )
    base, replies, known = 1.0 / (vocabulary + 1), [made], [(rt, rc)]
    for s in range(m.sweeps):
        made, sums = word_round(state, replies[-1], known[-1], s, base, buckets, m)
        if s <= m.burn_in:  # what the result does not read goes at once
            _util.drop(replies[-1])
        replies.append(made)
        known.append(sums[:2])
    _util.drop(state)
    right = counts.withColumn("round", F.lit(0))
    for k in range(m.burn_in + 1, m.sweeps + 1):
        right = right.unionByName(replies[k].select("to", "source", "blob", F.lit(k).alias("round")))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left.column("payload")[0].as_py())
        of_round = lambda k: right.filter(pa.array(right.column("round").to_numpy() == k))
        n, _ = c.counted(of_round(0))
        total, t, many = np.zeros(len(n)), np.minimum(n, 1), n > 1
        for k in range(m.burn_in + 1, m.sweeps + 1):
            t[many], customers, count, tables, rc, rt = kept(of_round(k))
            after = Totals(tables, customers, *known[k])
            total += after.leaf(n, t, c.context, after.root(rc, rt, base, m)[c.word], m)
        count = count[c.word]
        logp, base_log = np.log10(total / (m.sweeps - m.burn_in)), np.log10((count + 1) / (n_tokens + vocabulary + 1))
        sums = [np.add.reduceat(x[c.pair_of], c.starts) for x in (logp, base_log, (count > 0).astype(np.int64))]
        return pa.table({
            "id": left.column("ids").combine_chunks().flatten(), "held_out": pa.array(c.held), "n_tokens": pa.array(c.lens), "n_known": pa.array(sums[2]),
            "train_tokens": pa.array(np.full(len(c.lens), n_tokens, dtype=np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[0]), "perplexity": pa.array(10 ** np.minimum(300, -sums[0] / c.lens)),
        })

    kinds = {"held_out": T.BooleanType(), "n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType(), "perplexity": T.DoubleType()}
    schema = T.StructType([T.StructField("id", chunks.schema["ids"].dataType.elementType), *[T.StructField(k, v) for k, v in kinds.items()]])
    return chunks.select("chunk", "ids", "payload").groupBy("chunk").cogroup(right.groupBy("to")).applyInArrow(finish, schema).withColumnRenamed("id", id_col)
