"""Near-duplicate documents by DartMinHash over five-word shingles.

A text is the weighted set of its shingles (hashes of five lower-cased words; weight: how often). Hashed darts are
thrown into each element's region of weight and rank: the plane is cut into fixed cells, a Poisson number of darts falls
into each by the cell's own hash, and a text keeps the darts below its weights. The dart of least rank in each of
``coordinates`` makes a signature that two texts share, per coordinate, with the probability of their weighted Jaccard
similarity. Signatures are joined in bands and every link is verified exactly.

Copies (equal shingle sets) are one node from the start, whatever their ids. In a bucket each node is compared with the
bucket's most central one, not with all others; nodes that are still outside the bucket's largest component after that
are compared with its nodes in blocks, so no link of a shared bucket is lost and pairs that are no links are never rows.
Components are found by distributed label propagation.

Defined results: texts without words are their own class of one; texts of one to four words are one shingle; every row has
the class of its own text, so rows of one id with different texts may differ; rows without an id take part, and a class
that has no other has a null id; of a class's rows the one of least id (and hash of the text) stands for it, with all that
are alike in id and text; an empty table gives no rows; extra columns pass through or are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util


@dataclass(frozen=True)
class Near:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5
    block_bytes: int = 1 << 20  # shingle sets of a bucket that are compared with as many others in one go
    broadcast_bytes: int = 16 << 20  # keys of rows up to this size are broadcast; beyond, the join shuffles

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TURNS = np.array([pow(0x100000001B3, i, 1 << 64) | 1 for i in range(1, 17)], dtype=np.uint64)
FLOOR = 0.125  # height of the lowest rank cells


def _steps(n: int) -> np.uint64:
    """``n`` golden steps, modulo 2**64."""
    return np.uint64(0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Shingler:
    MEMORY = 300_000

    def __init__(self, words: int):
        self.words, self.memory = words, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes and their counts."""
        words, memory = (text or "").lower().split(), self.memory
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for w in set(words).difference(memory):
            memory[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        codes = np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=n)
        if len(memory) > self.MEMORY:
            memory.clear()
        k = min(n, self.words)
        total = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            total += mix(codes[i : n - k + 1 + i] + _TURNS[i]) * _TURNS[i]
        return np.unique(mix(total), return_counts=True)


def _poisson_tables() -> dict[float, np.ndarray]:
    out = {}
    for mean in (1.0, 0.5, 0.25, 0.125):
        p = [math.exp(-mean) * mean**i / math.factorial(i) for i in range(18)]
        out[mean] = np.cumsum(p)
    return out


_POISSON = _poisson_tables()


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Signatures (sets x k) of weighted sets that lie end to end; ``sizes`` counts each set's elements, all positive.

    Ranks are searched up to a height at which about k ln k + 2 k darts are expected; sets with an empty coordinate
    are searched again up to twice that height, which cannot change a coordinate that is filled.
    """
    n = len(sizes)
    out = np.zeros((n, k), dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    totals = np.add.reduceat(weights.astype(np.float64), starts)
    height = (k * math.log(k) + 2 * k) / totals
    todo = np.arange(n)
    while len(todo):
        number = sizes[todo]
        at = np.repeat(starts[todo] - (np.cumsum(number) - number), number) + np.arange(number.sum())
        owner = np.repeat(np.arange(len(todo)), number)
        where, rank, dart = _throw(elements[at], weights[at].astype(np.float64), owner, height[todo][owner], k)
        order = np.lexsort((dart, rank, where))
        where, dart = where[order], dart[order]
        first = np.ones(len(where), dtype=bool)
        first[1:] = where[1:] != where[:-1]
        found = np.zeros((len(todo), k), dtype=bool)
        found.ravel()[where[first]] = True
        rows = np.zeros((len(todo), k), dtype=np.uint64)
        rows.ravel()[where[first]] = dart[first]
        full = found.all(axis=1)
        out[todo[full]] = rows[full]
        todo = todo[~full]
        height[todo] *= 2
    return out


def _throw(e: np.ndarray, w: np.ndarray, owner: np.ndarray, height: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner * k + coordinate, rank, dart) of all darts below each element's weight and height."""
    wheres, ranks, darts = [], [], []
    low_w, wide, layer = 0.0, 1.0, 0
    while (in_w := np.nonzero(w > low_w)[0]).size:
        low_r, tall, level = 0.0, FLOOR, 0
        while (at := in_w[height[in_w] > low_r]).size:
            area = wide * tall
            parts = max(1, int(area))
            part_tall = tall / parts
            if parts > 1:  # cells of area one, one above the other
                need = np.minimum(parts, np.ceil((height[at] - low_r) / part_tall)).astype(np.int64)
                part = np.arange(need.sum()) - np.repeat(np.cumsum(need) - need, need)
                at = np.repeat(at, need)
            else:
                part = np.zeros(len(at), dtype=np.int64)
            cell = mix(e[at] + _steps(((layer * 64 + level) << 24) + 1) + mix(part.astype(np.uint64) + _GOLD))
            count = np.searchsorted(_POISSON[min(1.0, area)], unit(mix(cell ^ _M1)), side="right")
            r = 0
            while (hit := np.nonzero(count > r)[0]).size:
                dart = mix(cell[hit] + _steps(r + 2))
                up = low_w + wide * unit(mix(dart ^ _M2))
                rank = low_r + (part[hit] + unit(mix(dart + _M1))) * part_tall
                own = at[hit]
                inside = (up < w[own]) & (rank < height[own])
                coordinate = (mix(dart + _M2) % np.uint64(k)).astype(np.int64)
                wheres.append((owner[own] * k + coordinate)[inside])
                ranks.append(rank[inside])
                darts.append(dart[inside])
                r += 1
            low_r, tall, level = low_r + tall, (tall if level == 0 else tall * 2), level + 1
        low_w, wide, layer = low_w + wide, (wide if layer == 0 else wide * 2), layer + 1
    return np.concatenate(wheres), np.concatenate(ranks), np.concatenate(darts)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
    for i in range(rows):
        total = mix(total + parts[:, :, i])
    return total.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][ia], b[1][ib]).sum()
    union = a[1].sum() + b[1].sum() - shared
    return float(shared / union) if union else 0.0


def _chunks(sizes: list[int], most: int):
    """Runs of sets with at most ``most`` elements together, one set at least."""
    a, total = 0, 0
    for i, s in enumerate(sizes):
        if i > a and total + s > most:
            yield a, i
            a, total = i, 0
        total += s
    if sizes:
        yield a, len(sizes)


def _digest(shape: tuple[np.ndarray, np.ndarray]) -> list:
    """128 bits of a shingle set; nulls for none."""
    if not len(shape[0]):
        return [None, None]
    return np.frombuffer(hashlib.blake2b(shape[0].tobytes() + shape[1].astype(np.int64).tobytes(), digest_size=16).digest(), dtype=np.int64).tolist()


def _keyed(docs: DataFrame, id_col: str, *more) -> DataFrame:
    return docs.select(*more, _util.col(id_col).alias("_id"), F.col("text").cast("string").alias("text")).withColumn("_t", _util.row_hash(F.col("text")))


def signature_rows(docs: DataFrame, id_col: str = "doc_id", near: Near = Near()) -> DataFrame:
    """``_id``, ``_t`` (hash of the text), the digest of the shingle set (``d1``, ``d2``), its weight and band hashes."""
    found: list[Shingler] = []

    def run(texts: list) -> list[pa.Array]:
        if not found:
            found.append(Shingler(near.words))
        sets = [found[0](t) for t in texts]
        some = [i for i, s in enumerate(sets) if len(s[0])]
        bands: list = [None] * len(sets)
        for a, b in _chunks([len(sets[i][0]) for i in some], 60_000):
            part = [sets[i] for i in some[a:b]]
            sig = signatures(np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part]), np.array([len(p[0]) for p in part]), near.coordinates)
            for i, row in zip(some[a:b], band_hashes(sig, near.bands, near.rows), strict=True):
                bands[i] = row
        digests = [_digest(s) for s in sets]
        return [
            pa.array([d[0] for d in digests], type=pa.int64()), pa.array([d[1] for d in digests], type=pa.int64()),
            pa.array([int(s[1].sum()) for s in sets], type=pa.int64()), pa.array(bands, type=pa.list_(pa.int64())),
        ]

    fields = [T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return _util.map_columns(_keyed(docs, id_col), run, fields, ["_id", "_t"])


def _small(rows: DataFrame, near: Near) -> bool:
    """Whether rows of an ``_id`` and a few numbers may be broadcast."""
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length(F.col("_id").cast("string")))).first()
    return 64 * count + (size or 0) <= near.broadcast_bytes


def _shapes(docs: DataFrame, wanted: DataFrame, id_col: str, near: Near) -> DataFrame:
    """``node`` and its shingle set as bytes, for the wanted rows (``node``, ``_id``, ``_t``, ``d1``, ``d2``)."""
    found: list[Shingler] = []

    def run(texts: list) -> list[pa.Array]:
        if not found:
            found.append(Shingler(near.words))
        sets = [found[0](t) for t in texts]
        digests = [_digest(s) for s in sets]
        return [
            pa.array([s[0].tobytes() for s in sets], type=pa.binary()), pa.array([s[1].astype(np.int32).tobytes() for s in sets], type=pa.binary()),
            pa.array([d[0] for d in digests], type=pa.int64()), pa.array([d[1] for d in digests], type=pa.int64()),
        ]

    of = wanted.select("node", "d1", "d2", F.col("_id").alias("_of"), F.col("_t").alias("_of_t"))
    of = F.broadcast(of) if _small(wanted, near) else of.hint("merge")
    some = _keyed(docs, id_col).join(of, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_t") == F.col("_of_t")))
    fields = [T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("e1", T.LongType()), T.StructField("e2", T.LongType())]
    made = _util.map_columns(some, run, fields, ["node", "d1", "d2"]).filter("d1 = e1 and d2 = e2")
    return made.groupBy("node").agg(F.min(F.struct("hashes", "counts")).alias("shape"))


def _verified(pairs: DataFrame, shapes: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    _util.ship(pairs.sparkSession)
    least = near.similarity

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ok = []
                for a_h, a_c, b_h, b_c in zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True):
                    one = np.frombuffer(a_h, np.uint64), np.frombuffer(a_c, np.int32)
                    two = np.frombuffer(b_h, np.uint64), np.frombuffer(b_c, np.int32)
                    ok.append(weighted_jaccard(one, two) >= least - 1e-12)
                yield b.select([0, 1]).filter(pa.array(ok, type=pa.bool_()))

    one, two = (shapes.select(F.col("node").alias(x), F.col("shape.hashes").alias(f"{x}h"), F.col("shape.counts").alias(f"{x}c")) for x in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ah", "ac", "bh", "bc").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) of an edge table (a, b).

    Each step takes the least label among the neighbours and then the label's own label, which halves the way left.
    """
    both = _util.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = _util.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("got"))
        jump = labels.select(F.col("node").alias("got"), F.col("label").alias("further"))
        new = _util.save(
            step.join(jump, "got", "left").select("node", F.least("got", F.coalesce("further", "got")).alias("label"), (F.least("got", F.coalesce("further", "got")) != F.col("label")).alias("moved")), "labels"
        )
        moved = new.filter("moved").limit(1).count()
        _util.drop(labels)
        labels = new.select("node", "label")
        if not moved:
            _util.drop(both)
            return labels


def expanded(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weighted set as a plain set: an element of weight c is c different ones."""
    if (counts == 1).all():
        return hashes
    turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.repeat(hashes, counts)
    return np.where(turn > 0, mix(out + turn.astype(np.uint64) * _GOLD), out)


def block_links(one: list[np.ndarray], two: list[np.ndarray], least: float) -> np.ndarray:
    """Which of ``one`` (rows) and ``two`` (columns), plain sets, have at least this Jaccard similarity; exact."""
    sizes = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    names, place = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(two)), np.concatenate(sizes))
    left = row < len(one)
    both = (np.bincount(place[left], minlength=len(names)) > 0) & (np.bincount(place[~left], minlength=len(names)) > 0)
    keep = both[place]  # what only one side has is in no intersection
    place, row = (np.cumsum(both) - 1)[place[keep]], row[keep]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    shared, step = np.zeros((len(one), len(two))), max(64, (1 << 22) // (len(one) + len(two)))
    for low in range(0, int(both.sum()), step):  # dense counts of a slice of the elements at a time
        here = slice(*np.searchsorted(place, [low, low + step]))
        dense = np.zeros((len(one) + len(two), step), dtype=np.float32)
        dense[row[here], place[here] - low] = 1
        shared += dense[: len(one)] @ dense[len(one) :].T
    return shared >= (least - 1e-12) * (sizes[0][:, None] + sizes[1][None, :] - shared)


def _left_links(members: DataFrame, labels: DataFrame, shapes: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) of one bucket between different components.

    Nodes outside a bucket's largest component are compared with all its nodes in blocks of at most about
    ``near.block_bytes`` each side, which travel as blocks: pairs that are no links are never rows.
    """
    placed = _util.save(members.select("bucket", "node", "weight", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    parts = placed.groupBy("bucket", "label", "n").agg(F.count("*").alias("size"), F.sum("weight").alias("w"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("size", "label", "w")).alias("big"), F.max("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("parts")).filter("parts > 1 and n > 2")
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w * 12 / F.lit(near.block_bytes))).cast("int")  # noqa: E731  12 bytes an element at most
    open_ = _util.save(open_.select("bucket", F.col("big.label").alias("big"), blocks(F.col("w") - F.col("big.w")).alias("ub"), blocks(F.col("w")).alias("mb")), "open-buckets")
    rows = placed.select("bucket", "node", "label").join(open_, "bucket").withColumn("h", F.xxhash64("node", F.lit("block")))
    own = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter("label <> big").select("bucket", own("ub").alias("u"), every("mb").alias("m"), F.lit(0).alias("side"), "node", "label")
    right = rows.select("bucket", every("ub").alias("u"), own("mb").alias("m"), F.lit(1).alias("side"), "node", "label")
    key = ["bucket", "u", "m"]
    whole = left.unionByName(right).join(shapes.select("node", F.col("shape.hashes").alias("hashes"), F.col("shape.counts").alias("counts")), "node")
    dealt = whole.select(*key, "side", "node", "label", "hashes", "counts").repartition(*key).sortWithinPartitions(*key, "side", "node")
    least = near.similarity
    _util.ship(members.sparkSession)

    def links(group: list[tuple]) -> list[tuple[int, int]]:
        one, two = [r for r in group if r[3] == 0], [r for r in group if r[3] == 1]
        if not one or not two:
            return []
        sets = [[expanded(np.frombuffer(r[6], np.uint64), np.frombuffer(r[7], np.int32)) for r in side] for side in (one, two)]
        found, seen = [], set()
        for i, j in np.argwhere(block_links(*sets, least)).tolist():
            (u, lu), (v, lv) = one[i][4:6], two[j][4:6]
            if lu != lv and (u, lv) not in seen:  # one link to a component is enough
                seen.add((u, lv))
                found.append((min(u, v), max(u, v)))
        return found

    def run(batches):
        group: list[tuple] = []
        for whole in batches:
            out = []
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                for r in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if group and group[0][:3] != r[:3]:
                        out += links(group)
                        group = []
                    group.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = links(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _classes(docs: DataFrame, id_col: str, near: Near) -> DataFrame:
    """A row for each of ``docs``: ``_id``, ``_t``, ``class_id``, ``stands`` (for its class) and ``class_size``."""
    signed = _util.save(signature_rows(docs, id_col, near), "signatures", stays=True)
    with _util.scratch():
        class_of = _util.save(_class_of(docs, signed, id_col, near), "class-of", stays=True)
    own = F.col("d1").isNull()
    joined = signed.select("_id", "_t", "d1", "d2").join(class_of, ["d1", "d2"], "left")
    stands = own | (F.col("_id").eqNullSafe(F.col("front._id")) & F.col("_t").eqNullSafe(F.col("front._t")))
    return joined.select("_id", "_t", F.when(own, F.col("_id")).otherwise(F.col("front._id")).alias("class_id"), stands.alias("stands"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def _class_of(docs: DataFrame, signed: DataFrame, id_col: str, near: Near) -> DataFrame:
    """``d1``, ``d2``, ``front`` (the row that stands for the class) and ``class_size``."""
    front = F.struct(F.col("_id").isNull().alias("none"), "_id", "_t")  # rows with an id come first
    copies = signed.filter("d1 is not null").groupBy("d1", "d2").agg(F.min(front).alias("front"), F.count("*").alias("rows"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    copies = _util.save(copies.withColumn("node", F.monotonically_increasing_id()), "copies")  # numbered once, by being saved
    rows = copies.select(F.explode("bands").alias("bucket"), "node", "weight")
    shared = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    # Sides that hold one row for each key are saved before a join, so that Spark can split a key with many rows beside them.
    members = _util.save(rows.join(_util.save(shared.select("bucket", "n"), "buckets"), "bucket"), "members")
    # A bucket's hub is its most central node: the one that meets most others in all its buckets together.
    central = _util.save(members.groupBy("node").agg(F.sum("n").alias("score")), "central")
    hubs = members.select("bucket", "node").join(central, "node").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("best"))
    hubs = _util.save(hubs.select("bucket", (-F.col("best.minus")).alias("hub")), "hubs")
    wanted = copies.select("node", "front._id", "front._t", "d1", "d2").join(central, "node", "left_semi")
    shapes = _util.save(_shapes(docs, wanted, id_col, near), "shapes")
    pairs = members.select("bucket", "node").join(hubs, "bucket").filter("node <> hub")
    pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    edges = _util.save(_verified(pairs, shapes, near), "links")
    labels = components(edges)
    extra = _util.save(_left_links(members, labels, shapes, near), "links")
    if extra.limit(1).count():
        labels = components(edges.union(extra))

    # What every class has, by its label: the row that stands for it and its number of rows; then by each shingle set.
    labelled = copies.select("d1", "d2", "front", "rows", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = _util.save(labelled.groupBy("label").agg(F.min("front").alias("front"), F.sum("rows").alias("class_size")), "class-sizes")
    return labelled.select("d1", "d2", "label").join(per, "label").select("d1", "d2", "front", "class_size")


def classes(docs: DataFrame, id_col: str = "doc_id", near: Near = Near()) -> DataFrame:
    """One row per document: ``id_col``, ``class_id`` (least id of the class), ``is_representative``, ``class_size``."""
    return _classes(docs, id_col, near).select(F.col("_id").alias(id_col), "class_id", F.col("stands").alias("is_representative"), "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", near: Near = Near()) -> DataFrame:
    """The rows of ``docs`` that stand for their classes, columns unchanged."""
    gone = _util.save(_classes(docs, id_col, near).filter("not stands").select("_id", "_t").distinct(), "gone")
    side = gone.select(F.col("_id").alias("_of"), F.col("_t").alias("_of_t"))
    side = F.broadcast(side) if _small(gone, near) else side.hint("merge")
    rows = _keyed(docs, id_col, F.struct(*[_util.col(c).alias(c) for c in docs.columns]).alias(_util.KEPT))
    return _util.unpacked(rows.join(side, F.col("_id").eqNullSafe(F.col("_of")) & F.col("_t").eqNullSafe(F.col("_of_t")), "left_anti"), docs.columns)
