"""Classifiers, near-duplicates, the language model and the pipeline."""

import itertools
import math
import zlib
from collections import Counter
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from runstore.llm import dart_minhash, lm_score, quality_fm, queries, toxicity

from .test_text_ops import ODD, docs

DATA = Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_pairwise_part_is_the_double_sum():
    rng = np.random.default_rng(3)
    m = quality_fm.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    slots, x = np.array([1, 5, 7, 19]), rng.normal(size=4)
    slow = 0.3 + sum(m.linear[i] * v for i, v in zip(slots, x)) + sum(m.factors[a] @ m.factors[b] * x[i] * x[j] for (i, a), (j, b) in itertools.combinations(enumerate(slots), 2))
    assert math.isclose(m.logits([(slots, x)])[0], slow)
    assert np.allclose(m.logits([(slots, x), (slots[:1], x[:1])]), [slow, 0.3 + m.linear[1] * x[0]])


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b]), np.ones(2)))
        y.append(float(a ^ b))
    m = quality_fm.train(rows, np.array(y), 4, 0.5, quality_fm.Settings(epochs=60))
    assert np.mean((m.scores(rows) > 0.5) == np.array(y)) > 0.95


def test_classifiers_take_odd_rows_and_missing_labels(spark):
    df, none = docs(spark, ODD), labels(spark, [])
    some = labels(spark, [(i, i % 2, i % 2) for i in range(len(ODD))] + [(None, 1, 1), (3, None, None)])
    for lab in (none, some):
        machine = quality_fm.fit(df, lab)
        rows = quality_fm.score(df.unionByName(df), machine, ["doc_id", "class_id"], name="q").collect()
        assert len(rows) == 2 * len(ODD) and all(0 <= r.q <= 1 for r in rows)
        model = toxicity.fit(df, lab)
        rows = toxicity.score(df, model, ["doc_id"]).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert quality_fm.score(df.limit(0), machine, ["doc_id"]).count() == 0 == toxicity.score(df.limit(0), model, ["doc_id"]).count()
        assert quality_fm.keep_good(df, machine).columns == df.columns


def test_toxicity_catches_words_anywhere_and_misspellings():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts, y = [], []
    for i in range(240):
        words = [word() for _ in range(rng.integers(20, 300))]
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.integers(len(words)), str(rng.choice(["zonkers", "kworble", "vexunto"])))
        texts.append(" ".join(words))
        y.append(int(i % 3 == 0))
    model = toxicity.train(texts[:180], np.array(y[:180]), 0.3)
    score = toxicity.Scorer(model.gram_logits(), model.offset, toxicity.Settings())
    assert np.mean([(score(t) >= 0.5) == v for t, v in zip(texts[180:], y[180:])]) > 0.85
    clean = " ".join(word() for _ in range(40))
    assert score(clean + " zonkerz kworbles zonkers") > score(clean)
    assert 0 <= score("") <= 1 and 0 <= score("x" * 500) <= 1


def test_repeated_words_count_once_in_a_window():
    assert toxicity.fresh(np.array([1, 1, 2, 1, 3, 3, 1]), 3).tolist() == [True, False, True, False, True, False, True]
    assert toxicity.fresh(np.zeros(0, dtype=np.int64), 3).tolist() == []
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = [" ".join([word() for _ in range(60)] + ["zonkers"] * (i % 3 == 0)) for i in range(240)]
    y = np.array([int(i % 3 == 0) for i in range(240)])
    models = [toxicity.train(texts, y, rate) for rate in (1 / 3, 0.05)]
    score = toxicity.Scorer(models[0].gram_logits(), models[0].offset, toxicity.Settings())
    assert max(score(" ".join([w] * 40)) for w in texts[1].split()[:30]) < 0.5 < score(texts[0])
    assert models[1].offset < models[0].offset  # the labels' share of ones, not the sample's


def test_best_passage_is_the_best_of_all_starts():
    rng = np.random.default_rng(7)
    for n in (1, 15, 16, 17, 24, 100):
        logits = rng.normal(size=n)
        a, b, mean = toxicity.best_passage(logits, 16)
        assert b - a == min(n, 16) and math.isclose(mean, max(logits[k : k + 16].mean() for k in range(max(1, n - 15))))
    assert toxicity.best_passage(np.repeat([0.0, 1.0, 0.0], [4, 16, 20]), 16) == (4, 20, 1.0)


def test_bags_hold_every_ngram():
    s = toxicity.Settings()
    flat, lens = toxicity.bags(["ab", "abcd", "!!"], s)
    count = lambda n: sum(max(0, n - k + 1) for k in range(3, 6)) + 1
    assert lens.tolist() == [count(4), count(6), count(4)] and len(flat) == lens.sum()
    assert toxicity.bags([], s)[1].tolist() == []


@needs_data
def test_quality_scores_by_plain_python(spark):
    """The query's scores from features counted with dictionaries and all pairs of them."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    m = quality_fm.fit(d, spark.read.parquet(f"{DATA}/labels.parquet"), 4, 2)
    got = {r.doc_id: r.score for r in queries.op5_quality_fm(spark, str(DATA)).collect()}
    linear, factors, slots = m.linear.astype(np.float32), m.factors.astype(np.float32), quality_fm.Settings().word_slots
    for r in d.orderBy("n_chars").limit(25).collect():
        words = (r.text or "").split()
        count = Counter(zlib.crc32(w.encode("utf-8", "replace")) % slots for w in words)
        size = math.sqrt(sum(math.log1p(c) ** 2 for c in count.values())) or 1
        x = [(k, math.log1p(c) / size) for k, c in count.items()]
        for i, v in enumerate(quality_fm.statistics(r.text or "", words)):
            x.append((slots + i * quality_fm.BINS + min(quality_fm.BINS - 1, int(math.sqrt(min(1, max(0, v))) * quality_fm.BINS)), 1.0))
        x.append((slots + quality_fm.STATS * quality_fm.BINS + min(31, int(r.n_chars).bit_length()), 1.0))
        z = m.bias + sum(float(linear[k]) * v for k, v in x) + sum(float(factors[a] @ factors[b]) * u * v for (a, u), (b, v) in itertools.combinations(x, 2))
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-z)), abs_tol=2e-4)


def slow_toxicity(text, model, s):
    """A text's score from its n-grams, word by word and window by window, with Python's whole numbers."""
    full = (1 << 64) - 1

    def slots(word):
        marked = f"<{word.strip('.,;:!?*#$%&|') or word}>"
        codes = [(ord(c) + 1) * 0x9E3779B97F4A7C15 & full for c in marked]
        hashes = []
        for n in range(s.low, s.high + 1):
            for k in range(len(codes) - n + 1):
                rolled = 0
                for v in codes[k : k + n]:
                    rolled = (rolled * 0x100000001B3 + (v ^ v >> 29)) & full
                hashes.append(rolled ^ n)
        whole = 0
        for place, v in enumerate(codes):
            mixed = (v + place) * (2 * place + 0xD6E8FEB86659FD93 & full) & full
            whole = whole + (mixed ^ mixed >> 32) & full
        for h in [*hashes, whole]:
            h = h * 0xFF51AFD7ED558CCD & full
            yield (h ^ h >> 33) % s.slots

    weights, words = model.gram_logits(), (text or "").lower().split()
    odds = {w: np.mean([weights[k] for k in slots(w)]) for w in set(words)}
    value = [0.0 if w in words[max(0, k - s.window + 1) : k] else odds[w] for k, w in enumerate(words)]
    best = max((np.mean(value[k : k + s.window]) for k in range(max(1, len(value) - s.window + 1))), default=0.0) if words else 0.0
    return 1 / (1 + math.exp(-(best + model.offset)))


@needs_data
def test_toxicity_scores_by_plain_python(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    s = toxicity.Settings()
    model = toxicity.fit(d, spark.read.parquet(f"{DATA}/labels.parquet"), 5, 0)
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, str(DATA)).collect()}
    assert len(got) == d.count()
    for r in d.orderBy("n_chars").limit(60).collect():
        want = slow_toxicity(r.text, model, s)
        assert math.isclose(got[r.doc_id].score, want, rel_tol=1e-9) and got[r.doc_id].predicted == int(want >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_samples_are_bounded_by_bytes_and_one_row_an_id(spark):
    from runstore.llm import _learn

    df = spark.createDataFrame([(1, "a" * 40), (1, "b" * 10), (2, "c" * 30), (3, "d" * 70), (4, None)], "doc_id long, text string")
    got = {r.id: r.text for r in _learn.texts_of(df, [1, 3, 2, 4, 9], 45, ["text"]).collect()}
    assert got == {1: "b" * 10, 2: "c" * 30, 4: None}


@needs_data
def test_held_out_accuracy(spark):
    got = queries.op5_quality_fm(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out")
    assert got.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.93


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    for keep in (0.9, 0.5):
        n = int(400 * keep)
        a, b = (np.unique(base), None), np.unique(np.concatenate([base[:n], rng.integers(0, 2**63, 400 - n).astype(np.uint64)]))
        one, two = a[0], b
        w1, w2 = np.ones(len(one)), np.where(np.isin(two, base[:40]), 3, 1)
        sig = dart_minhash.signatures(np.concatenate([one, two]), np.concatenate([w1, w2]), np.array([len(one), len(two)]), 1200)
        assert abs((sig[0] == sig[1]).mean() - dart_minhash.weighted_jaccard((one, w1), (two, w2))) < 0.05
    tiny = dart_minhash.signatures(np.array([5], np.uint64), np.array([1.0]), np.array([1]), 120)
    assert (tiny != 0).all()


def test_block_links_are_exact():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, 25).astype(np.uint64)) for _ in range(12)]
    got = dart_minhash.block_links(sets[:5], sets[5:], 0.5)
    want = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.5 for b in sets[5:]] for a in sets[:5]]
    assert (got == np.array(want)).all()
    h, c = np.array([3, 9], np.uint64), np.array([1, 3], np.int32)
    assert len(set(dart_minhash.expanded(h, c).tolist())) == 4


def slow_classes(texts, near):
    shingle = dart_minhash.Shingler(near.words)
    sets, label = [shingle(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a][0]) and dart_minhash.weighted_jaccard(sets[a], sets[b]) >= near.similarity:
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    return dict(enumerate(label))


def test_near_classes_by_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [f"v{i}" for i in rng.integers(0, 500, 130)]
    texts = [*ODD, "", " ".join(base), " ".join(base)]
    for _ in range(40):  # chains of edits: links that only members other than the hub have
        words = list(base)
        for _ in range(rng.integers(1, 6)):
            words[rng.integers(len(words))] = f"n{rng.integers(10**6)}"
        texts.append(" ".join(words))
        if rng.random() < 0.4:
            base = words
    for near in (dart_minhash.Near(), dart_minhash.Near(block_bytes=6000, broadcast_bytes=0)):
        rows = dart_minhash.classes(docs(spark, texts), near=near).collect()
        want = slow_classes(texts, near)
        assert {r.doc_id: r.class_id for r in rows} == want
        assert all(r.is_representative == (r.doc_id == r.class_id) and r.class_size == Counter(want.values())[r.class_id] for r in rows)
    kept = dart_minhash.keep_one(docs(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == docs(spark, []).columns
    assert dart_minhash.classes(docs(spark, ["x"]).limit(0)).count() == 0


def test_near_classes_go_by_row(spark):
    rng = np.random.default_rng(3)
    a, b = (" ".join(f"{k}{i}" for i in rng.integers(0, 10**6, 60)) for k in "ab")
    schema = "doc_id long, text string"
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail")]
    got = {(r.doc_id, r.class_id, r.is_representative, r.class_size) for r in dart_minhash.classes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 1, True, 2), (2, 1, False, 2), (3, 1, False, 2)}
    rows = [(5, a), (5, b), (2, a + " tail"), (3, b + " tail"), (None, a), (None, "alone"), (None, "alone")]
    kept = dart_minhash.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(2, a + " tail"), (3, b + " tail"), (None, "alone"), (None, "alone")], key=str)
    named = dart_minhash.classes(spark.createDataFrame([("y", a), ("x", a + " tail"), ("z", b)], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in named} == {("x", "x"), ("y", "x"), ("z", "z")}


def test_planted_near_copies_are_found(spark):
    """Copies with up to 2 % of their words changed, a similarity of about 0.8 or more, against exact comparison."""
    rng, rows, pairs = np.random.default_rng(21), [], []
    shingle = dart_minhash.Shingler(5)
    for _ in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        copy = list(words)
        for k in rng.choice(200, int(rng.integers(0, 5)), replace=False):
            copy[k] = f"n{rng.integers(10**9)}"
        pairs.append((len(rows), " ".join(words), " ".join(copy)))
        rows += [pairs[-1][1], pairs[-1][2]]
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(docs(spark, rows)).collect()}
    wanted = [i for i, x, y in pairs if dart_minhash.weighted_jaccard(shingle(x), shingle(y)) >= 0.8]
    assert len(wanted) > 100 and np.mean([got[i + 1] == got[i] for i in wanted]) >= 0.99


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in dart_minhash.components(edges).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_language_model_base_is_exact_and_model_sums_to_one(spark):
    texts = [*ODD, *["the cat sat on the mat", "The dog sat on the log"] * 20]
    m = lm_score.Model(chunk_mb=0.05, range_tokens=20_000)
    rows = sorted(lm_score.score(docs(spark, texts), m).collect(), key=lambda r: r.doc_id)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = Counter(w for t, h in zip(texts, held) if not h for w in lm_score.tokens_of(t))
    total, vocabulary = sum(count.values()), len(count)
    for r, t, h in zip(rows, texts, held):
        tokens = lm_score.tokens_of(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(tokens), sum(w in count for w in tokens), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + vocabulary + 1)) for w in tokens), rel_tol=1e-9)
        assert r.score < 0 and r.perplexity >= 1
    again = sorted(lm_score.score(docs(spark, texts).repartition(3), m).collect(), key=lambda r: r.doc_id)
    assert np.allclose([r.score for r in rows], [r.score for r in again], rtol=1e-5)
    assert lm_score.score(docs(spark, ["x"]).limit(0)).count() == 0


def in_one_place(tokens, m):
    """What ``sweeps`` takes: words, starts, contexts, counts, base and context marks; and the numbers of the words."""
    train = Counter()
    for i, words in enumerate(tokens):
        for before, w in zip([None, *words], words):
            train[w, before] += not lm_score.is_held_out(i, m)
    names = sorted({w for w, _ in train})
    number = {None: len(names), **{w: k for k, w in enumerate(names)}}
    words = np.array([lm_score.word_hash(w) for w in names], dtype=np.uint64)
    pairs = sorted((number[w], number[c], n) for (w, c), n in train.items())
    owner, contexts, counts = (np.array(x) for x in zip(*pairs))
    starts, count = np.searchsorted(owner, np.arange(len(names))), np.bincount(owner, weights=counts)
    base = 1 / ((count > 0).sum() + 1)
    if m.discount is None:
        roots = np.bincount(owner, weights=np.minimum(counts, 1)).astype(int)
        m = replace(m, discount=lm_score.fitted((counts == 1).sum(), (counts == 2).sum()), root_discount=lm_score.fitted((roots == 1).sum(), (roots == 2).sum()))
    return (words, starts, contexts, counts, base, m, np.append(words, lm_score.START)), number, pairs, owner


def averaged(tokens, m):
    """log10 of the averaged predictive probability of each (word, context)."""
    args, number, pairs, owner = in_one_place(tokens, m)
    _, _, contexts, counts, base, m, _ = args
    p = 0
    for s, (totals, t, rc, rt) in enumerate(lm_score.sweeps(*args)):
        if s > m.burn_in:
            p = p + totals.leaf(counts, t, contexts, totals.root(rc, rt, base, m)[owner], m) / (m.sweeps - m.burn_in)
    return {pair[:2]: x for pair, x in zip(pairs, np.log10(p))}, number


def test_every_context_has_a_restaurant(spark):
    """Against the model of all (word, context) pairs in one place; words are spread unevenly over the partitions."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 60) % 400 + 100 * (i > 40)) for i in range(60)]
    tokens = [lm_score.tokens_of(t) for t in texts]
    m = lm_score.Model(chunk_mb=0.004, range_tokens=500)
    logp, number = averaged(tokens, m)
    for parts in (1, 2, 40):  # the same scores whatever the partitions
        df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), parts), "doc_id long, text string")
        for r in lm_score.score(df, m).collect():
            assert math.isclose(r.score, sum(logp[number[w], number[c]] for c, w in zip([None, *tokens[r.doc_id]], tokens[r.doc_id])), rel_tol=1e-9)


def test_seating_agrees_with_one_customer_at_a_time():
    """Against Gibbs in plain Python, where every customer leaves its table and is seated given all others."""
    rng = np.random.default_rng(4)
    tokens = [lm_score.tokens_of(" ".join(f"w{k}" for k in rng.zipf(1.5, 25) % 30)) for _ in range(40)]
    m = lm_score.Model(discount=0.6, strength=3.0, root_discount=0.5, root_strength=3.0, sweeps=400, burn_in=50)
    ours, number = averaged(tokens, m)
    train = [(w, c) for i, words in enumerate(tokens) if not lm_score.is_held_out(i, m) for c, w in zip([None, *words], words)]
    base = 1 / (len({w for w, _ in train}) + 1)
    root, leaf, at_leaf = {}, {}, {}  # customers at each table, by word; by context and word

    def chance(tables, all_customers, all_tables, d, strength, parent):
        return (sum(tables) - d * len(tables) + (strength + d * all_tables) * parent) / (strength + all_customers)

    def p_root(w):
        return chance(root.get(w, []), sum(map(sum, root.values())), sum(map(len, root.values())), m.root_discount, m.root_strength, base)

    def p_leaf(w, c):
        r = leaf.get(c, {})
        return chance(r.get(w, []), sum(map(sum, r.values())), sum(map(len, r.values())), m.discount, m.strength, p_root(w))

    def sit(tables, d, new):
        k = rng.choice(len(tables) + 1, p=(x := np.array([*[n - d for n in tables], new])) / x.sum())
        tables[k : k + 1] = [(tables[k] if k < len(tables) else 0) + 1]
        return k == len(tables) - 1 and tables[k] == 1

    def leave(tables):
        k = rng.choice(len(tables), p=np.array(tables) / sum(tables))  # customers at tables are alike
        tables[k] -= 1
        return tables.pop(k) == 0 if not tables[k] else False

    def add(w, c):
        r = leaf.setdefault(c, {})
        if sit(r.setdefault(w, []), m.discount, (m.strength + m.discount * sum(map(len, r.values()))) * p_root(w)):
            sit(root.setdefault(w, []), m.root_discount, (m.root_strength + m.root_discount * sum(map(len, root.values()))) * base)

    for w, c in train:
        add(w, c)
    total, rounds = Counter(), 60
    for sweep in range(rounds + 10):
        for k in rng.permutation(len(train)):
            w, c = train[k]
            if leave(leaf[c][w]):
                leave(root[w])
            add(w, c)
        if sweep >= 10:
            for pair in set(train):
                total[pair] += p_leaf(*pair) / rounds
    theirs = np.array([math.log10(total[w, c]) for w, c in sorted(total, key=str)])
    mine = np.array([ours[number[w], number[c]] for w, c in sorted(total, key=str)])
    assert abs((mine - theirs).mean()) < 0.01 and np.abs(mine - theirs).mean() < 0.02 and np.corrcoef(mine, theirs)[0, 1] > 0.995


def test_predictive_probabilities_sum_to_one():
    """Every word after one context, and the unknown word, after each sweep."""
    m, rng = lm_score.Model(discount=0.7, root_discount=0.6), np.random.default_rng(0)
    words = rng.integers(0, 2**62, 50).astype(np.uint64)
    contexts, counts = np.tile(np.arange(3), 50), rng.integers(0, 60, 150)
    counts[::3] += 1
    starts, base = np.arange(0, 150, 3), 1 / 51
    for totals, t, rc, rt in lm_score.sweeps(words, starts, contexts, counts, base, m):
        p = totals.leaf(counts, t, contexts, totals.root(rc, rt, base, m)[np.repeat(np.arange(50), 3)], m)
        unknown = totals.leaf(0, 0, np.arange(3), totals.root(0, 0, base, m), m)
        assert np.allclose(np.bincount(contexts, weights=p) + unknown, 1)
        assert (t <= counts).all() and (t >= np.minimum(counts, 1)).all() and (rt <= rc).all()


def test_tables_are_drawn_from_their_distribution():
    """Stirling numbers against counts of all partitions, and groups against the exact draw."""
    ways = Counter({(): 1.0})
    for n in range(6):
        after = Counter()
        for sizes, x in ways.items():
            after[tuple(sorted([*sizes, 1]))] += x
            for k, size in enumerate(sizes):
                after[tuple(sorted([*sizes[:k], size + 1, *sizes[k + 1 :]]))] += x * (size - 0.4)
        ways = after
    for t in range(1, 7):
        assert math.isclose(math.exp(lm_score.stirling(0.4, 8)[6, t]), sum(x for sizes, x in ways.items() if len(sizes) == t))
    rng = np.random.default_rng(9)
    for customers, others, base, strength, discount in ((60, 8, 0.2, 5.0, 0.5), (150, 400, 0.01, 20.0, 0.8), (150, 3, 0.6, 20.0, 0.3), (40, 5000, 0.05, 20.0, 0.7), (200, 0, 1e-4, 5.0, 0.6)):
        draw = lambda exact: lm_score.seat(np.full(4000, customers), np.full(4000, others), np.full(4000, base), strength, discount, rng.integers(0, 2**62, 4000).astype(np.uint64), exact)  # noqa: B023, E731
        one, two = draw(16), draw(256)
        assert abs(one.mean() - two.mean()) < 0.08 * two.mean() and abs(one.std() - two.std()) < 0.15 * two.std() + 0.01 and one.min() >= 1 and one.max() <= customers


@needs_data
def test_model_beats_its_base_on_held_out_texts(spark):
    r = queries.op3_lm_score(spark, str(DATA)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


@needs_data
def test_pipeline_stages_by_plain_python(spark, tmp_path):
    import corpus_pipeline
    from runstore.llm import line_dedup, quality_rules

    from .test_text_ops import slow_lines

    rows = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 150")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{len(seen)}"))
        d = spark.read.parquet(str(tmp_path / f"s{len(seen)}"))
        seen.append(d)
    assert all(x.columns == rows.columns for x in seen[:-1])
    r = quality_rules.Rules()
    ok = lambda n, c, s, dup, rep, lines: n >= r.min_words and 100 * rep <= r.max_repeat_percent * n and 100 * s <= r.max_symbols_percent * n and 100 * dup <= r.max_dup_lines_percent * lines
    texts = {x.doc_id: x.text for x in rows.collect()}
    first = {x.doc_id for x in seen[0].collect()}
    assert first == {i for i, t in texts.items() if ok(*quality_rules.measure(t))}
    second = {x.doc_id for x in seen[1].collect()}
    assert second <= first and len(second) > 0.9 * len(first)
    third, lines = {x.doc_id: x.text for x in seen[2].collect()}, line_dedup.Lines()
    want = slow_lines([(i, texts[i]) for i in sorted(second)], lines)
    assert third == {i: t for i, t in want.items() if t == texts[i] or t.strip() and len(t.encode()) >= lines.least_left * len(texts[i].encode())}
    ids = sorted(third)
    classes = slow_classes([third[i] for i in ids], dart_minhash.Near())
    fourth = {x.doc_id for x in seen[3].collect()}
    assert fourth == {ids[v] for v in classes.values()}
    assert {x.doc_id for x in seen[4].collect()} == fourth
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


def operators(spark, folder):
    """Every operator on a table, for its rows in any order; ``folder`` holds labels and documents."""
    import public_tokenizers

    from runstore.llm import bpe, line_dedup, media_avi, packing, quality_rules, sharding

    lab, train = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/documents.parquet")
    machine, model = quality_fm.fit(train, lab), toxicity.fit(train, lab)
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = {
        "judge": lambda d: quality_rules.judge(d, d.columns), "keep_good": quality_rules.keep_good, "dedup": line_dedup.dedup, "rewrite": line_dedup.rewrite,
        "classes": dart_minhash.classes, "keep_one": dart_minhash.keep_one, "quality": lambda d: quality_fm.score(d, machine, d.columns), "quality_keep": lambda d: quality_fm.keep_good(d, machine),
        "toxicity": lambda d: toxicity.score(d, model, d.columns), "media": lambda d: media_avi.digests(d, d.columns), "bpe": lambda d: bpe.digests(d, ranks, pattern, d.columns),
        "packing": lambda d: packing.pack_documents(d, path, pattern).drop("sequence_id", "offset"), "shards": lambda d: sharding.assign(d, 3), "model": lambda d: lm_score.score(d),
    }
    return rows


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("small")
    rng = np.random.default_rng(30)
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, int(rng.integers(55, 90)))) for _ in range(30)]
    texts += [texts[0], texts[1], texts[2] + " tail", "\n".join(texts[3:6]), *ODD, "# $ % " * 60]
    docs(spark, texts).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    labels(spark, [(i, int(i < 30), int(i % 7 == 0)) for i in range(len(texts))]).coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_clashing_names_change_nothing(spark, small):
    """Extra columns with every name that operators use inside, or give to what they make."""
    from .test_text_ops import CLASHES

    d = spark.read.parquet(f"{small}/documents.parquet")
    more = d.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    for name, run in operators(spark, small).items():
        one, two = run(d), run(more)
        mine = [c for c in one.columns if c in two.columns and c not in CLASHES]
        rows = [sorted(map(str, x.select(*mine).collect())) for x in (one, two)]
        assert rows[0] == rows[1] and rows[0], name
        if set(CLASHES) <= set(two.columns):
            values = two.select(*["`" + c.replace("`", "``") + "`" for c in CLASHES]).distinct().collect()
            assert [tuple(v) for v in values] == [tuple(range(len(CLASHES)))], name


def test_every_operator_takes_nulls_everywhere_repeats_and_no_rows(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    nothing = d.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema.fields]).limit(3)
    odd = d.limit(3).unionByName(d.limit(3)).unionByName(nothing)
    same = {"judge", "dedup", "classes", "quality", "toxicity", "media", "bpe", "shards", "model"}
    for name, run in operators(spark, small).items():
        assert run(d.limit(0)).count() == 0, name
        n = run(odd).count()
        assert n == 9 if name in same else n <= 9 or name == "packing", name


def test_pipeline_takes_nulls_no_rows_and_clashing_names(spark, small, tmp_path):
    import corpus_pipeline

    from .test_text_ops import CLASHES

    d = spark.read.parquet(f"{small}/documents.parquet")
    nothing = d.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema.fields]).limit(2)
    tables = {"whole": d, "odd": d.unionByName(nothing), "clash": d.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)]), "empty": d.limit(0)}
    found = {}
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found[name] = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect())
    assert found["whole"] and found["whole"] == found["clash"] == found["odd"] and not found["empty"]


def test_pipeline_leaves_its_input_alone_wherever_it_is(spark, small, tmp_path):
    """A folder that is named like scratch tables is none: its documents are read again by the second stage."""
    import corpus_pipeline

    rows = {}
    for name in ("plain", "runstore-data"):
        for t in ("documents", "labels"):
            spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        rows[name] = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect())
        assert spark.read.parquet(f"{tmp_path}/{name}/documents.parquet").count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert rows["plain"] and rows["plain"] == rows["runstore-data"]
