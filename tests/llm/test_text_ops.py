"""Rules, lines, shards, BPE, packing and media: against brute force, libraries, SQL and exact round trips."""

import contextlib
import hashlib
import struct
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runstore.llm import _util, bpe, line_dedup, media_avi, packing, quality_rules, queries, sharding

DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, kept string, score double, class_id long"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))


def docs(spark, texts, sources=None):
    rows = [(i, t, None, (sources or {}).get(i, "s"), None if t is None else len(t), 1, "x", "y", 0.5, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "one", "a b c d", "a b c d", LONG, "é ñ 日本 a b", "x\n\nx\nx"]


def test_measures_by_brute_force():
    def slow(text):
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.strip(quality_rules.SPACES)]
        return len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit), len(lines)

    for t in ["a b c a b c d", "a a a a a", "x\ny\nx\n \nx", "#a $b c \x1c d", "a b c", "é é é é", *[t for t in ODD if t]]:
        assert quality_rules.measure(t) == slow(t), t[:40]
    assert quality_rules.measure(None) == (0,) * 6


def test_hosts_are_judged_with_shrinkage_and_joined_back(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "# $ %"
    texts = [good] * 30 + [bad] * 30 + [good] + [bad]
    sources = {i: "good" if i < 30 else "bad" if i < 60 else "few" if i == 60 else None for i in range(62)}
    for rules in (quality_rules.Rules(), quality_rules.Rules(broadcast_bytes=0)):
        rows = {r.doc_id: r for r in quality_rules.judge(docs(spark, texts, sources), ["doc_id", "kept"], rules=rules).collect()}
        assert len(rows) == 62 and all(rows[i]._kept for i in range(30)) and not any(rows[i]._kept for i in range(30, 60))
        assert rows[31].host_rejected and not rows[0].host_rejected and rows[0].kept == "y"
        assert 0 < rows[60].host_rate < rows[31].host_rate < 1 and rows[61].base_failed


def test_odd_and_empty_tables_do_not_crash(spark):
    odd, none = docs(spark, ODD), docs(spark, ["x"]).limit(0)
    for df, n in ((odd, len(ODD)), (odd.unionByName(odd), 2 * len(ODD)), (none, 0)):
        assert quality_rules.judge(df, ["doc_id"]).count() == n
        assert sharding.assign(df, 4).count() == n
        assert media_avi.digests(df, ["doc_id"]).count() == n
        assert bpe.digests(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"]).count() == n
        assert packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).select("doc_id").distinct().count() == min(n, len(ODD))
        assert line_dedup.dedup(df).count() == n
        assert quality_rules.keep_good(df).columns == df.columns == line_dedup.rewrite(df).columns


def edits(a, b):
    """Word edits between two lists, by the usual table over what is left without equal words at both ends."""
    while a and b and a[0] == b[0]:
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def slow_lines(rows, lines):
    """Kept texts by comparing every line with every earlier one; ``rows`` are (place in order, text)."""
    out, seen = {}, []
    for i, t in rows:
        if t is None:
            out[i] = None
            continue
        keep = []
        for raw in t.split("\n"):
            words = " ".join(raw.lower().replace("\t", " ").split(" ")).split()

            def near(s, words=words):
                most = min(lines.max_edits, max(len(s), len(words)) // lines.words_per_edit)
                return abs(len(s) - len(words)) <= most and edits(s, words) <= most

            gone = bool(words) and (words in seen or any(map(near, seen)))
            if words:
                seen.append(words)
            if not gone:
                keep.append(raw)
        out[i] = "\n".join(keep)
    return out


def test_line_dedup_by_brute_force(spark):
    base = [f"{k}{i}" for k in "ab" for i in range(7)]
    line = " ".join(base)
    variants = [line, line.upper(), "  ".join(base), " ".join(base[1:]), " ".join(base[:-1]), " ".join([*base[:5], "new", *base[5:]]), " ".join([*base[:3], "other", *base[4:]]), " ".join([*base[:3], "x", *base[4:-1], "y"]), " ".join(base[2:]), " ".join(["p", "p", *base]), " ".join(["p", *base])]
    texts = [*variants, "\n".join(variants), "a b\na b\n\na b", "a b c d e\na b c d e", None, "", LONG, LONG + " end", "\n".join([LONG, "tail"])]
    for lines in (line_dedup.Lines(), line_dedup.Lines(broadcast_bytes=0)):
        got = {r.doc_id: r._kept_text for r in line_dedup.dedup(docs(spark, texts), lines=lines).collect()}
        assert got == slow_lines(list(enumerate(texts)), lines)
    kept = line_dedup.rewrite(docs(spark, ["a b c d e", "a b c d e", None, "", "a b c d e\n" + "x" * 50, "a b c d e\nx"]))
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {0: ("a b c d e", 9), 2: (None, None), 3: ("", 0), 4: ("x" * 50, 50)}


@pytest.mark.parametrize("most", [0, 1, 2])
def test_lines_of_any_length_within_any_bound(spark, most):
    """Lines of 1 to 20 words with up to four edits, in two alphabets: a small one that makes many chance meetings."""
    rng = np.random.default_rng(most)
    texts = []
    for size, alphabet in [(n, a) for n in range(1, 21) for a in ("ab", "abcdefghijklmnop")]:
        base = [str(w) for w in rng.choice(list(alphabet), size)]
        made = [base]
        for _ in range(6):
            words = list(made[rng.integers(len(made))])
            for _ in range(rng.integers(0, 3)):
                at = int(rng.integers(0, len(words) + 1))
                words[at : at + int(rng.integers(0, 2))] = [str(rng.choice(list(alphabet)))] * int(rng.integers(0, 2))
            made.append(words)
        texts.append("\n".join(" ".join(w) for w in made))
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    lines = line_dedup.Lines(max_edits=most)
    rows = line_dedup.dedup(docs(spark, texts), lines=lines).collect()
    assert {r.doc_id: r._kept_text for r in rows} == slow_lines(list(enumerate(texts)), lines)


def test_rows_of_one_id_or_none_lose_no_text_of_their_own(spark):
    a, b = "one line that two rows of an id have in common", "another text altogether which stands nowhere else here"
    schema = "doc_id long, text string"
    got = line_dedup.dedup(spark.createDataFrame([(1, a), (2, b), (2, a)], schema)).collect()
    assert sorted((r.doc_id, r._kept_text) for r in got) == [(1, a), (2, ""), (2, b)]
    got = line_dedup.rewrite(spark.createDataFrame([(None, a), (None, b), (None, a + "\n" + b), (7, a)], schema)).collect()
    assert sum(a in r.text for r in got) == 1 == sum(b in r.text for r in got) and all(r.doc_id is None for r in got)
    same = line_dedup.dedup(spark.createDataFrame([(5, a), (5, a)], schema)).collect()
    assert [r._kept_text for r in same] == [a, a]
    named = line_dedup.rewrite(spark.createDataFrame([("x", a), ("y", a), (None, b)], "doc_id string, text string")).collect()
    assert sorted(r.text for r in named) == sorted([a, b]) and {r.doc_id for r in named} == {"x", None}


@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
@settings(max_examples=30, deadline=None)
def test_word_edit_expression(spark_once, a, b):
    df = spark_once.createDataFrame([(a, b)], "a array<string>, b array<string>")
    got = df.select(*[line_dedup.word_edits_within(F.col("a"), F.col("b"), k) for k in range(3)]).first()
    assert tuple(got) == tuple(edits(a, b) <= k for k in range(3))


@pytest.fixture(scope="module")
def spark_once(spark):
    return spark


def test_shards_by_brute_force(spark):
    texts = [*ODD, *[f"t{i}" * (i % 37) for i in range(300)], "z" * 3000]
    rows = sorted(sharding.assign(docs(spark, texts), 7).collect(), key=lambda r: r.doc_id)
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert [r["size"] for r in rows] == sizes and [r.text_crc32 for r in rows] == [zlib.crc32((t or "").encode()) for t in texts]
    total, before, slots = sum(sizes), 0, Counter()
    for r, s in zip(rows, sizes):
        assert r.shard == min(6, (2 * before + s) * 7 // (2 * total)) and r.slot == slots[r.shard]
        slots[r.shard] += 1
        before += s
    with pytest.raises(ValueError):
        sharding.assign(docs(spark, ["x"]), 0)


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_bpe_is_that_of_the_library(text):
    ids = LIBRARY.encode_ordinary(text)
    assert CODEC.encode(text) == ids and CODEC.decode(ids) == text.encode()


RANDOM = np.random.default_rng(17)


@pytest.mark.parametrize("part", ["a" * 5000, "ab" * 1500, "xyzzy" * 1001, "日本語" * 900, "a" * 2048, "  " * 3000, "".join(RANDOM.choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000)), "".join(RANDOM.choice(list("ab"), 9_999)), "a" * 1_000_000, "x" + "ab" * 300_001])
def test_bpe_of_long_parts(part):
    assert CODEC.encode(part) == LIBRARY.encode_ordinary(part)
    if len(part) < 6000:
        assert CODEC.merge_row(part.encode()) == CODEC.merge_matrix([part.encode()], len(part.encode()))[0]


@given(st.dictionaries(st.text("abc", min_size=2, max_size=4), st.none(), max_size=25), st.text("abc", min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_long_parts_by_any_ranks(tokens, part):
    """Ranks in any order, where a merge may make a pair of lesser rank than its own."""
    ranks = {bytes([i]): i for i in range(256)} | {t.encode(): 256 + k for k, t in enumerate(tokens)}
    codec = bpe.Codec(ranks, ".+")
    ids = [bytes([b]) for b in part.encode()]
    while found := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a + b in ranks]:
        _, k = min(found)
        ids[k : k + 2] = [ids[k] + ids[k + 1]]
    want = [ranks[t] for t in ids]
    assert codec.merge_row(part.encode()) == want == codec.merge_matrix([part.encode()], max(2, len(part)))[0]


def test_bpe_columns_round_trip(spark):
    df = bpe.encode_column(docs(spark, ODD), PATH, public_tokenizers.PATTERN, ["doc_id"])
    back = {r.doc_id: r.text for r in bpe.decode_column(df, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    n, ids, text = CODEC.digests(["", "some text"])[1]
    want = LIBRARY.encode_ordinary("some text")
    assert (n, ids, text) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(b"some text").hexdigest())


def test_open_bins_place_best_and_close_the_fullest():
    bins = packing.OpenBins(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    for n in (6, 7, 8):  # three open: the fullest, with 2 free, closes
        bins.place(n)
    assert bins.place(2) == (3, 7) and bins.place(4) == (2, 6)


def test_pieces():
    ids = np.arange(2500, dtype="<u4").tobytes()
    assert [p[:3] for p in packing.pieces_of(ids, 1024)] == [(0, 0, 452), (1, 452, 1024), (2, 1476, 1024)]
    assert [p[:3] for p in packing.pieces_of(ids[: 4 * 2048], 1024)] == [(0, 0, 1024), (1, 1024, 1024)]
    assert packing.pieces_of(b"", 1024) == []


def test_packing_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, "x <|endoftext|> is text", "<|endoftext|><|endoftext|>", "<|endoftext|", *[f"word{i} " * (i % 90) for i in range(200)]]
    for p in (packing.Packing(), packing.Packing(open_bins=4, task_tokens=20_000)):
        rows = packing.pack_documents(docs(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, p).collect()
        by, bins = {}, {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, text in enumerate(texts):
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
            assert sum(r.length for r in by[i]) == len(ids)
            for r in by[i]:
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        for spots in bins.values():
            at = 0
            for offset, length in sorted(spots):
                assert offset == at
                at += length
            assert at <= 1024
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / 1024 + 8


@given(st.binary(max_size=2000))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(raw):
    payload = media_avi.pad(raw)
    rate, frames = media_avi.read_avi(media_avi.write_avi(media_avi.encode_frames(payload)))
    assert rate == 25 and media_avi.decode_flat(frames).tobytes() == payload and len(payload) % 192 == 0 and payload
    assert (media_avi.decode_frame(frames[0])[::8, ::8].ravel() == media_avi.decode_flat(frames[:1])[0]).all()


def test_general_jpeg_with_ac_coefficients_and_restarts():
    """A hand-made 16x8 frame: one AC coefficient in the first block, a restart marker between the blocks."""
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    dc = ([0, 2] + [0] * 14, [0, 4])  # 00: category 0, 01: category 4
    ac = ([0, 2] + [0] * 14, [0x00, 0x03])  # 00: end, 01: a coefficient of 3 bits
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\x10" * 64) + seg(0xC0, struct.pack(">BHHB", 8, 8, 16, 1) + b"\x01\x11\x00")
    head += seg(0xC4, b"\x00" + bytes(dc[0]) + bytes(dc[1])) + seg(0xC4, b"\x10" + bytes(ac[0]) + bytes(ac[1])) + seg(0xDD, b"\0\1") + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    first = int("01" + "1010" + "01" + "101" + "00" + "111", 2).to_bytes(2, "big")  # dc 10, ac 5, end, padding
    second = int("01" + "0011" + "00", 2).to_bytes(1, "big")  # dc -12, end
    image = media_avi.decode_frame(head + first + b"\xff\xd0" + second + b"\xff\xd9")
    x = np.arange(8)
    wave = 128 + 160 / 8 + 80 * np.sqrt(1 / 8) * np.sqrt(2 / 8) * np.cos((2 * x + 1) * np.pi / 16)
    assert image.shape == (8, 16) and (image[0, :8] == np.rint(wave)).all() and (image[:, 8:] == 128 - 24).all()


# Some codes of the standard Huffman tables, as printed in annex K of T.81.
DC_LUMA = {0: "00", 1: "010", 2: "011", 3: "100", 4: "101", 5: "110", 6: "1110", 7: "11110", 8: "111110"}
DC_CHROMA = {0: "00", 1: "01", 2: "10", 3: "110", 4: "1110", 5: "11110", 6: "111110", 7: "1111110", 8: "11111110"}
AC_LUMA = {0x00: "1010", 0x01: "00", 0x02: "01", 0x03: "100", 0x04: "1011", 0x11: "1100", 0xF0: "11111111001"}
AC_CHROMA = {0x00: "00", 0x01: "01", 0x02: "100", 0x11: "1011", 0xF0: "1111111010"}


def colour_frame(y, cb, cr):
    """A 16x16 frame of four flat luma blocks (values less 128) and one block of each colour, without Huffman tables."""
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    head = b"\xff\xd8" + seg(0xE0, b"AVI1" + bytes(10)) + b"\xff" + seg(0xDB, b"\0" + b"\x08" * 64 + b"\1" + b"\x08" * 64)
    head += seg(0xC0, struct.pack(">BHHB", 8, 16, 16, 3) + b"\x01\x22\x00\x02\x11\x01\x03\x11\x01") + seg(0xDA, b"\x03\x01\x00\x02\x11\x03\x11\x00\x3f\x00")
    bits, last = "", 0

    def dc(d, codes):
        size = abs(d).bit_length()
        return codes[size] + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")

    for v in y:
        bits += dc(v - last, DC_LUMA) + AC_LUMA[0x00]
        last = v
    bits += dc(cb, DC_CHROMA) + AC_CHROMA[0x00] + dc(cr, DC_CHROMA) + AC_CHROMA[0x00]
    bits += "1" * (-len(bits) % 8)
    return head + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_frames_in_colour_with_standard_tables():
    tables = media_avi._standard()
    for kind, codes in ((0x00, DC_LUMA), (0x01, DC_CHROMA), (0x10, AC_LUMA), (0x11, AC_CHROMA)):
        assert len(tables[kind]) == (12 if kind < 16 else 162)
        assert all(tables[kind][len(c), int(c, 2)] == s for s, c in codes.items())
    luma, cb, cr = media_avi.decode_planes(colour_frame([10, -20, 30, 5], 7, -9))
    assert luma.shape == cb.shape == cr.shape == (16, 16)
    assert (luma[:8, :8] == 138).all() and (luma[:8, 8:] == 108).all() and (luma[8:, :8] == 158).all() and (luma[8:, 8:] == 133).all()
    assert (cb == 135).all() and (cr == 119).all()
    with pytest.raises(ValueError):
        media_avi.decode_frame(colour_frame([1, 2, 3, 4], 0, 0).replace(b"\xff\xc0", b"\xff\xc2"))


def test_indexes_from_the_file_start_and_further_parts():
    frames = [colour_frame([k, k, k, k], 0, 0) for k in range(5)]
    media = media_avi.write_avi(frames, size=(16, 16))
    assert media_avi.read_avi(media) == (25, frames)
    movi, at = media.index(b"movi"), media.index(b"idx1") + 8
    absolute = bytearray(media)
    for k in range(5):
        place = struct.unpack_from("<I", absolute, at + 16 * k + 8)[0]
        struct.pack_into("<I", absolute, at + 16 * k + 8, place + movi)
    assert media_avi.read_avi(bytes(absolute))[1] == frames
    assert media_avi.read_avi(media[: at - 8])[1] == frames  # cut off before the index
    more = b"".join(media_avi._chunk(b"00dc", f) for f in frames)
    assert media_avi.read_avi(media + media_avi._chunk(b"RIFF", b"AVIX" + media_avi._chunk(b"LIST", b"movi" + more)))[1] == frames * 2
    assert media_avi.decode_flat(frames).tolist() == [[128 + k] * 4 for k in range(5)]


def test_media_digests_by_hand(spark):
    texts = [*ODD, "abc" * 200, "x" * 192, "x" * 193]
    rows = {r.doc_id: r for r in media_avi.digests(docs(spark, texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        media, r = media_avi.store(t), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        # The stored bytes are read back pixel by pixel, and shots found frame by frame.
        frames = media_avi.read_avi(media)[1][:40]
        assert b"".join(media_avi.decode_frame(f)[::8, ::8].tobytes() for f in frames) == payload[: 192 * len(frames)]
        blocks = [payload[k : k + 192] for k in range(0, len(payload), 192)]
        hist = [Counter(v >> 4 for v in b) for b in blocks]
        d = [sum(abs(x[k] - y[k]) for k in range(16)) / 384 for x, y in zip(hist, hist[1:])]
        cuts = [k + 1 for k in range(1, len(d)) if d[k] > max(0.1, np.mean(d[max(0, k - 8) : k]) + 2 * np.std(d[max(0, k - 8) : k]))]
        edges = [0, *cuts, len(blocks)]
        want = f"frames={len(blocks)};clips={len(edges) - 1};longest={max(np.diff(edges))};mean={np.mean(list(payload)):.4f};cuts={zlib.crc32(np.array(edges[:-1], dtype='<u4').tobytes())}"
        assert r.feature == want


def test_clips_find_a_cut_and_rows_are_timed(spark):
    still, other = np.full((20, 192), 40, np.uint8), np.full((10, 192), 200, np.uint8)
    assert [c[:2] for c in media_avi.clips(np.concatenate([still, other]), 25)] == [(0, 20), (20, 30)]
    df = media_avi.media_column(docs(spark, [" " * 192 * 20 + "z" * 192 * 10, None]), ["doc_id"]).unionByName(spark.createDataFrame([(7, bytearray(b"junk")), (8, None)], "doc_id long, media binary"))
    rows = sorted(map(tuple, media_avi.clip_rows(df, ["doc_id"]).collect()))
    assert rows == [(0, 0, 0, 20, 0.0, 0.8, None), (0, 1, 20, 10, 0.8, 1.2, None), (1, 0, 0, 1, 0.0, 0.04, None), (7, None, None, None, None, None, "ValueError: not an AVI file")]
    colour = media_avi.write_avi([colour_frame([k] * 4, 0, 0) for k in [0] * 12 + [90] * 8], size=(16, 16))
    rows = sorted(map(tuple, media_avi.clip_rows(spark.createDataFrame([(1, bytearray(colour))], "clip long, m binary"), ["clip"], "m").collect()))
    assert [r[:4] for r in rows] == [(1, 0, 0, 12), (1, 1, 12, 8)]


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got, want = queries.queries()[name](spark, str(DATA)).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    flat = lambda d: d[columns].astype(object).where(d[columns].notna(), None).astype(str).sort_values(columns).reset_index(drop=True)
    assert flat(got).equals(flat(want))


def test_saved_tables_and_remainders(spark):
    saved = _util.save(spark.range(5).toDF("n"), "t")
    assert saved.count() == 5
    _util.drop(saved)
    assert spark.range(3).select(_util.id_remainder("id", 7).alias("r")).collect() == [(zlib.crc32(str(i).encode()) % 7,) for i in range(3)]


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1m")
        rows = docs(spark, ["x" * 3_000_000, None, ""])  # a row beyond the bound still travels whole
        found = _util.save(quality_rules.judge(rows, ["doc_id"]), "t").select("doc_id", "word_chars").collect()
        assert spark.conf.get(key) == "1m" and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"
        assert sorted(map(tuple, found)) == [(0, 3_000_000), (1, 0), (2, 0)]
    finally:
        spark.conf.set(key, before)


CLASHES = ["n", "failures", "host", "of", "salt", "host_rate", "host_rejected", "rule_failed", "base_failed", "failed", "n_words", "t", "made", "exact", "near", "found", "parts", "row", "id", "line", "h", "g", "first", "last", "rep", "node", "label", "bucket", "class_size", "is_representative", "d1", "d2", "weight", "bands", "gone", "stays", "round", "piece", "length", "offset", "sequence_id", "score_", "predicted", "words", "key", "_id", "_no", "_t", "_made0", "_gone", "_kept_text", "_n_exact", "_n_near", "_parts", "_rank", "_salt", "_rule_failed", "_fm_score", "_sampled", "_host", "_of", "_first", "_row", "_kept_row", "a.b", "c`d"]


def clashing(spark, texts):
    """A table whose other columns have the names that operators use inside."""
    df = docs(spark, texts)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_util, "shared_dir", lambda spark: f"file://{tmp_path}")
    df = docs(spark, ["a b c d e f", "a b c d e g", "x\ny", "x"])
    line_dedup.dropped_lines(df)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["runstore-gone"]
    kept = _util.save(df, "input", stays=True)
    with _util.scratch():
        made = _util.save(kept.limit(2), "a")
        out = _util.save(made, "b", stays=True)
    assert out.count() == 2 and not [p for p in tmp_path.iterdir() if p.name.startswith("runstore-a-")]
    _util.drop(kept, out, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert len(list(tmp_path.iterdir())) == 1 and (DATA / "labels.parquet").exists()


TOKENS: dict = {}


@given(st.text(st.sampled_from("abé1'st .,;:!?_%&²\n\t\r\x00\x1c\x85\u00a0\u3000\u0301日👍"), max_size=40) | st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_library(text):
    from tokenizers import Tokenizer

    if not TOKENS:
        path = public_tokenizers.path("byte_bpe_50k.json")
        TOKENS["own"], TOKENS["library"] = packing.TextIds(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
        assert TOKENS["own"].fast is not None
    want = TOKENS["library"].encode(text, add_special_tokens=False).ids
    own, fast = TOKENS["own"], TOKENS["own"].fast
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == want
    own.fast = None  # for files of another kind
    try:
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == want
    finally:
        own.fast = fast


def test_files_of_another_kind_are_left_to_their_model():
    from tokenizers import Tokenizer, models

    letters = packing.byte_letters()
    vocabulary = {c: i for i, c in enumerate(letters)} | {"ab": 256, "bc": 257, "abc": 258}
    for merges, works in (([("a", "b"), ("b", "c"), ("ab", "c")], True), ([("b", "c"), ("a", "b"), ("ab", "c")], False)):
        model = Tokenizer(models.BPE(vocab=vocabulary, merges=merges)).model
        described = {"type": "BPE", "vocab": vocabulary, "merges": [" ".join(m) for m in merges]}
        assert (packing.ranks_of(described, model) is not None) == works
    assert packing.ranks_of({"type": "BPE", "vocab": vocabulary, "merges": ["a b", "b c", "ab c"], "byte_fallback": True}, model) is None
