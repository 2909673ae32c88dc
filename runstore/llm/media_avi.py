"""AVI motion-JPEG columns: RIFF writing and index parsing, intra-frame decoding, shots and timed clips.

The container is RIFF/AVI with an ``idx1`` index; each ``00dc`` chunk is one baseline JPEG (gray, 8-bit). A payload is
stored one byte to a flat 8x8 block: the DC coefficient is the sample less 128 at quantiser 8, so decoding gives the
byte back exactly. The Huffman tables make every block 16 bits (code and magnitude bits of a DC difference take 12
together, the end of block 4) and never form a marker byte.

Decoding takes any sequential 8-bit JPEG of one or three components in one scan, subsampled or not: tables are read from
the frame itself, and where it has no Huffman tables, as is usual in motion-JPEG, the standard ones hold. Frames whose
blocks all decode to the same number of bits are decoded for all frames at once, others block by block with AC
coefficients and inverse DCT. Of an index both offsets from the ``movi`` list and from the file's start are understood,
and files of several RIFF parts (OpenDML) are read to the end.

Shots: the distance of successive frames' 16-bin histograms (of the luma's block means) is compared with the mean plus ``sensitivity`` deviations
of the distances in the window before; a cut starts a new clip.

Defined results: a null or empty text is one frame of spaces; equal texts give equal media and features; repeated rows
are stored one by one; a text whose file would pass the 4 GiB of a RIFF size raises ``ValueError`` (Spark's own texts end at
2 GiB); a file that cannot be read has one row without a clip that says why; an empty table gives no rows; extra columns
pass through or are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util

FRAME = 192  # payload bytes of a frame
ACROSS, DOWN = 16, 12  # blocks of a frame


@dataclass(frozen=True)
class Shots:
    rate: int = 25  # frames a second
    bins: int = 16
    window: int = 8
    sensitivity: float = 2.0
    least: float = 0.1  # smallest distance that can be a cut


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


# --- JPEG ---------------------------------------------------------------------------------------------------------


def _canonical(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(bits, code) to symbol, from the lists of a DHT segment."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[bits, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


# The Huffman tables that ITU-T T.81 gives in its annex K, as counts by length and the first symbols by code; the
# other symbols follow in rising order.
_K_DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [])
_K_DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], [])
_K_AC_LUMA = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
)
_K_AC_CHROMA = (
    [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)


def _standard() -> dict[int, dict[tuple[int, int], int]]:
    """The standard tables by class and number, as in a DHT segment."""
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    out = {}
    for kind, (counts, _) in ((0x00, _K_DC_LUMA), (0x01, _K_DC_CHROMA)):
        out[kind] = _canonical(counts, list(range(12)))
    for kind, (counts, head) in ((0x10, _K_AC_LUMA), (0x11, _K_AC_CHROMA)):
        first = [int(x, 16) for x in head.split()]
        out[kind] = _canonical(counts, first + sorted(set(every) - set(first)))
    return out


# A code of 12 - category bits for each DC category 8 down to 0, and one of 4 bits for the end of a block.
_DC = ([0, 0, 0] + [1] * 9 + [0] * 4, list(range(8, -1, -1)))
_AC = ([0, 0, 0, 1] + [0] * 12, [0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    quantiser = _segment(0xDB, b"\0" + b"\x08" * 64)
    frame = _segment(0xC0, struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + b"\x01\x11\x00")
    tables = b"".join(_segment(0xC4, bytes([kind]) + bytes(t[0]) + bytes(t[1])) for kind, t in ((0x00, _DC), (0x10, _AC)))
    return b"\xff\xd8" + quantiser + frame + tables + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _difference_words() -> np.ndarray:
    """The 16 bits of a block for every DC difference from -255 to 255."""
    code_of = {s: (bits, code) for (bits, code), s in _canonical(*_DC).items()}
    out = []
    for d in range(-255, 256):
        category = abs(d).bit_length()
        bits, code = code_of[category]
        magnitude = d if d >= 0 else d + (1 << category) - 1
        out.append(((code << category | magnitude) << 4) & 0xFFFF)
    return np.array(out, dtype=">u2")


_HEAD, _WORDS, _END = _jpeg_head(), _difference_words(), b"\xff\xd9"


def encode_frames(payload: bytes) -> list[bytes]:
    """Baseline JPEGs of a padded payload, ``FRAME`` bytes to each."""
    dc = np.frombuffer(payload, dtype=np.uint8).reshape(-1, FRAME).astype(np.int64) - 128
    words = _WORDS[np.diff(dc, axis=1, prepend=0) + 255]
    return [_HEAD + row.tobytes() + _END for row in words]


class _Tables:
    """The parsed head of a frame; ``parts`` has each component's number of blocks across and down in a unit, and its tables."""

    def __init__(self, head: bytes):
        quant, huff, self.restart, at, found, scan = {}, _standard(), 0, 2, [], {}
        if head[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        for marker, body in _segments(head):
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = _canonical(list(body[1:17]), list(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or n not in (1, 3):
                    raise ValueError("only 8-bit frames of one or three components are decoded")
                found = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("only sequential Huffman frames are decoded")
        if not found or set(scan) != {f[0] for f in found}:
            raise ValueError("only frames of one scan are decoded")
        one = len(found) == 1  # blocks of a single component come one by one
        self.parts = [(1 if one else h, 1 if one else v, quant[q], huff[scan[i] >> 4], huff[0x10 | scan[i] & 15]) for i, h, v, q in found]
        self.wide, self.tall = max(p[0] for p in self.parts), max(p[1] for p in self.parts)
        self.units_across, self.units_down = -(-self.width // (8 * self.wide)), -(-self.height // (8 * self.tall))
        self.across, self.down = self.units_across * self.parts[0][0], self.units_down * self.parts[0][1]  # of the luma
        self.q = self.parts[0][2]
        self.fixed = self._fixed()

    def _fixed(self) -> np.ndarray | None:
        """DC difference by 16-bit word, if every flat block takes 16 bits; -1000 where the word is no such block."""
        dc, ac = self.parts[0][3:]
        if len(self.parts) > 1 or self.restart or list(ac.values()) != [0] or any(bits + s + next(iter(ac))[0] != 16 for (bits, _), s in dc.items()):
            return None
        (end_bits, end_code), out = next(iter(ac)), np.full(1 << 16, -1000, dtype=np.int64)
        for (_, code), s in dc.items():
            m = np.arange(1 << s)
            value = np.where(m >> max(0, s - 1) == 1, m, m - (1 << s) + 1) if s else np.zeros(1, dtype=np.int64)
            out[((code << s | m) << end_bits) | end_code] = value
        return out


def _segments(head: bytes):
    """(marker, body) of the segments after the start marker; bytes of filling before a marker are passed over."""
    at = 2
    while at + 4 <= len(head):
        while head[at + 1] == 0xFF:
            at += 1
        size = struct.unpack_from(">H", head, at + 2)[0]
        yield head[at + 1], head[at + 4 : at + 2 + size]
        at += 2 + size


_PARSED: dict[bytes, _Tables] = {}


def _split(frame: bytes) -> tuple[bytes, bytes]:
    """Head up to and with the scan header, and the scan's data."""
    at = 2
    while True:
        while frame[at + 1] == 0xFF:
            at += 1
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        at += 2 + size
        if marker == 0xDA:
            end = frame.rfind(b"\xff\xd9")
            return frame[:at], frame[at : end if end >= at else len(frame)]


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def _scan_blocks(data: bytes, t: _Tables) -> list[np.ndarray]:
    """Quantised coefficients of every component's blocks, row by row of blocks, symbol by symbol."""
    out = [np.zeros((t.units_down * v, t.units_across * h, 64), dtype=np.int64) for h, v, *_ in t.parts]
    parts, bits, last, used = [], "", [0] * len(t.parts), 0
    start = at = 0
    while at < len(data):  # part at restart markers
        if data[at] == 0xFF and at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[start:at])
            at = start = at + 2
        else:
            at += 1
    parts.append(data[start:])
    streams = iter(parts)

    def symbol(table: dict[tuple[int, int], int]) -> int:
        nonlocal used
        code = 0
        for n in range(1, 17):
            code = code << 1 | (bits[used] == "1")
            used += 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("bad Huffman code")

    def number(n: int) -> int:
        nonlocal used
        if not n:
            return 0
        v = int(bits[used : used + n], 2)
        used += n
        return v if v >> (n - 1) else v - (1 << n) + 1

    for unit in range(t.units_across * t.units_down):
        if unit == 0 or t.restart and unit % t.restart == 0:
            raw = next(streams).replace(b"\xff\x00", b"\xff")
            bits, used, last = "".join(f"{x:08b}" for x in raw), 0, [0] * len(t.parts)
        down, across = divmod(unit, t.units_across)
        for i, (h, v, _, dc, ac) in enumerate(t.parts):
            for y in range(v):
                for x in range(h):
                    block = out[i][down * v + y, across * h + x]
                    last[i] += number(symbol(dc))
                    block[0], k = last[i], 1
                    while k < 64 and (s := symbol(ac)) != 0:
                        k += s >> 4
                        block[k] = number(s & 15)
                        k += 1
    return out


def decode_planes(frame: bytes) -> list[np.ndarray]:
    """The planes of a frame's components, all of the frame's size: gray, or luma and two of colour."""
    head, data = _split(frame)
    t, planes = _PARSED.get(head) or _Tables(head), []
    for (h, v, q, *_), found in zip(t.parts, _scan_blocks(data, t), strict=True):
        coefficients = np.zeros((found.shape[0] * found.shape[1], 64))
        coefficients[:, _ZIGZAG] = found.reshape(-1, 64) * q
        blocks = np.einsum("xu,nuv,yv->nxy", _COS, coefficients.reshape(-1, 8, 8), _COS)
        image = np.clip(np.rint(blocks) + 128, 0, 255).astype(np.uint8)
        image = image.reshape(*found.shape[:2], 8, 8).swapaxes(1, 2).reshape(found.shape[0] * 8, found.shape[1] * 8)
        rows, columns = np.arange(t.height) * v // t.tall, np.arange(t.width) * h // t.wide
        planes.append(image[rows[:, None], columns])
    return planes


def decode_frame(frame: bytes) -> np.ndarray:
    """Pixels of a gray frame, or the luma of one in colour."""
    return decode_planes(frame)[0]


def _block_means(frame: bytes) -> np.ndarray:
    """The mean of each luma block, which is its DC coefficient."""
    head, data = _split(frame)
    t = _PARSED.get(head) or _Tables(head)
    return np.clip((_scan_blocks(data, t)[0][:, :, 0].ravel() * t.q[0] + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def decode_flat(frames: list[bytes]) -> np.ndarray:
    """The mean of each luma block, frames x blocks: for flat blocks what was stored."""
    if not frames:
        return np.zeros((0, FRAME), dtype=np.uint8)
    head, data = _split(frames[0])
    if head not in _PARSED:
        if len(_PARSED) > 16:
            _PARSED.clear()
        _PARSED[head] = _Tables(head)
    t = _PARSED[head]
    n, size = len(head), len(data)
    alike = all(len(f) == len(frames[0]) and f.startswith(head) for f in frames)
    if alike and t.fixed is not None and size == 2 * t.across * t.down:
        raw = np.frombuffer(b"".join([f[n : n + size] for f in frames]), dtype=">u2").reshape(len(frames), -1)
        step = t.fixed[raw]
        if (step > -1000).all():
            return np.clip((np.cumsum(step, axis=1) * t.q[0] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return np.stack([_block_means(f) for f in frames])


# --- RIFF ---------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], rate: int = 25, size: tuple[int, int] = (ACROSS * 8, DOWN * 8)) -> bytes:
    """An AVI file with one motion-JPEG stream and an ``idx1`` index."""
    width, height = size
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 10_000, 0, 0, 0, width, height)
    form = struct.pack("<IIIHH4sIIIII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movi.append(c)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(c)
    if at + 16 * len(index) + len(head) + 64 >= 1 << 32:
        raise ValueError("a RIFF file holds less than 4 GiB")
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> tuple[float, list[bytes]]:
    """Frame rate and frames, found through the index; ``movi`` lists that none covers are walked."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index = 25.0, [], None

    def walk(at: int, end: int) -> None:
        nonlocal rate, index
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name in (b"LIST", b"RIFF"):
                if media[at + 8 : at + 12] == b"movi":
                    movi.append((at + 8, min(len(media), at + 8 + size)))
                else:
                    walk(at + 12, min(len(media), at + 8 + size))
            elif name == b"strh" and media[at + 8 : at + 12] == b"vids":
                scale, per = struct.unpack_from("<II", media, at + 28)
                rate = per / scale if scale and per else rate
            elif name == b"idx1":
                index = (at + 8, size // 16)
            at += 8 + size + (size & 1)

    walk(0, len(media))

    def listed(start: int) -> list[bytes] | None:
        """The frames of the index, whose offsets count from the list or, in some files, from the file's start."""
        entries = list(struct.iter_unpack("<4sIII", media[index[0] : index[0] + 16 * index[1]]))
        for origin in (start, 0):
            if all(media[origin + at : origin + at + 4] == name for name, _, at, _ in entries):
                return [media[origin + at + 8 : origin + at + 8 + size] for name, _, at, size in entries if name[2:] in (b"dc", b"db") and size]
        return None

    def walked(start: int, end: int) -> list[bytes]:
        at, out = start + 4, []
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":  # a group of chunks
                at += 12
                continue
            if name[2:] in (b"dc", b"db") and size:
                out.append(media[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
        return out

    frames = []
    for k, (start, end) in enumerate(movi):
        found = listed(start) if index and k == 0 else None
        frames += walked(start, end) if found is None else found
    return rate, frames


# --- Shots and columns --------------------------------------------------------------------------------------------


def histogram_distances(samples: np.ndarray, shots: Shots = Shots()) -> np.ndarray:
    """Half the L1 distance of successive frames' histograms, between 0 and 1."""
    n, per = samples.shape
    bins = samples.astype(np.int64) * shots.bins >> 8
    hist = np.bincount((bins + np.arange(n)[:, None] * shots.bins).ravel(), minlength=n * shots.bins).reshape(n, shots.bins)
    return np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * per)


def clips(samples: np.ndarray, rate: float, shots: Shots = Shots()) -> list[tuple[int, int, float, float]]:
    """(first frame, frame after the last, start second, end second) of every shot."""
    n = len(samples)
    d = histogram_distances(samples, shots)
    sums, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    here = np.arange(len(d))
    low = np.maximum(0, here - shots.window)
    size = np.maximum(1, here - low)
    mean = (sums[here] - sums[low]) / size
    spread = np.sqrt(np.maximum(0, (squares[here] - squares[low]) / size - mean**2))
    cut = (here > 0) & (d > np.maximum(shots.least, mean + shots.sensitivity * spread))
    edges = [0, *(here[cut] + 1).tolist(), n]
    return [(a, b, a / rate, b / rate) for a, b in zip(edges, edges[1:])]


def store(text: str | None) -> bytes:
    """The text's UTF-8 as an AVI file."""
    return write_avi(encode_frames(pad((text or "").encode("utf-8"))))


def _digest(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8")
    media = store(text)
    rate, frames = read_avi(media)
    samples = decode_flat(frames)
    back = samples.tobytes()
    found = clips(samples, rate)
    longest = max(b - a for a, b, _, _ in found)
    feature = f"frames={len(frames)};clips={len(found)};longest={longest};mean={samples.mean():.4f};cuts={zlib.crc32(np.array([a for a, *_ in found], dtype='<u4').tobytes())}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


_KINDS = [("n_bytes", T.LongType(), pa.int64()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string())]


def digests(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Each text stored as AVI, read back and described: the columns of the query's contract after ``keep``."""

    def run(texts: list) -> list[pa.Array]:
        rows = [_digest(t) for t in texts]
        return [pa.array([r[i] for r in rows], type=k) for i, (_, _, k) in enumerate(_KINDS)]

    return _util.map_columns(docs, run, [T.StructField(n, k) for n, k, _ in _KINDS], keep)


def media_column(docs: DataFrame, keep: list[str], name: str = "media") -> DataFrame:
    """``keep`` columns and the AVI file of each text as binary."""

    def run(texts: list) -> list[pa.Array]:
        return [pa.array([store(t) for t in texts], type=pa.binary())]

    return _util.map_columns(docs, run, [T.StructField(name, T.BinaryType())], keep)


def clip_rows(df: DataFrame, keep: list[str], media: str = "media", shots: Shots = Shots()) -> DataFrame:
    """One row per clip of each AVI in ``media``: ``keep``, ``clip``, ``first_frame``, ``n_frames``, ``start_s``, ``end_s``, ``error``.

    A null or empty file has no clips and no row; one that cannot be read has a row with ``error`` and without a clip.
    """
    _util.ship(df.sparkSession)
    made = [("clip", T.IntegerType(), pa.int32()), ("first_frame", T.LongType(), pa.int64()), ("n_frames", T.LongType(), pa.int64()), ("start_s", T.DoubleType(), pa.float64()), ("end_s", T.DoubleType(), pa.float64()), ("error", T.StringType(), pa.string())]
    work = _util.packed(df, keep, _util.col(media).alias("m"))
    schema = T.StructType([T.StructField(_util.KEPT, work.schema[_util.KEPT].dataType), *[T.StructField(n, k) for n, k, _ in made]])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                source, rows = [], []
                for i, raw in enumerate(b.column(1).to_pylist()):
                    found: list = []
                    try:
                        if raw:
                            rate, frames = read_avi(raw)
                            found = [(k, a, e - a, s0, s1, None) for k, (a, e, s0, s1) in enumerate(clips(decode_flat(frames), rate, shots))] if frames else []
                            if not frames:
                                raise ValueError("no frames")
                    except (ValueError, struct.error, IndexError, KeyError, StopIteration) as e:
                        found = [(None,) * 5 + (f"{type(e).__name__}: {e}",)]
                    source += [i] * len(found)
                    rows += found
                taken = b.column(0).take(pa.array(source, type=pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, *(pa.array([r[j] for r in rows], type=k) for j, (_, _, k) in enumerate(made))], names=schema.names)

    return _util.unpacked(work.mapInArrow(run, schema), keep, {n: F.col(n) for n, _, _ in made})
