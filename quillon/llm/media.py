"""AVI motion-JPEG media columns: write, index, read back, and cut into shots.

Unit of storage: one quantised DCT coefficient.  A baseline JPEG coefficient of
size category 8 takes the values -255..-128 and 128..255, whose eight magnitude
bits run through 0..255; so a byte *is* the magnitude field of one coefficient.
With one Huffman code of eight bits for that category, and a restart marker
after every 8x8 block (which resets the DC predictor), a block of 64 payload
bytes becomes 64 pairs (code byte, payload byte) and a marker.  The stream is
plain baseline JPEG, and coding and decoding are array operations.

Reading starts from the file alone: RIFF lists and the idx1 index lead to the
images, whose quantisation, Huffman, frame and scan headers and restart intervals
are parsed (``parse_jpeg``).  Images whose tables make every coefficient one code
byte and one magnitude byte are decoded as arrays, all other baseline images
bit by bit (``decode_scan``), with any number of components and sampling factors;
other coding processes and missing tables are errors.  ``movie_clips`` detects
shots in any motion-JPEG AVI of such images.

Cases: a null text counts as empty; an empty text is one block of zeros; very long
texts become more frames (RIFF sizes are 32-bit: a text above about 1.9 GB, which no
Arrow string column holds either, is an error); equal rows get equal results; extra
columns are ignored; the result depends on the text alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 64
#: Blocks across and down one frame (64 x 32 pixels, 2048 payload bytes).
ACROSS, DOWN = 8, 4
PER_FRAME = ACROSS * DOWN
FPS = 25
BINS = 16


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    lengths = bytes([0] * 7 + [1] + [0] * 8)  # one code, of eight bits: 00000000
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + b"\x01\x11\x00"),
            _segment(0xC4, b"\x00" + lengths + b"\x08"),
            _segment(0xC4, b"\x10" + lengths + b"\x08"),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        )
    )


HEAD = _jpeg_head()
_LAST = PER_FRAME - 1


def _stuffed(scan: np.ndarray) -> bytes:
    """Entropy-coded bytes of blocks (n x 128): a zero byte after each 0xFF of data."""
    return scan.tobytes().replace(b"\xff", b"\xff\x00")


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG images for a payload whose length is a multiple of 64."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    n = -(-len(blocks) // PER_FRAME)
    full = np.zeros((n * PER_FRAME, BLOCK), np.uint8)
    full[: len(blocks)] = blocks
    plain = not (blocks == 255).any()
    scan = np.zeros((n, PER_FRAME, BLOCK * 2 + 2), np.uint8)
    scan[:, :, 1 : 2 * BLOCK : 2] = full.reshape(n, PER_FRAME, BLOCK)
    scan[:, :, -2] = 0xFF
    scan[:, :, -1] = 0xD0 + np.arange(PER_FRAME) % 8
    scan[:, _LAST, -1] = 0xD9
    out = []
    for k in range(n):
        if plain:
            out.append(HEAD + scan[k].tobytes())
        else:
            out.append(HEAD + b"".join(_stuffed(scan[k, i, :-2]) + scan[k, i, -2:].tobytes() for i in range(PER_FRAME)))
    return out


@dataclass
class Jpeg:
    """Headers of a baseline image, and where its scan starts.

    parts: (id, across, down, quantiser) per component; scan: (component, DC table, AC table)."""

    width: int = 0
    height: int = 0
    restart: int = 0
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], dict[tuple[int, int], int]] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    start: int = 0


def parse_jpeg(image: bytes) -> Jpeg:
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    out, at = Jpeg(), 2
    while True:
        if at + 4 > len(image) or image[at] != 0xFF:
            raise ValueError("a JPEG header is cut short")
        marker, n = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        body = image[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                out.quantisers[k] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                count, code, place, table = list(body[1:17]), 0, 17, {}
                for length, m in enumerate(count, 1):
                    for _ in range(m):
                        table[length, code] = body[place]
                        code, place = code + 1, place + 1
                    code <<= 1
                out.codes[body[0] >> 4, body[0] & 15] = table
                body = body[place:]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples of more than 8 bits")
            out.height, out.width = struct.unpack_from(">HH", body, 1)
            out.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            ids = [p[0] for p in out.parts]
            out.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if any((0, d) not in out.codes or (1, a) not in out.codes for _, d, a in out.scan):
                raise ValueError("a Huffman table is missing")
            out.start = at
            return out


def _is_bytewise(j: Jpeg) -> bool:
    """Whether every coefficient is an eight-bit code and an eight-bit magnitude, every block with a restart marker behind it."""
    one = {(8, 0): 8}
    return len(j.scan) == 1 and j.restart == 1 and all(j.codes[0, d] == one and j.codes[1, a] == one for _, d, a in j.scan)


def _intervals(body: bytes) -> list[bytes]:
    """The entropy-coded bytes between restart markers, without stuffing, up to the end marker."""
    data = np.frombuffer(body, np.uint8)
    marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] != 0) & (data[1:] != 0xFF))
    out, at = [], 0
    for m in marks.tolist():
        out.append(body[at:m].replace(b"\xff\x00", b"\xff"))
        at = m + 2
        if not 0xD0 <= data[m + 1] <= 0xD7:
            break
    return out


def decode_scan(image: bytes, j: Jpeg) -> list[np.ndarray]:
    """Quantised coefficients (blocks down x blocks across x 64, in scan order) of every component."""
    if len(j.scan) != len(j.parts):
        raise ValueError("components in several scans")
    across, down = max(p[1] for p in j.parts), max(p[2] for p in j.parts)
    if len(j.parts) == 1:
        wide, high, units = -(-j.width // 8), -(-j.height // 8), [(0, 1, 1)]
    else:
        wide, high, units = -(-j.width // (8 * across)), -(-j.height // (8 * down)), [(k, p[1], p[2]) for k, p in enumerate(j.parts)]
    out = [np.zeros((high * v, wide * h, BLOCK), np.int64) for _, h, v in units]
    mcu, per = 0, j.restart or wide * high
    for raw in _intervals(image[j.start :]):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist()
        at, last = 0, [0] * len(units)

        def code(table: dict[tuple[int, int], int], bits=bits) -> int:
            nonlocal at
            value = 0
            for length in range(1, 17):
                value = value << 1 | bits[at]
                at += 1
                if (length, value) in table:
                    return table[length, value]
            raise ValueError("no such Huffman code")

        def number(size: int, bits=bits) -> int:
            nonlocal at
            value = 0
            for b in bits[at : at + size]:
                value = value << 1 | b
            at += size
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        for _ in range(min(per, wide * high - mcu)):
            row, col = divmod(mcu, wide)
            for part, dc, ac in j.scan:
                _, h, v = units[part]
                for y in range(v):
                    for x in range(h):
                        block = out[part][row * v + y, col * h + x]
                        last[part] += number(code(j.codes[0, dc]))
                        block[0], k = last[part], 1
                        while k < BLOCK:
                            run, size = divmod(code(j.codes[1, ac]), 16)
                            if not size and run < 15:
                                break
                            k += run
                            if size:
                                block[k] = number(size)
                            k += 1
            mcu += 1
    if mcu < wide * high:
        raise ValueError("the scan is cut short")
    return out


def decode_coefficients(image: bytes) -> np.ndarray:
    """The magnitude bytes of one bytewise image, blocks x 64."""
    j = parse_jpeg(image)
    if not _is_bytewise(j):
        raise ValueError("not an image of bytes")
    body = image[j.start :]
    blocks, size = -(-j.width // 8) * -(-j.height // 8), BLOCK * 2 + 2
    if len(body) != blocks * size:
        pairs = np.frombuffer(body, np.uint8)
        keep = np.ones(len(pairs), bool)
        keep[1:] = ~((pairs[:-1] == 0xFF) & (pairs[1:] == 0))
        body = pairs[keep].tobytes()
    return np.frombuffer(body, np.uint8).reshape(blocks, size)[:, 1 : 2 * BLOCK : 2]


def decode_luma(image: bytes) -> np.ndarray:
    """Samples (height x width) of the first component of any baseline image."""
    j = parse_jpeg(image)
    q = j.quantisers[j.parts[0][3]]
    if _is_bytewise(j):
        v = decode_coefficients(image).astype(np.int64)
        coef = np.where(v < 128, v - 255, v).reshape(-(-j.height // 8), -(-j.width // 8), BLOCK)
    else:
        coef = decode_scan(image, j)[0]
    x = np.clip(np.rint((coef * q).astype(np.float32) @ _TRANSFORM + 128), 0, 255).astype(np.uint8)
    x = x.reshape(*x.shape[:2], 8, 8).transpose(0, 2, 1, 3)
    return x.reshape(x.shape[0] * 8, -1)[: j.height, : j.width]


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """A RIFF AVI with one video stream, an idx1 index, and the payload's length in LIST INFO."""
    images = encode_frames(payload)
    w, h = ACROSS * 8, DOWN * 8
    most = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(images), 0, 1, most, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(images), most, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    strl = b"LIST" + struct.pack("<I", 4 + 8 + len(strh) + 8 + len(strf)) + b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ISBJ", b"%d\x00" % len(payload)))
    movi, index, at = [b"movi"], [], 4
    for image in images:
        c = _chunk(b"00dc", image)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        movi.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        tag, n = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        yield tag, at + 8, n
        at += 8 + n + n % 2


def images_of(avi: bytes) -> tuple[list[bytes], int | None, int]:
    """The images by way of idx1, the payload's length where LIST INFO has it, and the microseconds of a frame."""
    data = memoryview(avi)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    movi = length = None
    per_frame = 1_000_000 // FPS
    entries: list[tuple[bytes, int, int]] = []
    for tag, at, n in _chunks(data, 12, len(data)):
        kind = bytes(data[at : at + 4]) if tag == b"LIST" else b""
        if kind == b"movi":
            movi = at
        elif kind == b"hdrl":
            per_frame = next((struct.unpack_from("<I", data, a)[0] for t, a, _ in _chunks(data, at + 4, at + n) if t == b"avih"), per_frame)
        elif kind == b"INFO":
            for t, a, m in _chunks(data, at + 4, at + n):
                if t == b"ISBJ":
                    length = int(bytes(data[a : a + m]).rstrip(b"\x00"))
        elif tag == b"idx1":
            entries = [struct.unpack_from("<4s4xII", data, at + 16 * i) for i in range(n // 16)]
    if movi is None:
        raise ValueError("AVI without movie data")
    video = [(o, n) for tag, o, n in entries if tag[2:] in (b"dc", b"db")]
    # offsets count from the list's type or, with some writers, from the file's start
    base = movi if not video or bytes(data[movi + video[0][0] + 2 : movi + video[0][0] + 4]) in (b"dc", b"db") else 0
    return [bytes(data[base + o + 8 : base + o + 8 + n]) for o, n in video], length, per_frame


def read_avi(avi: bytes) -> tuple[np.ndarray, int]:
    """Blocks (n x 64) of all frames by way of idx1, and the payload's length."""
    images, length, _ = images_of(avi)
    if length is None:
        raise ValueError("AVI without a payload's length")
    return np.concatenate([decode_coefficients(x) for x in images]), length


def movie_clips(avi: bytes) -> list[tuple[int, int, int]]:
    """Timed clips (start ms, end ms, frames) of any AVI of baseline JPEG images."""
    images, _, per_frame = images_of(avi)
    if not images:
        return []
    frames = [decode_luma(x) for x in images]
    hist = np.stack([np.bincount(f.ravel() >> 4, minlength=BINS) for f in frames])
    starts = shots(hist, pixels=frames[0].size)
    return [(a * per_frame // 1000, b * per_frame // 1000, b - a) for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)]


def _basis() -> np.ndarray:
    k = np.arange(8)
    b = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    b[0] /= np.sqrt(2)
    return b.astype(np.float32)


def _zigzag() -> np.ndarray:
    """Place in the block (row * 8 + column) of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


BASIS, ZIGZAG = _basis(), _zigzag()
_TRANSFORM = np.einsum("ur,vc->uvrc", BASIS, BASIS).reshape(64, 64)[ZIGZAG]


def luma(blocks: np.ndarray) -> np.ndarray:
    """Decoded 8-bit samples of blocks of magnitude bytes."""
    v = blocks.astype(np.float32)
    v -= np.where(blocks < 128, np.float32(255), np.float32(0))
    x = v @ _TRANSFORM
    x += 128
    np.rint(x, out=x)
    return np.clip(x, 0, 255, out=x).astype(np.uint8)


def shots(histograms: np.ndarray, window: int = 8, factor: int = 2, pixels: int = 64 * PER_FRAME) -> list[int]:
    """First frames of the clips: a cut stands where the histogram difference
    exceeds ``factor`` times the mean of the ``window`` differences before it
    (integer arithmetic; the first difference is compared with half a frame)."""
    d = np.abs(np.diff(histograms.astype(np.int64), axis=0)).sum(axis=1)
    total = np.concatenate(([0], np.cumsum(d)))
    i = np.arange(len(d))
    lo = np.maximum(0, i - window)
    n, s = i - lo, total[i] - total[lo]
    cut = np.where(n > 0, d * n > factor * s, 2 * d > pixels)
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def clips(blocks: np.ndarray) -> list[tuple[int, int, int]]:
    """Timed clips (start ms, end ms, frames) of a decoded movie."""
    n = len(blocks) // PER_FRAME
    hist = np.zeros((n, BINS), np.int64)
    step = 64
    for k in range(0, n, step):
        part = luma(blocks[k * PER_FRAME : (k + step) * PER_FRAME])
        m = len(part) // PER_FRAME
        code = (part >> 4).reshape(m, -1).astype(np.int32) + (np.arange(m, dtype=np.int32) * BINS)[:, None]
        hist[k : k + m] = np.bincount(code.ravel(), minlength=m * BINS).reshape(m, BINS)
    starts = shots(hist)
    ends = [*starts[1:], n]
    return [(a * 1000 // FPS, b * 1000 // FPS, b - a) for a, b in zip(starts, ends, strict=True)]


def pad(raw: bytes) -> bytes:
    """``raw`` and zero bytes up to a positive multiple of 64."""
    return raw + b"\x00" * (-len(raw) % BLOCK if raw else BLOCK)


MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)
CLIP_SCHEMA = "doc_id long, clip int, start_ms long, end_ms long, frames int"


def _movies(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, bytes, bytes, np.ndarray, int]]]:
    """Rows (id, raw text, AVI bytes, blocks read back, payload length), a few megabytes at a time."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        rows, held = [], 0
        for i, doc_id in enumerate(ids):
            raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
            avi = write_avi(pad(raw))
            blocks, length = read_avi(avi)
            rows.append((doc_id, raw, avi, blocks, length))
            held += len(avi)
            if held > 4_000_000:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.strip().split()[0] for f in MEDIA_SCHEMA.split(",")]
    for rows in _movies(batches):
        out = []
        for doc_id, raw, avi, blocks, length in rows:
            back = blocks.tobytes()[:length]
            cut = clips(blocks)
            feature = f"frames={len(blocks) // PER_FRAME};clips={len(cut)};ms=" + ",".join(f"{a}-{b}" for a, b, _ in cut)
            out.append(
                (doc_id, len(raw), length, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(avi), hashlib.sha256(avi).hexdigest(), feature)
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if n.endswith("256") or n == "feature" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names
        )


def _clip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _movies(batches):
        out = [(r[0], i, *c) for r in rows for i, c in enumerate(clips(r[3]))]
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "clip", "start_ms", "end_ms", "frames"])


def _media_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _movies(batches):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "media"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: sizes, digests of what was stored and read back, and the clips."""
    return _source(docs, id_col, text_col).mapInArrow(_digests, MEDIA_SCHEMA)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The AVI files themselves: (doc_id, media)."""
    return _source(docs, id_col, text_col).mapInArrow(_media_bytes, "doc_id long, media binary")


def clip_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Timed clip rows: (doc_id, clip, start_ms, end_ms, frames)."""
    return _source(docs, id_col, text_col).mapInArrow(_clip_rows, CLIP_SCHEMA)
