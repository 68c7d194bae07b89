"""Motion-JPEG clips in AVI: bytes stored as samples of lossless JPEG frames, read back by the RIFF index.

A frame is a lossless JPEG (process 14, predictor 1) of ``WIDTH`` x ``HEIGHT`` 8-bit samples. Its
Huffman table gives the difference category s a code of 9 - s bits, so a code and its s extra bits are
always 9 bits, and whole frames are coded and decoded as arrays. Frames with other tables are decoded
bit by bit. Shots are cut where the histogram difference of two frames exceeds an adaptive threshold.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT = 64, 16
FRAME = WIDTH * HEIGHT
FPS = 25
BLOCK = 64
CATEGORIES = 9
CLIPS = "array<struct<clip:int,first_frame:int,n_frames:int,start_s:double,end_s:double,score:double>>"

# --- 9-bit symbols -------------------------------------------------------------------------------


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each difference from -255 to 255 (at difference + 255), and the difference of each symbol."""
    symbol, difference = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (9 - s)) - 2 if s < 9 else 0  # canonical: category 8 is 0, 7 is 10, 6 is 110, ...
        extra = d if d > 0 else d + (1 << s) - 1
        symbol[d + 255] = (prefix << s) | extra
        difference[symbol[d + 255]] = d
    return symbol, difference


SYMBOL, DIFFERENCE = _code_tables()


def _pack9(symbols: np.ndarray) -> np.ndarray:
    """(n, 8k) symbols as (n, 9k) bytes."""
    s = symbols.reshape(-1, 8).astype(np.uint16)
    out = np.empty((len(s), 9), np.uint8)
    out[:, 0] = s[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (s[:, k - 1] << (8 - k)) | (s[:, k] >> (k + 1))
    out[:, 8] = s[:, 7]
    return out.reshape(len(symbols), -1)


def _unpack9(data: np.ndarray) -> np.ndarray:
    b = data.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        out[:, k] = ((b[:, k] << (k + 1)) | (b[:, k + 1] >> (7 - k))) & 511
    return out.reshape(len(data), -1)


def _differences(samples: np.ndarray) -> np.ndarray:
    """Predictor 1: the left neighbour; the first of a row: the one above; the first of all: 128."""
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    return d


def _samples(d: np.ndarray) -> np.ndarray:
    x = d.astype(np.int32)
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1)
    return np.cumsum(x, axis=2).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Category counts by code length 1 to 16, then the categories: 8 has one bit, 0 has nine.
_HUFFMAN = bytes([0]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
_HEAD = b"\xff\xd8" + _segment(0xC4, _HUFFMAN) + _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of (n, HEIGHT, WIDTH) samples."""
    coded = _pack9(SYMBOL[_differences(samples).reshape(len(samples), -1) + 255])
    return [_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in coded]


def _parse_jpeg(frame: bytes) -> tuple[int, int, bytes, bytes]:
    """Height, width, Huffman table and entropy-coded bytes of a lossless JPEG with one component."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, table, size = 2, b"", (0, 0)
    while True:
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC4:
            table = body[1:]
        elif marker == 0xC3:
            size = struct.unpack_from(">HH", body, 1)
        elif marker == 0xDA:
            return *size, table, frame[at : frame.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")


def _decode_any(height: int, width: int, table: bytes, data: bytes) -> np.ndarray:
    """Bit by bit, for any Huffman table."""
    codes, code, at = {}, 0, 16
    for n, count in enumerate(table[:16], 1):
        for _ in range(count):
            codes[n, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    d, at = [], 0
    while len(d) < height * width:
        code, n = 0, 0
        while (n, code) not in codes:
            code, n, at = code << 1 | bits[at], n + 1, at + 1
        s, extra = codes[n, code], 0
        for _ in range(s):
            extra, at = extra << 1 | bits[at], at + 1
        d.append(extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1)
    return _samples(np.array(d, np.int16).reshape(1, height, width))[0]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(n, height, width) samples of lossless JPEG frames of one size."""
    parsed = [_parse_jpeg(f) for f in frames]
    if parsed and all(p[:3] == (HEIGHT, WIDTH, _HUFFMAN[1:]) for p in parsed):
        data = np.frombuffer(b"".join(p[3] for p in parsed), np.uint8).reshape(len(parsed), -1)
        return _samples(DIFFERENCE[_unpack9(data)].reshape(-1, HEIGHT, WIDTH))
    return np.array([_decode_any(*p) for p in parsed], np.uint8)


# --- AVI -----------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def encode_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold ``payload``; the last is filled up with 0, and an info chunk keeps the length."""
    n = -(-len(payload) // FRAME)
    samples = np.frombuffer(payload.ljust(n * FRAME, b"\0"), np.uint8).reshape(n, HEIGHT, WIDTH)
    frames = encode_frames(samples)
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"IPLN", b"%d" % len(payload)))
    return _chunk(b"RIFF", b"AVI " + head + info + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[float, int, list[bytes]]:
    """Frames a second, payload bytes (0 if not given) and the frames that the index names."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    found: dict[bytes, int] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST":
                found.setdefault(data[at + 8 : at + 12], at + 8)
                if data[at + 8 : at + 12] != b"movi":
                    walk(at + 12, at + 8 + n)
            else:
                found.setdefault(name, at)
            at += 8 + n + (n & 1)

    walk(12, len(data))
    scale, rate = struct.unpack_from("<II", data, found[b"strh"] + 8 + 20)
    length = int(data[(at := found[b"IPLN"]) + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]]) if b"IPLN" in found else 0
    frames, movi, at = [], found[b"movi"], found[b"idx1"]
    for k in range(struct.unpack_from("<I", data, at + 4)[0] // 16):
        name, _, offset, n = struct.unpack_from("<4sIII", data, at + 8 + 16 * k)
        if name[2:] in (b"dc", b"db"):
            frames.append(data[movi + offset + 8 : movi + offset + 8 + n])
    return rate / scale, length, frames


def shots(frames: np.ndarray, fps: float = FPS, window: int = 8, factor: float = 1.5, least: float = 0.2) -> list[dict]:
    """Clips between cuts: a frame starts a shot if its histogram differs from the last frame's by more than
    ``least`` and ``factor`` times the mean difference of up to ``window`` frames before it in its shot."""
    if not len(frames):
        return []
    n = len(frames)
    bins = (np.arange(n)[:, None] * 32 + (frames.reshape(n, -1) >> 3)).ravel()
    histogram = np.bincount(bins, minlength=32 * n).reshape(n, 32) / (frames[0].size)
    score = np.concatenate([[0.0], 0.5 * np.abs(np.diff(histogram, axis=0)).sum(axis=1)])
    cuts = [0]
    for k in range(1, n):
        recent = score[max(cuts[-1] + 1, k - window) : k]
        if score[k] > max(least, factor * recent.mean() if len(recent) else 0.0):
            cuts.append(k)
    ends = [*cuts[1:], n]
    return [
        {"clip": i, "first_frame": a, "n_frames": b - a, "start_s": a / fps, "end_s": b / fps, "score": round(float(score[a]), 6)}
        for i, (a, b) in enumerate(zip(cuts, ends, strict=True))
    ]


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of ``block``."""
    return data.ljust(max(block, -(-len(data) // block) * block), b"\0")


# --- Spark ---------------------------------------------------------------------------------------


def to_avi(text: Column) -> Column:
    """The AVI file of each text's padded UTF-8 bytes; null counts as empty."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: encode_avi(padded((x or "").encode())))

    return F.pandas_udf(run, "binary")(text)


def _clips(media: bytes | None) -> list[dict] | None:
    if media is None:
        return None
    fps, _, frames = read_avi(media)
    return shots(decode_frames(frames), fps)


def clips(media: Column) -> Column:
    """The timed clips of each AVI file; null for null."""

    def run(files: pd.Series) -> pd.Series:
        return files.map(_clips)

    return F.pandas_udf(run, CLIPS)(media)


def clip_rows(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per clip of the AVI files in ``column``, beside the other columns; a clip's column whose name one of them has is led by clip_."""
    others = [c for c in media.columns if c != column]
    found = media.select(F.struct(*others).alias("_row") if others else F.lit(None).alias("_row"), F.explode(clips(F.col(column))).alias("_clip"))
    own = [F.col(f"_clip.{c}").alias(f"clip_{c}" if c in others else c) for c in found.select("_clip.*").columns]
    return found.select(*(F.col(f"_row.`{c}`").alias(c) for c in others), *own)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores each text as an AVI file in a binary column, reads the stored bytes back, and returns digests.

    feature: frames, shots, the first frames of the shots after the first, mean and deviation of the
    payload's samples. Null and empty texts are 64 bytes 0. Equal texts give equal values. Repeated rows each
    give a row; a null doc_id stays null; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n_bytes, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = data.as_py()
                fps, length, frames = read_avi(media)
                samples = decode_frames(frames)
                payload = samples.tobytes()[:length]
                found = shots(samples, fps)
                values = np.frombuffer(payload, np.uint8)
                feature = f"frames={len(frames)};shots={len(found)};cuts={','.join(str(c['first_frame']) for c in found[1:])};mean={values.mean():.4f};std={values.std():.4f}"
                out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    stored = docs.select(
        F.col("doc_id").cast("long"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), to_avi(F.col("text")).alias("media")
    )
    return stored.mapInArrow(run, DIGEST)
