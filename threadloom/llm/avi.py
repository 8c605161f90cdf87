"""Media columns: bytes as a motion-JPEG AVI, read back by its RIFF index, with shots as timed clips.

A payload is stored as 8-bit grey samples, ``WIDTH`` to a line and up to ``LINES`` lines to a frame. Each
frame is a lossless JPEG (SOF3, predictor 1) of its own, so every frame is an intra frame. Its Huffman
table gives category c a code of ``10 - c`` bits; with the c extra bits every difference takes ten bits,
which lets numpy pack and unpack whole frames at once. Byte stuffing follows the standard.

Reading goes by the ``idx1`` chunk: offsets and sizes of the frames, then each frame is decoded. Shots
start where the histogram difference of successive frames exceeds the mean of the differences seen so far
in the shot by ``SPREAD`` standard deviations and ``LEAST`` at least.

Defined results: null text counts as empty; an empty text gives one line of zeros. Equal texts give equal bytes, so
repeated rows give equal rows. An empty table gives an empty result. The last frame has as many lines as are left, told
by its own header. A very long text is held whole with its stored form; RIFF sizes have 32 bits, more than a text of
Spark can have. Only doc_id and text are read, so extra columns of any name do no harm. In shots a difference that ties
with the bound is no cut. Files that are cut short, of other frames, or with a wrong index are defined by ``read_avi``
and ``clip_rows``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, LINES, FPS = 64, 64, 25
BINS, SPREAD, LEAST = 16, 3.0, 0.25
BITS = 10


def _tables() -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ten-bit codes by difference + 255, differences by code, and the DHT segment."""
    codes, back, code = np.zeros(511, np.uint16), np.zeros(1 << BITS, np.int16), 0
    for length in range(2, 11):  # category 8 has two bits, category 0 ten
        c = BITS - length
        for d in [0] if c == 0 else [*range(-(1 << c) + 1, -(1 << (c - 1)) + 1), *range(1 << (c - 1), 1 << c)]:
            extra = d if d > 0 else d + (1 << c) - 1
            word = (code << c) | (extra if c else 0)
            codes[d + 255], back[word] = word, d
        code = (code + 1) << 1
    counts = bytes(1 if 2 <= n <= 10 else 0 for n in range(1, 17))
    table = b"\x00" + counts + bytes(range(8, -1, -1))
    return codes, back, b"\xff\xc4" + struct.pack(">H", 2 + len(table)) + table


CODES, BACK, DHT = _tables()
SCAN = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
SHIFTS = np.arange(BITS - 1, -1, -1, dtype=np.uint16)
POWERS = (1 << SHIFTS).astype(np.uint16)


def encode_frame(samples: np.ndarray) -> bytes:
    """A lossless JPEG of lines x WIDTH samples."""
    s = samples.astype(np.int16)
    diff = np.empty_like(s)
    diff[:, 1:] = s[:, 1:] - s[:, :-1]
    diff[1:, 0] = s[1:, 0] - s[:-1, 0]
    diff[0, 0] = s[0, 0] - 128
    words = CODES[diff.ravel() + 255].astype(np.uint64)
    words = np.concatenate([words, np.full(-len(words) % 4, 1023, np.uint64)]).reshape(-1, 4)
    packed = (words[:, 0] << np.uint64(30)) | (words[:, 1] << np.uint64(20)) | (words[:, 2] << np.uint64(10)) | words[:, 3]
    data = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()[: -(-len(s) * WIDTH * BITS // 8)]
    head = b"\xff\xd8\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, len(s), WIDTH, 1, 1, 0x11, 0) + DHT + SCAN
    return head + data.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


class BrokenMedia(ValueError):
    """Bytes that are no AVI file of lossless JPEG frames."""


def _segments(frame: bytes) -> tuple[dict[int, bytes], int]:
    """Bodies of a frame's marker segments up to the scan, by marker, and where the scan's data begin."""
    if frame[:2] != b"\xff\xd8" or frame[-2:] != b"\xff\xd9":
        raise BrokenMedia("a frame does not begin and end as a JPEG")
    found, at = {}, 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise BrokenMedia("a marker is missing")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        found[marker] = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            return found, at
    raise BrokenMedia("a frame has no scan")


def _huffman(table: bytes) -> dict[tuple[int, int], int]:
    """Category by (length, code) of a DHT body with one table."""
    out, code, at = {}, 0, 17
    for length, count in enumerate(table[1:17], 1):
        for _ in range(count):
            out[length, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _differences(data: bytes, codes: dict[tuple[int, int], int], n: int) -> np.ndarray:
    """n differences from Huffman-coded categories and their extra bits."""
    bits, out, at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), np.zeros(n, np.int64), 0
    for i in range(n):
        code, length = 0, 0
        while (length, code) not in codes:
            if at >= len(bits) or length > 16:
                raise BrokenMedia("a scan ends early")
            code, length, at = code << 1 | bits[at], length + 1, at + 1
        c = codes[length, code]
        extra = int("".join(map(str, bits[at : at + c])) or "0", 2)
        at += c
        out[i] = 0 if c == 0 else extra if extra >> (c - 1) else extra - (1 << c) + 1
    if at > len(bits):
        raise BrokenMedia("a scan ends early")
    return out


def _predicted(diff: np.ndarray, predictor: int, first: int) -> np.ndarray:
    """Samples from differences: the first line from the left, first samples of lines from above, others by the
    predictor over left, above and above left."""
    lines, width = diff.shape
    out = np.zeros((lines, width), np.int64)
    if predictor == 1:
        seeds = diff[:, 0].copy()
        seeds[0] += first
        out = diff.copy()
        out[:, 0] = np.cumsum(seeds)
        return np.cumsum(out, 1) & 0xFF
    rules = {2: lambda a, b, c: b, 3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1}
    if predictor not in rules:
        raise BrokenMedia(f"no predictor {predictor}")
    out[0] = np.cumsum(diff[0] + np.eye(1, width, dtype=np.int64)[0] * first) & 0xFF
    for y in range(1, lines):
        out[y, 0] = (out[y - 1, 0] + diff[y, 0]) & 0xFF
        for x in range(1, width):
            out[y, x] = (rules[predictor](int(out[y, x - 1]), int(out[y - 1, x]), int(out[y - 1, x - 1])) + int(diff[y, x])) & 0xFF
    return out


def decode_frame(frame: bytes) -> np.ndarray:
    """Samples of a lossless JPEG frame of one component of eight bits, with its own Huffman table and predictor. Frames
    with this module's table, where every difference takes ten bits, are unpacked at once."""
    parts, at = _segments(frame)
    if 0xC3 not in parts or len(parts[0xC3]) < 6 or 0xC4 not in parts or len(parts[0xDA]) < 6:
        raise BrokenMedia("no lossless frame with a table")
    bits, lines, width, components = struct.unpack_from(">BHHB", parts[0xC3])
    predictor, shift = parts[0xDA][-3], parts[0xDA][-1] & 15
    if bits != 8 or components != 1 or not lines or not width or shift:
        raise BrokenMedia("only frames of one component of eight bits can be read")
    data, n = frame[at:-2].replace(b"\xff\x00", b"\xff"), lines * width
    if parts[0xC4] == DHT[4:]:
        if len(data) < -(-n * BITS // 8):
            raise BrokenMedia("a scan ends early")
        raw = np.frombuffer(data + b"\x00" * (-len(data) % 5), np.uint8).reshape(-1, 5).astype(np.uint64)
        packed = (raw[:, 0] << np.uint64(32)) | (raw[:, 1] << np.uint64(24)) | (raw[:, 2] << np.uint64(16)) | (raw[:, 3] << np.uint64(8)) | raw[:, 4]
        words = np.stack([(packed >> np.uint64(k)) & np.uint64(1023) for k in (30, 20, 10, 0)], 1).ravel()[:n]
        diff = BACK[words].astype(np.int64)
    else:
        diff = _differences(data, _huffman(parts[0xC4]), n)
    return _predicted(diff.reshape(lines, width), predictor, 128).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [encode_frame(samples[k : k + LINES]) for k in range(0, len(samples), LINES)]
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, WIDTH, LINES, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, LINES)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, LINES, 1, 8, b"MJPG", WIDTH * LINES, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + header + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _indexed(media: bytes, movi: int, end: int, index: bytes) -> list[tuple[int, int]] | None:
    """(start, size) of the frames by an index, whose offsets count from the list's name or from the file's beginning;
    None if an entry does not lie on a chunk of its name and size."""
    for base in (movi, 0):
        out = []
        for k in range(0, len(index) - 15, 16):
            name, (where, size) = index[k : k + 4], struct.unpack_from("<II", index, k + 8)
            at = base + where
            if name[2:] in (b"dc", b"db"):
                if at + 8 + size > end or media[at : at + 4] != name or struct.unpack_from("<I", media, at + 4)[0] != size:
                    break
                out.append((at + 8, size))
        else:
            return out
    return None


def read_avi(media: bytes) -> tuple[list[np.ndarray], int]:
    """Frames in index order, and the microseconds of a frame. Without an index, or with one that does not fit the
    chunks, frames are taken in the order of their chunks. What is no such file raises ``BrokenMedia``."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise BrokenMedia("not an AVI file")
    at, movi, end, index, micros = 12, 0, 0, b"", 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi, end = at + 8, min(len(media), at + 8 + size)
        elif name == b"LIST" and media[at + 8 : at + 12] == b"hdrl" and at + 24 <= len(media):
            micros = struct.unpack_from("<I", media, at + 20)[0]
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if not movi or not micros:
        raise BrokenMedia("a list is missing")
    places = _indexed(media, movi, end, index) if index else None
    if places is None:
        places, at = [], movi + 4
        while at + 8 <= end:
            size = struct.unpack_from("<I", media, at + 4)[0]
            if media[at + 2 : at + 4] in (b"dc", b"db"):
                places.append((at + 8, size))
            at += 8 + size + (size & 1)
    if not places:
        raise BrokenMedia("no frames")
    return [decode_frame(media[a : a + n]) for a, n in places], micros


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, last + 1) frame of each shot."""
    hist = np.array([np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames])
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts, seen, total, square = [0], 0, 0.0, 0.0
    for k, d in enumerate(diff.tolist(), 1):
        mean = total / seen if seen else 0.0
        spread = max(0.0, square / seen - mean * mean) ** 0.5 if seen else 0.0
        if d > mean + max(LEAST, SPREAD * spread):
            cuts.append(k)
            seen, total, square = 0, 0.0, 0.0
        else:
            seen, total, square = seen + 1, total + d, square + d * d
    return list(zip(cuts, [*cuts[1:], len(frames)], strict=True))


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\x00" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def media_column(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Digest per document, and the stored bytes with ``keep_media``."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                payload, n = padded(text.as_py())
                media = write_avi(payload)
                frames, micros = read_avi(media)
                back = b"".join(f.tobytes() for f in frames)
                clips = ";".join(f"{a * micros // 1000}-{b * micros // 1000}" for a, b in shots(frames))
                feature = f"frames={len(frames)} mean={sum(back) / len(back):.3f} clips_ms={clips}"
                rows.append((key.as_py(), n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, *[media] * keep_media))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_media]
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def clip_rows(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per shot of each stored file: the key, clip, start_ms, end_ms, error. Null media gives no rows; media that
    cannot be read gives one row with nulls and the reason in ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, m in zip(batch.column(0), batch.column(1), strict=True):
                if m.as_py() is None:
                    continue
                try:
                    frames, micros = read_avi(m.as_py())
                except BrokenMedia as e:
                    rows.append((k.as_py(), None, None, None, str(e)))
                else:
                    rows += [(k.as_py(), i, a * micros // 1000, b * micros // 1000, None) for i, (a, b) in enumerate(shots(frames))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], [key, "clip", "start_ms", "end_ms", "error"])

    return media.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, f"`{key}` long, clip long, start_ms long, end_ms long, error string")
