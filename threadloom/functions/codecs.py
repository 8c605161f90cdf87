"""yEnc and uuencode as Arrow UDFs over binary columns; null in, null out."""

from __future__ import annotations

import binascii
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

PLUS42, MINUS42 = bytes((i + 42) % 256 for i in range(256)), bytes((i - 42) % 256 for i in range(256))
PLUS64, MINUS64 = bytes((i + 64) % 256 for i in range(256)), bytes((i - 64) % 256 for i in range(256))
CRITICAL = re.compile(rb"[\x00\r\n=]")
COLUMNS = 128
#: Bytes that the offsets of a binary column reach.
MOST = (1 << 31) - 1


def yenc(data: bytes, name: str = "file", part: int | None = None, parts: int = 1, begin: int = 0, size: int | None = None) -> bytes:
    """A yEnc block. With ``part`` it is one of ``parts`` of a file of ``size`` bytes, of which it starts at ``begin``."""
    body = CRITICAL.sub(lambda m: b"=" + m[0].translate(PLUS64), data.translate(PLUS42))
    lines, at = [], 0
    while at < len(body):
        end = at + COLUMNS
        end += body[end - 1 : end] == b"="  # an escape and its sign stay together
        lines.append(body[at:end])
        at = end
    total, crc = len(data) if size is None else size, f"{zlib.crc32(data):08x}"
    if part is None:
        head, tail = [f"=ybegin line={COLUMNS} size={total} name={name}"], f"=yend size={len(data)} crc32={crc}"
    else:
        head = [f"=ybegin part={part} total={parts} line={COLUMNS} size={total} name={name}", f"=ypart begin={begin + 1} end={begin + len(data)}"]
        tail = f"=yend size={len(data)} part={part} pcrc32={crc}"
    return b"\r\n".join([*(h.encode() for h in head), *lines, tail.encode(), b""])


def unyenc_part(text: bytes) -> dict | None:
    """name, part, parts, begin, finish (exclusive), size, content and ok of the first block of a text; ok tells that
    length and sum are as told. None without a block that ends."""
    body, found = [], {}
    for line in re.split(rb"\r?\n", text):
        if line.startswith(b"=ybegin "):
            found["head"] = line
        elif line.startswith(b"=yend ") and found:
            found["end"] = line
            break
        elif line.startswith(b"=ypart ") and found:
            found["part"] = line
        elif found:
            body.append(line)
    if "end" not in found:
        return None
    data = re.sub(rb"=(.)", lambda m: m[1].translate(MINUS64), b"".join(body), flags=re.S).translate(MINUS42)
    number = lambda line, key: int(m[1]) if (m := re.search(rb"\b%s=([0-9]+)" % key, found.get(line, b""))) else None
    crc = re.search(rb"\bpcrc32=([0-9A-Fa-f]{1,8})", found["end"]) or (None if "part" in found else re.search(rb"\bcrc32=([0-9A-Fa-f]{1,8})", found["end"]))
    size, begin = number("end", b"size"), (number("part", b"begin") or 1) - 1
    name = re.search(rb" name=(.*?)\s*$", found["head"])
    good = (size is None or size == len(data)) and (not crc or int(crc[1], 16) == zlib.crc32(data))
    return {"name": name[1].decode("utf-8", "replace") if name else None, "part": number("head", b"part"), "parts": number("head", b"total"), "begin": begin, "finish": begin + len(data), "size": number("head", b"size"), "content": data, "ok": good}


def unyenc(text: bytes) -> bytes | None:
    """The content, or None if no block is there or size or sum differ."""
    found = unyenc_part(text)
    return found["content"] if found and found["ok"] else None


def uu(data: bytes, name: str = "file") -> bytes:
    lines = [binascii.b2a_uu(data[k : k + 45]) for k in range(0, len(data), 45)]
    return f"begin 644 {name}\n".encode() + b"".join(lines) + b"`\nend\n"


def unuu(text: bytes) -> bytes | None:
    found = re.search(rb"^begin [0-7]{3,4} [^\r\n]*\r?\n(.*?)^end", text, re.S | re.M)
    if not found:
        return None
    out = []
    for line in re.split(rb"\r?\n", found[1]):
        if line and line != b"`":
            try:
                out.append(binascii.a2b_uu(line))
            except binascii.Error:  # too long a line: take what its length byte says
                n = ((line[0] - 32) & 63) * 4 + 5
                out.append(binascii.a2b_uu(line[: n // 3]))
    return b"".join(out)


def column_of(values: Iterable[bytes | None], n: int) -> pa.Array:
    """A binary column of ``n`` values in one growing buffer, so none but the last is held beside it."""
    data, ends, valid = bytearray(), np.zeros(n + 1, np.int64), np.ones(n, bool)
    for k, v in enumerate(values):
        valid[k] = v is not None
        if v:
            data += v
        ends[k + 1] = len(data)
    if len(data) > MOST:
        raise ValueError(f"a batch of {n} values takes {len(data)} bytes, more than a column holds")
    bits = pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), n, [bits, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _column(f):
    @F.arrow_udf(BinaryType())
    def run(x: pa.Array) -> pa.Array:
        made = column_of((f(v.as_py()) if v.is_valid else None for v in x), len(x))
        pa.default_memory_pool().release_unused()  # a worker lives on, and what its pool keeps counts as the executor's
        return made

    return run


KINDS = {"name": StringType(), "part": IntegerType(), "parts": IntegerType(), "begin": LongType(), "finish": LongType(), "size": LongType(), "content": BinaryType(), "ok": BooleanType()}
FRAMES = {"part": "Int32", "parts": "Int32", "begin": "Int64", "finish": "Int64", "size": "Int64", "ok": "boolean"}


@F.pandas_udf(StructType([StructField(n, k) for n, k in KINDS.items()]))
def yenc_parts(x: pd.Series) -> pd.DataFrame:
    """What ``unyenc_part`` tells, as a struct; nulls without a block."""
    rows = [(unyenc_part(bytes(v)) if v is not None else None) or {} for v in x]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=FRAMES.get(n, object)) for n in KINDS})


@F.pandas_udf(BinaryType())
def yenc_encode_part(content: pd.Series, name: pd.Series, part: pd.Series, parts: pd.Series, begin: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else yenc(bytes(c), n, int(p), int(t), int(b), int(s)) for c, n, p, t, b, s in zip(content, name, part, parts, begin, size, strict=True)], dtype=object)


def chained(content, encoders):
    """Content through encoders, one after another."""
    for encode in encoders:
        content = encode(content)
    return content


yenc_encode, yenc_decode, uu_encode, uu_decode = map(_column, (yenc, unyenc, uu, unuu))


def crc32_hex(content):
    return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")
