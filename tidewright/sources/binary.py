"""Row codecs in binary: MessagePack maps and BSON documents, bare or in zstd frames, over Arrow batches.

Rows of nulls, booleans, whole numbers, doubles, texts, bytes and times (UTC; RFC 3339 text in MessagePack, milliseconds in
BSON). Reading takes a schema; fields that are not in it are skipped, missing ones are null, and nesting below 32 levels is
read past. A payload that is cut or malformed is null.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime, timedelta

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_DEPTH = 32
_EPOCH = datetime(1970, 1, 1)


def _plain(v):
    if isinstance(v, datetime):
        return (v.astimezone(UTC).replace(tzinfo=None) if v.tzinfo else v).isoformat(timespec="microseconds")
    return v.isoformat() if isinstance(v, date) else v


def pack(v) -> bytes:
    """One MessagePack value in its shortest form."""
    v = _plain(v)
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        if 0 <= v < 128 or -32 <= v < 0:
            return struct.pack("b" if v < 0 else "B", v)
        forms = [(0xCC, ">BB", 0, 2**8), (0xCD, ">BH", 0, 2**16), (0xCE, ">BI", 0, 2**32), (0xCF, ">BQ", 0, 2**64)] if v > 0 else [(0xD0, ">Bb", -(2**7), 0), (0xD1, ">Bh", -(2**15), 0), (0xD2, ">Bi", -(2**31), 0), (0xD3, ">Bq", -(2**63), 0)]
        mark, form = next((m, f) for m, f, lo, hi in forms if lo <= v < hi)
        return struct.pack(form, mark, v)
    if isinstance(v, float):
        return struct.pack(">Bd", 0xCB, v)
    if isinstance(v, str):
        data = v.encode("utf-8", "surrogatepass")
        return _sized(len(data), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + data
    if isinstance(v, bytes | bytearray):
        return _sized(len(v), 0, 0, (0xC4, 0xC5, 0xC6)) + bytes(v)
    if isinstance(v, dict):
        return _sized(len(v), 0x80, 16, (None, 0xDE, 0xDF)) + b"".join(pack(k) + pack(x) for k, x in v.items())
    return _sized(len(v), 0x90, 16, (None, 0xDC, 0xDD)) + b"".join(map(pack, v))


def _sized(n: int, short: int, below: int, marks: tuple) -> bytes:
    if n < below:
        return bytes([short | n])
    for mark, form, most in zip(marks, (">BB", ">BH", ">BI"), (2**8, 2**16, 2**32), strict=True):
        if mark is not None and n < most:
            return struct.pack(form, mark, n)
    raise ValueError("too long")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("cut payload")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]


_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZES = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}


def unpack(r: _Reader, depth: int = 0):
    m = r.number("B")
    if depth > MAX_DEPTH:
        raise ValueError("nested too deep")
    if m < 0x80 or m >= 0xE0:
        return m if m < 0x80 else m - 256
    if m in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[m]
    if m in _NUMBERS:
        return r.number(_NUMBERS[m])
    n = r.number(_SIZES[m]) if m in _SIZES else m & (0x1F if 0xA0 <= m < 0xC0 else 0x0F)
    if 0xA0 <= m < 0xC0 or m in (0xD9, 0xDA, 0xDB):
        return r.take(n).decode("utf-8", "surrogatepass")
    if m in (0xC4, 0xC5, 0xC6):
        return r.take(n)
    if m < 0x90 or m in (0xDE, 0xDF):
        return {unpack(r, depth + 1): unpack(r, depth + 1) for _ in range(n)}
    if m < 0xA0 or m in (0xDC, 0xDD):
        return [unpack(r, depth + 1) for _ in range(n)]
    raise ValueError("an unknown type")


def bson(row: dict) -> bytes:
    """One BSON document."""
    out = []
    for name, v in row.items():
        key = name.encode() + b"\0"
        if v is None:
            out.append(b"\x0a" + key)
        elif isinstance(v, bool):
            out.append(b"\x08" + key + bytes([v]))
        elif isinstance(v, int):
            out.append(b"\x10" + key + struct.pack("<i", v) if -(2**31) <= v < 2**31 else b"\x12" + key + struct.pack("<q", v))
        elif isinstance(v, float):
            out.append(b"\x01" + key + struct.pack("<d", v))
        elif isinstance(v, datetime):
            v = v.astimezone(UTC).replace(tzinfo=None) if v.tzinfo else v
            out.append(b"\x09" + key + struct.pack("<q", (v - _EPOCH) // timedelta(milliseconds=1)))
        elif isinstance(v, bytes | bytearray):
            out.append(b"\x05" + key + struct.pack("<iB", len(v), 0) + bytes(v))
        elif isinstance(v, dict | list):
            out.append((b"\x03" if isinstance(v, dict) else b"\x04") + key + bson(v if isinstance(v, dict) else {str(i): x for i, x in enumerate(v)}))
        else:
            data = str(_plain(v)).encode("utf-8", "surrogatepass") + b"\0"
            out.append(b"\x02" + key + struct.pack("<i", len(data)) + data)
    body = b"".join(out) + b"\0"
    return struct.pack("<i", len(body) + 4) + body


def unbson(r: _Reader, depth: int = 0) -> dict:
    if depth > MAX_DEPTH:
        raise ValueError("nested too deep")
    end = r.at + r.number("<i")
    out = {}
    while m := r.number("B"):
        stop = r.data.index(b"\0", r.at)
        name = r.take(stop - r.at).decode()
        r.take(1)
        if m in (1, 16, 18):
            v = r.number({1: "<d", 16: "<i", 18: "<q"}[m])
        elif m == 2:
            v = r.take(r.number("<i")).removesuffix(b"\0").decode("utf-8", "surrogatepass")
        elif m in (3, 4):
            v = unbson(r, depth + 1)
            v = v if m == 3 else [*v.values()]
        elif m == 5:
            n = r.number("<i")
            r.take(1)
            v = r.take(n)
        elif m == 8:
            v = r.number("B") == 1
        elif m == 9:
            v = _EPOCH + timedelta(milliseconds=r.number("<q"))
        elif m == 10:
            v = None
        else:
            raise ValueError("an unknown type")
        out[name] = v
    if r.at != end:
        raise ValueError("a wrong length")
    return out


_CODECS: dict[str, tuple[Callable[[dict], bytes], Callable[[bytes], dict]]] = {"msgpack": (pack, lambda b: unpack(_Reader(b))), "bson": (bson, lambda b: unbson(_Reader(b)))}


def encode_rows(df: DataFrame, codec: str, zstd: bool = False, name: str = "payload") -> DataFrame:
    """One payload a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = zstandard.ZstdCompressor() if zstd else None
        for b in batches:
            data = [_CODECS[codec][0](row) for row in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([frame.compress(x) for x in data] if frame else data, pa.binary())], [name])

    return df.mapInArrow(run, f"`{name}` binary")


def _fit(v, kind: T.DataType):
    """The value as the field's type; null if it isn't one."""
    if v is None:
        return None
    try:
        if isinstance(kind, T.TimestampNTZType | T.TimestampType):
            t = v if isinstance(v, datetime) else datetime.fromisoformat(v)
            return t if isinstance(kind, T.TimestampNTZType) else t.replace(tzinfo=t.tzinfo or UTC)
        if isinstance(kind, T.DateType):
            return date.fromisoformat(v[:10])
        if isinstance(kind, T.BooleanType):
            return v if isinstance(v, bool) else None
        if isinstance(kind, T.IntegerType | T.LongType | T.ShortType | T.ByteType):
            return v if isinstance(v, int) and not isinstance(v, bool) else None
        if isinstance(kind, T.DoubleType | T.FloatType):
            return float(v)
        if isinstance(kind, T.BinaryType):
            return v if isinstance(v, bytes) else None
        return v if isinstance(v, str) else None
    except (TypeError, ValueError):
        return None


def decode_rows(df: DataFrame, codec: str, schema: T.StructType, zstd: bool = False, name: str = "payload") -> DataFrame:
    """The fields of ``schema`` from each payload; all null where it can't be read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = zstandard.ZstdDecompressor() if zstd else None
        for b in batches:
            rows = []
            for x in b.column(0).to_pylist():
                try:
                    got = _CODECS[codec][1](frame.decompress(x) if frame else x) if x is not None else {}
                    rows.append(got if isinstance(got, dict) else {})
                except (ValueError, KeyError, struct.error, zstandard.ZstdError):
                    rows.append({})
            cols = [pa.array([_fit(r.get(f.name), f.dataType) for r in rows], arrow.field(f.name).type) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.select(f"`{name}`").mapInArrow(run, schema)
