"""Column encodings: runs, deltas, truth values, typed values."""

from __future__ import annotations

import struct
from decimal import Decimal
from itertools import groupby

from ..functions import leb128
from ..functions.leb128 import Malformed
from ..schema import BYTES, COUNTER, FALSE, FLOAT, INT, NULL, STRING, TIMESTAMP, TRUE, UINT

# Column types, and numbers of the columns of ops and changes: fixed values of the format.
GROUP, ACTOR, INTEGER, DELTA, BOOLEAN, TEXT, META, RAW = range(8)
OP_COLUMNS = {
    "obj_actor": 1, "obj_ctr": 2, "key_actor": 17, "key_ctr": 19, "key_str": 21, "id_actor": 33, "id_ctr": 35, "insert": 52, "action": 66, "value_meta": 86, "value": 87,
    "pred_group": 112, "pred_actor": 113, "pred_ctr": 115, "succ_group": 128, "succ_actor": 129, "succ_ctr": 131, "expand": 148, "mark_name": 165,
}
CHANGE_COLUMNS = {"actor": 1, "seq": 3, "max_op": 19, "time": 35, "message": 53, "deps_group": 64, "deps_index": 67, "extra_meta": 86, "extra": 87}
DEFLATE = 8


def _number(x: int) -> bytes:
    return leb128.unsigned(x)


def _text(x: str) -> bytes:
    raw = x.encode()
    return leb128.unsigned(len(raw)) + raw


_WRITE = {"uint": _number, "int": leb128.signed, "text": _text}


def _read_text(data: bytes, at: int) -> tuple[str, int]:
    n, at = leb128.read_unsigned(data, at)
    if at + n > len(data):
        raise Malformed("unexpected end")
    return data[at : at + n].decode(), at + n


_READ = {"uint": leb128.read_unsigned, "int": leb128.read_signed, "text": _read_text}


def encode_runs(values: list, kind: str) -> bytes:
    """Runs of two or more alike, runs of nulls, and literals between them; a column of nulls alone is empty."""
    if all(v is None for v in values):
        return b""
    out, literal = bytearray(), []

    def flush() -> None:
        if literal:
            out.extend(leb128.signed(-len(literal)))
            for v in literal:
                out.extend(_WRITE[kind](v))
            literal.clear()

    for v, run in groupby(values):
        n = sum(1 for _ in run)
        if v is not None and n == 1:
            literal.append(v)
            continue
        flush()
        out.extend(leb128.signed(0) + leb128.unsigned(n) if v is None else leb128.signed(n) + _WRITE[kind](v))
    flush()
    return bytes(out)


def decode_runs(data: bytes, kind: str) -> list:
    out, at = [], 0
    while at < len(data):
        n, at = leb128.read_signed(data, at)
        if n > 0:
            v, at = _READ[kind](data, at)
            out += [v] * n
        elif n == 0:
            n, at = leb128.read_unsigned(data, at)
            out += [None] * n
        else:
            for _ in range(-n):
                v, at = _READ[kind](data, at)
                out.append(v)
    return out


def encode_deltas(values: list) -> bytes:
    base, out = 0, []
    for v in values:
        out.append(None if v is None else v - base)
        base = base if v is None else v
    return encode_runs(out, "int")


def decode_deltas(data: bytes) -> list:
    base, out = 0, []
    for v in decode_runs(data, "int"):
        base += v or 0
        out.append(None if v is None else base)
    return out


def encode_bools(values: list, optional: bool = False) -> bytes:
    """Lengths of runs, beginning with false; an optional column without true is empty."""
    if optional and not any(values):
        return b""
    out, last = bytearray(), False
    count = 0
    for v in values:
        if bool(v) != last:
            out += leb128.unsigned(count)
            last, count = bool(v), 0
        count += 1
    return bytes(out + leb128.unsigned(count)) if values else b""


def decode_bools(data: bytes) -> list:
    out, at, value = [], 0, False
    while at < len(data):
        n, at = leb128.read_unsigned(data, at)
        out += [value] * n
        value = not value
    return out


def encode_value(v: dict) -> tuple[int, bytes]:
    """Meta word and payload of a value struct."""
    tag = v["tag"]
    if tag in (NULL, FALSE, TRUE):
        raw = b""
    elif tag == UINT:
        raw = leb128.unsigned(int(v["u"]))
    elif tag in (INT, COUNTER, TIMESTAMP):
        raw = leb128.signed(v["l"])
    elif tag == FLOAT:
        raw = struct.pack("<d", v["d"])
    elif tag == STRING:
        raw = v["s"].encode()
    else:
        raw = bytes(v["b"] or b"")
    return len(raw) << 4 | tag, raw


def decode_value(meta: int, raw: bytes) -> dict:
    tag = meta & 15
    out = {"tag": tag, "l": None, "u": None, "d": None, "s": None, "b": None}
    if tag == UINT:
        out["u"] = Decimal(leb128.read_unsigned(raw, 0)[0])
    elif tag in (INT, COUNTER, TIMESTAMP):
        out["l"] = leb128.read_signed(raw, 0)[0]
    elif tag == FLOAT:
        if len(raw) != 8:
            raise Malformed("a float64 has 8 bytes")
        out["d"] = struct.unpack("<d", raw)[0]
    elif tag == STRING:
        out["s"] = raw.decode()
    elif tag >= BYTES:
        out["b"] = raw
    return out


def encode_values(values: list[dict]) -> tuple[bytes, bytes]:
    """The meta and the payload column."""
    pairs = [encode_value(v) for v in values]
    return encode_runs([m for m, _ in pairs], "uint"), b"".join(raw for _, raw in pairs)


def decode_values(meta: bytes, raw: bytes, n: int) -> list[dict]:
    out, at = [], 0
    for m in padded(decode_runs(meta, "uint"), n):
        size = (m or 0) >> 4
        if at + size > len(raw):
            raise Malformed("unexpected end")
        out.append(decode_value(m or 0, raw[at : at + size]))
        at += size
    return out


def padded(values: list, n: int, fill=None) -> list:
    """A short column goes on with nulls."""
    return [*values, *[fill] * (n - len(values))]


def write_columns(columns: dict[int, bytes]) -> tuple[bytes, bytes]:
    """Directory and data of the columns that hold anything, by number."""
    some = sorted((k, v) for k, v in columns.items() if v)
    return leb128.unsigned(len(some)) + b"".join(leb128.unsigned(k) + leb128.unsigned(len(v)) for k, v in some), b"".join(v for _, v in some)
