"""Codec vectors, round trips and malformed input."""

import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.codec import chunks, messages
from chronofold.codec import columns as co
from chronofold.functions import bloom, leb128
from chronofold.functions.leb128 import Malformed
from chronofold.schema import COUNTER, DELETE, INCREMENT, MAKE_LIST, MARK, SET


def val(tag=0, **more):
    return {"tag": tag, "l": None, "u": None, "d": None, "s": None, "b": None} | more


@pytest.mark.parametrize("n", [0, 1, 127, 128, 255, 256, 16383, 16384, 2**32 - 1, 2**64 - 1])
def test_unsigned(n):
    assert leb128.read_unsigned(leb128.unsigned(n), 0) == (n, len(leb128.unsigned(n)))


@pytest.mark.parametrize("n", [0, 63, 64, 65, 127, 128, -63, -64, -65, -128, -129, 2**63 - 1, -(2**63)])
def test_signed(n):
    assert leb128.read_signed(leb128.signed(n), 0) == (n, len(leb128.signed(n)))


@pytest.mark.parametrize("raw", [b"", b"\x80", b"\x80\x00", b"\xff" * 10 + b"\x01", b"\xff" * 9 + b"\x02"])
def test_unsigned_malformed(raw):
    with pytest.raises(Malformed):
        leb128.read_unsigned(raw, 0)


def test_run_vectors():
    """Bytes put together by hand: a run is its length and value, literals minus their number and the values, nulls 0 and their number."""
    assert list(co.encode_runs([7] * 4, "uint")) == [4, 7]
    assert list(co.encode_runs([None] * 3 + [9], "uint")) == [0, 3, 0x7F, 9]
    assert list(co.encode_runs([8, 300, 6], "uint")) == [0x7D, 8, 0xAC, 2, 6]
    assert list(co.encode_runs([5, 5, 5, 2, 4, 2, 2], "uint")) == [3, 5, 0x7E, 2, 4, 2, 2]
    assert list(co.encode_runs(["é", "é", "z"], "text")) == [2, 2, 0xC3, 0xA9, 0x7F, 1, 0x7A]
    assert list(co.encode_deltas([10, 20, 30, 29, 28, None, 28])) == [3, 10, 2, 0x7F, 0, 1, 0x7F, 0]
    assert list(co.encode_bools([True, True, False])) == [0, 2, 1]
    assert list(co.encode_bools([False] * 200 + [True])) == [0xC8, 1, 1]
    assert co.encode_runs([None] * 6, "text") == b"" and co.encode_bools([False] * 6, optional=True) == b""


def test_column_numbers():
    assert co.OP_COLUMNS["value_meta"] == 5 << 4 | co.META and co.OP_COLUMNS["succ_ctr"] == 8 << 4 | co.DELTA and co.OP_COLUMNS["mark_name"] == 10 << 4 | co.TEXT


@given(st.lists(st.one_of(st.none(), st.integers(0, 5), st.integers(0, 2**64 - 1))))
def test_runs_round_trip(values):
    back = co.decode_runs(co.encode_runs(values, "uint"), "uint")
    assert co.padded(back, len(values)) == values


@given(st.lists(st.one_of(st.none(), st.integers(-(2**40), 2**40))))
def test_deltas_round_trip(values):
    assert co.padded(co.decode_deltas(co.encode_deltas(values)), len(values)) == values


@given(st.lists(st.booleans()))
def test_bools_round_trip(values):
    assert co.padded(co.decode_bools(co.encode_bools(values)), len(values), False) == values


VALUES = [val(), val(1), val(2), val(3, u=Decimal(2**64 - 1)), val(4, l=-42), val(5, d=3.14), val(6, s="Hello 🌍 café"), val(6, s=""), val(7, b=b"\xde\xad"), val(8, l=100), val(9, l=-1000000), val(13, b=b"xyz")]


def test_values_round_trip():
    meta, raw = co.encode_values(VALUES)
    assert co.decode_values(meta, raw, len(VALUES)) == VALUES


def op(ctr, actor, **more):
    return {"op_ctr": ctr, "op_actor": actor, "obj_ctr": None, "obj_actor": None, "map_key": None, "elem_ctr": None, "elem_actor": None, "insert": False, "action": SET, "value": val(), "pred": [], "mark_name": None, "expand": False} | more


A, B = b"\xaa" * 16, b"\xbb" * 16


def history():
    """Two actors' changes on a map, a list with a deleted element, a counter and a range."""
    one = [
        op(1, A, map_key="", value=val(6, s="empty key")), op(2, A, map_key="list", action=MAKE_LIST),
        op(3, A, obj_ctr=2, obj_actor=A, insert=True, value=val(6, s="a")), op(4, A, obj_ctr=2, obj_actor=A, elem_ctr=3, elem_actor=A, insert=True, value=val(4, l=7)),
        op(5, A, map_key="n", value=val(COUNTER, l=3)),
    ]
    two = [
        op(6, B, obj_ctr=2, obj_actor=A, elem_ctr=3, elem_actor=A, action=DELETE, pred=[{"ctr": 3, "actor": A}]), op(7, B, map_key="n", action=INCREMENT, value=val(4, l=2), pred=[{"ctr": 5, "actor": A}]),
        op(8, B, obj_ctr=2, obj_actor=A, elem_ctr=4, elem_actor=A, action=MARK, mark_name="bold", expand=True, value=val(2)),
    ]
    three = [op(6, A, map_key="", action=DELETE, pred=[{"ctr": 1, "actor": A}])]
    raw1, h1 = chunks.encode_change(one, A, 1, 1000, "first", [])
    raw2, h2 = chunks.encode_change(two, B, 1, -5, None, [h1])
    raw3, h3 = chunks.encode_change(three, A, 2, 2000, "", [h1])
    meta = [(h1, A, 1, 1, 5, 1000, "first", [], raw1), (h2, B, 1, 6, 8, -5, None, [h1], raw2), (h3, A, 2, 6, 6, 2000, None, [h1], raw3)]
    changes = [dict(zip(("hash", "actor", "seq", "start_op", "max_op", "time", "message", "deps", "raw"), m, strict=True)) for m in meta]
    return changes, [r | {"change_hash": h} for rows, h in ((one, h1), (two, h2), (three, h3)) for r in rows]


def same(a, b):
    key = lambda r: (r["op_ctr"], r["op_actor"])
    assert sorted(a, key=key) == sorted(b, key=key)


def test_changes_round_trip():
    changes, ops = history()
    found = chunks.load(b"".join(c["raw"] for c in changes))
    assert found[0] == changes
    same(found[1], ops)


def test_document_round_trip_and_trailing_change():
    changes, ops = history()
    data = chunks.encode_document(ops, changes)
    got, rows = chunks.load(data)
    assert {c["hash"] for c in got} == {c["hash"] for c in changes}
    same(rows, ops)
    assert chunks.encode_document(rows, got) == data
    late, h = chunks.encode_change([op(9, B, map_key="late", value=val(2))], B, 2, 0, None, [changes[1]["hash"]])
    got, rows = chunks.load(data + late + changes[0]["raw"])
    assert len(got) == 4 and len(rows) == len(ops) + 1


def test_gaps_need_explicit_ids():
    raw, h = chunks.encode_change([op(3, A, map_key="x"), op(9, A, map_key="y")], A, 1, 0, None, [])
    change, rows = chunks.load(raw)
    assert [r["op_ctr"] for r in rows] == [3, 9] and change[0]["max_op"] == 9


def test_malformed_never_crashes():
    changes, ops = history()
    data = chunks.encode_document(ops, changes) + changes[0]["raw"]
    rng = random.Random(5)
    for _ in range(400):
        broken = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        try:
            chunks.load(bytes(broken[: rng.randrange(1, len(broken) + 1)]))
        except (Malformed, UnicodeDecodeError):
            pass


@settings(max_examples=30)
@given(st.lists(st.binary(min_size=32, max_size=32), unique=True, max_size=40))
def test_bloom(hashes):
    wire = bloom.filter_of(hashes)
    assert all(bloom.contains(wire, h) for h in hashes)


def test_bloom_false_positives():
    import hashlib

    h = [hashlib.sha256(str(i).encode()).digest() for i in range(2000)]
    wire = bloom.filter_of(h[:1000])
    assert sum(bloom.contains(wire, x) for x in h[1000:]) <= 50


def test_messages():
    m = messages.Message([b"h" * 32], [b"n" * 32], [([b"s" * 32], b"bits"), ([], b"")], [b"change"])
    assert messages.Message.decode(m.encode()) == m
    assert messages.Message.decode(b"\x43" + m.encode()[1:]) == m
    s = messages.State(shared=[b"x" * 32], sent={b"y"}, in_flight=True)
    assert messages.State.decode(s.encode()) == s.reset() == messages.State(shared=[b"x" * 32])
    with pytest.raises(Malformed):
        messages.Message.decode(b"\x41")


def test_cursor_vectors():
    """Version, kind (1 start, 2 end, 3 element), and for an element its actor, counter and side (1 before, 2 after)."""
    for c, raw in ((("start",), [1, 1]), (("end",), [1, 2]), (("op", 300, b"\x0a\x0b"), [1, 3, 2, 10, 11, 0xAC, 2, 2]), (("op", 5, b"", True), [1, 3, 0, 5, 1])):
        assert list(messages.cursor_bytes(*c)) == raw and messages.parse_cursor_bytes(bytes(raw)) == (*c, *(0, b"", False)[len(c) - 1 :])
    assert messages.parse_cursor_bytes(bytes([0, 2, 10, 11, 7])) == ("op", 7, b"\x0a\x0b", False)
    for raw in ([], [1], [2, 1], [1, 0], [1, 4], [1, 3, 2, 10], [1, 3, 0, 5], [1, 3, 0, 5, 3]):
        with pytest.raises(Malformed):
            messages.parse_cursor_bytes(bytes(raw))


def test_filters_are_read_once():
    import numpy as np

    rng = random.Random(4)
    for n in (0, 1, 3, 50):
        h = [rng.randbytes(32) for _ in range(200)]
        wire = bloom.filter_of(h[:n])
        assert bloom.contained(wire, np.array([list(x[:12]) for x in h], np.uint8)).tolist() == [bloom.contains(wire, x) for x in h]


@pytest.mark.parametrize("c", [("start", 0, b"", False), ("end", 0, b"", False), ("op", 300, A, True), ("op", 0, b"", False)])
def test_cursor_bytes(c):
    assert messages.parse_cursor_bytes(messages.cursor_bytes(*c)) == c


def test_whole_groups():
    import pyarrow as pa

    from chronofold.functions.groups import split, whole_groups

    rng = random.Random(1)
    keys = [k for k in range(30) for _ in range(rng.choice([1, 2, 40]))]
    rows = [{"k": k, "i": i} for i, k in enumerate(keys)]
    for size in (1, 3, 7, 500):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size]) for i in range(0, len(rows), size)] + [pa.RecordBatch.from_pylist(rows[:0], schema=pa.schema([("k", pa.int64()), ("i", pa.int64())]))]
        got = list(whole_groups(iter(batches), ["k"], rows=10))
        assert [r for part in got for r in part] == rows
        assert [len({r["k"] for r in g}) for part in got for g in split(part, ["k"])] == [1] * 30 and all(a[-1]["k"] != b[0]["k"] for a, b in zip(got, got[1:], strict=False))
