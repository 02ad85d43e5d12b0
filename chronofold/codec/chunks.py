"""Containers: headers, changes, whole documents.

Ops and changes are dicts with the columns of ``schema.OPS`` and ``schema.CHANGES``.  In a document deletions have no rows of their own;
reading gives them back from the ids that overwrite something and are not there.  Change hashes are those of the changes' wire form, so
reading a document encodes its changes again, in causal order, and compares the heads.
"""

from __future__ import annotations

import hashlib
import zlib

from ..functions import leb128
from ..functions.leb128 import Malformed
from ..schema import DELETE
from . import columns as co

MAGIC = bytes([0x85, 0x6F, 0x4A, 0x83])
DOCUMENT, CHANGE, DEFLATED = 0, 1, 2
NO_VALUE = {"tag": 0, "l": None, "u": None, "d": None, "s": None, "b": None}


def sealed(kind: int, body: bytes) -> tuple[bytes, bytes]:
    """The chunk and its hash."""
    tail = bytes([kind]) + leb128.unsigned(len(body)) + body
    digest = hashlib.sha256(tail).digest()
    return MAGIC + digest[:4] + tail, digest


def split_chunks(data: bytes) -> list[tuple[int, bytes, bytes]]:
    """(type, contents, hash) of each chunk; deflated changes come inflated, as changes."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise Malformed("no chunk")
        if at + 9 > len(data):
            raise Malformed("unexpected end")
        check, kind = data[at + 4 : at + 8], data[at + 8]
        n, start = leb128.read_unsigned(data, at + 9)
        if kind > 2:
            raise Malformed(f"chunk type {kind} is not supported")
        if start + n > len(data):
            raise Malformed("unexpected end")
        body = data[start : start + n]
        if kind == DEFLATED:
            try:
                body, kind = zlib.decompress(body, -15), CHANGE
            except zlib.error as e:
                raise Malformed("bad deflate data") from e
        digest = sealed(kind, body)[1]
        if digest[:4] != check:
            raise Malformed("checksum does not match")
        out.append((kind, body, digest))
        at = start + n
    return out


def _prefixed(items: list[bytes], sized: bool) -> bytes:
    return leb128.unsigned(len(items)) + b"".join((leb128.unsigned(len(x)) if sized else b"") + x for x in items)


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self) -> int:
        n, self.at = leb128.read_unsigned(self.data, self.at)
        return n

    def signed(self) -> int:
        n, self.at = leb128.read_signed(self.data, self.at)
        return n

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Malformed("unexpected end")
        self.at += n
        return self.data[self.at - n : self.at]

    def sized(self) -> bytes:
        return self.bytes(self.number())

    def hashes(self) -> list[bytes]:
        return [self.bytes(32) for _ in range(self.number())]

    def directory(self) -> list[tuple[int, int]]:
        out = [(self.number(), self.number()) for _ in range(self.number())]
        if any(a[0] & ~co.DEFLATE >= b[0] & ~co.DEFLATE for a, b in zip(out, out[1:], strict=False)):
            raise Malformed("columns out of order")
        return out

    def columns(self, directory: list[tuple[int, int]]) -> dict[int, bytes]:
        out = {}
        for spec, n in directory:
            raw = self.bytes(n)
            try:
                out[spec & ~co.DEFLATE] = zlib.decompress(raw, -15) if spec & co.DEFLATE else raw
            except zlib.error as e:
                raise Malformed("bad deflate data") from e
        return out


def _op_columns(rows: list[dict], actors: dict[bytes, int], *, ids: bool, edge: str) -> dict[int, bytes]:
    n, idx = co.OP_COLUMNS, lambda a: None if a is None else actors[bytes(a)]
    head = lambda r: r["map_key"] is None and r["elem_ctr"] is None
    edges = [sorted((p["ctr"], actors[bytes(p["actor"])]) for p in r[edge] or []) for r in rows]
    meta, raw = co.encode_values([r["value"] or NO_VALUE for r in rows])
    out = {
        n["obj_actor"]: co.encode_runs([idx(r["obj_actor"]) for r in rows], "uint"),
        n["obj_ctr"]: co.encode_runs([r["obj_ctr"] for r in rows], "uint"),
        n["key_actor"]: co.encode_runs([idx(r["elem_actor"]) for r in rows], "uint"),
        n["key_ctr"]: co.encode_deltas([0 if head(r) else r["elem_ctr"] for r in rows]),
        n["key_str"]: co.encode_runs([r["map_key"] for r in rows], "text"),
        n["insert"]: co.encode_bools([r["insert"] for r in rows]),
        n["action"]: co.encode_runs([r["action"] for r in rows], "uint"),
        n["value_meta"]: meta,
        n["value"]: raw,
        n[f"{edge}_group"]: co.encode_runs([len(e) for e in edges], "uint"),
        n[f"{edge}_actor"]: co.encode_runs([a for e in edges for _, a in e], "uint"),
        n[f"{edge}_ctr"]: co.encode_deltas([c for e in edges for c, _ in e]),
        n["expand"]: co.encode_bools([r["expand"] for r in rows], optional=True),
        n["mark_name"]: co.encode_runs([r["mark_name"] for r in rows], "text"),
    }
    if ids:
        out |= {n["id_actor"]: co.encode_runs([idx(r["op_actor"]) for r in rows], "uint"), n["id_ctr"]: co.encode_deltas([r["op_ctr"] for r in rows])}
    return out


def _rows(columns: dict[int, bytes], actors: list[bytes], edge: str, start: int | None = None) -> list[dict]:
    n, get = co.OP_COLUMNS, lambda name: columns.get(co.OP_COLUMNS[name], b"")
    action = co.decode_runs(get("action"), "uint")
    size = len(action)
    col = lambda name, kind: co.padded(co.decode_deltas(get(name)) if kind == "delta" else co.decode_bools(get(name)) if kind == "bool" else co.decode_runs(get(name), kind), size)

    def actor(i):
        if i is None:
            return None
        if i >= len(actors):
            raise Malformed("actor out of range")
        return actors[i]

    oa, oc, ka, kc, ks = col("obj_actor", "uint"), col("obj_ctr", "uint"), col("key_actor", "uint"), col("key_ctr", "delta"), col("key_str", "text")
    ia, ic, insert, expand, name = col("id_actor", "uint"), col("id_ctr", "delta"), col("insert", "bool"), col("expand", "bool"), col("mark_name", "text")
    values = co.decode_values(get("value_meta"), get("value"), size)
    group = co.padded(co.decode_runs(get(f"{edge}_group"), "uint"), size, 0)
    total = sum(g or 0 for g in group)
    ea, ec = co.padded(co.decode_runs(get(f"{edge}_actor"), "uint"), total), co.padded(co.decode_deltas(get(f"{edge}_ctr")), total)
    out, at = [], 0
    for i in range(size):
        k = group[i] or 0
        explicit = ic[i] is not None
        if not explicit and start is None:
            raise Malformed("op without an id")
        root, mapped = oc[i] is None or oc[i] == 0 and oa[i] is None, ks[i] is not None
        elem = not mapped and kc[i] is not None and kc[i] > 0
        out.append({
            "op_ctr": ic[i] if explicit else start + i, "op_actor": actor(ia[i] or 0) if explicit else actors[0], "obj_ctr": None if root else oc[i], "obj_actor": None if root else actor(oa[i]),
            "map_key": ks[i], "elem_ctr": kc[i] if elem else None, "elem_actor": actor(ka[i]) if elem else None, "insert": bool(insert[i]), "action": action[i], "value": values[i],
            edge: [{"ctr": c, "actor": actor(a)} for c, a in zip(ec[at : at + k], ea[at : at + k], strict=True)], "mark_name": name[i], "expand": bool(expand[i]),
        })
        at += k
    return out


def encode_change(rows: list[dict], actor: bytes, seq: int, time: int, message: str | None, deps: list[bytes]) -> tuple[bytes, bytes]:
    """A change's chunk and hash.  Op ids are left out if they count up from the first."""
    rows = sorted(rows, key=lambda r: r["op_ctr"])
    start = rows[0]["op_ctr"] if rows else 0
    named = {bytes(a) for r in rows for a in (r["obj_actor"], r["elem_actor"], *(p["actor"] for p in r["pred"] or [])) if a is not None} - {bytes(actor)}
    actors = {bytes(actor): 0} | {a: i for i, a in enumerate(sorted(named), 1)}
    ids = any(r["op_ctr"] != start + i for i, r in enumerate(rows))
    directory, data = co.write_columns(_op_columns(rows, actors, ids=ids, edge="pred"))
    said = (message or "").encode()
    body = _prefixed(sorted(deps), False) + leb128.unsigned(len(actor)) + bytes(actor) + leb128.unsigned(seq) + leb128.unsigned(start) + leb128.signed(time)
    body += leb128.unsigned(len(said)) + said + _prefixed(sorted(named), True) + directory + data
    return sealed(CHANGE, body)


def decode_change(body: bytes, digest: bytes) -> tuple[dict, list[dict]]:
    r = Reader(body)
    deps, actor, seq, start, time = r.hashes(), r.sized(), r.number(), r.number(), r.signed()
    message = r.sized().decode()
    actors = [actor, *[r.sized() for _ in range(r.number())]]
    rows = _rows(r.columns(r.directory()), actors, "pred", start)
    top = max([start + len(rows) - 1, *(x["op_ctr"] for x in rows)])
    change = {"hash": digest, "actor": actor, "seq": seq, "start_op": start, "max_op": top, "time": time, "message": message or None, "deps": deps, "raw": sealed(CHANGE, body)[0]}
    return change, [x | {"change_hash": digest} for x in rows]


def _order(r: dict) -> tuple:
    low = lambda c, a: (c or 0, bytes(a or b""))
    key = (0, (r["map_key"] or "").encode()) if r["map_key"] is not None else (1, low(r["op_ctr"], r["op_actor"]) if r["insert"] else low(r["elem_ctr"], r["elem_actor"]))
    return low(r["obj_ctr"], r["obj_actor"]), key, low(r["op_ctr"], r["op_actor"])


def encode_document(rows: list[dict], changes: list[dict]) -> bytes:
    """A document's chunk, from all its ops (with pred) and changes.

    Deletions that overwrite nothing, and edges that name a deletion, cannot be written: leave them out before the changes are hashed.
    """
    actors = sorted({bytes(a) for r in rows for a in (r["op_actor"], *(p["actor"] for p in r["pred"] or []))} | {bytes(c["actor"]) for c in changes})
    idx = {a: i for i, a in enumerate(actors)}
    succ: dict[tuple, list[dict]] = {}
    for r in rows:
        for p in r["pred"] or []:
            succ.setdefault((p["ctr"], bytes(p["actor"])), []).append({"ctr": r["op_ctr"], "actor": r["op_actor"]})
    kept = sorted((r | {"succ": succ.get((r["op_ctr"], bytes(r["op_actor"])), [])} for r in rows if r["action"] != DELETE), key=_order)
    ordered = sorted(changes, key=lambda c: (c["max_op"], bytes(c["actor"]), c["seq"]))
    at = {bytes(c["hash"]): i for i, c in enumerate(ordered)}
    deps = [sorted(at[bytes(d)] for d in c["deps"] or [] if bytes(d) in at) for c in ordered]
    used = {bytes(d) for c in changes for d in c["deps"] or []}
    heads = sorted(h for h in at if h not in used)
    n = co.CHANGE_COLUMNS
    change_columns = {
        n["actor"]: co.encode_runs([idx[bytes(c["actor"])] for c in ordered], "uint"), n["seq"]: co.encode_deltas([c["seq"] for c in ordered]),
        n["max_op"]: co.encode_deltas([c["max_op"] for c in ordered]), n["time"]: co.encode_deltas([c["time"] for c in ordered]), n["message"]: co.encode_runs([c["message"] for c in ordered], "text"),
        n["deps_group"]: co.encode_runs([len(d) for d in deps], "uint"), n["deps_index"]: co.encode_deltas([i for d in deps for i in d]),
    }
    (cd, cx), (od, ox) = co.write_columns(change_columns), co.write_columns(_op_columns(kept, idx, ids=True, edge="succ"))
    body = _prefixed(actors, True) + _prefixed(heads, False) + cd + od + cx + ox
    return sealed(DOCUMENT, body)[0]


def decode_document(body: bytes) -> tuple[list[dict], list[dict]]:
    """Changes and ops (with pred) of a document; it fails if the heads that are named are not those of its changes."""
    r = Reader(body)
    actors = [r.sized() for _ in range(r.number())]
    heads = r.hashes()
    cd, od = r.directory(), r.directory()
    cc, oc = r.columns(cd), r.columns(od)
    rows = _rows(oc, actors, "succ")
    by_id = {(x["op_ctr"], x["op_actor"]): x | {"pred": []} for x in rows}
    for x in rows:
        for p in x["succ"]:
            k = (p["ctr"], p["actor"])
            if k not in by_id:  # a deletion
                e = (x["op_ctr"], x["op_actor"]) if x["insert"] else (x["elem_ctr"], x["elem_actor"])
                by_id[k] = {**x, "op_ctr": k[0], "op_actor": k[1], "elem_ctr": None if x["map_key"] is not None else e[0], "elem_actor": None if x["map_key"] is not None else e[1], "insert": False, "action": DELETE, "value": NO_VALUE, "pred": [], "mark_name": None, "expand": False}
            by_id[k]["pred"].append({"ctr": x["op_ctr"], "actor": x["op_actor"]})
    n, get = co.CHANGE_COLUMNS, lambda name: cc.get(co.CHANGE_COLUMNS[name], b"")
    who = co.decode_runs(get("actor"), "uint")
    size = len(who)
    seq, top, time = (co.padded(co.decode_deltas(get(c)), size, 0) for c in ("seq", "max_op", "time"))
    message = co.padded(co.decode_runs(get("message"), "text"), size)
    group = co.padded(co.decode_runs(get("deps_group"), "uint"), size, 0)
    index = co.decode_deltas(get("deps_index"))
    own: dict[bytes, list[dict]] = {}
    for x in by_id.values():
        x.pop("succ", None)
        own.setdefault(x["op_actor"], []).append(x)
    starts, changes, ops, at = {}, [], [], 0
    for i in range(size):
        actor, k = actors[who[i]], group[i] or 0
        if any(d >= i for d in index[at : at + k]):
            raise Malformed("a change comes before what it depends on")
        mine = [x for x in own.get(actor, []) if starts.get(actor, 0) < x["op_ctr"] <= top[i]]
        starts[actor] = top[i]
        deps = [changes[d]["hash"] for d in index[at : at + k]]
        at += k
        raw, digest = encode_change(mine, actor, seq[i], time[i], message[i], deps)
        changes.append({"hash": digest, "actor": actor, "seq": seq[i], "start_op": min((x["op_ctr"] for x in mine), default=top[i] + 1), "max_op": top[i], "time": time[i], "message": message[i], "deps": deps, "raw": raw})
        ops += [x | {"change_hash": digest} for x in mine]
    used = {d for c in changes for d in c["deps"]}
    if sorted(c["hash"] for c in changes if c["hash"] not in used) != sorted(heads):
        raise Malformed("heads do not match the changes")
    return changes, ops


def load(data: bytes) -> tuple[list[dict], list[dict]]:
    """Changes and ops of all chunks: at most one document, and changes, each once."""
    changes, ops, seen, documents = [], [], set(), 0
    for kind, body, digest in split_chunks(data):
        documents += kind == DOCUMENT
        if documents > 1:
            raise Malformed("more than one document")
        found = decode_document(body) if kind == DOCUMENT else None
        if found is None:
            change, rows = decode_change(body, digest)
            found = [change], rows
        for c in found[0]:
            if c["hash"] not in seen:
                seen.add(c["hash"])
                changes.append(c)
                ops += [x for x in found[1] if x["change_hash"] == c["hash"]]
    return changes, ops
