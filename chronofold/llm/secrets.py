"""Secret scans (operator 4).

Patterns propose, structure confirms: what looks like base64 or hex is decoded, and it is reported only if its bytes parse as a key
encoding (nested DER lengths that add up, or an OpenSSH blob of length-prefixed strings) or, for signed tokens, if the header is JSON
that names an algorithm.  The base kinds (assign, access, hex) are reported by pattern alone.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .util import fresh, put, steps

#: In the order in which spans with one start are given.
KINDS = ("assign", "access", "hex", "pem", "jwt", "ssh", "der")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Every match of the above has one of these in it, which is quicker to see.
_SIGN = re.compile(r"[dtnyDTNY][\"']?\x20*[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]++)-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_B64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_B64URL = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{40,}={0,2}")
#: Lines of base64 of either alphabet, where a DER sequence or an SSH blob can begin.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M|AAAA|b3Bl)[A-Za-z0-9+/_-]{15,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?=[0-9a-f]*[A-F])[0-9A-Fa-f]{24,}")
_PLAIN = str.maketrans("-_", "+/")
_TAGS = {0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x16, 0x17, 0x18, 0x30, 0x31, 0xA0, 0xA1, 0xA2, 0xA3}


def _length(b: bytes, at: int) -> tuple[int, int] | None:
    """The DER length at ``at`` and where its contents begin."""
    if at >= len(b):
        return None
    n = b[at]
    if n < 0x80:
        return n, at + 1
    k = n & 0x7F
    if not 0 < k <= 4 or at + 1 + k > len(b):
        return None
    return int.from_bytes(b[at + 1 : at + 1 + k], "big"), at + 1 + k


def is_der(b: bytes) -> bool:
    """A sequence that fills ``b``, whose parts, on every level, fill what holds them; it begins with an integer or a sequence."""
    if len(b) < 16 or b[0] != 0x30:
        return False
    todo, top = [(0, len(b))], True
    while todo:
        at, stop = todo.pop()
        n = 0
        while at < stop:
            tag, found = b[at], _length(b, at + 1)
            if tag not in _TAGS or found is None or found[1] + found[0] > stop:
                return False
            if tag & 0x20 and found[0]:
                todo.append((found[1], found[1] + found[0]))
            at = found[1] + found[0]
            n += 1
        if top and n != 1:
            return False
        top = False
    inner = _length(b, 1)
    return inner is not None and inner[1] < len(b) and b[inner[1]] in (0x02, 0x30)


def is_ssh(b: bytes) -> bool:
    """An OpenSSH private key, or a public key blob whose length-prefixed strings fill it."""
    magic = b"openssh-key-v1\0"
    private = b.startswith(magic)
    at, n = len(magic) if private else 0, 0
    while at + 4 <= len(b) and n < 3:
        size = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + size > len(b):
            return False
        if n == 0 and not private and not re.match(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+\Z", b[at + 4 : at + 4 + size]):
            return False
        at, n = at + 4 + size, n + 1
    return n == 3 if private else n >= 2


def decoded(text: str) -> bytes | None:
    """The bytes of base64, with or without padding and white space."""
    plain = "".join(text.split()).rstrip("=")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".", 2)
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def armoured(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of every armoured key or certificate: the next dashes after its first line are those of its last."""
    at = 0
    while m := _PEM.search(text, at):
        at = m.end()
        k = text.find("-----", at)
        if k < 0:
            return
        last = f"-----END {m[1]}-----"
        if ("KEY" in m[1] or "CERTIFICATE" in m[1]) and text.startswith(last, k):
            yield m.start(), k + len(last), text[at:k]
            at = k + len(last)


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's number, end) of every secret, in order; code points, ends exclusive.

    Base kinds are matched leftmost and non-overlapping within a kind; kinds may overlap each other.
    """
    out: list[tuple[int, int, int]] = []
    add = lambda kind, m: out.append((m.start(), KINDS.index(kind), m.end()))
    if _SIGN.search(text):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                add("assign", m)
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 20:
                add("access", m)
    for m in _HEX.finditer(text):
        add("hex", m)
        if len(m[0]) % 2 == 0 and is_der(bytes.fromhex(m[0])):
            add("der", m)
    if "-----BEGIN " in text:
        for start, stop, body in armoured(text):
            lines = [x for x in body.split("\n") if ":" not in x]
            # what an encrypted body holds has no structure
            if (b := decoded("".join(lines))) and (is_der(b) or is_ssh(b) or "4,ENCRYPTED" in body):
                out.append((start, KINDS.index("pem"), stop))
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            if is_signed_token(m[0]):
                add("jwt", m)
    for m in _B64.finditer(text):
        if b := decoded(m[0]):
            if is_ssh(b):
                add("ssh", m)
            elif is_der(b):
                add("der", m)
    for m in _HEX_ANY.finditer(text):
        if len(m[0]) % 2 == 0 and is_der(bytes.fromhex(m[0])):
            add("der", m)
    for m in _B64URL.finditer(text):
        if kind := structure(m[0]):
            add(kind, m)
    for m in _WRAPPED.finditer(text):
        ends = [m.start() + x.end() for x in re.finditer(r"[^\s]+", m[0])]
        if m[0][0] == "M":
            # the sequence's own length tells where it ends
            size = _length(decoded(text[m.start() : m.start() + 8].translate(_PLAIN)) or b"", 1)
            chars = -(-8 * (size[0] + size[1]) // 6) if size else 0
            counts = accumulate(len(x.rstrip("=")) for x in m[0].split())
            ends = [ends[0], *(e for e, n in zip(ends, counts, strict=True) if n == chars)]
        for end in reversed(ends[1:][-2:]):
            if kind := structure(text[m.start() : end]):
                out.append((m.start(), KINDS.index(kind), end))
                break
    return sorted(set(out))


def structure(text: str) -> str | None:
    """The structural kind that base64 of either alphabet decodes to."""
    b = decoded(text.translate(_PLAIN))
    return None if not b else "ssh" if is_ssh(b) else "der" if is_der(b) else None


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        elif b <= at:
            continue
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, *, text: str = "text", redact: bool = False) -> DataFrame:
    """``df`` with n_assign, n_access, n_hex, base_sha256, spans (all kinds) and, if asked for, redacted (the text without its secrets).

    Spans are ``kind:start:end`` by start and kind, comma-joined; base_sha256 is the digest of the base kinds' alone.  Null texts are
    empty.  Every row stays; columns of these names are replaced.
    """
    ship(df.sparkSession)
    kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()} | ({"redacted": pa.string()} if redact else {})

    @F.arrow_udf(f"struct<{','.join(f'{c}:{"bigint" if t == pa.int64() else "string"}' for c, t in kinds.items())}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for texts in steps(batch):
                for x in texts:
                    spans = scan(x)
                    base = [s for s in spans if s[1] < len(BASE)]
                    rows.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), redacted(x, spans) if redact else None))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], [*kinds])

    at = fresh(df, "secrets")
    out = put(df, **{at: run(F.col(f"`{text}`"))})
    return put(out, **{c: F.col(f"{at}.{c}") for c in kinds}).drop(at)
