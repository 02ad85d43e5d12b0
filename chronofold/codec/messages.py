"""What peers send each other, what they keep of each other, and cursors in bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import leb128
from ..functions.leb128 import Malformed
from .chunks import Reader, _prefixed

V1, V2, STATE = 0x42, 0x43, 0x43


@dataclass
class Message:
    heads: list[bytes] = field(default_factory=list)
    need: list[bytes] = field(default_factory=list)
    #: (heads since, filter in wire form) pairs.
    have: list[tuple[list[bytes], bytes]] = field(default_factory=list)
    changes: list[bytes] = field(default_factory=list)

    def encode(self) -> bytes:
        have = leb128.unsigned(len(self.have)) + b"".join(_prefixed(since, False) + leb128.unsigned(len(bits)) + bits for since, bits in self.have)
        return bytes([V1]) + _prefixed(self.heads, False) + _prefixed(self.need, False) + have + _prefixed(self.changes, True)

    @staticmethod
    def decode(data: bytes) -> Message:
        """Both versions are read with the one layout."""
        r = Reader(data)
        if r.bytes(1)[0] not in (V1, V2):
            raise Malformed("no sync message")
        return Message(r.hashes(), r.hashes(), [(r.hashes(), r.sized()) for _ in range(r.number())], [r.sized() for _ in range(r.number())])


@dataclass
class State:
    """What is known of a peer; only the shared heads outlast an encoding."""

    shared: list[bytes] = field(default_factory=list)
    last_sent: list[bytes] = field(default_factory=list)
    their_heads: list[bytes] | None = None
    their_need: list[bytes] | None = None
    their_have: list[tuple[list[bytes], bytes]] | None = None
    sent: set[bytes] = field(default_factory=set)
    in_flight: bool = False
    responded: bool = False

    def encode(self) -> bytes:
        return bytes([STATE]) + _prefixed(sorted(self.shared), False)

    @staticmethod
    def decode(data: bytes) -> State:
        r = Reader(data)
        if r.bytes(1)[0] != STATE:
            raise Malformed("no sync state")
        return State(shared=r.hashes())

    def reset(self) -> State:
        return State(shared=self.shared)


# Kinds of cursors, and to which side one moves once its element is gone.
START, END, ELEMENT = 1, 2, 3
BEFORE, AFTER = 1, 2


def cursor_bytes(kind: str, ctr: int = 0, actor: bytes = b"", before: bool = False) -> bytes:
    """Version, kind, and for an element its actor, counter and side."""
    if kind in ("start", "end"):
        return bytes([1, START if kind == "start" else END])
    return bytes([1, ELEMENT]) + leb128.unsigned(len(actor)) + actor + leb128.unsigned(ctr) + bytes([BEFORE if before else AFTER])


def parse_cursor_bytes(data: bytes) -> tuple[str, int, bytes, bool]:
    """kind, counter, actor, before; version 0 had elements alone, and no side: they move forwards."""
    if len(data) < 2:
        raise Malformed("no cursor")
    r = Reader(data)
    version = r.bytes(1)[0]
    if version > 1:
        raise Malformed("unknown cursor version")
    kind = r.bytes(1)[0] if version else ELEMENT
    if kind in (START, END):
        return "start" if kind == START else "end", 0, b"", False
    if kind != ELEMENT:
        raise Malformed("unknown cursor kind")
    actor = r.sized()
    ctr, side = r.number(), r.bytes(1)[0] if version else AFTER
    if side not in (BEFORE, AFTER):
        raise Malformed("unknown cursor side")
    return "op", ctr, actor, side == BEFORE
