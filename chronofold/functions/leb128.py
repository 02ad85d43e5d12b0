"""Variable-length integers, seven bits a byte from the lowest."""

from __future__ import annotations


class Malformed(ValueError):
    """Bytes that are no such encoding: cut off, too large, or longer than need be."""


def unsigned(n: int) -> bytes:
    if not 0 <= n < 1 << 64:
        raise Malformed("out of range")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def signed(n: int) -> bytes:
    if not -(1 << 63) <= n < 1 << 63:
        raise Malformed("out of range")
    out = bytearray()
    while not -64 <= n < 64:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n & 0x7F)
    return bytes(out)


def _run(data: bytes, at: int) -> int:
    end = at
    while end < len(data) and data[end] & 0x80:
        end += 1
    if end >= len(data):
        raise Malformed("unexpected end")
    if end - at > 9:
        raise Malformed("too large")
    return end + 1


def read_unsigned(data: bytes, at: int) -> tuple[int, int]:
    """The number at ``at`` and the place after it."""
    end = _run(data, at)
    n = sum((b & 0x7F) << 7 * i for i, b in enumerate(data[at:end]))
    if n >= 1 << 64:
        raise Malformed("too large")
    if end - at > 1 and data[end - 1] == 0:
        raise Malformed("longer than need be")
    return n, end


def read_signed(data: bytes, at: int) -> tuple[int, int]:
    end = _run(data, at)
    n = sum((b & 0x7F) << 7 * i for i, b in enumerate(data[at:end]))
    if data[end - 1] & 0x40:
        n -= 1 << 7 * (end - at)
    if not -(1 << 63) <= n < 1 << 63:
        raise Malformed("too large")
    return n, end
