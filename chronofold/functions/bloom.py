"""The filter of change hashes that peers exchange: 10 bits an entry, 7 probes."""

from __future__ import annotations

import numpy as np

from . import leb128

BITS, PROBES = 10, 7


def probes(digest: bytes, size: int) -> list[int]:
    """Bits of a hash in a filter of ``size`` bits: three little-endian words step each other on."""
    if not size:
        return []
    x, y, z = (int.from_bytes(digest[i : i + 4], "little") % size for i in (0, 4, 8))
    out = [x]
    for _ in range(PROBES - 1):
        x, y = (x + y) % size, (y + z) % size
        out.append(x)
    return out


def filter_of(hashes: list[bytes]) -> bytes:
    """Wire form: entries, bits an entry, probes, bits; nothing for no entries."""
    if not hashes:
        return b""
    bits = bytearray(-(-len(hashes) * BITS // 8))
    for h in hashes:
        for p in probes(h, 8 * len(bits)):
            bits[p >> 3] |= 1 << (p & 7)
    return leb128.unsigned(len(hashes)) + leb128.unsigned(BITS) + leb128.unsigned(PROBES) + bytes(bits)


def parse(wire: bytes) -> tuple[int, int, int, bytes]:
    """Entries, bits an entry, probes, bits."""
    if not wire:
        return 0, BITS, PROBES, b""
    n, at = leb128.read_unsigned(wire, 0)
    each, at = leb128.read_unsigned(wire, at)
    k, at = leb128.read_unsigned(wire, at)
    bits = wire[at : at + -(-n * each // 8)]
    if len(bits) < -(-n * each // 8):
        raise ValueError("truncated filter")
    return n, each, k, bits


def contains(wire: bytes, digest: bytes) -> bool:
    n, _, _, bits = parse(wire)
    return bool(n) and all(bits[p >> 3] >> (p & 7) & 1 for p in probes(digest, 8 * len(bits)))


def contained(wire: bytes, digests: np.ndarray) -> np.ndarray:
    """Which of the digests (rows of 12 bytes or more) the filter holds; it is read once."""
    n, _, _, bits = parse(wire)
    if not n:
        return np.zeros(len(digests), bool)
    size = np.uint64(8 * len(bits))
    x, y, z = (np.ascontiguousarray(digests[:, k : k + 4]).view("<u4")[:, 0].astype(np.uint64) % size for k in (0, 4, 8))
    held, out = np.frombuffer(bits, np.uint8), np.ones(len(digests), bool)
    for _ in range(PROBES):
        out &= (held[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        x, y = (x + y) % size, (y + z) % size
    return out
