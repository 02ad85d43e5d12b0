"""Lossless WebP (VP8L) in numpy: a decoder for the whole format and an encoder.

Pixels are uint32 arrays (alpha, red, green, blue from the top byte) of shape (height, width).
"""

from __future__ import annotations

import struct

import numpy as np

MAX_SIDE = 16384
LITERALS, LENGTHS, DISTANCES = 256, 24, 40

# Fixed values of the format: the order in which code lengths of the code-length code are stored, and the (x, y) offsets of the 120 short
# distance codes.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)

_REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], np.int64)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of a prefix code, as they stand in the stream (first bit lowest)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    step = 1 << (15 - lengths[order].astype(np.int64))
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = _REVERSED[np.cumsum(step) - step]
    return codes


class Code:
    """A prefix code for reading: by the next ``bits`` bits, symbol and length.  One symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("empty prefix code")
        self.single = int(used[0]) if len(used) == 1 else None
        self.highest, self.bits = int(used[-1]), int(lengths.max())
        if self.single is not None:
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        times = 1 << (self.bits - lengths[order])
        if times.sum() != 1 << self.bits:
            raise ValueError("incomplete prefix code")
        place = _REVERSED[:: 1 << (15 - self.bits)]
        self.symbol, self.length = np.empty(1 << self.bits, np.int32), np.empty(1 << self.bits, np.int32)
        self.symbol[place], self.length[place] = np.repeat(order, times), np.repeat(lengths[order], times)
        self.mask = (1 << self.bits) - 1
        #: By the next bits, how far the next symbol is if this one is a literal.
        self.step = np.where(self.symbol < LITERALS, self.length, 0)


class Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + bytes(8), 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        k = self.at >> 3
        value = int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("truncated stream")
        return value

    def symbol(self, code: Code) -> int:
        if code.single is not None:
            return code.single
        k = self.at >> 3
        bits = int.from_bytes(self.data[k : k + 3], "little") >> (self.at & 7) & code.mask
        self.at += int(code.length[bits])
        if self.at > self.end:
            raise ValueError("truncated stream")
        return int(code.symbol[bits])


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        n = bits.read(1) + 1
        for k in range(n):
            symbol = bits.read(8 if k or bits.read(1) else 1)
            if symbol >= size:
                raise ValueError("symbol out of range")
            lengths[symbol] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for place in CODE_LENGTH_ORDER[: bits.read(4) + 4]:
        own[place] = bits.read(3)
    code, most, k, last = Code(own), size, 0, 8
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
        if most > size:
            raise ValueError("too many code lengths")
    while k < size and most:
        most -= 1
        x = bits.symbol(code)
        if x < 16:
            lengths[k] = x
            last = x or last
            k += 1
            continue
        n, value = (bits.read(2) + 3, last) if x == 16 else (bits.read(3) + 3, 0) if x == 17 else (bits.read(7) + 11, 0)
        if k + n > size:
            raise ValueError("too many code lengths")
        lengths[k : k + n] = value
        k += n
    return Code(lengths)


def amount(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def reference(bits: Bits, symbol: int, distance: Code, width: int) -> tuple[int, int]:
    """The length and the distance, in pixels, of a back-reference whose length symbol has been read."""
    length, d = amount(bits, symbol - LITERALS), amount(bits, bits.symbol(distance))
    if d > len(NEAR):
        return length, d - len(NEAR)
    x, y = NEAR[d - 1]
    return length, max(1, x + y * width)


def green_runs(bits: Bits, code: Code, distance: Code, n: int, width: int, chunk: int = 1 << 20) -> np.ndarray:
    """``n`` green samples where no other channel takes bits: runs of literals, and back-references between them.

    Each bit of a chunk is taken as a possible start; a literal's start leads to the next one, any other symbol's to itself.  Runs
    are then followed eight literals at a time.
    """
    if code.single is not None:
        if code.single >= LITERALS:
            raise ValueError("reference out of range")
        return np.full(n, code.single, np.uint8)
    out, done = np.empty(n, np.uint8), 0
    raw = np.frombuffer(bits.data, np.uint8)
    while done < n:
        first = bits.at >> 3
        some = raw[first : first + min(chunk, 15 * (n - done) + 64) // 8 + 2].astype(np.int32)
        if len(some) < 4:
            raise ValueError("truncated stream")
        wide = some[:-2] | some[1:-1] << 8 | some[2:] << 16
        window = ((wide[:, None] >> np.arange(8, dtype=np.int32)) & np.int32(code.mask)).ravel()
        size = len(window)
        step = np.arange(size + 1, dtype=np.int32)
        step[:-1] += code.step[window]
        np.minimum(step, size, out=step)
        two = step[step]
        four = two[two]
        eight = memoryview(four[four])
        at = bits.at & 7
        while done < n and at < size:
            starts, most = [at], -(-(n - done) // 8)
            while len(starts) < most and (then := eight[at]) != at:
                starts.append(then)
                at = then
            s = np.array(starts)
            s = np.stack([s, four[s]], 1).ravel()
            s = np.stack([s, two[s]], 1).ravel()
            s = np.stack([s, step[s]], 1).ravel()[: n - done]
            end = int(step[s[-1]])
            if end == s[-1]:
                # the run stands still at what is no literal, or at the chunk's end
                s = s[: np.searchsorted(s, end)]
            out[done : done + len(s)] = code.symbol[window[s]]
            done += len(s)
            at = end
            if at >= size or done == n:
                if not len(s):
                    raise ValueError("truncated stream")
                bits.at = 8 * first + int(s[-1]) + int(code.length[window[s[-1]]])
                break
            bits.at = 8 * first + at
            length, d = reference(bits, bits.symbol(code), distance, width)
            if d > done or done + length > n:
                raise ValueError("reference out of range")
            if d >= length:
                out[done : done + length] = out[done - d : done - d + length]
            else:
                out[done : done + length] = np.resize(out[done - d : done], length)
            done += length
            at = bits.at - 8 * first
        if bits.at > bits.end:
            raise ValueError("truncated stream")
    return out


def read_pixels(bits: Bits, width: int, height: int, *, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, scale = None, 0
    if main and bits.read(1):
        scale = bits.read(3) + 2
        groups = read_pixels(bits, -(-width >> scale), -(-height >> scale), main=False) >> np.uint32(8) & np.uint32(0xFFFF)
    codes = []
    for _ in range(1 if groups is None else int(groups.max()) + 1):
        codes.append([read_code(bits, n) for n in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)])
    n = width * height
    if len(codes) == 1 and not cache_bits and all(c.single is not None for c in codes[0][1:4]):
        green, red, blue, alpha, distance = codes[0]
        run = green_runs(bits, green, distance, n, width)
        return (run.astype(np.uint32) << np.uint32(8) | np.uint32(alpha.single << 24 | red.single << 16 | blue.single)).reshape(height, width)
    out, cache, put = [0] * n, [0] * (1 << cache_bits), 0
    where = None if groups is None else np.repeat(np.repeat(groups, 1 << scale, 0)[:height], 1 << scale, 1)[:, :width].ravel().tolist()
    shift = 32 - cache_bits
    while put < n:
        green, red, blue, alpha, distance = codes[0 if where is None else where[put]]
        g = bits.symbol(green)
        if g < LITERALS:
            r = bits.symbol(red)
            b = bits.symbol(blue)
            px = bits.symbol(alpha) << 24 | r << 16 | g << 8 | b
            out[put] = px
            put += 1
            if cache_bits:
                cache[(0x1E35A7BD * px & 0xFFFFFFFF) >> shift] = px
        elif g < LITERALS + LENGTHS:
            length, d = reference(bits, g, distance, width)
            if d > put or put + length > n:
                raise ValueError("reference out of range")
            for k in range(put, put + length):
                px = out[k] = out[k - d]
                if cache_bits:
                    cache[(0x1E35A7BD * px & 0xFFFFFFFF) >> shift] = px
            put += length
        else:
            out[put] = cache[g - LITERALS - LENGTHS]
            put += 1
    return np.array(out, np.uint32).reshape(height, width)


def split(px: np.ndarray) -> np.ndarray:
    """Channels as int32, last axis alpha, red, green, blue."""
    return (px[..., None] >> np.array([24, 16, 8, 0], np.uint32) & np.uint32(255)).astype(np.int32)


def join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: int, left, top, corner, right) -> list[int]:
    """The prediction from the four neighbours (left, above, above left, above right), each a list of four channels."""
    average = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]  # noqa: B905, E731
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return average(average(left, right), top)
    if mode <= 10:
        return {6: lambda: average(left, corner), 7: lambda: average(left, top), 8: lambda: average(corner, top), 9: lambda: average(top, right), 10: lambda: average(average(left, corner), average(top, right))}[mode]()
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        by_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    return [clamp(a + int((a - c) / 2)) for a, c in zip(average(left, top), corner, strict=True)]


def with_prediction(px: np.ndarray, modes: np.ndarray, scale: int, *, forward: bool) -> np.ndarray:
    """Subtracts (forward) or adds back each pixel's prediction from its neighbours before it."""
    height, width = px.shape
    if not forward and modes.size and modes.min() == modes.max() and modes.min() in (1, 2):
        # the left or the upper neighbour everywhere: running sums
        c = split(px)
        c[0, 0, 0] += 255
        c[0] = np.cumsum(c[0], 0)
        c[:, 0] = np.cumsum(c[:, 0], 0)
        if height > 1:
            c[1:] = np.cumsum(c[1:], 1) if modes.min() == 1 else np.cumsum(c, 0)[1:] if width == 1 else np.concatenate([c[1:, :1], np.cumsum(c, 0)[1:, 1:]], 1)
        return join(c & 255)
    given = split(px).tolist()
    done = [[None] * width for _ in range(height)]
    whole = given if forward else done
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = [255, 0, 0, 0] if x == 0 else whole[0][x - 1]
            elif x == 0:
                p = whole[y - 1][0]
            else:
                up = whole[y - 1]
                p = predicted(int(modes[y >> scale, x >> scale]), whole[y][x - 1], up[x], up[x - 1], up[x + 1] if x + 1 < width else whole[y][0])
            done[y][x] = [(v - q if forward else v + q) & 255 for v, q in zip(given[y][x], p, strict=True)]
    return join(np.array(done))


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def with_cross_colour(px: np.ndarray, table: np.ndarray, scale: int, *, forward: bool) -> np.ndarray:
    """Takes from red what green explains, and from blue what green and red explain, or gives it back."""
    height, width = px.shape
    c, t = split(px), split(np.repeat(np.repeat(table, 1 << scale, 0)[:height], 1 << scale, 1)[:, :width])
    delta = lambda a, b: (_signed(a) * _signed(b)) >> 5
    sign = -1 if forward else 1
    red = c[..., 1].copy()
    c[..., 1] = (c[..., 1] + sign * delta(t[..., 3], c[..., 2])) & 255
    by = red if forward else c[..., 1]
    c[..., 3] = (c[..., 3] + sign * (delta(t[..., 2], c[..., 2]) + delta(t[..., 1], by))) & 255
    return join(c)


def palette_bits(n: int) -> int:
    """How many pixels share one, as a power of two, for a palette of ``n`` colours."""
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode_stream(data: bytes) -> np.ndarray:
    """Pixels of a VP8L chunk's contents."""
    if not data or data[0] != 0x2F:
        raise ValueError("no VP8L signature")
    bits = Bits(data)
    bits.at = 8
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, full = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("repeated transform")
        seen.add(kind)
        if kind < 2:
            scale = bits.read(3) + 2
            table = read_pixels(bits, -(-width >> scale), -(-height >> scale), main=False)
            undo.append((kind, width, scale, table))
        elif kind == 2:
            undo.append((2, width, 0, None))
        else:
            n = bits.read(8) + 1
            colours = np.cumsum(split(read_pixels(bits, n, 1, main=False)[0]), axis=0) & 255
            undo.append((3, width, palette_bits(n), join(colours)))
            width = -(-width >> palette_bits(n))
    px = read_pixels(bits, width, height, main=True)
    for kind, wide, scale, table in reversed(undo):
        if kind == 0:
            px = with_prediction(px, table >> np.uint32(8) & np.uint32(15), scale, forward=False)
        elif kind == 1:
            px = with_cross_colour(px, table, scale, forward=False)
        elif kind == 2:
            green = px >> np.uint32(8) & np.uint32(255)
            px = px & np.uint32(0xFF00FF00) | (px + (green << np.uint32(16) | green)) & np.uint32(0x00FF00FF) if not (px & np.uint32(0xFF00FF)).any() else join(split(px) + split(green << np.uint32(16) | green))
        else:
            index = (px >> np.uint32(8) & np.uint32(255)).astype(np.int64)
            if scale:
                each = 8 >> scale
                index = (index[..., None] >> (each * np.arange(1 << scale)) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            px = np.where(index < len(table), table[np.minimum(index, len(table) - 1)], np.uint32(0))
    if px.shape != (height, full):
        raise ValueError("wrong size")
    return px


def images(data: bytes) -> list[np.ndarray]:
    """The pixels of each of the WebP files that ``data`` holds, one after the other."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("no lossless WebP file")
        whole, size = (struct.unpack("<I", data[at + k : at + k + 4])[0] for k in (4, 16))
        if size + 12 > whole or at + 8 + whole > len(data):
            raise ValueError("truncated file")
        out.append(decode_stream(data[at + 20 : at + 20 + size]))
        at += 8 + whole
    return out


def contained(stream: bytes) -> bytes:
    """A WebP file around a VP8L stream."""
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Writer:
    def __init__(self) -> None:
        self.bits: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.bits.append((value, n))

    def array(self) -> tuple[np.ndarray, np.ndarray]:
        a = np.array(self.bits, np.int64).reshape(-1, 2)
        return a[:, 0], a[:, 1]


def packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers of up to 16 bits each, lowest bit first."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return b""
    at = ends - sizes
    wide, word, n = values << (at & 15), at >> 4, int(ends[-1] >> 4) + 2
    out = np.bincount(word, wide & 0xFFFF, n) + np.bincount(word + 1, wide >> 16, n)
    return out.astype("<u2").tobytes()[: int(ends[-1] + 7 >> 3)]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths, 15 at most, of a complete prefix code for what occurs (two symbols or more).

    Each symbol gets the bits of its share, rounded up; what room that leaves goes to the most frequent first.
    """
    used = np.flatnonzero(counts)
    share = np.maximum(counts[used] / counts[used].sum(), 2.0**-13)
    own = np.clip(np.ceil(-np.log2(share / share.sum())).astype(np.int64), 1, 15)
    room = (1 << 15) - int((1 << (15 - own)).sum())
    order = np.argsort(-counts[used], kind="stable").tolist()
    while room:
        for k in order:
            if (cost := 1 << (15 - int(own[k]))) <= room and own[k] > 1:
                own[k] -= 1
                room -= cost
    lengths = np.zeros(len(counts), np.int64)
    lengths[used] = own
    return lengths


#: A fixed complete code for code lengths: 3 bits for a zero and a long run of zeros, 4 or 5 for the others; 16 is not used.
_LENGTH_SIZES = np.array([3, 5, 5, 5, 4, 4, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5, 0, 5, 3], np.int64)
_LENGTH_CODES = canonical(_LENGTH_SIZES)


def write_code(out: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the prefix code for what occurs; its codes and lengths."""
    used, lengths = np.flatnonzero(counts), np.zeros(len(counts), np.int64)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        out.put(1, 1), out.put(len(symbols) - 1, 1), out.put(1, 1), out.put(symbols[0], 8)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
            lengths[symbols] = 1
        return canonical(lengths), lengths
    lengths = code_lengths(counts) if len(used) > 1 else np.eye(1, len(counts), used[0], dtype=np.int64)[0]
    out.put(0, 1), out.put(15, 4)
    for place in CODE_LENGTH_ORDER:
        out.put(int(_LENGTH_SIZES[place]), 3)
    out.put(0, 1)
    k, size, plain = 0, len(counts), lengths.tolist()
    while k < size:
        n = 0
        while k + n < size and n < 138 and not plain[k + n]:
            n += 1
        symbol = 18 if n >= 11 else 17 if n >= 3 else plain[k]
        out.put(int(_LENGTH_CODES[symbol]), int(_LENGTH_SIZES[symbol]))
        if symbol >= 17:
            out.put(n - (11 if symbol == 18 else 3), 7 if symbol == 18 else 3)
        k += n if symbol >= 17 else 1
    return (canonical(lengths), lengths) if len(used) > 1 else (np.zeros(size, np.int64), np.zeros(size, np.int64))


def header(out: Writer, width: int, height: int) -> None:
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(0, 1), out.put(0, 3)


def _symbol(n: int) -> tuple[int, int, int]:
    """The prefix symbol of a length or distance, its extra bits' value and number."""
    if n <= 4:
        return n - 1, 0, 0
    extra = (n - 1).bit_length() - 2
    half = (n - 1) >> extra & 1
    return 2 * extra + 2 + half, (n - 1) & ((1 << extra) - 1), extra


#: Bytes of the shortest repeat that is stored as a back-reference, of the longest, and of the stretch compared at once.
LEAST, MOST, STRETCH = 20, 4096, 256


def repeats(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that stood before, apart and in order; they begin after a space or control."""
    n = len(flat)
    starts = np.flatnonzero(np.concatenate([[True], flat[:-1] <= 32])[: max(0, n - LEAST + 1)])
    if len(starts) < 2:
        return []
    wide = flat.astype(np.uint64)
    for k in (1, 2, 4):
        wide[: n - k] |= wide[k:] << np.uint64(8 * k)
    keys = wide[starts] * np.uint64(0x9E3779B97F4A7C15) ^ wide[starts + 8] * np.uint64(0xC2B2AE3D27D4EB4F) ^ wide[starts + LEAST - 8]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out, free = [], 0
    later, before = starts[order[1:][same]], starts[order[:-1][same]]
    turn = np.argsort(later)
    for i, p in zip(later[turn].tolist(), before[turn].tolist(), strict=True):
        if i < free:
            continue
        length, most = 0, min(MOST, n - i)
        while length < most:
            stop = min(length + STRETCH, most)
            differ = flat[i + length : i + stop] != flat[p + length : p + stop]
            k = int(differ.argmax())
            if differ[k]:
                length += k
                break
            length = stop
        if length >= LEAST:
            out.append((i, length, i - p))
            free = i + length
    return out


def _grey_transforms(out: Writer) -> None:
    """Subtract-green, no further transform, no colour cache, one group of codes."""
    out.put(1, 1), out.put(2, 2), out.put(0, 1), out.put(0, 1), out.put(0, 1)


def _constant_channels(out: Writer) -> None:
    for value in (0, 0, 255):
        write_code(out, np.eye(1, 256, value, dtype=np.int64)[0])


def encode_grey(samples: np.ndarray) -> bytes:
    """A WebP file of 8-bit grey samples (height, width): green is coded, and the subtract-green transform gives red and blue.

    Of few values a palette with several samples a pixel is made.  Otherwise what repeats is stored as back-references if that is
    estimated to take fewer bits, or differences from the left neighbour (predictor) if these have the lower entropy.
    """
    height, width = samples.shape
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=LITERALS + LENGTHS)
    values = np.flatnonzero(counts)
    if len(values) <= 16:
        px = samples.astype(np.uint32)
        return encode(px << np.uint32(16) | px << np.uint32(8) | px | np.uint32(0xFF000000), palette=True)
    out = Writer()
    header(out, width, height)
    shift = np.diff(samples, axis=1, prepend=np.concatenate([[samples[0, 0]], samples[:-1, 0]])[:, None].astype(np.uint8))
    shift[0, 0] = samples[0, 0]
    steps = np.bincount(shift.ravel(), minlength=LITERALS + LENGTHS)
    if entropy(steps) < entropy(counts):
        # predictor 1 for the whole picture, then subtract-green as always: of the residues, since green is what is coded
        out.put(1, 1), out.put(0, 2), out.put(7, 3)
        side = (-(-width >> 9), -(-height >> 9))
        _write_pixels(out, np.full((side[1], side[0]), 0xFF000100, np.uint32), main=False)
        _grey_transforms(out)
        codes, sizes = write_code(out, steps)
        # alpha's residue is zero everywhere: the first pixel is predicted as opaque black
        for value in (0, 0, 0):
            write_code(out, np.eye(1, 256, value, dtype=np.int64)[0])
        write_code(out, np.zeros(DISTANCES, np.int64))
        head, wide = out.array()
        residues = shift.ravel()
        return contained(packed(np.concatenate([head, codes[residues]]), np.concatenate([wide, sizes[residues]])))
    _grey_transforms(out)
    found = repeats(flat)
    if found:
        at, length, far = np.array(found).T
        near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed([*enumerate(NEAR)])}
        coded = [(*_symbol(m), *_symbol(near.get(d, d + len(NEAR)))) for _, m, d in found]
        by_length, by_far = np.array([c[:3] for c in coded]).T, np.array([c[3:] for c in coded]).T
        covered = np.zeros(len(flat) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + length, -1)
        literal = np.cumsum(covered[:-1]) == 0
        left = np.bincount(flat[literal], minlength=LITERALS + LENGTHS)
        left[LITERALS:] += np.bincount(by_length[0], minlength=LENGTHS)
        places = np.bincount(by_far[0], minlength=DISTANCES)
        bits = entropy(left) + entropy(places) + int(by_length[2].sum() + by_far[2].sum()) + 5 * (int((places > 0).sum()) + LENGTHS)
        if bits < entropy(counts):
            codes, sizes = write_code(out, left)
            _constant_channels(out)
            far_codes, far_sizes = write_code(out, places)
            head, wide = out.array()
            each = literal.astype(np.int64)
            each[at] = 4
            put = np.cumsum(each) - each
            value, size = np.empty(int(each.sum()), np.int64), np.empty(int(each.sum()), np.int64)
            value[put[literal]], size[put[literal]] = codes[flat[literal]], sizes[flat[literal]]
            cells = ((codes[LITERALS + by_length[0]], sizes[LITERALS + by_length[0]]), by_length[1:], (far_codes[by_far[0]], far_sizes[by_far[0]]), by_far[1:])
            for k, (v, z) in enumerate(cells):
                value[put[at] + k], size[put[at] + k] = v, z
            return contained(packed(np.concatenate([head, value]), np.concatenate([wide, size])))
    codes, sizes = write_code(out, counts)
    _constant_channels(out)
    write_code(out, np.zeros(DISTANCES, np.int64))
    head, wide = out.array()
    return contained(packed(np.concatenate([head, codes[flat]]), np.concatenate([wide, sizes[flat]])))


def entropy(counts: np.ndarray) -> float:
    """Bits that symbols of these counts take at best."""
    some = counts[counts > 0].astype(np.float64)
    return float(-(some * np.log2(some / some.sum())).sum()) if len(some) else 0.0


def _write_pixels(out: Writer, px: np.ndarray, *, main: bool, cache_bits: int = 0, matches: bool = False) -> None:
    height, width = px.shape
    flat, n = px.ravel().tolist(), px.size
    out.put(1 if cache_bits else 0, 1), out.put(cache_bits, 4 if cache_bits else 0)
    if main:
        out.put(0, 1)
    tokens, cache, seen, k = [], [-1] * (1 << cache_bits), {}, 0
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed([*enumerate(NEAR)])}
    while k < n:
        p = seen.get(tuple(flat[k : k + 4])) if matches else None
        length = 0
        if p is not None:
            while k + length < n and length < 4096 and flat[p + length] == flat[k + length]:
                length += 1
        slot = (0x1E35A7BD * flat[k] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 4:
            tokens.append((length, near.get(k - p, k - p + len(NEAR))))
        elif cache_bits and cache[slot] == flat[k]:
            tokens.append((-1, slot))
        else:
            tokens.append((0, flat[k]))
        for _ in range(length if length >= 4 else 1):
            if cache_bits:
                cache[(0x1E35A7BD * flat[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[k]
            if matches:
                seen[tuple(flat[k : k + 4])] = k
            k += 1
    coded = []
    for length, x in tokens:
        if length > 0:
            a, b = _symbol(length), _symbol(x)
            coded.append([(0, LITERALS + a[0]), (None, a[1], a[2]), (4, b[0]), (None, b[1], b[2])])
        elif length < 0:
            coded.append([(0, LITERALS + LENGTHS + x)])
        else:
            coded.append([(0, x >> 8 & 255), (1, x >> 16 & 255), (2, x & 255), (3, x >> 24)])
    counts = [np.zeros(s, np.int64) for s in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)]
    for row in coded:
        for x in row:
            if x[0] is not None:
                counts[x[0]][x[1]] += 1
    codes = [write_code(out, c) for c in counts]
    for row in coded:
        for x in row:
            if x[0] is None:
                out.put(x[1], x[2])
            else:
                out.put(int(codes[x[0]][0][x[1]]), int(codes[x[0]][1][x[1]]))


def encode(px: np.ndarray, *, predictor: int | None = None, cross: tuple[int, int, int] | None = None, subtract: bool = False, palette: bool = False, cache_bits: int = 0, matches: bool = True) -> bytes:
    """A WebP file of ``px`` with the transforms asked for: one predictor mode, one cross-colour element (green to red, green to blue,
    red to blue), subtract-green, or a palette (256 colours at most)."""
    height, width = px.shape
    out = Writer()
    header(out, width, height)
    if palette:
        colours, index = np.unique(px, return_inverse=True)
        index, scale = index.reshape(px.shape), palette_bits(len(colours))
        out.put(1, 1), out.put(3, 2), out.put(len(colours) - 1, 8)
        c = split(colours)
        _write_pixels(out, join(np.diff(c, axis=0, prepend=0)).reshape(1, -1), main=False)
        each, wide = 8 >> scale, -(-width >> scale)
        full = np.zeros((height, wide << scale), np.int64)
        full[:, :width] = index
        bundled = (full.reshape(height, wide, 1 << scale) << (each * np.arange(1 << scale))).sum(2)
        px = (bundled.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    if predictor is not None:
        scale = 4
        table = np.full((-(-height >> scale), -(-px.shape[1] >> scale)), predictor << 8 | 0xFF000000, np.uint32)
        out.put(1, 1), out.put(0, 2), out.put(scale - 2, 3)
        _write_pixels(out, table, main=False)
        px = with_prediction(px, table >> np.uint32(8) & np.uint32(15), scale, forward=True)
    if cross is not None:
        scale = 5
        table = np.full((-(-height >> scale), -(-px.shape[1] >> scale)), 0xFF000000 | (cross[2] & 255) << 16 | (cross[1] & 255) << 8 | cross[0] & 255, np.uint32)
        out.put(1, 1), out.put(1, 2), out.put(scale - 2, 3)
        _write_pixels(out, table, main=False)
        px = with_cross_colour(px, table, scale, forward=True)
    if subtract:
        out.put(1, 1), out.put(2, 2)
        c = split(px)
        c[..., 1] -= c[..., 2]
        c[..., 3] -= c[..., 2]
        px = join(c)
    out.put(0, 1)
    _write_pixels(out, px, main=True, cache_bits=cache_bits, matches=matches)
    return contained(packed(*out.array()))
