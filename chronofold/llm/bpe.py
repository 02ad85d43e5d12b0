"""BPE encoding and decoding (operator 3).

Contiguous rank arrays: a short word is held as its part boundaries, its parts' ids and the ranks of adjacent parts.  The scan
for the least rank, the deletion of a boundary and the renewal of the neighbouring ranks are repeated until no pair has a rank.
Words of one length form the rows of three arrays, so that one numpy step serves them all; words over ``SHORT`` bytes keep
their candidates in a heap.  Texts are cut at safe places (``pieces``) and each distinct piece is encoded once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .pieces import sections
from .util import fresh, put, steps

SHORT = 32
#: Pieces that a worker remembers; beyond that it starts anew, so its memory is bounded.
REMEMBERED = 400_000
#: Words in one array step.
ROWS = 1 << 15

NONE = np.iinfo(np.int32).max
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids, byte_of = spec["model"]["vocab"], {c: b for b, c in enumerate(letters)}
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.special, key=len, reverse=True))).split if self.special else None
        self.byte_id = np.array([ids[c] for c in letters], np.int64)
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        order = np.argsort(key := left << 20 | right)
        self.keys, self.rank_of = np.append(key[order], np.iinfo(np.int64).max), np.append(order, NONE).astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, t)) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.first_ranks = self.ranks(*(x.ravel() for x in np.broadcast_arrays(self.byte_id[:, None], self.byte_id[None, :]))).reshape(256, 256)
        self.digits = {i: b"%d" % i for i in self.bytes_of}
        self.known: tuple[dict, dict] = ({}, {})

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, NONE without one."""
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def same_length(self, words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ``n`` bytes each, 1 to SHORT: a row for each, and how many of it count."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        ids = np.full((len(words), n + 1), -1, np.int64)
        ids[:, :n] = self.byte_id[raw]
        bounds = np.tile(np.arange(n + 1, dtype=np.int16), (len(words), 1))
        rank = np.full((len(words), n), NONE, np.int64)
        rank[:, : n - 1] = self.first_ranks[raw[:, :-1], raw[:, 1:]]
        row, column = np.arange(len(words)), np.arange(n + 1)
        out, ends = np.zeros((len(words), n), np.uint32), np.zeros(len(words), np.int64)
        while len(row):
            each = np.arange(len(row))
            at = rank.argmin(1)
            best = rank[each, at]
            if (done := best == NONE).any():
                out[row[done]], ends[row[done]] = ids[done, :n], (bounds[done] == n).argmax(1)
                keep = ~done
                row, ids, bounds, rank, at, best = row[keep], ids[keep], bounds[keep], rank[keep], at[keep], best[keep]
                each = each[: len(row)]
            ids[each, at] = self.merged[best]
            after = column[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            bounds[:, :-1] = np.where(after, bounds[:, 1:], bounds[:, :-1])
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NONE
            rank[each, at] = self.ranks(ids[each, at], ids[each, at + 1] & 0xFFFFF)
            if len(some := np.flatnonzero(at)):
                left = at[some] - 1
                rank[some, left] = self.ranks(ids[some, left], ids[some, left + 1])
        return out, ends

    def long(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length."""
        ids, n = self.byte_id[np.frombuffer(word, np.uint8)].tolist(), len(word)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        raw = np.frombuffer(word, np.uint8)
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(self.first_ranks[raw[:-1], raw[1:]].tolist()) if r != NONE]
        heapq.heapify(heap)
        keys, merged = self.pairs, self.merged
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(merged[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (x := keys.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (x, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], np.uint32)

    @property
    def pairs(self) -> dict:
        if not hasattr(self, "_pairs"):
            self._pairs = {(int(k) >> 20, int(k) & 0xFFFFF): int(r) for k, r in zip(self.keys[:-1], self.rank_of[:-1], strict=True)}
        return self._pairs

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 4-byte numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order, out = np.argsort(sizes, kind="stable"), [b""] * len(words)
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cuts) if len(words) else ():
            n = int(sizes[group[0]])
            if n > SHORT:
                for i in group.tolist():
                    out[i] = self.long(words[i]).astype("<u4").tobytes()
                continue
            for start in range(0, len(group), ROWS):
                some = group[start : start + ROWS].tolist()
                ids, ends = self.same_length([words[i] for i in some], n)
                raw, wide = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (i, end) in enumerate(zip(some, ends.tolist(), strict=True)):
                    out[i] = raw[k * wide : k * wide + 4 * end]
        return out

    def learn(self, known: dict[str, bytes], new: list[str], lead: str) -> None:
        """Encodes pieces that are not yet known.  A piece of letters alone is one word."""
        plain = [x for x in new if x.isalpha()]
        known.update(zip(plain, self.words([(lead + x).encode() for x in plain]), strict=True))
        if len(plain) == len(new):
            return
        plan, words = [], {}
        for piece in new:
            if not piece.isalpha():
                row = []
                for part in self.split(lead + piece) if self.split and any(s in piece for s in self.special) else (lead + piece,):
                    if part in self.special:
                        row.append(self.special[part].to_bytes(4, "little"))
                    elif part:
                        row += [words.setdefault(w, len(words)) for w in self.find(part)]
                plan.append((piece, row))
        ids = self.words([w.encode() for w in words])
        for piece, row in plan:
            known[piece] = b"".join([x if isinstance(x, bytes) else ids[x] for x in row])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known[0]) + len(self.known[1]) > REMEMBERED:
            self.known = ({}, {})
        parts = [sections(x) for x in texts]
        feed = {"\n"} if any(len(p) > 1 for p in parts) else set()
        for known, some, lead in ((self.known[0], feed.union(line[0] for p in parts for line in p), ""), (self.known[1], set().union(*(line[1:] for p in parts for line in p)), " ")):
            if new := [x for x in some if x not in known]:
                self.learn(known, new, lead)
        first, later = self.known[0], self.known[1].__getitem__
        between = first.get("\n", b"")
        return [np.frombuffer(between.join([first[line[0]] + b"".join(map(later, line[1:])) for line in p]), "<u4") for p in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids (array of int) of its column ``text``, as the library of ``path`` gives them without added tokens.

    Null and empty texts have no ids.  A column called ``ids`` is replaced.
    """
    ship(df.sparkSession)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(path)
        for batch in batches:
            got = [x for texts in steps(batch) for x in own.encode(texts)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint32), *got]).astype(np.int32)))

    return put(df, **{ids: run(F.col(f"`{text}`"))})


def decode(df: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its column ``ids``; null ids give the empty text."""
    ship(df.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(path)
        for batch in batches:
            yield pa.array([own.decode(x or []) for x in batch.to_pylist()], pa.string())

    return put(df, **{text: run(F.col(f"`{ids}`"))})


def round_trip(df: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """``df`` with n_tokens and the SHA-256 of the ids (decimal, comma-joined) and of the text decoded from them (UTF-8).

    Ids and decoded texts stay in the worker, a step of ``STEP_BYTES`` at a time.  Null texts are empty.  Columns of these names are
    replaced.
    """
    ship(df.sparkSession)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(path)
        digits = own.digits.__getitem__
        for batch in batches:
            n, coded, plain = [], [], []
            for texts in steps(batch):
                for ids in map(np.ndarray.tolist, own.encode(texts)):
                    n.append(len(ids))
                    coded.append(hashlib.sha256(b",".join(map(digits, ids))).hexdigest())
                    plain.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    at = fresh(df, "round_trip")
    out = put(df, **{at: run(F.col(f"`{text}`"))})
    return put(out, **{c: F.col(f"{at}.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop(at)
