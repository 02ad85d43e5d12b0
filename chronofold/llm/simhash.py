"""SimHash near-duplicates (operator 7).

Fingerprints that differ in at most BUDGET bits are found by a binary trie's self-join: pairs of nodes are walked down together, the
bits in which they differ add up, and a pair is left as soon as they exceed the budget.  To spread the trie over tasks, it is
entered below a common run of bits: of BUDGET + 1 blocks of a fingerprint one at least is equal in any pair, so each
fingerprint is dealt out once for each block, turned so that this block comes first.  Tries of over LEAF fingerprints are cut into parts
by hash, and each pair of parts is walked on its own.  A task returns a spanning forest of the links it finds, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .components import components
from .util import join_hot, put, shared, small, steps

BUDGET, LEAF = 2, 4096
#: Rows that a task walks at once, and shingles whose hashes it holds at once.
WALK, SHINGLES = 1 << 16, 1 << 16
#: Pairs of nodes with so few pairs of fingerprints are compared one by one.
FEW = 8

_SPREAD = np.array([sum(1 << 8 * i for i in range(8) if b >> i & 1) for b in range(256)], np.uint64)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes, from one start to the next, how many have each of the 64 bits set."""
    sizes = np.diff(np.append(starts, len(hashes)))
    parts = -(-sizes // 255)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.repeat(starts, parts) + 255 * (np.arange(len(first)) - first)
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    return np.add.reduceat(lanes.view(np.uint8).reshape(len(cuts), 64), np.cumsum(parts) - parts, axis=0, dtype=np.int64)


def fingerprints(texts: list[str], shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints; a text without words has fingerprint 0."""
    out = np.zeros(len(texts), np.uint64)
    one, weight = xxhash.xxh64_intdigest, np.uint64(1) << np.arange(64, dtype=np.uint64)
    held: list[int] = []
    starts: list[int] = []
    rows: list[int] = []

    def close() -> None:
        if rows:
            counts = bit_counts(np.array(held, np.uint64), np.array(starts))
            sizes = np.diff([*starts, len(held)])
            out[rows] = np.where(2 * counts > sizes[:, None], weight, np.uint64(0)).sum(1, dtype=np.uint64)
            held.clear(), starts.clear(), rows.clear()

    for k, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        line, n = b" ".join(words), max(1, len(words) - shingle + 1)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        stops = ends[-n:].tolist()
        begins = [0, *(ends[: n - 1] + 1).tolist()]
        if n > SHINGLES:
            counts = np.zeros(64, np.int64)
            for a in range(0, n, SHINGLES):
                hashes = np.array([one(line[i:j], 42) for i, j in zip(begins[a : a + SHINGLES], stops[a : a + SHINGLES], strict=True)], np.uint64)
                counts += bit_counts(hashes, np.array([0]))[0]
            out[k] = np.where(2 * counts > n, weight, np.uint64(0)).sum(dtype=np.uint64)
            continue
        rows.append(k)
        starts.append(len(held))
        held += [one(line[i:j], 42) for i, j in zip(begins, stops, strict=True)]
        if len(held) > SHINGLES:
            close()
    close()
    return out


def with_fingerprints(df: DataFrame, *, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """``df`` with the fingerprint of its column ``text`` as a signed long; null is the empty text."""
    ship(df.sparkSession)

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = [fingerprints(x, shingle) for x in steps(batch)]
            yield pa.array(np.concatenate([np.empty(0, np.uint64), *got]).view(np.int64))

    return put(df, **{out: run(F.col(f"`{text}`"))})


def trie_links(x: np.ndarray, group: np.ndarray, budget: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all pairs of one group whose numbers differ in at most ``budget`` bits.

    ``x`` (unsigned) is sorted within each group; ``group`` is sorted.  Pairs of nodes with at most ``few`` pairs of numbers are compared one
    by one, and so are those that are left at the bottom, whose numbers are equal on each side.
    """
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    stops = np.append(starts[1:], len(x))
    some = stops - starts > 1
    a, b = np.stack([starts[some], stops[some]]), np.stack([starts[some], stops[some]])
    bits = np.zeros(a.shape[1], np.int64)
    found = [np.empty((2, 0), np.int64)]
    for depth in range(65):
        if not a.shape[1]:
            break
        done = ((a[1] - a[0]) * (b[1] - b[0]) <= few) | ((a[0] == b[0]) & (a[1] - a[0] <= 3)) | (depth == 64)
        if done.any():
            na, nb = (a[1] - a[0])[done], (b[1] - b[0])[done]
            each = np.repeat(np.arange(len(na)), na * nb)
            k = np.arange(len(each)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            i, j = a[0][done][each] + k // nb[each], b[0][done][each] + k % nb[each]
            near = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
            found.append(np.stack([i[near], j[near]]))
            a, b, bits = a[:, ~done], b[:, ~done], bits[~done]
            if not a.shape[1]:
                break
        ones = np.concatenate([[0], np.cumsum((x >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        ma, mb = (r[1] - (ones[r[1]] - ones[r[0]]) for r in (a, b))
        zero_a, one_a, zero_b, one_b = np.stack([a[0], ma]), np.stack([ma, a[1]]), np.stack([b[0], mb]), np.stack([mb, b[1]])
        same = a[0] == b[0]
        a = np.concatenate([zero_a, one_a, zero_a, one_a[:, ~same]], 1)
        b = np.concatenate([zero_b, one_b, one_b, zero_b[:, ~same]], 1)
        bits = np.concatenate([bits, bits, bits + 1, bits[~same] + 1])
        keep = (bits <= budget) & (a[1] > a[0]) & (b[1] > b[0]) & ((a[0] != b[0]) | (a[1] - a[0] > 1))
        a, b, bits = a[:, keep], b[:, keep], bits[keep]
    return tuple(np.concatenate(found, 1))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of ``n`` places is linked with, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(budget: int, offsets: list[int]):
    def walk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        bits, block, low, high, fp, node = (t[c].to_numpy() for c in ("bits", "block", "low", "high", "fp", "node"))
        turn = np.array(offsets, np.uint64)[block]
        x = fp.view(np.uint64)
        x = (x << turn) | np.where(turn > 0, x >> ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
        order = np.lexsort((x, high, low, block, bits))
        x, node = x[order], node[order]
        group = np.concatenate([[0], np.cumsum(np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in (bits, block, low, high)]))])
        a, b = trie_links(x, group, budget)
        root = forest(len(x), a, b)
        some = np.flatnonzero(root != np.arange(len(x)))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < WALK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = [whole.column(c).to_numpy() for c in ("bits", "block", "low", "high")]
            ends = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            if len(ends):
                cut = int(ends[-1]) + 1
                yield walk([whole.slice(0, cut)])
                held = [whole.slice(cut)]
                rows = len(held[0])
        if rows:
            yield walk(held)

    return run


def links(prints: DataFrame, *, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """Edges (u, v) between nodes of ``prints`` (fp, node; fingerprints distinct) that span the same components as all links.

    A link joins fingerprints that differ in at most ``budget`` bits (below 64).
    """
    ship(prints.sparkSession)
    cuts = [64 * i // (budget + 1) for i in range(budget + 2)]
    blocks = [F.struct(F.lit(i).alias("block"), (F.shiftrightunsigned("fp", 64 - hi) if hi < 64 else F.col("fp")).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 63 else -1)).alias("bits")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    dealt = prints.where("node is not null").select("fp", "node", F.explode(F.array(*blocks)).alias("b")).select("fp", "node", "b.block", "b.bits")
    # large tries are counted and few, so that finding their rows is no shuffle by the crowded keys themselves
    large = shared(dealt.groupBy("block", "bits").count().where(F.col("count") > leaf).select("block", "bits", F.ceil(F.col("count") / F.lit(leaf)).cast("int").alias("parts")))
    dealt = dealt.join(small(large), ["block", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
    dealt = dealt.select("bits", "block", "fp", "node", F.explode(pairs).alias("p")).select("bits", "block", "p.low", "p.high", "fp", "node")
    dealt = dealt.repartition("bits", "block", "low", "high").sortWithinPartitions("bits", "block", "low", "high")
    return dealt.mapInArrow(_links(budget, cuts), "u long, v long")


def near_duplicates(df: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``df``: its id, fp (fingerprint as a signed long) and component_id, the least id that can be reached over links.

    Texts with equal fingerprints, and those within ``budget`` bits, are linked; texts without words (null ones too) have fingerprint 0 and are
    linked like any other.  Ids are integers; rows without one take the component of their fingerprint's other rows, and link nothing
    where there is none (component_id null).
    """
    rows = shared(with_fingerprints(df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")), shingle=shingle).select("id", "fp"))
    prints = shared(rows.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")))
    found = components(links(prints.drop("n"), budget=budget))
    prints = shared(prints.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"), "n"))
    # one fingerprint may have a large part of all rows: every copy of a text, or every text without words
    return join_hot(rows, prints, "fp", "n", rows.count()).select(F.col("id").alias(id), "fp", "component_id")
