"""Near copies by similarity (operator 7, with confirmation): texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash proposes and the shingles themselves decide.  A similarity of 0.8 lets about 16 of 100 fingerprint bits differ, far more than a trie
over 64 bits can be pruned by, so fingerprints are 256 bits wide and enter tries by many tables: a table takes some bits of the
fingerprint, and those that agree on them are one trie.  Its self-join keeps the pairs within a budget of differing bits (``simhash.trie_links``
over the first 64 bits, a count over the next 64).  The number of bits of a table follows from the number of fingerprints, so that a trie
of unlike texts holds about CROWD of them at any size, and the number of tables from the bits, so that a pair at 0.8 meets in none of
them with probability MISS.

Texts with equal fingerprints are one node.  The first FIRST tables propose each member's nearest neighbours; after these are confirmed, all
tables propose only pairs whose ends are in different components.  A trie with very many such pairs (a dense group on both sides of the
similarity) names itself instead, and is walked once more with the members' shingles: there pairs are decided from the nearest on, by the
shingles, each in the first table in which its ends meet, and a pair whose ends have been joined meanwhile is passed over.  So a dense group
sends as many rows as it has members and links, and no pair within the budget is left out unless its ends are joined already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import simhash
from .components import components
from .util import BROADCAST_ROWS, let_go, shared, small, steps

SHINGLE = 5
#: Links up to which one task joins components: two integers each, a few seconds in all.
AT_ONCE = 1_000_000
#: Similarity of near copies as a fraction.
OVER, UNDER = 4, 5
#: 64-bit words of a fingerprint.
WORDS = 4
#: Fingerprints, pairs and the like of a task, at least; tasks that read what is few beside them.
TASK_NODES, TASKS = 50_000, 4
#: Differing bits of the first 64 and of all bits of a pair, at most: over three standard deviations above what texts at 0.8 have.
NEAR_64, NEAR = 21, 58
#: The share of differing bits that tables are made for, and how often they may miss a pair that has it.
DIFFER, MISS = 0.16, 0.001
#: Unlike texts of one trie, and the least number of bits by which it is entered.
CROWD, LEAST_BITS = 64, 4
#: Tables of the first pass; pairs a member for which all pairs of a trie are proposed at once.
FIRST, MANY = 2, 1
#: Members of a trie's part; rows that a task walks, and pairs that it may have, at once; members from which joined ones are set apart.
LEAF, WALK, PAIRS, CROWDED = 1024, 1 << 14, 1 << 21, 128

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
NODE = ["node", "root", *(f"w{i}" for i in range(WORDS))]


def shingles(text: str) -> frozenset[bytes]:
    """The distinct runs of five words; a shorter text is one run."""
    words = text.encode().lower().split()
    if len(words) <= SHINGLE:
        return frozenset([b" ".join(words)])
    return frozenset(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))


def similar(a: frozenset[bytes], b: frozenset[bytes]) -> bool:
    if UNDER * min(len(a), len(b)) < OVER * max(len(a), len(b)):
        return False
    both = len(a & b)
    return UNDER * both >= OVER * (len(a) + len(b) - both)


class WordHashes(dict):
    """Hashes of words, made as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


#: Words whose hashes a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
_words = WordHashes()


def shingle_hashes(text: str) -> np.ndarray:
    """The hashes of the text's distinct shingles: those of their words, mixed one after the other."""
    if len(_words) > REMEMBERED:
        _words.clear()
    words = text.encode().lower().split()
    each, run = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)), min(SHINGLE, len(words))
    out = np.full(len(words) - run + 1, _ODD[0], np.uint64)
    for i in range(run):
        out = (out ^ each[i : len(words) - run + 1 + i]) * np.uint64(_ODD[1])
        out ^= out >> np.uint64(31)
    return np.unique(out)


def wide_prints(texts: list[str]) -> np.ndarray:
    """Fingerprints of the sets of shingles: a row of WORDS words a text, whose bits are set in over half of the hashes."""
    out = np.zeros((len(texts), WORDS), np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def close() -> None:
        sizes = np.array([len(h) for h in held])
        starts, hashes = np.cumsum(sizes) - sizes, np.concatenate(held)
        for j in range(WORDS):
            # other bits of the same shingles for each word
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_ODD[j])
            hashes ^= hashes >> np.uint64(32)
            counts = simhash.bit_counts(hashes, starts)
            out[rows, j] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        held.clear(), rows.clear()

    size = 0
    for k, text in enumerate(texts):
        held.append(shingle_hashes(text))
        rows.append(k)
        size += len(held[-1])
        if size > simhash.SHINGLES:
            close()
            size = 0
    if rows:
        close()
    return out


def copy_of(text):
    """Which rows hold one and the same text; null is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _with_prints(texts: DataFrame) -> DataFrame:
    @F.arrow_udf("struct<" + ",".join(f"w{i}:bigint" for i in range(WORDS)) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = np.concatenate([np.empty((0, WORDS), np.uint64), *(wide_prints(x) for x in steps(batch))]).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(got[:, i]) for i in range(WORDS)], [f"w{i}" for i in range(WORDS)])

    return texts.withColumn("w", run("text")).drop("text")


def _with_hashes(texts: DataFrame) -> DataFrame:
    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got = [shingle_hashes(t).view(np.int64) for some in steps(batch) for t in some]
            yield pa.ListArray.from_arrays(np.cumsum([0, *map(len, got)], dtype=np.int32), np.concatenate([np.empty(0, np.int64), *got]))

    return texts.select("node", run("text").alias("hashes"))


def plan(nodes: int) -> tuple[int, int]:
    """Bits of a table, and tables, for so many fingerprints."""
    bits = max(LEAST_BITS, ceil(log2(max(nodes, 1) / CROWD)))
    return bits, ceil(log(MISS) / log(1 - (1 - DIFFER) ** bits))


def table_keys(words: np.ndarray, bits: int, tables: range) -> np.ndarray:
    """The keys (a row a fingerprint, a column a table) under which fingerprints enter tries."""
    loose = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    weight = (1 << np.arange(bits)).astype(np.float32 if bits <= 24 else np.float64)
    # each table's bits are drawn by its own number, so that a table is the same however many there are
    return np.stack([(loose[:, np.random.default_rng(t).permutation(64 * WORDS)[:bits]] @ weight).astype(np.int64) + (t << bits) for t in tables], 1)


def _deal(bits: int, tables: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 4096):
                some = batch.slice(k, 4096)
                words = np.stack([some.column(f"w{i}").to_numpy(zero_copy_only=False) for i in range(WORDS)], 1)
                each = np.repeat(np.arange(len(some)), len(tables))
                cells = [some.column(c).to_numpy(zero_copy_only=False)[each] for c in NODE]
                yield pa.RecordBatch.from_arrays([pa.array(table_keys(words, bits, tables).ravel()), *map(pa.array, cells)], ["key", *NODE])

    return run


def _nearest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which pairs are the nearest one of a member."""
    keep = np.zeros(len(a), bool)
    if not len(a):
        return keep
    ends, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((pair, far[pair], ends))
    keep[pair[order[np.flatnonzero(np.append(True, ends[order][1:] != ends[order][:-1]))]]] = True
    return keep


def _across(w0: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of pairs between two sides whose first words are near."""
    step = max(1, PAIRS // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(w0[a[k : k + step], None] ^ w0[b]) <= NEAR_64)
        yield a[k + i], b[j]


def _decide(pairs: np.ndarray, node: np.ndarray, root: np.ndarray, held: list[np.ndarray]) -> list[tuple[int, int]]:
    """The links (u, v) that join components, of pairs of places in the order in which they are to be decided."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = find(int(root[i])), find(int(root[j]))
        x, y = held[i], held[j]
        if a != b and UNDER * min(len(x), len(y)) >= OVER * max(len(x), len(y)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if UNDER * both >= OVER * (len(x) + len(y) - both):
                top[max(a, b)] = min(a, b)
                out.append((int(node[i]), int(node[j])))
    return out


def _walk(bits: int, nearest: bool, decide: bool):
    """Pairs (u, v) of whole tries: to be confirmed, or, if they are decided here, links.  (key, null) names a trie that has too many to be
    confirmed; if the ``nearest`` are wanted, each member has its nearest one instead."""

    def walk(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, low, high, node, root = (t[c].to_numpy() for c in ("key", "low", "high", "node", "root"))
        words = np.stack([t[f"w{i}"].to_numpy() for i in range(WORDS)], 1).view(np.uint64)
        order = np.lexsort((words[:, 0], high, low, key))
        key, low, high, node, root, words = (x[order] for x in (key, low, high, node, root, words))
        w0 = np.ascontiguousarray(words[:, 0])
        lists = t["hashes"].combine_chunks() if decide else None
        held = [lists[int(k)].values.to_numpy() for k in order] if decide else []
        new = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in (key, low, high)])) if len(key) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        # tries of one component have nothing to say; the others are walked so many at a time that their pairs fit in memory
        lows, highs = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
        some = np.flatnonzero(lows < highs)
        cost = np.cumsum(sizes[some] ** 2) // PAIRS
        for part in np.split(some, np.flatnonzero(np.diff(cost)) + 1) if len(some) else ():
            at, of, found = [], [], []
            for k, g in enumerate(part.tolist()):
                own = np.arange(starts[g], starts[g] + sizes[g])
                if len(own) > CROWDED:
                    values, counts = np.unique(root[own], return_counts=True)
                    if 2 * counts.max() > len(own):
                        # most are joined already: the rest is compared with them, and joins the walk without them
                        joined = root[own] == values[counts.argmax()]
                        found += [(a, b, np.full(len(a), k)) for a, b in _across(w0, own[~joined], own[joined])]
                        own = own[~joined]
                at.append(own)
                of.append(np.full(len(own), k))
            at, of = np.concatenate(at), np.concatenate(of)
            a, b = simhash.trie_links(w0[at], of, NEAR_64, few=64)
            a, b, own = (np.concatenate(x) for x in zip((at[a], at[b], of[a]), *found, strict=True))
            keep = root[a] != root[b]
            a, b, own = a[keep], b[keep], own[keep]
            far = np.zeros(len(a), np.int16)
            for i in range(WORDS):
                far += np.bitwise_count(words[a, i] ^ words[b, i])
            keep = far <= NEAR
            a, b, far, own = a[keep], b[keep], far[keep], own[keep]
            if decide:
                # a pair is decided in the first table in which its ends meet
                for k, g in enumerate(part.tolist()):
                    mine = np.flatnonzero(own == k)
                    table = int(key[starts[g]]) >> bits
                    keys = table_keys(words[starts[g] : starts[g] + sizes[g]], bits, range(table)) if table else np.empty((sizes[g], 0))
                    for c in range(keys.shape[1]):
                        mine = mine[keys[a[mine] - starts[g], c] != keys[b[mine] - starts[g], c]]
                    links = _decide(np.stack([a[mine], b[mine]], 1)[np.argsort(far[mine], kind="stable")], node, root, held)
                    yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in links], pa.int64()), pa.array([min(x) for x in links], pa.int64())], ["u", "v"])
                continue
            more = np.bincount(own, minlength=len(part)) > MANY * sizes[part]
            if nearest or more.any():
                keep = _nearest(a, b, far) if nearest else ~more[own]
                a, b = a[keep], b[keep]
                if not nearest:
                    yield pa.RecordBatch.from_arrays([pa.array(key[starts[part[more]]]), pa.nulls(int(more.sum()), pa.int64())], ["u", "v"])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < WALK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ends = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in (whole.column(c).to_numpy() for c in ("key", "low", "high"))]))
            if len(ends):
                cut = int(ends[-1]) + 1
                yield from walk(pa.Table.from_batches([whole.slice(0, cut)]))
                held = [whole.slice(cut)]
                rows = len(held[0])
        if rows:
            yield from walk(pa.Table.from_batches(held))

    return run


def _counted(df: DataFrame) -> tuple[int, DataFrame]:
    """The number of rows of a checkpoint, and the same to be broadcast if they are few; a look for a first row would take several jobs."""
    n = df.count()
    return n, F.broadcast(df) if n <= BROADCAST_ROWS else df


def proposed(nodes: DataFrame, bits: int, tables: range, *, apart: bool = False, only: DataFrame | None = None, hashes=None) -> DataFrame:
    """Pairs (u, v) of nodes (node, root, w0...) of different roots that some table lets meet within the budget.

    ``only`` (key) names the tries to walk, with ``hashes``, which gives (node, hashes) of nodes, to decide pairs by.  A trie of over LEAF members is cut by hash.  Where all but LEAF of them have one root, these are
    dealt out and the others meet each part; else each pair of parts is walked, or, if ``apart``, each part on its own.  Rows (key, null)
    name tries that have more pairs than have been proposed.
    """
    dealt = nodes.select(*NODE).mapInArrow(_deal(bits, tables), "key long, " + ", ".join(f"{c} long" for c in NODE))
    if only is not None:
        dealt = shared(dealt.join(small(only), "key", "left_semi"))
    of = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    large = shared(of.where((F.col("n") > LEAF) & (F.col("least") < F.col("most"))).select("key", "n", F.ceil(F.col("n") / F.lit(LEAF)).cast("int").alias("parts")))
    zero = F.lit(0)
    many, large = _counted(large.coalesce(TASKS))
    if not many:
        dealt = dealt.select("key", zero.alias("low"), zero.alias("high"), *NODE)
    else:
        if not apart:
            by_root = dealt.join(large, "key").groupBy("key", "n", "parts", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key", "n", "parts").agg(F.max(F.struct("m", "root")).alias("t"))
            # a row for each row of ``large``
            top = shared(by_root.select("key", "parts", F.when(F.col("n") - F.col("t.m") <= LEAF, F.col("t.root")).alias("top"))).coalesce(TASKS)
            large = F.broadcast(top) if many <= BROADCAST_ROWS else top
        dealt = dealt.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
        each = F.sequence(zero, F.col("parts") - 1)
        alone = F.array(F.struct(own.alias("low"), own.alias("high")))
        to = alone
        if not apart:
            all_parts = F.transform(each, lambda j: F.struct(j.alias("low"), j.alias("high")))
            pairs = F.transform(each, lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
            to = F.when((F.col("parts") == 1) | (F.col("root") == F.col("top")), alone).when(F.col("top").isNotNull(), all_parts).otherwise(pairs)
        dealt = dealt.select("key", *NODE, F.explode(to).alias("p")).select("key", "p.low", "p.high", *NODE)
    if hashes is not None:
        dealt = dealt.join(hashes(dealt.select("node").distinct()), "node")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(_walk(bits, apart, hashes is not None), "u long, v long")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = lru_cache(256)(shingles)
    for batch in batches:
        keep = [similar(held(a or ""), held(b or "")) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        yield batch.select(["u", "v", "a"]).filter(pa.array(keep, pa.bool_())).select(["u", "v"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are near copies; ``texts`` (node, text) has each node once."""
    held = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    return held.select("u", "v", "a", "b").mapInArrow(_confirm, "u long, v long")


def firsts(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, copy, n) for each group of near copies: its least id, the ``copy_of`` the text that stands there, and how many rows have both.

    Groups are the components of all pairs of near copies; rows without an id are in none.
    """
    ship(df.sparkSession)
    named = df.where(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    words = [f"w{i}" for i in range(WORDS)]
    rows = shared(_with_prints(named.select("id", copy_of(F.col("text")).alias("copy"), "text")).select("id", "copy", "w.*"))
    same = rows.groupBy(*words, "id", "copy").agg(F.count(F.lit(1)).alias("n"))
    nodes = shared(same.groupBy(*words).agg(F.min(F.struct("id", "copy", "n")).alias("first")).select(F.col("first.copy").alias("node"), "first", *words))
    count = nodes.count()
    bits, tables = plan(count)
    # what is small beside the texts is not spread over all of the session's shuffle partitions
    tasks = TASKS + count // TASK_NODES
    told = named.withColumn("copy", copy_of(F.col("text")))

    def texts(ends: DataFrame) -> DataFrame:
        """(node, text) of nodes: one row holds the text of each, that of its least id."""
        wanted = shared(nodes.coalesce(tasks).join(ends, "node").select(F.col("node").alias("copy"), F.col("first.id").alias("id")).coalesce(tasks))
        return told.join(small(wanted), ["copy", "id"], "left_semi").groupBy(F.col("copy").alias("node")).agg(F.first("text").alias("text"))

    roots = None
    for turn in range(3):
        let_go(df.sparkSession)
        # read several times below: joined once
        own = nodes.withColumn("root", F.col("node")) if roots is None else shared(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select(*NODE))
        if turn < 2:
            found = shared(proposed(own, bits, range(min(FIRST, tables) if turn == 0 else tables), apart=turn == 0))
            let_go(df.sparkSession)
            pairs = shared(found.where("v is not null").coalesce(tasks).distinct().coalesce(tasks))
            new = shared(confirmed(pairs, texts(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())))
        else:
            dense = found.where("v is null").select(F.col("u").alias("key"))
            if not dense.count():
                break
            only = shared(dense.coalesce(tasks).distinct().coalesce(tasks))
            new = shared(proposed(own, bits, range(tables), only=only, hashes=lambda ends: _with_hashes(texts(ends))))
        let_go(df.sparkSession)
        if roots is None or new.count():
            # what is joined already goes on as stars
            roots = components(new if roots is None else new.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), AT_ONCE)
    grouped = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    return grouped.agg(F.min("first").alias("first")).select(F.col("first.id").alias(id), "first.copy", "first.n")
