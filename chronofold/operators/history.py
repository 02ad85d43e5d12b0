"""The change graph and reads at a point in it.

``clocks`` gives every change its vector clock once; a read at any heads is then a lookup and a maximum.  The graph of one document is
walked in one task, in causal order; documents are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import split, whole_groups
from ..functions.ship import ship
from . import maps, sequence
from .visibility import visible_at


def causal(deps: dict) -> list:
    """Hashes in an order in which dependencies come first; dependencies that are not there do not count, cycles are left out."""
    waits = {h: {d for d in ds if d in deps} for h, ds in deps.items()}
    after: dict = {}
    for h, ds in waits.items():
        for d in ds:
            after.setdefault(d, []).append(h)
    ready, out = sorted(h for h, ds in waits.items() if not ds), []
    while ready:
        h = ready.pop()
        out.append(h)
        for x in after.get(h, ()):
            waits[x].discard(h)
            if not waits[x]:
                ready.append(x)
    return out


def clocks(changes: DataFrame) -> DataFrame:
    """(doc_id, hash, actor, max_ctr): for each change the highest op of each actor that it has seen, its own included."""
    ship(changes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["doc_id"]):
            out = []
            for group in split(rows, ["doc_id"]):
                by_hash, known = {r["hash"]: r for r in group}, {}
                for h in causal({h: r["deps"] or [] for h, r in by_hash.items()}):
                    r, clock = by_hash[h], {}
                    for d in r["deps"] or []:
                        for actor, ctr in known.get(d, {}).items():
                            if clock.get(actor, -1) < ctr:
                                clock[actor] = ctr
                    clock[r["actor"]] = max(clock.get(r["actor"], -1), r["max_op"])
                    known[h] = clock
                    out += [(r["doc_id"], h, actor, ctr) for actor, ctr in clock.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["doc_id", "hash", "actor", "max_ctr"])

    rows = changes.select("doc_id", "hash", "actor", "max_op", "deps").repartition("doc_id").sortWithinPartitions("doc_id")
    return rows.mapInArrow(run, "doc_id bigint, hash binary, actor binary, max_ctr bigint")


def clock_at(changes_clocks: DataFrame, heads: DataFrame) -> DataFrame:
    """The clock (doc_id, actor, max_ctr) of heads (doc_id, hash); unknown hashes count for nothing."""
    return changes_clocks.join(heads.select("doc_id", "hash").distinct(), ["doc_id", "hash"]).groupBy("doc_id", "actor").agg(F.max("max_ctr").alias("max_ctr"))


def ancestors(changes: DataFrame, heads: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(doc_id, hash) of everything reached from heads over dependencies, heads included; nothing is passed through ``stop``."""
    ship(changes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["doc_id"]):
            out = []
            for group in split(rows, ["doc_id"]):
                deps = {r["hash"]: r["deps"] or [] for r in group if r["role"] == 0}
                seen = {r["hash"] for r in group if r["role"] == 2}
                todo = [r["hash"] for r in group if r["role"] == 1]
                while todo:
                    h = todo.pop()
                    if h in deps and h not in seen:
                        seen.add(h)
                        out.append((group[0]["doc_id"], h))
                        todo += deps[h]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "hash"])

    none = F.lit(None).cast("array<binary>")
    rows = changes.select("doc_id", "hash", "deps", F.lit(0).alias("role")).unionByName(heads.select("doc_id", "hash", none.alias("deps"), F.lit(1).alias("role")))
    if stop is not None:
        rows = rows.unionByName(stop.select("doc_id", "hash", none.alias("deps"), F.lit(2).alias("role")))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "doc_id bigint, hash binary")


def get_at(ops: DataFrame, clock: DataFrame) -> DataFrame:
    """The winners at a clock, counters as totals."""
    return maps.values(ops, clock)


def get_all_at(ops: DataFrame, clock: DataFrame) -> DataFrame:
    return maps.all_values(visible_at(ops, clock))


def keys_at(ops: DataFrame, clock: DataFrame) -> DataFrame:
    return maps.keys(visible_at(ops, clock))


def length_at(ops: DataFrame, clock: DataFrame) -> DataFrame:
    return maps.lengths(visible_at(ops, clock))


def elements_at(ops: DataFrame, clock: DataFrame) -> DataFrame:
    return sequence.elements(ops, clock)


def text_at(ops: DataFrame, clock: DataFrame) -> DataFrame:
    return sequence.text(sequence.elements(ops, clock))
