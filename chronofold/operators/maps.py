"""Reads of maps: winners, conflicts, keys, counters, paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.groups import split, whole_groups
from ..functions.ship import ship
from ..schema import COUNTER, INCREMENT, OBJ, SET, op_id, scalar
from .visibility import ID, flagged, is_make

KEY = ["doc_id", *OBJ, "map_key"]


def all_values(live: DataFrame) -> DataFrame:
    """Every live op of every map key, with ``rank`` (0 the winner's) by id from the highest."""
    w = W.partitionBy(*KEY).orderBy(F.desc("op_ctr"), F.desc("op_actor"))
    return live.where("map_key is not null").withColumn("rank", (F.row_number().over(w) - 1).cast("long"))


def winners(live: DataFrame) -> DataFrame:
    """The live op with the highest id of each map key.

    One pass of partial aggregation, so that a hot key sends one row a task and not all its rows.
    """
    rest = [c for c in live.columns if c not in KEY]
    best = live.where("map_key is not null").groupBy(*KEY).agg(F.max_by(F.struct(*rest), op_id()).alias("w"))
    return best.select(*KEY, *[F.col(f"w.{c}").alias(c) for c in rest]).select(*live.columns)


def values(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """The winner of each map key, now or at a clock; where it is an increment, ``value`` is the counter's total.

    The total adds up the key's counters and increments (of those that the clock covers), as ``key_sums`` does.
    """
    rows = flagged(ops) if clock is None else flagged(ops, clock)
    return won(rows.where("map_key is not null"), ops.columns, 0).where("w_0 is not null").select(*KEY, F.col("w_0.*")).select(*ops.columns)


def won(rows: DataFrame, columns: list[str], *clocks: int) -> DataFrame:
    """Per key the winner (a struct, null if there is none) at each of the clocks of ``flagged``."""
    rest = [c for c in columns if c not in KEY]
    amount = F.when((F.col("action") == INCREMENT) | (F.col("value.tag") == COUNTER), F.col("value.l"))
    best = rows.groupBy(*KEY).agg(*[F.max_by(F.struct(*rest), F.when(F.col(f"live_{k}"), op_id())).alias(f"w_{k}") for k in clocks], *[F.coalesce(F.sum(F.when(F.col(f"seen_{k}"), amount)), F.lit(0)).alias(f"t_{k}") for k in clocks])
    folded = [F.when(F.col(f"w_{k}").isNotNull(), F.col(f"w_{k}").withField("value", F.when(F.col(f"w_{k}.action") == INCREMENT, scalar(COUNTER, l=F.col(f"t_{k}"))).otherwise(F.col(f"w_{k}.value")))).alias(f"w_{k}") for k in clocks]
    return best.select(*KEY, *folded)


def conflicts(live: DataFrame) -> DataFrame:
    """Keys with more than one live op, and how many."""
    return live.where("map_key is not null").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keys(live: DataFrame) -> DataFrame:
    return live.where("map_key is not null").select(*KEY).distinct()


def lengths(live: DataFrame) -> DataFrame:
    """Number of keys of every map that has any."""
    return keys(live).groupBy("doc_id", *OBJ).agg(F.count(F.lit(1)).alias("length"))


def key_sums(ops: DataFrame) -> DataFrame:
    """Per key the counters' values and all increments, seen or not, added up: the plain sum, which mixes concurrent counters."""
    amount = F.when((F.col("action") == INCREMENT) | (F.col("value.tag") == COUNTER), F.col("value.l"))
    return ops.where("map_key is not null").groupBy(*KEY).agg(F.sum(amount).alias("total")).where("total is not null")


def counters(ops: DataFrame) -> DataFrame:
    """Live counters, each with its own total: the value it was set to and the increments that descend from it.

    An increment belongs to every counter that its chain of predecessors reaches.  The counters and increments of one key are walked in one
    task, in order of their ids, which predecessors precede; an op that names a later one as its predecessor belongs to nothing.
    """
    ship(ops.sparkSession)
    own = ops.where(F.col("map_key").isNotNull() & ((F.col("action") == INCREMENT) | (F.col("value.tag") == COUNTER) | (F.size("pred") > 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, KEY):
            out = []
            for group in split(rows, KEY):
                of: dict[tuple, frozenset] = {}
                total: dict[tuple, int] = {}
                gone: set[tuple] = set()
                for r in sorted(group, key=lambda r: (r["op_ctr"], r["op_actor"])):
                    me, before = (r["op_ctr"], r["op_actor"]), [(p["ctr"], p["actor"]) for p in r["pred"] or []]
                    if r["action"] == INCREMENT:
                        of[me] = frozenset().union(*(of.get(p, ()) for p in before))
                        for c in of[me]:
                            total[c] += r["by"] or 0
                        continue
                    gone.update(c for p in before for c in of.get(p, ()))
                    if r["counter"]:
                        of[me], total[me] = frozenset([me]), r["by"] or 0
                out += [(group[0]["doc_id"], *c, group[0]["obj_ctr"], group[0]["obj_actor"], group[0]["map_key"], n) for c, n in total.items() if c not in gone]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], [*ID, *OBJ, "map_key", "total"])

    rows = own.select(*KEY, "op_ctr", "op_actor", "action", "pred", ((F.col("action") == SET) & (F.col("value.tag") == COUNTER)).alias("counter"), F.col("value.l").alias("by"))
    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, "doc_id bigint, op_ctr bigint, op_actor binary, obj_ctr bigint, obj_actor binary, map_key string, total bigint")


def parents(ops: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """(doc_id, obj_ctr, obj_actor, depth, at_ctr, at_actor, map_key, idx): the steps from each object up to the root.

    depth 0 is the object's own place; ``elements`` (see ``sequence``) gives the index of members of sequences.  The make ops of a document,
    a small part of its log, meet in one task, and paths of any depth are followed there; many documents share a step.
    """
    ship(ops.sparkSession)
    made = ops.where(is_make(F.col("action"))).select(
        "doc_id", "op_ctr", "op_actor", *OBJ, "map_key",
        F.when(F.col("insert"), F.col("op_ctr")).otherwise(F.col("elem_ctr")).alias("e_ctr"), F.when(F.col("insert"), F.col("op_actor")).otherwise(F.col("elem_actor")).alias("e_actor"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "obj_ctr", "obj_actor", "depth", "at_ctr", "at_actor", "map_key", "e_ctr", "e_actor"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.binary()]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

        for rows in whole_groups(batches, ["doc_id"]):
            out = []
            for group in split(rows, ["doc_id"]):
                place = {(r["op_ctr"], r["op_actor"]): r for r in group}
                for own in place:
                    at, depth, met = own, 0, set()
                    while (r := place.get(at)) is not None and at not in met:
                        met.add(at)
                        out.append((r["doc_id"], *own, depth, r["obj_ctr"], r["obj_actor"], r["map_key"], r["e_ctr"], r["e_actor"]))
                        at, depth = (r["obj_ctr"], r["obj_actor"]), depth + 1
                    if len(out) > 1 << 16:
                        yield batch(out)
                        out = []
            yield batch(out)

    out = made.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "doc_id bigint, obj_ctr bigint, obj_actor binary, depth int, at_ctr bigint, at_actor binary, map_key string, e_ctr bigint, e_actor binary")
    if elements is None:
        return out.withColumn("idx", F.lit(None).cast("long")).drop("e_ctr", "e_actor")
    place = elements.select("doc_id", F.col("elem_ctr").alias("e_ctr"), F.col("elem_actor").alias("e_actor"), "idx")
    return out.join(place, ["doc_id", "e_ctr", "e_actor"], "left").drop("e_ctr", "e_actor")


def map_range(ops: DataFrame) -> DataFrame:
    """Winners in key order, counters as totals."""
    return values(ops).orderBy("doc_id", *[F.asc_nulls_first(c) for c in OBJ], "map_key")
