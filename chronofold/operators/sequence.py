"""Lists and texts: the order of elements, what they hold, and positions that outlast edits.

Elements form a tree (each was inserted after another, or at the head); the document order is its preorder with later siblings first.
The order of one sequence is found in one task, with an explicit stack; sequences are spread over tasks by object, and many small
ones share a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.groups import split, whole_groups
from ..functions.ship import ship
from ..schema import OBJ, STRING, op_id
from .visibility import covered, no_marks, object_type, visible

SEQ = ["doc_id", *OBJ]
ELEMENT = [*SEQ, "elem_ctr", "elem_actor"]


def preorder(ids: list[tuple], refs: list[tuple]) -> list[int]:
    """The places of elements in document order.  An element whose reference is not there is left out, with all that hangs on it."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    children: dict[tuple, list[int]] = {}
    for i in order:
        children.setdefault(refs[i], []).append(i)
    stack, out = list(children.get((None, None), ())), []
    while stack:
        i = stack.pop()
        out.append(i)
        stack += children.get(ids[i], ())
    return out


def document_order(ops: DataFrame) -> DataFrame:
    """(doc_id, obj_*, elem_*, pos) of every element, deleted ones too; pos counts from 0 within its sequence."""
    ship(ops.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, SEQ):
            out = []
            for group in split(rows, SEQ):
                found = preorder([(r["op_ctr"], r["op_actor"]) for r in group], [(r["elem_ctr"], r["elem_actor"]) for r in group])
                out += [(r["doc_id"], r["obj_ctr"], r["obj_actor"], r["op_ctr"], r["op_actor"], pos) for pos, r in enumerate(map(group.__getitem__, found))]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], [*ELEMENT, "pos"])

    inserts = ops.where("insert").select(*SEQ, "op_ctr", "op_actor", "elem_ctr", "elem_actor")
    return inserts.repartition(*SEQ).sortWithinPartitions(*SEQ).mapInArrow(run, "doc_id bigint, obj_ctr bigint, obj_actor binary, elem_ctr bigint, elem_actor binary, pos bigint")


def element_of(ops: DataFrame) -> DataFrame:
    """Sequence ops with elem_* naming the element that they are about (an insert is about the one it makes)."""
    own = [F.when(F.col("insert"), F.col(o)).otherwise(F.col(e)).alias(e) for o, e in (("op_ctr", "elem_ctr"), ("op_actor", "elem_actor"))]
    return ops.where("map_key is null").select(*[c for c in ops.columns if c not in ("elem_ctr", "elem_actor")], *own)


def element_winners(live: DataFrame) -> DataFrame:
    """The live op with the highest id of each element; marks do not count."""
    live = element_of(no_marks(live))
    rest = [c for c in live.columns if c not in ELEMENT]
    return live.groupBy(*ELEMENT).agg(F.max_by(F.struct(*rest), op_id()).alias("w")).select(*ELEMENT, *[F.col(f"w.{c}").alias(c) for c in rest])


def elements(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """Visible elements with ``pos`` (place among all), ``idx`` (place among visible ones, from 0) and their winner's columns."""
    ops = ops if clock is None else covered(ops, clock)
    found = document_order(ops).join(element_winners(visible(ops)), ELEMENT)
    return found.withColumn("idx", (F.row_number().over(W.partitionBy(*SEQ).orderBy("pos")) - 1).cast("long"))


def text(found: DataFrame) -> DataFrame:
    """The text of every sequence of ``elements``: its string values, one after the other."""
    said = F.when(F.col("value.tag") == STRING, F.col("value.s"))
    pieces = F.array_sort(F.collect_list(F.struct("idx", said.alias("s"))))
    return found.groupBy(*SEQ).agg(F.array_join(F.transform(pieces, lambda x: F.coalesce(x["s"], F.lit(""))), "").alias("text"))


def lengths(found: DataFrame) -> DataFrame:
    return found.groupBy(*SEQ).agg(F.count(F.lit(1)).alias("length"))


def item(found: DataFrame, idx: int) -> DataFrame:
    return found.where(F.col("idx") == idx)


def cursors(found: DataFrame) -> DataFrame:
    """Elements with ``cursor``, the stable name of their place."""
    return found.withColumn("cursor", cursor_string(F.col("elem_ctr"), F.col("elem_actor"), F.lit(False)))


def cursor_string(ctr: Column, actor: Column, before: Column) -> Column:
    """``ctr@hexactor``, with a minus sign if the cursor moves backwards once its element is gone."""
    return F.concat(F.when(before, "-").otherwise(""), ctr.cast("string"), F.lit("@"), F.lower(F.hex(actor)))


def parse_cursor(text: Column) -> Column:
    """STRUCT<kind, ctr, actor, before> of a cursor's text: ``s`` (start), ``e`` (end) or an element; null for what is no cursor."""
    kind = F.when(text == "s", "start").when(text == "e", "end").when(text.rlike("^-?[0-9]+@([0-9a-fA-F]{2})*$"), "op")
    return F.when(kind.isNotNull(), F.struct(
        kind.alias("kind"), F.when(kind == "op", F.regexp_extract(text, "([0-9]+)@", 1).cast("long")).alias("ctr"),
        F.when(kind == "op", F.unhex(F.regexp_extract(text, "@([0-9a-fA-F]*)", 1))).alias("actor"), text.startswith("-").alias("before"),
    ))


def cursor_positions(ops: DataFrame, wanted: DataFrame, clock: DataFrame | None = None, by_id: bool = False) -> DataFrame:
    """``wanted`` (doc_id, obj_*, cursor) with ``position``: the index its element has, or would have.

    A cursor on a deleted element goes to the next visible one after it in document order, or to the last before it if it moves
    backwards; ``by_id`` takes the nearest element by id instead.  Start is 0, end the length; an unknown element gives null.
    """
    seen = ops if clock is None else covered(ops, clock)
    order = document_order(seen).join(element_winners(visible(seen)).select(*ELEMENT, F.lit(True).alias("live")), ELEMENT, "left")
    w = W.partitionBy(*SEQ).orderBy(*(["elem_ctr", "elem_actor"] if by_id else ["pos"]))
    count = F.sum(F.col("live").cast("long"))
    if by_id:
        idx = (F.sum(F.col("live").cast("long")).over(W.partitionBy(*SEQ).orderBy("pos")) - 1).alias("i")
        order = order.select("*", F.when(F.col("live"), idx).alias("own"))
        order = order.select("*", F.last("own", ignorenulls=True).over(w).alias("low"), F.first("own", ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("high"))
    else:
        before = F.coalesce(count.over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        order = order.select("*", F.when(F.col("live"), before).alias("own"), before.alias("n")).select("*", F.when(F.col("n") > 0, F.col("n") - 1).alias("low"), F.col("n").alias("high"))
    size = order.groupBy(*SEQ).agg(F.coalesce(count, F.lit(0)).alias("length"))
    c = wanted.select(*SEQ, "cursor", parse_cursor(F.col("cursor")).alias("c")).select(*SEQ, "cursor", "c.*").withColumnsRenamed({"ctr": "elem_ctr", "actor": "elem_actor"})
    exact = c.join(order.select(*ELEMENT, "own", "low", "high", F.lit(True).alias("known")), ELEMENT, "left").join(size, SEQ, "left")
    gone = F.when(F.col("before"), F.coalesce("low", F.lit(0))).otherwise(F.coalesce("high", "length"))
    position = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "end", F.coalesce("length", F.lit(0))).when(F.col("known"), F.coalesce("own", gone))
    return exact.select(*SEQ, "cursor", position.cast("long").alias("position"))


def text_objects(ops: DataFrame) -> DataFrame:
    return ops.where(object_type(F.col("action")) == "text").select("doc_id", F.col("op_ctr").alias("obj_ctr"), F.col("op_actor").alias("obj_actor"))
