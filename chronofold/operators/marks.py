"""Named ranges on texts.

A range is two ops on elements: a beginning, which has the name and value, and an end, whose id is the next of the same actor.  The
beginning is anchored to the element before the range, the end to the range's last element.  An anchor that is gone (or the head)
means the start of the text for a beginning and its end for an end.  Whether a range grows with text inserted at its edges (expand) is
kept but not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MARK
from . import sequence
from .sequence import ELEMENT, SEQ
from .visibility import covered, visible


def ranges(ops: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """(doc_id, obj_*, name, value, start, stop, op_ctr, op_actor) of every live range; an empty or reversed one is left out."""
    seen = ops if clock is None else covered(ops, clock)
    found = sequence.elements(seen).select(*ELEMENT, "idx")
    size = sequence.lengths(found)
    live = visible(seen).where(F.col("action") == MARK)
    begin = live.where("mark_name is not null").select(*SEQ, "op_ctr", "op_actor", "elem_ctr", "elem_actor", F.col("mark_name").alias("name"), "value")
    end = live.where("mark_name is null").select(*SEQ, (F.col("op_ctr") - 1).alias("op_ctr"), "op_actor", F.col("elem_ctr").alias("e_ctr"), F.col("elem_actor").alias("e_actor"))
    both = begin.join(end, [*SEQ, "op_ctr", "op_actor"])
    both = both.join(found, ELEMENT, "left").withColumn("start", F.coalesce(F.col("idx") + 1, F.lit(0))).drop("idx", "elem_ctr", "elem_actor")
    last = found.select(*SEQ, F.col("elem_ctr").alias("e_ctr"), F.col("elem_actor").alias("e_actor"), (F.col("idx") + 1).alias("stop"))
    both = both.join(last, [*SEQ, "e_ctr", "e_actor"], "left").join(size, SEQ, "left")
    both = both.withColumn("stop", F.coalesce("stop", "length", F.lit(0)))
    return both.where("start < stop").select(*SEQ, "name", "value", "start", "stop", "op_ctr", "op_actor")


def at_position(found: DataFrame, position: int) -> DataFrame:
    """The ranges that hold a place; of those with one name the one made last."""
    here = found.where((F.col("start") <= position) & (F.col("stop") > position))
    best = F.max_by(F.struct("value", "start", "stop"), F.struct("op_ctr", "op_actor"))
    return here.groupBy(*SEQ, "name").agg(best.alias("m")).select(*SEQ, "name", "m.value", "m.start", "m.stop")


def mark_set(found: DataFrame) -> DataFrame:
    """(doc_id, obj_*, marks): each text's ranges by name, as a map of arrays of (start, stop) in order."""
    each = found.groupBy(*SEQ, "name").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("r"))
    return each.groupBy(*SEQ).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "r")))).alias("marks"))
