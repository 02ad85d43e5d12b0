"""What changed between two clocks, as patch rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import INCREMENT, OBJ
from . import maps, sequence
from .sequence import ELEMENT, SEQ
from .visibility import flagged, is_make, value_equal, visible_at


def diff_maps(ops: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, obj_*, map_key, patch, value, op_ctr, op_actor): putMap for keys that are new or hold another value or object, deleteMap
    for those that are gone."""
    # both sides in one pass over the log
    both = maps.won(flagged(ops, old, new).where("map_key is not null"), ops.columns, 0, 1).withColumnsRenamed({"w_0": "a", "w_1": "b"}).where("a is not null or b is not null")
    same_id = F.col("a.op_ctr").eqNullSafe(F.col("b.op_ctr")) & F.col("a.op_actor").eqNullSafe(F.col("b.op_actor")) & (F.col("b.action") != INCREMENT)
    same_value = (F.col("a.action") == F.col("b.action")) & value_equal(F.col("a.value"), F.col("b.value")) & ~is_make(F.col("b.action"))
    patch = F.when(F.col("b").isNull(), "deleteMap").when(F.col("a").isNull() | ~(same_id | same_value), "putMap")
    return both.withColumn("patch", patch).where("patch is not null").select(*maps.KEY, "patch", F.col("b.value").alias("value"), F.col("b.op_ctr").alias("op_ctr"), F.col("b.op_actor").alias("op_actor"))


def diff_sequences(ops: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, obj_*, patch, idx, n, text): a row for each run of neighbouring elements.

    deleteSeq counts elements gone, at their index in the old sequence; insert counts new ones, at their index in the new one, with
    their strings joined; putSeq is an element that stayed and holds another value.
    """
    a, b = (sequence.elements(ops, c) for c in (old, new))
    gone = a.join(b.select(*ELEMENT), ELEMENT, "left_anti").withColumn("patch", F.lit("deleteSeq")).select(*SEQ, "patch", "idx", F.lit("").alias("s"))
    added = b.join(a.select(*ELEMENT), ELEMENT, "left_anti").withColumn("patch", F.lit("insert")).select(*SEQ, "patch", "idx", F.coalesce("value.s", F.lit("")).alias("s"))
    before = a.select(*ELEMENT, F.col("op_ctr").alias("o_ctr"), F.col("op_actor").alias("o_actor"))
    put = b.join(before, ELEMENT).where((F.col("op_ctr") != F.col("o_ctr")) | (F.col("op_actor") != F.col("o_actor")))
    put = put.select(*SEQ, F.lit("putSeq").alias("patch"), "idx", F.coalesce("value.s", F.lit("")).alias("s"))
    rows = gone.unionByName(added)
    island = F.col("idx") - F.row_number().over(W.partitionBy(*SEQ, "patch").orderBy("idx"))
    runs = rows.withColumn("island", island).groupBy(*SEQ, "patch", "island").agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "s"))), lambda x: x["s"]), "").alias("text"))
    return runs.drop("island").unionByName(put.select(*SEQ, "patch", "idx", F.lit(1).cast("long").alias("n"), F.col("s").alias("text")))


def diff_counts(ops: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, obj_*, deleted, inserted): elements gone and new, all told."""
    a, b = (sequence.elements(ops, c).select(*ELEMENT) for c in (old, new))
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2))).groupBy(*ELEMENT).agg(F.sum("side").alias("s"))
    return both.groupBy(*SEQ).agg(F.count(F.when(F.col("s") == 1, 1)).alias("deleted"), F.count(F.when(F.col("s") == 2, 1)).alias("inserted"))


def diff(ops: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """All patches of the objects that can be reached from the root at the new clock, outermost first: depth, path and the patch's columns."""
    up = maps.parents(ops)
    alive = maps.winners(visible_at(ops, new)).where(is_make(F.col("action"))).select("doc_id", F.col("op_ctr").alias("obj_ctr"), F.col("op_actor").alias("obj_actor"))
    chain = up.select("doc_id", "obj_ctr", "obj_actor", "depth", F.col("map_key").alias("k"))
    paths = chain.groupBy("doc_id", *OBJ).agg(F.max("depth").alias("depth"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", F.coalesce("k", F.lit("[]")).alias("k"))), asc=False), lambda x: x["k"]), "/").alias("path"))
    paths = paths.join(alive, ["doc_id", *OBJ], "left_semi").withColumn("depth", F.col("depth") + 1)
    m = diff_maps(ops, old, new).select("doc_id", *OBJ, F.col("map_key").alias("at"), "patch", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("text"))
    s = diff_sequences(ops, old, new).select("doc_id", *OBJ, F.col("idx").cast("string").alias("at"), "patch", "n", "text")
    rows = m.unionByName(s)
    top = rows.where("obj_ctr is null").withColumn("depth", F.lit(0)).withColumn("path", F.lit(""))
    inner = rows.where("obj_ctr is not null").join(paths, ["doc_id", *OBJ])
    return top.select("doc_id", "depth", "path", "patch", "at", "n", "text").unionByName(inner.select("doc_id", "depth", "path", "patch", "at", "n", "text"))
