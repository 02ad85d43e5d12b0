"""Merging replicas: unions by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changes import heads
from .visibility import ID


def merge_ops(*replicas: DataFrame) -> DataFrame:
    """Each op once.  Replicas may hold different halves of an op's edges (one that never saw what was overwritten), so preds are united."""
    every = replicas[0]
    for r in replicas[1:]:
        every = every.unionByName(r)
    rest = [c for c in every.columns if c not in (*ID, "pred")]
    out = every.groupBy(*ID).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pred")))).alias("pred"), *[F.first(c, ignorenulls=True).alias(c) for c in rest])
    return out.select(*every.columns)


def new_ops(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    return theirs.join(ours.select(*ID), ID, "left_anti")


def merge_changes(*replicas: DataFrame) -> DataFrame:
    """Each change once, by document and hash."""
    every = replicas[0]
    for r in replicas[1:]:
        every = every.unionByName(r)
    return every.dropDuplicates(["doc_id", "hash"])


def merge_heads(*replicas: DataFrame) -> DataFrame:
    """The sinks of the united graph."""
    return heads(merge_changes(*replicas))


def fork(ops: DataFrame, to: DataFrame) -> DataFrame:
    """Ops copied to new documents; ``to`` has doc_id and new_doc_id."""
    return ops.join(to, "doc_id").withColumn("doc_id", F.col("new_doc_id")).select(*ops.columns)
