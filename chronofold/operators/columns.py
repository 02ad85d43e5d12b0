"""Positional columns: a table of (part columns, pos, v), pos counting from 0 within each part, read and rewritten by place.

Every operator works within parts, which are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = ["doc_id"]


def _up_to(part: list[str]):
    return W.partitionBy(*part).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)


def number(df: DataFrame, value: Column, order: str, part: list[str] = PART) -> DataFrame:
    """The positional column of ``value`` over ``df`` in ``order``."""
    return df.select(*part, (F.row_number().over(W.partitionBy(*part).orderBy(order)) - 1).cast("long").alias("pos"), value.alias("v"))


def fill(spark, part_value: int, n: int) -> DataFrame:
    """``n`` nulls."""
    return spark.range(n).select(F.lit(part_value).cast("long").alias("doc_id"), F.col("id").alias("pos"), F.lit(None).cast("long").alias("v"))


def get(df: DataFrame, pos: int) -> DataFrame:
    return df.where(F.col("pos") == pos)


def rows_between(df: DataFrame, start: int, stop: int) -> DataFrame:
    return df.where((F.col("pos") >= start) & (F.col("pos") < stop))


def weight(df: DataFrame) -> Column:
    """What a value adds to the accumulator: itself, 1 for true, 0 for null and text."""
    kind = dict(df.dtypes)["v"]
    return F.coalesce(F.col("v").cast("long"), F.lit(0)) if kind != "string" else F.lit(0).cast("long")


def accumulate(df: DataFrame, part: list[str] = PART) -> DataFrame:
    """``acc_before`` and ``acc_after``: the sum of values before and up to each place."""
    out = df.withColumn("acc_after", F.sum(weight(df)).over(_up_to(part)))
    return out.withColumn("acc_before", F.col("acc_after") - weight(df))


def total(df: DataFrame, part: list[str] = PART) -> DataFrame:
    return df.groupBy(*part).agg(F.sum(weight(df)).alias("acc"), F.count(F.lit(1)).alias("n"))


def seek(df: DataFrame, amount: int, part: list[str] = PART) -> DataFrame:
    """The first place at which the accumulator has grown to ``amount``."""
    return accumulate(df, part).where(F.col("acc_after") >= amount).groupBy(*part).agg(F.min("pos").alias("pos"))


def splice(df: DataFrame, pos: int, delete: int, values: DataFrame, part: list[str] = PART) -> DataFrame:
    """``df`` with ``delete`` places from ``pos`` on replaced by ``values`` (part columns, k, v; k orders them); the rest moves up or down."""
    kept = df.where((F.col("pos") < pos) | (F.col("pos") >= pos + delete)).select(*part, F.when(F.col("pos") < pos, 0).otherwise(2).alias("side"), F.col("pos").alias("k"), "v")
    put = values.select(*part, F.lit(1).alias("side"), F.col("k").cast("long").alias("k"), "v")
    both = kept.unionByName(put)
    return both.select(*part, (F.row_number().over(W.partitionBy(*part).orderBy("side", "k")) - 1).cast("long").alias("pos"), "v")


def equal(a: DataFrame, b: DataFrame, part: list[str] = PART) -> DataFrame:
    """Whether two columns are the same, for each part that either has."""
    both = a.select(*part, "pos", "v", F.lit(1).alias("s")).unionByName(b.select(*part, "pos", "v", F.lit(-1).alias("s")))
    return both.groupBy(*part, "pos", "v").agg(F.sum("s").alias("s")).groupBy(*part).agg((F.max(F.abs("s")) == 0).alias("equal"))


def scope(df: DataFrame, value: Column, part: list[str] = PART) -> DataFrame:
    """The places, start to stop (exclusive), that a value has in a sorted column."""
    return df.where(F.col("v") == value).groupBy(*part).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))


def find(df: DataFrame, low: Column, high: Column | None = None) -> DataFrame:
    """Places that hold a value, or one from low to high (exclusive)."""
    return df.where(F.col("v") == low if high is None else (F.col("v") >= low) & (F.col("v") < high))


def remap(df: DataFrame, f) -> DataFrame:
    return df.withColumn("v", f(F.col("v")))


def runs(df: DataFrame, part: list[str] = PART) -> DataFrame:
    """(part, start, n, v): runs of one value (nulls are alike)."""
    w = W.partitionBy(*part).orderBy("pos")
    new = F.when(F.col("pos") == F.min("pos").over(W.partitionBy(*part)), 1).otherwise((~F.col("v").eqNullSafe(F.lag("v").over(w))).cast("int"))
    at = df.withColumn("new", new).withColumn("island", F.sum("new").over(_up_to(part)))
    return at.groupBy(*part, "island").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).drop("island")


def next_runs(df: DataFrame, pos: int, part: list[str] = PART) -> DataFrame:
    """For each part the rest, from ``pos`` on, of the run that holds it."""
    return runs(df, part).where((F.col("start") <= pos) & (F.col("start") + F.col("n") > pos)).select(*part, (F.col("start") + F.col("n") - pos).alias("n"), "v")


def encoded_runs(df: DataFrame, part: list[str] = PART) -> DataFrame:
    """The segments of a run-length encoding: ``run`` (two or more alike), ``null`` or ``literal`` (single values in a row).

    A column of nulls alone has no segments.
    """
    each = runs(df, part).withColumn("kind", F.when(F.col("v").isNull(), "null").when(F.col("n") > 1, "run").otherwise("literal"))
    w = W.partitionBy(*part).orderBy("start")
    new = ((F.col("kind") != "literal") | ~F.lag("kind").over(w).eqNullSafe(F.lit("literal"))).cast("int")
    each = each.withColumn("new", new).withColumn("seg", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = each.groupBy(*part, "seg", "kind").agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    some = F.max((F.col("kind") != "null").cast("int")).over(W.partitionBy(*part))
    return out.withColumn("some", some).where("some = 1").select(*part, "start", "kind", "n")


def expand(found: DataFrame, part: list[str] = PART) -> DataFrame:
    """The positional column of ``runs``."""
    return found.select(*part, "start", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select(*part, (F.col("start") + F.col("k")).alias("pos"), "v")


def deltas(df: DataFrame, part: list[str] = PART) -> DataFrame:
    """Each value less the one before it (the first less 0); a null stays null and does not move the base."""
    before = F.last("v", ignorenulls=True).over(W.partitionBy(*part).orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("v", F.col("v") - F.coalesce(before, F.lit(0).cast("long")))


def undelta(df: DataFrame, part: list[str] = PART) -> DataFrame:
    return df.withColumn("v", F.when(F.col("v").isNotNull(), F.sum("v").over(_up_to(part))))


def bool_runs(df: DataFrame, part: list[str] = PART) -> DataFrame:
    """(part, k, n): lengths of runs of alternating truth, beginning with false (0 long if the column begins with true); null is false."""
    r = runs(df.withColumn("v", F.coalesce("v", F.lit(False))), part)
    lead = r.where((F.col("start") == 0) & F.col("v")).select(*part, F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("n"))
    both = r.select(*part, "start", "n").unionByName(lead)
    return both.select(*part, (F.row_number().over(W.partitionBy(*part).orderBy("start")) - 1).cast("long").alias("k"), "n")


def zone_map(df: DataFrame, block: int = 64, part: list[str] = PART) -> DataFrame:
    """Count, least, greatest and sum of every block of places."""
    return df.groupBy(*part, F.floor(F.col("pos") / block).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("v").alias("sum"))


def unsigned_size(v: Column) -> Column:
    """Bytes of a number's variable-length form: one for every seven bits."""
    bits = F.length(F.regexp_replace(F.bin(v), "^0+(?=.)", ""))
    return F.ceil(bits / F.lit(7)).cast("long")


def signed_size(v: Column) -> Column:
    """Likewise with a sign bit."""
    magnitude = F.when(v < 0, F.bitwise_not(v)).otherwise(v)
    bits = F.when(magnitude == 0, 0).otherwise(F.length(F.bin(magnitude)))
    return F.ceil((bits + 1) / F.lit(7)).cast("long")


def value_meta(meta: Column) -> tuple[Column, Column]:
    """Type tag and payload length of a value's meta word."""
    return meta.bitwiseAND(F.lit(15)), F.shiftright(meta, 4)


def column_spec(id: Column, kind: Column, deflate: Column) -> Column:
    """A column's number from its id, type and whether it is deflated."""
    return F.shiftleft(id, 4).bitwiseOR(F.when(deflate, 8).otherwise(0)).bitwiseOR(kind)
