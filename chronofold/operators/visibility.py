"""Which ops count: overwrites, clocks, and the filters that single out ops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ACTION_NAMES, DELETE, MARK, OBJECT_TYPES, SCALAR_NAMES


def succ_edges(ops: DataFrame) -> DataFrame:
    """(doc_id, op_ctr, op_actor, succ_ctr, succ_actor): who overwrites an op, from the overwriters' pred."""
    e = ops.select("doc_id", F.col("op_ctr").alias("succ_ctr"), F.col("op_actor").alias("succ_actor"), F.explode("pred").alias("p"))
    return e.select("doc_id", F.col("p.ctr").alias("op_ctr"), F.col("p.actor").alias("op_actor"), "succ_ctr", "succ_actor")


ID = ["doc_id", "op_ctr", "op_actor"]


def flagged(ops: DataFrame, *clocks: DataFrame) -> DataFrame:
    """Ops with ``seen_0`` and ``live_0``, ``seen_1``...: whether each clock covers it, and whether it is visible then; without clocks, now.

    One pass: every op sends itself and the ids that it overwrites to where those ops are, so that the log is read once and shuffled once,
    however many clocks there are.  Ops that no clock covers are left out.
    """
    if clocks:
        each = None
        for k, clock in enumerate(clocks):
            part = clock.select("doc_id", F.col("actor").alias("op_actor"), F.lit(k).alias("k"), "max_ctr")
            each = part if each is None else each.unionByName(part)
        wide = each.groupBy("doc_id", "op_actor").agg(*[F.max(F.when(F.col("k") == k, F.col("max_ctr"))).alias(f"m_{k}") for k in range(len(clocks))])
        seen = [F.coalesce(F.col("op_ctr") <= F.col(f"m_{k}"), F.lit(False)) for k in range(len(clocks))]
        rows = ops.join(wide, ["doc_id", "op_actor"]).where(F.col("op_ctr") <= F.greatest(*[f"m_{k}" for k in range(len(clocks))]) if len(clocks) > 1 else seen[0])
    else:
        seen, rows = [F.lit(True)], ops
    rest = [c for c in ops.columns if c not in ID]
    kind = f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in ops.schema if f.name in rest)}>"
    no = F.lit(None).cast("boolean")
    own = F.struct(F.col("op_ctr").alias("ctr"), F.col("op_actor").alias("actor"), F.struct(*rest).alias("op"), *[x.alias(f"s_{k}") for k, x in enumerate(seen)], *[no.alias(f"d_{k}") for k in range(len(seen))])
    over = lambda p: F.struct(p["ctr"].alias("ctr"), p["actor"].alias("actor"), F.lit(None).cast(kind).alias("op"), *[no.alias(f"s_{k}") for k in range(len(seen))], *[x.alias(f"d_{k}") for k, x in enumerate(seen)])
    sent = rows.select("doc_id", F.inline(F.concat(F.array(own), F.transform("pred", over))))
    met = sent.groupBy("doc_id", "ctr", "actor").agg(F.first("op", ignorenulls=True).alias("op"), *[F.max(c).alias(c) for k in range(len(seen)) for c in (f"s_{k}", f"d_{k}")]).where("op is not null")
    live = [(F.col(f"s_{k}") & ~F.coalesce(F.col(f"d_{k}"), F.lit(False)) & (F.col("op.action") != DELETE)).alias(f"live_{k}") for k in range(len(seen))]
    named = {"op_ctr": F.col("ctr"), "op_actor": F.col("actor"), "doc_id": F.col("doc_id")}
    return met.select(*[named.get(c, F.col("op").getField(c)).alias(c) for c in ops.columns], *[F.col(f"s_{k}").alias(f"seen_{k}") for k in range(len(seen))], *live)


def visible(ops: DataFrame) -> DataFrame:
    """Ops that nothing overwrites and that are no deletions."""
    return ops.where(F.col("action") != DELETE).join(succ_edges(ops).select(*ID), ID, "left_anti")


def covered(ops: DataFrame, clock: DataFrame) -> DataFrame:
    """Ops that a clock (doc_id, actor, max_ctr) covers."""
    c = clock.select("doc_id", F.col("actor").alias("op_actor"), "max_ctr")
    return ops.join(c, ["doc_id", "op_actor"]).where("op_ctr <= max_ctr").select(*ops.columns)


def visible_at(ops: DataFrame, clock: DataFrame) -> DataFrame:
    """Ops visible at a clock: covered, no deletions, and overwritten by nothing that is covered."""
    return visible(covered(ops, clock))


def derive_succ(ops: DataFrame) -> DataFrame:
    """Ops with ``succ``, the sorted ids of those that overwrite them; edges to ops that are not there vanish."""
    s = succ_edges(ops).groupBy(*ID).agg(F.array_sort(F.collect_set(F.struct(F.col("succ_ctr").alias("ctr"), F.col("succ_actor").alias("actor")))).alias("succ"))
    return ops.join(s, ID, "left").withColumn("succ", F.coalesce("succ", F.array().cast("array<struct<ctr:bigint,actor:binary>>")))


def derive_pred(ops: DataFrame) -> DataFrame:
    """The inverse of ``derive_succ``: ops (with ``succ``) with ``pred`` rebuilt from the others' succ."""
    e = ops.select("doc_id", F.struct(F.col("op_ctr").alias("ctr"), F.col("op_actor").alias("actor")).alias("p"), F.explode("succ").alias("s"))
    p = e.groupBy("doc_id", F.col("s.ctr").alias("op_ctr"), F.col("s.actor").alias("op_actor")).agg(F.array_sort(F.collect_set("p")).alias("pred"))
    return ops.drop("pred").join(p, ID, "left").withColumn("pred", F.coalesce("pred", F.array().cast("array<struct<ctr:bigint,actor:binary>>")))


def in_order(ops: DataFrame) -> list[Column]:
    """The global order: documents, the root before other objects, map keys before elements, ids."""
    first = [F.asc_nulls_first(c) for c in ("doc_id", "obj_ctr", "obj_actor")]
    return [*first, F.col("map_key").isNull(), F.col("map_key"), *[F.asc_nulls_first(c) for c in ("elem_ctr", "elem_actor")], F.col("op_ctr"), F.col("op_actor")]


def ops_sorted(ops: DataFrame) -> DataFrame:
    return ops.orderBy(*in_order(ops))


def numbered(ops: DataFrame) -> DataFrame:
    """Ops with ``row``, their place (from 0) in their document's order."""
    from pyspark.sql import Window as W

    return ops.withColumn("row", (F.row_number().over(W.partitionBy("doc_id").orderBy(*in_order(ops)[1:])) - 1).cast("long"))


def op_range(ops: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows start to stop (exclusive) of each document's order."""
    return numbered(ops).where((F.col("row") >= start) & (F.col("row") < stop))


def visible_in_range(ops: DataFrame, start: int, stop: int) -> DataFrame:
    """The visible ops among rows start to stop of each document's order."""
    return visible(ops).join(op_range(ops, start, stop).select(*ID, "row"), ID)


def of_object(ops: DataFrame, ctr: int | None, actor: bytes | None) -> DataFrame:
    """Ops of one object; (None, None) is the root."""
    return ops.where("obj_ctr is null") if ctr is None else ops.where((F.col("obj_ctr") == ctr) & (F.col("obj_actor") == F.lit(bytearray(actor))))


def of_key(ops: DataFrame, key: str) -> DataFrame:
    return ops.where(F.col("map_key") == key)


def of_element(ops: DataFrame, ctr: int, actor: bytes) -> DataFrame:
    """The op that inserted an element, and those that update it."""
    actor = F.lit(bytearray(actor))
    own = F.col("insert") & (F.col("op_ctr") == ctr) & (F.col("op_actor") == actor)
    return ops.where(own | (~F.col("insert") & F.col("map_key").isNull() & (F.col("elem_ctr") == ctr) & (F.col("elem_actor") == actor)))


def named(column: Column, names, other: str) -> Column:
    out = None
    for code, name in names:
        out = F.when(column == code, name) if out is None else out.when(column == code, name)
    return out.otherwise(other)


def action_name(action: Column) -> Column:
    return named(action, enumerate(ACTION_NAMES), "unknown")


def is_make(action: Column) -> Column:
    return action.isin(*OBJECT_TYPES)


def object_type(action: Column) -> Column:
    """The type of object that a make op makes; null for others."""
    return F.when(is_make(action), named(action, OBJECT_TYPES.items(), ""))


def scalar_name(tag: Column) -> Column:
    return named(tag, enumerate(SCALAR_NAMES), "unknown")


def objects(ops: DataFrame) -> DataFrame:
    """(doc_id, obj_ctr, obj_actor, obj_type) of every object, each document's root among them."""
    made = ops.where(is_make(F.col("action"))).select("doc_id", F.col("op_ctr").alias("obj_ctr"), F.col("op_actor").alias("obj_actor"), object_type(F.col("action")).alias("obj_type"))
    root = ops.select("doc_id").distinct().select("doc_id", F.lit(None).cast("long").alias("obj_ctr"), F.lit(None).cast("binary").alias("obj_actor"), F.lit("map").alias("obj_type"))
    return root.unionByName(made)


def to_value(ops: DataFrame) -> DataFrame:
    """Ops with ``kind`` (object type or scalar type) and ``shown`` (the value as text; an object's is its id)."""
    from ..schema import ex_id

    make = is_make(F.col("action"))
    return ops.withColumn("kind", F.when(make, object_type(F.col("action"))).otherwise(scalar_name(F.col("value.tag")))).withColumn("shown", F.when(make, ex_id()).otherwise(value_string(F.col("value"))))


def value_string(v: Column) -> Column:
    """A scalar as text: bytes in hex, null as ``null``; unknown types as ``unknown(tag)``."""
    tag = v["tag"]
    return (
        F.when(tag == 0, "null").when(tag == 1, "false").when(tag == 2, "true").when(tag == 3, v["u"].cast("string")).when(tag.isin(4, 8, 9), v["l"].cast("string"))
        .when(tag == 5, v["d"].cast("string")).when(tag == 6, v["s"]).when(tag == 7, F.lower(F.hex(v["b"]))).otherwise(F.concat(F.lit("unknown("), tag.cast("string"), F.lit(")")))
    )


def value_equal(a: Column, b: Column) -> Column:
    """Type-strict equality of scalars."""
    out = a["tag"].eqNullSafe(b["tag"])
    for c in "ludsb":
        out = out & a[c].eqNullSafe(b[c])
    return out


def actors(ops: DataFrame) -> DataFrame:
    return ops.select("doc_id", F.col("op_actor").alias("actor")).distinct()


def actor_table(ops: DataFrame) -> DataFrame:
    """Actors with the index (from 0) that they have in their document's sorted table."""
    from pyspark.sql import Window as W

    return actors(ops).withColumn("idx", (F.row_number().over(W.partitionBy("doc_id").orderBy("actor")) - 1).cast("long"))


def max_op(ops: DataFrame) -> DataFrame:
    return ops.groupBy("doc_id").agg(F.max("op_ctr").alias("max_op"), F.count(F.lit(1)).alias("n_ops"))


def no_marks(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("action") != MARK)
