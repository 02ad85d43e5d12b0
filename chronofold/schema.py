"""The relational form of versioned documents: op rows, change rows, clocks.

An op row's id is (op_ctr, op_actor); obj_* null means the root map; map_key null means a sequence op, whose elem_* null is the
sequence's head.  ``pred`` holds the ids the op overwrites; who overwrites an op follows from that and is never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAKE_MAP, SET, MAKE_LIST, DELETE, MAKE_TEXT, INCREMENT, MAKE_TABLE, MARK = range(8)
#: Actions by code, object types by make action, scalar types by tag.
ACTION_NAMES = ("makeMap", "set", "makeList", "delete", "makeText", "increment", "makeTable", "mark")
OBJECT_TYPES = {MAKE_MAP: "map", MAKE_LIST: "list", MAKE_TEXT: "text", MAKE_TABLE: "table"}
SCALAR_NAMES = ("null", "false", "true", "uint", "int", "float64", "string", "bytes", "counter", "timestamp")
NULL, FALSE, TRUE, UINT, INT, FLOAT, STRING, BYTES, COUNTER, TIMESTAMP = range(10)

VALUE = "struct<tag:tinyint,l:bigint,u:decimal(20,0),d:double,s:string,b:binary>"
ID = "struct<ctr:bigint,actor:binary>"
OPS = (
    "doc_id bigint, op_ctr bigint, op_actor binary, obj_ctr bigint, obj_actor binary, map_key string, elem_ctr bigint, elem_actor binary, "
    f"insert boolean, action tinyint, value {VALUE}, pred array<{ID}>, mark_name string, expand boolean, change_hash binary"
)
CHANGES = "doc_id bigint, hash binary, actor binary, seq bigint, start_op bigint, max_op bigint, time bigint, message string, deps array<binary>, raw binary"
OP_COLUMNS = [x.split()[0] for x in ("doc_id op_ctr op_actor obj_ctr obj_actor map_key elem_ctr elem_actor insert action value pred mark_name expand change_hash").split()]
OBJ, ELEM, OP = ("obj_ctr", "obj_actor"), ("elem_ctr", "elem_actor"), ("op_ctr", "op_actor")


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def scalar(tag: Column | int, *, l: Column | None = None, u: Column | None = None, d: Column | None = None, s: Column | None = None, b: Column | None = None) -> Column:  # noqa: E741
    """A value struct with one member set."""
    tag = F.lit(tag) if isinstance(tag, int) else tag
    none = F.lit(None)
    return F.struct(
        tag.cast("tinyint").alias("tag"), (none if l is None else l).cast("bigint").alias("l"), (none if u is None else u).cast("decimal(20,0)").alias("u"),
        (none if d is None else d).cast("double").alias("d"), (none if s is None else s).cast("string").alias("s"), (none if b is None else b).cast("binary").alias("b"),
    )


def conform(df: DataFrame) -> DataFrame:
    """``df`` with exactly the op columns; those it lacks are null (pred empty, insert and expand false)."""
    kinds = {f.name: f.dataType for f in schema(OPS)}
    default = {"pred": F.array().cast(f"array<{ID}>"), "insert": F.lit(False), "expand": F.lit(False)}
    return df.select(*[(F.col(c) if c in df.columns else default.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in OP_COLUMNS])


def ops(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Op rows from dicts; ids are (ctr, actor) tuples under id, obj, elem and pred, values Python scalars or (tag, value)."""

    def value(x):
        tag, x = x if isinstance(x, tuple) else (NULL if x is None else TRUE if x is True else FALSE if x is False else INT if isinstance(x, int) else FLOAT if isinstance(x, float) else STRING if isinstance(x, str) else BYTES, x)
        member = {UINT: "u", INT: "l", COUNTER: "l", TIMESTAMP: "l", FLOAT: "d", STRING: "s"}.get(tag, "b" if tag >= BYTES else None)
        from decimal import Decimal

        return {"tag": tag, **{k: None for k in "ludsb"}, **({member: Decimal(x) if member == "u" else x} if member else {})}

    none, out = (None, None), []
    for r in rows:
        obj, elem = r.get("obj") or none, r.get("elem") or none
        cells = (
            r.get("doc", 1), *r["id"], *obj, r.get("key"), *elem, r.get("insert", False), r.get("action", SET), value(r.get("value")),
            [{"ctr": c, "actor": a} for c, a in r.get("pred", [])], r.get("mark"), r.get("expand", False), r.get("change"),
        )
        out.append(dict(zip(OP_COLUMNS, cells, strict=True)))
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    return spark.createDataFrame(pa.Table.from_pylist(out, schema=to_arrow_schema(schema(OPS))), schema(OPS))


def same(a: DataFrame, b: DataFrame, columns) -> Column:
    """Null-safe equality of ``columns`` of two frames."""
    out = None
    for c in columns:
        x = a[c].eqNullSafe(b[c])
        out = x if out is None else out & x
    return out


def ex_id(ctr: str | Column = "op_ctr", actor: str | Column = "op_actor") -> Column:
    """An id as text, ``ctr@hexactor``; a null one is ``_root``."""
    ctr, actor = (F.col(x) if isinstance(x, str) else x for x in (ctr, actor))
    return F.when(ctr.isNull(), "_root").otherwise(F.concat(ctr.cast("string"), F.lit("@"), F.lower(F.hex(actor))))


def op_id(ctr: str = "op_ctr", actor: str = "op_actor") -> Column:
    """What orders ops: counter, then actor bytes."""
    return F.struct(F.col(ctr).alias("ctr"), F.col(actor).alias("actor"))
