"""Edits as generators of op rows: from ops and commands to new ops.

Commands are rows; ``n`` orders those of one document, ``actor`` makes them.  Ids go on from the document's greatest counter.  Commands
that do not apply (deleting or incrementing what is not there, places beyond the end) make no op and use no id.  A batch of map
commands is applied in order.  Places of commands on a sequence are those it had before the batch, whatever the batch has done by then:
each inserts after the element that stood before its place, so of two at one place the later's text comes first, and an element that two
delete is deleted by the first.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..schema import BYTES, COUNTER, DELETE, FALSE, FLOAT, INCREMENT, INT, MAKE_LIST, MAKE_MAP, MAKE_TEXT, MARK, NULL, OBJ, OPS, SET, STRING, TIMESTAMP, TRUE, UINT, conform, scalar
from . import maps, sequence
from .sequence import ELEMENT, SEQ
from .visibility import no_marks, visible

PRED = "array<struct<ctr:bigint,actor:binary>>"


def _numbered(ops: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with op_ctr and op_actor of new ops."""
    top = ops.groupBy("doc_id").agg(F.max("op_ctr").alias("top"))
    at = F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
    return rows.join(top, "doc_id", "left").withColumn("op_ctr", (F.coalesce("top", F.lit(0)) + at).cast("long")).withColumn("op_actor", F.col("actor"))


def _preds(live: DataFrame, keys: list[str]) -> DataFrame:
    return live.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("op_ctr").alias("ctr"), F.col("op_actor").alias("actor")))).alias("held"))


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join that takes null keys (the root) as equal: by columns that stand for them."""
    for k in keys:
        kind = dict(a.dtypes)[k]
        fill = F.lit(-1).cast("long") if kind == "bigint" else F.lit(bytearray(b"")) if kind == "binary" else F.lit("")
        a, b = a.withColumn(f"_{k}", F.coalesce(k, fill)), b.withColumn(f"_{k}", F.coalesce(k, fill))
    out = a.join(b.drop(*keys), [f"_{k}" for k in keys], how)
    return out.drop(*[f"_{k}" for k in keys])


def edit_keys(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """New ops for commands (doc_id, obj_*, map_key, n, actor, action, value): set, make, delete and increment, as ``action`` says.

    Each overwrites all live ops of its key, or the op of the command before it on that key.
    """
    live = maps.all_values(visible(ops)).where(F.col("map_key").isNotNull())
    c = _null_safe(commands, _preds(live, maps.KEY), maps.KEY, "left")
    w = W.partitionBy(*maps.KEY).orderBy("n")
    # a deletion leaves nothing behind for the next one
    there = F.coalesce(F.lag(F.col("action") != DELETE).over(w), F.col("held").isNotNull())
    c = c.withColumn("there", there).where(F.col("there") | ~F.col("action").isin(DELETE, INCREMENT))
    c = _numbered(ops, c, "n")
    last = F.struct(F.lag("op_ctr").over(w).alias("ctr"), F.lag("op_actor").over(w).alias("actor"))
    pred = F.when(F.lag("action").over(w).isNull(), F.coalesce("held", F.array().cast(PRED))).when(F.lag("action").over(w) == DELETE, F.array().cast(PRED)).otherwise(F.array(last))
    return conform(c.withColumn("pred", pred))


def put(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """Sets keys to scalars: commands with ``value``."""
    return edit_keys(ops, commands.withColumn("action", F.lit(SET)))


def put_object(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """Sets keys to new objects: commands with ``action`` (a make action)."""
    return edit_keys(ops, commands.withColumn("value", scalar(0)))


def delete_keys(ops: DataFrame, commands: DataFrame) -> DataFrame:
    return edit_keys(ops, commands.withColumn("action", F.lit(DELETE)).withColumn("value", scalar(0)))


def increment(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """Adds ``by`` to keys."""
    return edit_keys(ops, commands.withColumn("action", F.lit(INCREMENT)).withColumn("value", scalar(INT, l=F.col("by"))))


def _placed(ops: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commands that apply, numbered (cmd), with the element that they insert after (r_ctr, r_actor); the elements that they delete, each
    once, with the ops that hold them (held); and the visible elements."""
    found = sequence.elements(ops)
    size = sequence.lengths(found)
    n = F.col("n") if "n" in commands.columns else F.lit(0)
    # a number of its own for each command, also where n is not given
    order = W.partitionBy("doc_id").orderBy(n, *OBJ, "pos", "del", "actor")
    c = commands.join(size, SEQ, "left").where(F.col("pos") + F.col("del") <= F.coalesce("length", F.lit(0))).drop("length").withColumn("cmd", F.row_number().over(order))
    own = [*ELEMENT, "idx"]
    # every live op of a deleted element is overwritten, but not the ranges that are anchored to it
    live = _preds(sequence.element_of(no_marks(visible(ops))), ELEMENT)
    gone = c.select(*SEQ, "actor", "cmd", "pos", "del").join(found.select(*own), SEQ).where((F.col("idx") >= F.col("pos")) & (F.col("idx") < F.col("pos") + F.col("del")))
    gone = gone.groupBy(*ELEMENT, "idx").agg(F.min(F.struct("cmd", "actor")).alias("c")).select(*ELEMENT, "idx", "c.*").join(live, ELEMENT)
    ref = found.select(*SEQ, F.col("elem_ctr").alias("r_ctr"), F.col("elem_actor").alias("r_actor"), (F.col("idx") + 1).alias("pos"))
    return c.join(ref, [*SEQ, "pos"], "left"), gone, found


def splice(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """New ops for commands (doc_id, obj_*, n, actor, pos, del, values): deletes ``del`` elements from ``pos`` on, then inserts values there.

    With a column ``action``, its make action is what is inserted instead of scalars.  Commands whose places reach beyond the end are left
    out; ``n`` may be missing where a sequence has one command.
    """
    c, gone, _ = _placed(ops, commands)
    gone = gone.select(*SEQ, "actor", "cmd", F.lit(0).alias("side"), "idx", "elem_ctr", "elem_actor", F.lit(False).alias("insert"), F.lit(DELETE).alias("action"), scalar(0).alias("value"), F.col("held").alias("pred"))
    action = (F.col("action") if "action" in commands.columns else F.lit(SET)).cast("int").alias("action")
    new = c.select(*SEQ, "actor", "cmd", "r_ctr", "r_actor", action, F.posexplode("values").alias("k", "value"))
    new = new.select(*SEQ, "actor", "cmd", F.lit(1).alias("side"), F.col("k").cast("long").alias("idx"), F.col("r_ctr").alias("elem_ctr"), F.col("r_actor").alias("elem_actor"), F.lit(True).alias("insert"), "action", "value", F.array().cast(PRED).alias("pred"))
    out = _numbered(ops, gone.unionByName(new), "cmd", "side", "idx")
    # the values of one command are chained
    chained = F.col("insert") & (F.col("idx") > 0)
    out = out.withColumn("elem_ctr", F.when(chained, F.col("op_ctr") - 1).otherwise(F.col("elem_ctr"))).withColumn("elem_actor", F.when(chained, F.col("op_actor")).otherwise(F.col("elem_actor")))
    return conform(out)


def insert_object(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """Inserts new, empty objects (``action``, a make action) at ``idx``, up to the length."""
    n = [c for c in ("n",) if c in commands.columns]
    return splice(ops, commands.select(*SEQ, *n, "actor", F.col("idx").alias("pos"), F.lit(0).alias("del"), "action", F.array(scalar(0)).alias("values")))


def insert(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """Inserts ``value`` at ``idx``, up to the length."""
    n = [c for c in ("n",) if c in commands.columns]
    return splice(ops, commands.select(*SEQ, *n, "actor", F.col("idx").alias("pos"), F.lit(0).alias("del"), F.array("value").alias("values")))


def text_values(text: Column) -> Column:
    """The code points of a text as values."""
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: scalar(STRING, s=x))


def splice_text(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """As ``splice``, with the code points of ``text`` as values; places count code points."""
    return splice(ops, commands.withColumn("values", text_values(F.col("text"))))


def set_elements(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """Overwrites the element at ``idx`` with ``value``."""
    found = sequence.elements(ops).select(*ELEMENT, "idx")
    c = commands.join(found, [*SEQ, "idx"]).join(_preds(sequence.element_of(no_marks(visible(ops))), ELEMENT), ELEMENT)
    c = _numbered(ops, c, "obj_ctr", "obj_actor", "idx")
    return conform(c.withColumn("action", F.lit(SET)).withColumn("pred", F.col("held")))


def mark(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """Two ops for each command (doc_id, obj_*, actor, n, start, stop, name, value, expand) on a range of a text's elements."""
    found = sequence.elements(ops).select(*ELEMENT, "idx")
    c = commands.join(sequence.lengths(found), SEQ).where("start >= 0 and start < stop and stop <= length").drop("length")
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), (F.col(e) - 1).cast("long").alias("idx")) for k, e in enumerate(("start", "stop"))]))
    c = c.select("*", sides.alias("x")).select("*", "x.side", "x.idx").drop("x").join(found, [*SEQ, "idx"], "left")
    c = _numbered(ops, c, "n", "side")
    first = F.col("side") == 0
    return conform(c.withColumn("action", F.lit(MARK)).withColumn("mark_name", F.when(first, F.col("name"))).withColumn("value", F.when(first, F.col("value")).otherwise(scalar(0))))


#: What a tagged node says of itself, and its value's tag and member; "text" and "map" are nodes of their own.
TAGS = {"counter": (COUNTER, "l"), "timestamp": (TIMESTAMP, "l"), "uint": (UINT, "u"), "int": (INT, "l"), "float": (FLOAT, "d"), "bytes": (BYTES, "b"), "string": (STRING, "s")}


def node(x) -> tuple[int, dict, list | dict | None]:
    """Action, value and members of a node in JSON.

    An object with the keys ``$`` and ``value`` alone is a tagged node: ``text``, one of TAGS (bytes in hex), or ``map``, whose value is taken as
    a map whatever its keys are.
    """
    if isinstance(x, dict) and x.keys() == {"$", "value"}:
        kind, x = x["$"], x["value"]
        if kind == "text":
            return MAKE_TEXT, _value(0), list(x)
        if kind in TAGS:
            tag, member = TAGS[kind]
            return SET, _value(tag, member, bytes.fromhex(x) if kind == "bytes" else Decimal(x) if member == "u" else float(x) if member == "d" else x), None
        if kind != "map" or not isinstance(x, dict):
            raise ValueError(f"unknown node {kind!r}")
    if isinstance(x, dict):
        return MAKE_MAP, _value(0), x
    if isinstance(x, list):
        return MAKE_LIST, _value(0), x
    tag, member = (NULL, None) if x is None else (TRUE if x else FALSE, None) if isinstance(x, bool) else (INT, "l") if isinstance(x, int) else (FLOAT, "d") if isinstance(x, float) else (STRING, "s")
    return SET, _value(tag, member, x), None


def _value(tag: int, member: str | None = None, x=None) -> dict:
    return {"tag": tag} | dict.fromkeys("ludsb") | ({member: x} if member else {})


def tree_rows(doc: int, obj: tuple, key: str | None, tree, top: int, actor: bytes, elem: tuple = (None, None), insert: bool = False, pred=()) -> list[tuple]:
    """Op rows that make a nested value at a key or place, breadth first, keys in byte order, members of lists and texts chained."""
    out, todo, ctr = [], deque([(obj, key, elem, insert, list(pred), tree)]), top
    while todo:
        obj, key, elem, insert, pred, x = todo.popleft()
        ctr += 1
        action, value, members = node(x)
        out.append((doc, ctr, actor, *obj, key, *elem, insert, action, value, [{"ctr": c, "actor": a} for c, a in pred], None, False, None))
        me = (ctr, actor)
        if action == MAKE_MAP:
            todo += [(me, k, (None, None), False, [], members[k]) for k in sorted(members, key=str.encode)]
        elif members is not None:
            # ids of members are known ahead: they follow all that is waiting
            last, n = (None, None), ctr + len(todo)
            for member in members:
                n += 1
                todo.append((me, None, last, True, [], member))
                last = (n, actor)
    return out


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.int8(),
             pa.struct([("tag", pa.int8()), ("l", pa.int64()), ("u", pa.decimal128(20, 0)), ("d", pa.float64()), ("s", pa.string()), ("b", pa.binary())]),
             pa.list_(pa.struct([("ctr", pa.int64()), ("actor", pa.binary())])), pa.string(), pa.bool_(), pa.binary()]
    from ..schema import OP_COLUMNS

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], OP_COLUMNS)


def create_trees(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """New ops for commands (doc_id, obj_*, map_key, actor, n, tree): nested values in JSON (see ``node``) set at keys.

    A command's ids go on from those of the commands before it, and it overwrites what one of them has set at its key, else what was live
    there; a command whose tree is no JSON fails the task.
    """
    ship(ops.sparkSession)
    live = maps.all_values(visible(ops))
    c = _null_safe(commands, _preds(live, maps.KEY), maps.KEY, "left")
    c = c.join(ops.groupBy("doc_id").agg(F.max("op_ctr").alias("top")), "doc_id", "left").select("doc_id", *OBJ, "map_key", "actor", "n", "tree", "held", F.coalesce("top", F.lit(0)).alias("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, top, last = object(), 0, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["doc_id"] != doc:
                    doc, top, last = r["doc_id"], r["top"], {}
                obj, place = (r["obj_ctr"], r["obj_actor"]), (r["obj_ctr"], r["obj_actor"], r["map_key"])
                held = [last[place]] if place in last else [(p["ctr"], p["actor"]) for p in r["held"] or []]
                rows = tree_rows(doc, obj, r["map_key"], json.loads(r["tree"]), top, r["actor"], pred=held)
                last[place] = (top + 1, r["actor"])
                top = rows[-1][1]
                out += rows
            yield _rows_batch(out)

    return c.repartition("doc_id").sortWithinPartitions("doc_id", "n").mapInArrow(run, OPS)


def splice_trees(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """As ``splice``, with nested values: ``trees`` is a JSON array of nodes.  A value's ops all come before those of the next."""
    ship(ops.sparkSession)
    c, gone, _ = _placed(ops, commands)
    dead = gone.groupBy("doc_id", "cmd").agg(F.array_sort(F.collect_list(F.struct("idx", "elem_ctr", "elem_actor", "held"))).alias("dead"))
    c = c.join(dead, ["doc_id", "cmd"], "left").join(ops.groupBy("doc_id").agg(F.max("op_ctr").alias("top")), "doc_id")
    c = c.select("doc_id", *OBJ, "actor", "cmd", "r_ctr", "r_actor", "trees", "dead", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, top = object(), 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["doc_id"] != doc:
                    doc, top = r["doc_id"], r["top"]
                obj, actor = (r["obj_ctr"], r["obj_actor"]), r["actor"]
                for x in r["dead"] or []:
                    top += 1
                    out.append((doc, top, actor, *obj, None, x["elem_ctr"], x["elem_actor"], False, DELETE, _value(0), x["held"], None, False, None))
                last = (r["r_ctr"], r["r_actor"])
                for tree in json.loads(r["trees"]):
                    rows = tree_rows(doc, obj, None, tree, top, actor, elem=last, insert=True)
                    last, top = (top + 1, actor), rows[-1][1]
                    out += rows
            yield _rows_batch(out)

    return c.repartition("doc_id").sortWithinPartitions("doc_id", "cmd").mapInArrow(run, OPS)


def text_tree(ops: DataFrame, commands: DataFrame) -> DataFrame:
    """Puts new, empty text objects at keys; ``splice_text`` fills them."""
    return put_object(ops, commands.withColumn("action", F.lit(MAKE_TEXT)))


def commit(new: DataFrame, meta: DataFrame) -> DataFrame:
    """Change rows for new ops: one for each document and actor.

    ``meta`` has doc_id, actor, seq, time, message and deps; the hash is that of the change's wire form.
    """
    ship(new.sparkSession)

    def seal(key, table):
        from ..codec.chunks import encode_change

        rows = table.to_pylist()
        m = rows[0]
        body = encode_change(rows, m["op_actor"], m["seq"], m["time"], m["message"], m["deps"] or [])
        start, stop = min(r["op_ctr"] for r in rows), max(r["op_ctr"] for r in rows)
        cells = (m["doc_id"], body[1], m["op_actor"], m["seq"], start, stop, m["time"], m["message"], m["deps"] or [], body[0])
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary()), pa.binary())
        from ..schema import CHANGES

        return pa.table([pa.array([x], t) for x, t in zip(cells, kinds, strict=True)], names=[c.split()[0] for c in CHANGES.split(", ")])

    from ..schema import CHANGES

    rows = new.join(meta.withColumnRenamed("actor", "op_actor"), ["doc_id", "op_actor"])
    return rows.groupBy("doc_id", "op_actor").applyInArrow(seal, CHANGES)
