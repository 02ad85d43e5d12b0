"""One document at a time: thin helpers over the set-oriented operators, for use by hand and in tests.

Objects are named by ids in text form, ``ctr@hexactor`` or ``_root``.  Reads return Python values, ``None`` or nothing where there is
nothing; edits return a new ``Document`` whose ops are written out, so that edits can follow each other.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .operators import changes as ch
from .operators import diff as df_
from .operators import history, maps, marks, merge, mutations, sequence, visibility
from .sources import container

ROOT = "_root"


def _id(name: str) -> tuple[int | None, bytes | None]:
    if name == ROOT:
        return None, None
    ctr, actor = name.split("@")
    return int(ctr), bytes.fromhex(actor)


def _scalar(x):
    """A value column of a Python scalar; (tag, value) for counters, timestamps and unsigned numbers."""
    tag, x = x if isinstance(x, tuple) else (0 if x is None else 2 if x is True else 1 if x is False else 4 if isinstance(x, int) else 5 if isinstance(x, float) else 6 if isinstance(x, str) else 7, x)
    member = {3: "u", 4: "l", 8: "l", 9: "l", 5: "d", 6: "s"}.get(tag, "b" if tag >= 7 else None)
    return S.scalar(tag, **({member: F.lit(bytearray(x) if isinstance(x, bytes) else x)} if member else {}))


def _python(r):
    """What an op row holds: an object's id or a scalar."""
    if r.action in S.OBJECT_TYPES:
        return f"{r.op_ctr}@{bytes(r.op_actor).hex()}"
    v = r.value
    return {0: None, 1: False, 2: True}[v.tag] if v.tag < 3 else next(x for x in (v.l, v.u, v.d, v.s, v.b) if x is not None)


def random_actor() -> bytes:
    """An actor that nobody else has: 16 random bytes."""
    return os.urandom(16)


@dataclass(frozen=True)
class Document:
    """A document's ops and sealed changes; ``pending`` holds ops that no change has yet."""

    spark: SparkSession
    actor: bytes
    ops: DataFrame
    changes: DataFrame
    pending: DataFrame
    doc_id: int = 1

    @staticmethod
    def new(spark: SparkSession, actor: bytes, doc_id: int = 1) -> Document:
        none = S.ops(spark, [])
        return Document(spark, actor, none, spark.createDataFrame([], S.schema(S.CHANGES)), none, doc_id)

    @staticmethod
    def load(spark: SparkSession, data: bytes, actor: bytes, doc_id: int = 1) -> Document:
        """From a container; new edits are by ``actor``, never by one of its authors unless that is given."""
        ops, changes = container.read(spark.createDataFrame([(doc_id, data)], "doc_id long, content binary"))
        return Document.new(spark, actor, doc_id)._with(ops=ops, changes=changes)

    def _with(self, **frames: DataFrame) -> Document:
        return replace(self, **{k: self.spark.createDataFrame(v.toArrow(), v.schema) for k, v in frames.items()})

    # reads

    def _seen(self, heads: list[bytes] | None) -> tuple[DataFrame, DataFrame | None]:
        return self.ops, None if heads is None else self.clock_at(heads)

    def _live(self, obj: str, heads: list[bytes] | None) -> DataFrame:
        ops, clock = self._seen(heads)
        return visibility.of_object(visibility.visible(ops) if clock is None else visibility.visible_at(ops, clock), *_id(obj))

    def clock_at(self, heads: list[bytes]) -> DataFrame:
        at = self.spark.createDataFrame([(self.doc_id, h) for h in heads], "doc_id long, hash binary")
        return history.clock_at(history.clocks(self.changes), at)

    def heads(self) -> list[bytes]:
        return sorted(bytes(r.hash) for r in ch.heads(self.changes).collect())

    def _elements(self, obj: str, heads: list[bytes] | None = None) -> DataFrame:
        return visibility.of_object(sequence.elements(*self._seen(heads)), *_id(obj))

    def get_all(self, obj: str, key: str | int, heads: list[bytes] | None = None) -> list:
        """All live values, the winner last."""
        if isinstance(key, int):
            at = self._elements(obj, heads).where(F.col("idx") == key).select("doc_id", "elem_ctr", "elem_actor")
            rows = sequence.element_of(visibility.no_marks(self._live(obj, heads))).join(at, ["doc_id", "elem_ctr", "elem_actor"])
        else:
            rows = visibility.of_key(self._live(obj, heads), key)
        return [_python(r) for r in rows.orderBy("op_ctr", "op_actor").collect()]

    def get(self, obj: str, key: str | int, heads: list[bytes] | None = None):
        """The winner: an object's id, a scalar, or a counter's total."""
        if isinstance(key, int):
            r = self._elements(obj, heads).where(F.col("idx") == key).first()
            return None if r is None else _python(r)
        ops, clock = self._seen(heads)
        r = maps.values(visibility.of_key(visibility.of_object(ops, *_id(obj)), key), clock).first()
        return None if r is None else _python(r)

    def keys(self, obj: str = ROOT, heads: list[bytes] | None = None) -> list[str]:
        return sorted((r.map_key for r in maps.keys(self._live(obj, heads)).collect()), key=str.encode)

    def length(self, obj: str = ROOT, heads: list[bytes] | None = None) -> int:
        kind = [r.obj_type for r in visibility.of_object(visibility.objects(self.ops), *_id(obj)).collect()]
        return self._elements(obj, heads).count() if kind and kind[0] in ("list", "text") else len(self.keys(obj, heads))

    def text(self, obj: str, heads: list[bytes] | None = None) -> str:
        r = sequence.text(self._elements(obj, heads)).first()
        return r.text if r else ""

    def map_range(self, obj: str = ROOT, heads: list[bytes] | None = None) -> list[tuple]:
        ops, clock = self._seen(heads)
        return sorted(((r.map_key, _python(r)) for r in maps.values(visibility.of_object(ops, *_id(obj)), clock).collect()), key=lambda x: x[0].encode())

    def list_items(self, obj: str, heads: list[bytes] | None = None) -> list:
        return [_python(r) for r in self._elements(obj, heads).orderBy("idx").collect()]

    def parents(self, obj: str) -> list[tuple]:
        """(object, key or index) of each step up to the root."""
        up = visibility.of_object(maps.parents(self.ops, sequence.elements(self.ops)), *_id(obj)).select("depth", S.ex_id("at_ctr", "at_actor").alias("at"), "map_key", "idx")
        return [(r["at"], r.idx if r.map_key is None else r.map_key) for r in up.orderBy("depth").collect()]

    def marks(self, obj: str, heads: list[bytes] | None = None) -> list[tuple]:
        rows = visibility.of_object(marks.ranges(*self._seen(heads)), *_id(obj))
        return sorted((r.start, r.stop, r.name) for r in rows.collect())

    def cursor(self, obj: str, index: int) -> str | None:
        r = sequence.cursors(self._elements(obj).where(F.col("idx") == index)).first()
        return r.cursor if r else None

    def cursor_position(self, obj: str, cursor: str, heads: list[bytes] | None = None) -> int | None:
        wanted = self.spark.createDataFrame([(self.doc_id, *_id(obj), cursor)], "doc_id long, obj_ctr long, obj_actor binary, cursor string")
        ops, clock = self._seen(heads)
        return sequence.cursor_positions(ops, wanted, clock).first().position

    def diff(self, old: list[bytes], new: list[bytes]) -> list[tuple]:
        rows = df_.diff(self.ops, self.clock_at(old), self.clock_at(new)).collect()
        return sorted(((r.path, r.patch, r["at"], r.n, r.text) for r in rows), key=str)

    # edits

    def _command(self, obj: str, **columns) -> DataFrame:
        ctr, actor = _id(obj)
        cells = {"doc_id": F.lit(self.doc_id).cast("long"), "obj_ctr": F.lit(ctr).cast("long"), "obj_actor": F.lit(None if actor is None else bytearray(actor)).cast("binary"), "actor": F.lit(bytearray(self.actor)), "n": F.lit(0)}
        return self.spark.range(1, numPartitions=1).select(*[v.alias(k) for k, v in (cells | columns).items()])

    def _grown(self, new: DataFrame) -> Document:
        new = self.spark.createDataFrame(new.toArrow(), new.schema)
        return self._with(ops=self.ops.unionByName(new), pending=self.pending.unionByName(new))

    def put(self, obj: str, key: str | int, value) -> Document:
        if isinstance(key, int):
            return self._grown(mutations.set_elements(self.ops, self._command(obj, idx=F.lit(key).cast("long"), value=_scalar(value))))
        return self._grown(mutations.put(self.ops, self._command(obj, map_key=F.lit(key), value=_scalar(value))))

    def put_object(self, obj: str, key: str, kind: str) -> tuple[Document, str]:
        """A new, empty object at a key, and its id."""
        action = next(a for a, name in S.OBJECT_TYPES.items() if name == kind)
        new = mutations.put_object(self.ops, self._command(obj, map_key=F.lit(key), action=F.lit(action)))
        out = self._grown(new)
        top = out.ops.agg(F.max("op_ctr")).first()[0]
        return out, f"{top}@{self.actor.hex()}"

    def insert_object(self, obj: str, index: int, kind: str) -> tuple[Document, str]:
        """A new, empty object in a sequence, and its id."""
        action = next(a for a, name in S.OBJECT_TYPES.items() if name == kind)
        out = self._grown(mutations.insert_object(self.ops, self._command(obj, idx=F.lit(index).cast("long"), action=F.lit(action))))
        top = out.ops.agg(F.max("op_ctr")).first()[0]
        return out, f"{top}@{self.actor.hex()}"

    def splice_trees(self, obj: str, pos: int, delete: int, trees: list) -> Document:
        """As ``splice``, with nested values."""
        return self._grown(mutations.splice_trees(self.ops, self._command(obj, pos=F.lit(pos).cast("long"), **{"del": F.lit(delete)}, trees=F.lit(json.dumps(trees)))))

    def put_tree(self, obj: str, key: str, tree) -> Document:
        """A nested value at a key."""
        return self._grown(mutations.create_trees(self.ops, self._command(obj, map_key=F.lit(key), tree=F.lit(json.dumps(tree)))))

    def delete(self, obj: str, key: str | int) -> Document:
        if isinstance(key, int):
            return self.splice(obj, key, 1, [])
        return self._grown(mutations.delete_keys(self.ops, self._command(obj, map_key=F.lit(key))))

    def increment(self, obj: str, key: str, by: int) -> Document:
        return self._grown(mutations.increment(self.ops, self._command(obj, map_key=F.lit(key), by=F.lit(by).cast("long"))))

    def splice(self, obj: str, pos: int, delete: int, values: list) -> Document:
        put = F.array(*map(_scalar, values)) if values else F.array().cast(f"array<{S.VALUE}>")
        return self._grown(mutations.splice(self.ops, self._command(obj, pos=F.lit(pos).cast("long"), **{"del": F.lit(delete)}, values=put)))

    def insert(self, obj: str, index: int, value) -> Document:
        return self.splice(obj, index, 0, [value])

    def splice_text(self, obj: str, pos: int, delete: int, text: str) -> Document:
        return self.splice(obj, pos, delete, list(text))

    def mark(self, obj: str, start: int, stop: int, name: str, value, expand: bool = False) -> Document:
        c = self._command(obj, start=F.lit(start).cast("long"), stop=F.lit(stop).cast("long"), name=F.lit(name), value=_scalar(value), expand=F.lit(expand))
        return self._grown(mutations.mark(self.ops, c))

    def commit(self, message: str | None = None, time: int = 0) -> Document:
        """Seals the pending ops; without any, nothing happens.  The time is the caller's, so that the hash is too."""
        if self.pending.count() == 0:
            return self
        mine = F.col("actor") == F.lit(bytearray(self.actor))
        seq = self.changes.where(mine).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        meta = self.spark.createDataFrame([(self.doc_id, self.actor, seq, time, message, self.heads())], "doc_id long, actor binary, seq long, time long, message string, deps array<binary>")
        return self._with(changes=self.changes.unionByName(mutations.commit(self.pending, meta)), pending=self.pending.limit(0))

    def fork(self, actor: bytes) -> Document:
        return replace(self.commit(), actor=actor)

    def merge(self, other: Document) -> Document:
        """With what the other has sealed or is about to."""
        a, b = self.commit(), other.commit()
        return a._with(ops=merge.merge_ops(a.ops, b.ops), changes=merge.merge_changes(a.changes, b.changes))

    def save(self) -> bytes:
        """The document in a container; an empty one is no bytes."""
        d = self.commit()
        r = container.write(d.ops, d.changes).first()
        return bytes(r.content) if r else b""


class AutoCommit:
    """A document that seals a change after each edit; reads are those of the document as it stands.

    ``clock`` gives a change's time in milliseconds.  Edits change the wrapper and return what else they give (an object's id), or nothing.
    """

    EDITS = frozenset("put put_object insert_object put_tree delete increment splice splice_trees insert splice_text mark merge".split())

    def __init__(self, doc: Document, clock: Callable[[], int] = lambda: time.time_ns() // 1_000_000) -> None:
        self.doc, self.clock, self.message = doc.commit(), clock, None

    @classmethod
    def new(cls, spark: SparkSession, actor: bytes | None = None, **more) -> AutoCommit:
        return cls(Document.new(spark, actor or random_actor()), **more)

    @classmethod
    def load(cls, spark: SparkSession, data: bytes, actor: bytes | None = None, **more) -> AutoCommit:
        return cls(Document.load(spark, data, actor or random_actor()), **more)

    def set_message(self, message: str) -> None:
        """For the next change alone."""
        self.message = message

    def fork(self, actor: bytes | None = None) -> AutoCommit:
        return AutoCommit(self.doc.fork(actor or random_actor()), self.clock)

    def __getattr__(self, name: str):
        own = getattr(self.doc, name)
        if name not in self.EDITS:
            return own

        def edit(*args, **settings):
            if name == "merge":
                args = tuple(a.doc if isinstance(a, AutoCommit) else a for a in args)
            found = own(*args, **settings)
            done, out = found if isinstance(found, tuple) else (found, None)
            if done.pending.count():
                done, self.message = done.commit(self.message, self.clock()), None
            self.doc = done
            return out

        return edit
