"""Replication between peers, many documents at a time: what to say next, and what follows from what was said.

A state is what one side knows of the other, a row a document; a message is a row a document too, and a document without one has nothing to
say.  Changes travel as rows of the change table; ``send`` names those that go with a message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import schema
from . import changes as ch
from .merge import merge_changes

HASHES = "array<binary>"
HAVE = f"array<struct<last_sync:{HASHES},bits:binary>>"
#: Only ``shared`` outlasts a session; their_* are null until a message has come.
STATE = f"doc_id bigint, shared {HASHES}, last_sent {HASHES}, their_heads {HASHES}, their_need {HASHES}, their_have {HAVE}, sent {HASHES}, in_flight boolean, responded boolean"
MESSAGE = f"doc_id bigint, heads {HASHES}, need {HASHES}, have {HAVE}, send {HASHES}"


def new_states(docs: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """States of a session that begins, for each doc_id; ``shared`` (doc_id, hash) are the heads known to be on both sides."""
    none = F.array().cast(HASHES)
    rows = docs.select("doc_id").distinct()
    if shared is None:
        rows = rows.withColumn("shared", none)
    else:
        rows = rows.join(shared.groupBy("doc_id").agg(F.array_sort(F.collect_set("hash")).alias("shared")), "doc_id", "left").withColumn("shared", F.coalesce("shared", none))
    kinds = {f.name: f.dataType for f in schema(STATE)}
    own = {"last_sent": none, "sent": none, "in_flight": F.lit(False), "responded": F.lit(False)}
    return rows.select(*[F.col(c) if c in ("doc_id", "shared") else own.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in kinds])


def reset(states: DataFrame) -> DataFrame:
    """What is left of states between sessions."""
    return new_states(states, hashes(states, "shared"))


def hashes(rows: DataFrame, column: str) -> DataFrame:
    """(doc_id, hash) of an array of hashes."""
    return rows.select("doc_id", F.explode(column).alias("hash"))


def _listed(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("hash")).alias(name))


def generate(changes: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages to send, and the states after them.

    A message has the own heads; of the peer's heads those that are not here (need); if there are none, a filter over what has come since the
    shared heads (have); and the hashes of the changes to send, if the peer's filters are known.  A document has none once it has
    answered with these heads before, has nothing to send, and either has the peer's heads, waits for an answer, or lacks nothing.
    """
    none = F.array().cast(HASHES)
    own = changes.join(states.select("doc_id"), "doc_id", "left_semi")
    need = hashes(states, "their_heads").join(own.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")
    known = states.where("their_have is not null")
    filters = known.select("doc_id", F.inline("their_have"))
    heard = own.join(known.select("doc_id"), "doc_id", "left_semi")
    send = ch.to_send(heard, filters, need=hashes(known, "their_need"), sent=hashes(known, "sent"))
    bits = ch.bloom_filters(ch.since(own, hashes(states, "shared")))
    rows = states
    for found, name in ((_listed(ch.heads(own), "heads"), "heads"), (_listed(need, "need"), "need"), (_listed(send, "send"), "send"), (bits, "bits")):
        rows = rows.join(found, "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(b"") if name == "bits" else none))
    have = F.when(F.size("need") == 0, F.array(F.struct(F.col("shared").alias("last_sync"), F.col("bits")))).otherwise(F.array().cast(HAVE)).alias("have")
    same = F.col("their_heads").isNotNull() & (F.array_sort("their_heads") == F.col("heads"))
    idle = same | F.col("in_flight") | ((F.size("need") == 0) & F.col("their_have").isNotNull())
    settled = F.col("responded") & (F.col("heads") == F.array_sort("last_sent")) & (F.size("send") == 0) & idle
    rows = rows.withColumn("settled", F.coalesce(settled, F.lit(False)))
    messages = rows.where("not settled").select("doc_id", "heads", "need", have, "send")
    says = ~F.col("settled")
    after = {"last_sent": F.when(says, F.col("heads")).otherwise(F.col("last_sent")), "sent": F.array_sort(F.array_union("sent", "send")), "in_flight": F.col("in_flight") | says, "responded": F.col("responded") | says}
    return messages, rows.select(*[after.get(c, F.col(c)).alias(c) for c in schema(STATE).names])


def receive(changes: DataFrame, states: DataFrame, messages: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes and states once messages, with the changes that came with them (``arrived``, change rows), have been taken in.

    If all of the peer's heads are here now, they are the shared ones; else those that are here join them.  A document without a
    state begins one; without a message, its state stays.
    """
    held = merge_changes(changes, arrived)
    every = states.unionByName(new_states(messages.join(states.select("doc_id"), "doc_id", "left_anti")))
    here = _listed(hashes(messages, "heads").join(held.select("doc_id", "hash"), ["doc_id", "hash"], "left_semi"), "here")
    came = messages.select("doc_id", F.array_sort(F.array_distinct("heads")).alias("heads"), "need", "have", F.lit(True).alias("came")).join(here, "doc_id", "left")
    rows = every.join(came, "doc_id", "left").withColumn("came", F.coalesce("came", F.lit(False))).withColumn("here", F.coalesce("here", F.array().cast(HASHES)))
    shared = F.when(F.size("here") == F.size("heads"), F.col("heads")).otherwise(F.array_sort(F.array_union("shared", "here")))
    after = {"shared": shared, "their_heads": F.col("heads"), "their_need": F.col("need"), "their_have": F.col("have"), "in_flight": F.lit(False)}
    return held, rows.select(*[F.when(F.col("came"), after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c in schema(STATE).names])


def sent_changes(changes: DataFrame, messages: DataFrame) -> DataFrame:
    """The change rows that go with messages."""
    return changes.join(hashes(messages, "send"), ["doc_id", "hash"], "left_semi")


def empty_states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema(STATE))
