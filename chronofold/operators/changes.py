"""Changes as rows: heads, dependencies, and what a peer lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bloom import contained, filter_of
from ..functions.ship import ship
from .history import ancestors


def edges(changes: DataFrame) -> DataFrame:
    """(doc_id, hash, dep)."""
    return changes.select("doc_id", "hash", F.explode("deps").alias("dep"))


def heads(changes: DataFrame) -> DataFrame:
    """(doc_id, hash) of the changes that no other depends on."""
    used = edges(changes).select("doc_id", F.col("dep").alias("hash"))
    return changes.select("doc_id", "hash").distinct().join(used, ["doc_id", "hash"], "left_anti")


def heads_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, equal): whether two head tables agree on a document."""
    both = a.select("doc_id", "hash").distinct().withColumn("side", F.lit(1)).unionByName(b.select("doc_id", "hash").distinct().withColumn("side", F.lit(-1)))
    odd = both.groupBy("doc_id", "hash").agg(F.sum("side").alias("s"))
    return odd.groupBy("doc_id").agg((F.max(F.abs("s")) == 0).alias("equal"))


def deps_index(changes: DataFrame) -> DataFrame:
    """(doc_id, idx, dep_idx): dependencies as places in their document's changes, ordered by max_op, actor and seq."""
    at = changes.select("doc_id", "hash", "deps", (F.row_number().over(W.partitionBy("doc_id").orderBy("max_op", "actor", "seq")) - 1).cast("long").alias("idx"))
    e = at.select("doc_id", "idx", F.explode("deps").alias("dep"))
    return e.join(at.select("doc_id", F.col("hash").alias("dep"), F.col("idx").alias("dep_idx")), ["doc_id", "dep"]).select("doc_id", "idx", "dep_idx")


def missing(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the wanted hashes (doc_id, hash) and of all dependencies, those that are not there."""
    named = edges(changes).select("doc_id", F.col("dep").alias("hash")).unionByName(wanted.select("doc_id", "hash")).distinct()
    return named.join(changes.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")


def since(changes: DataFrame, have: DataFrame) -> DataFrame:
    """(doc_id, hash) of the changes reached from the heads without passing through the hashes of ``have``.

    Ancestors of these that can be reached by another way are included, as in the protocol; see ``lacking`` for the exact set.
    """
    return ancestors(changes, heads(changes), have)


def lacking(changes: DataFrame, have: DataFrame) -> DataFrame:
    """(doc_id, hash) of the changes that are no ancestors of ``have``, nor in it."""
    held = ancestors(changes, have)
    return changes.select("doc_id", "hash").distinct().join(held, ["doc_id", "hash"], "left_anti")


def bloom_filters(hashes: DataFrame) -> DataFrame:
    """(doc_id, bits): a filter in wire form of each document's hashes, built task by task over its sorted rows."""
    ship(hashes.sparkSession)

    def build(key, table):
        import pyarrow as pa

        return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([filter_of(sorted(table.column("hash").to_pylist()))], pa.binary())})

    return hashes.select("doc_id", "hash").distinct().groupBy("doc_id").applyInArrow(build, "doc_id bigint, bits binary")


def unheld(hashes: DataFrame, filters: DataFrame) -> DataFrame:
    """The hashes (doc_id, hash) that are in none of their document's filters (doc_id, bits)."""
    ship(hashes.sparkSession)

    @F.arrow_udf("boolean")
    def held(bits, hashes):
        import numpy as np
        import pyarrow as pa

        bits = bits.dictionary_encode()
        rows = np.stack([np.frombuffer(h[:12], np.uint8) for h in hashes.to_pylist()]) if len(hashes) else np.empty((0, 12), np.uint8)
        of, out = bits.indices.fill_null(-1).to_numpy(zero_copy_only=False), np.zeros(len(hashes), bool)
        for k, wire in enumerate(bits.dictionary.to_pylist()):
            mine = np.flatnonzero(of == k)
            out[mine] = contained(wire, rows[mine])
        return pa.array(out)

    named = hashes.select("doc_id", "hash").distinct()
    met = named.join(filters.select("doc_id", "bits"), "doc_id").where(held("bits", "hash")).select("doc_id", "hash").distinct()
    return named.join(met, ["doc_id", "hash"], "left_anti")


def to_send(changes: DataFrame, filters: DataFrame, *, need: DataFrame | None = None, sent: DataFrame | None = None) -> DataFrame:
    """(doc_id, hash) of the changes to send a peer with these filters: of those since its baselines the ones in none of its filters, what
    it asks for, and all that depends on them; without those already sent, and what is reached through these alone.

    ``filters`` has doc_id and bits, a row or more a document, and may have last_sync (hashes, the peer's baseline).  A document without a
    filter is sent whole.
    """
    named = changes.select("doc_id", "hash").distinct()
    first = named
    if "last_sync" in filters.columns:
        first = since(changes, filters.select("doc_id", F.explode("last_sync").alias("hash")).distinct())
    first = unheld(first, filters)
    if need is not None:
        first = first.unionByName(need.select("doc_id", "hash").join(named, ["doc_id", "hash"], "left_semi"))
    return dependents(changes, first.distinct(), sent)


def dependents(changes: DataFrame, first: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(doc_id, hash) of these changes and of all that depend on them; without ``stop``, and nothing is passed through it."""
    down = edges(changes).groupBy("doc_id", F.col("dep").alias("hash")).agg(F.collect_set("hash").alias("deps"))
    every = changes.select("doc_id", "hash").distinct().join(down, ["doc_id", "hash"], "left")
    return ancestors(every.select("doc_id", "hash", "deps"), first, stop)


def shared_heads(changes: DataFrame, theirs: DataFrame) -> DataFrame:
    """The peer's heads that are here too."""
    return theirs.select("doc_id", "hash").join(changes.select("doc_id", "hash"), ["doc_id", "hash"], "left_semi")
