"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step works on at a time; bounds a worker's memory whatever the row count.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def strings(array: pa.Array) -> list[str]:
    """The values of a string array; null is the empty text."""
    return [x or "" for x in array.to_pylist()]


def steps(array: pa.Array, most: int = STEP_BYTES) -> Iterator[list[str]]:
    """Consecutive texts of an Arrow array in lists of about ``most`` bytes (one larger text makes a list of its own)."""
    start, n = 0, len(array)
    while start < n:
        stop, size = start, 0
        while stop < n and (size == 0 or size < most):
            size += array[stop].as_buffer().size if array[stop].is_valid else 0
            stop += 1
        yield strings(array.slice(start, stop - start))
        start = stop


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names.  One of this machine is made up only for a local master, whose tasks see it; elsewhere
    an unset spark.checkpoint.dir is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def shared(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage between steps of a long query: its heap shrinks to what is in use, and the shuffles, broadcasts and
    checkpoints of earlier steps go, which otherwise stay until its heap is full."""
    spark._jvm.System.gc()


#: Rows of ids, keys or hashes up to which a counted table is broadcast (some ten to a hundred bytes a row).
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if its rows are counted and few."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Keys that ``join_hot`` takes for hot, for each row of the other side that stands for a key.
HOT_KEYS, HOT_ROWS = 4096, 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has a row a key and in ``n`` how many rows of ``left``, of ``total``, have it.

    Keys of over ``total`` / HOT_KEYS rows, of which there are HOT_KEYS at most, are broadcast, so that a key with a large part of all
    rows isn't one task's; the rest is shuffled.  ``n`` is dropped; ``right`` should be cheap to read twice.
    """
    hot = right.where(F.col(n) > max(HOT_ROWS, total // HOT_KEYS)).drop(n)
    if hot.isEmpty():
        return left.join(right.drop(n), key)
    cold = right.where(F.col(n) <= max(HOT_ROWS, total // HOT_KEYS)).drop(n)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def put(df: DataFrame, **columns) -> DataFrame:
    """``df`` with these columns added; a column of ``df`` that has the name (in any case) is replaced."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and in whatever lambda ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
