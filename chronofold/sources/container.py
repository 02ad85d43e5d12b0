"""Documents in container files as op and change tables, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ship import ship
from ..schema import CHANGES, OPS, schema


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(doc_id, path, content) of container files; doc_id is the first 63 bits of the path's digest, so that it is the same in every run."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select(F.shiftrightunsigned(F.xxhash64("path"), 1).alias("doc_id"), "path", "content")


def read(containers: DataFrame, *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Ops and changes of containers (doc_id, content).  What is no container fails the task, or is left out if not ``strict``.

    Each table decodes the containers anew; write or persist it if it is used again.
    """
    ship(containers.sparkSession)

    def decode(which: int, ddl: str):
        target = to_arrow_schema(schema(ddl))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from ..codec.chunks import load
            from ..functions.leb128 import Malformed

            for batch in batches:
                for doc, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    try:
                        rows = load(content)[which]
                    except (Malformed, UnicodeDecodeError):
                        if strict:
                            raise
                        continue
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc} | {k: r.get(k) for k in target.names if k != "doc_id"} for r in rows], schema=target)

        return run

    rows = containers.select("doc_id", "content")
    return rows.mapInArrow(decode(1, OPS), OPS), rows.mapInArrow(decode(0, CHANGES), CHANGES)


def write(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc_id, content): each document in one container.  A document is put together in one task."""
    ship(ops.sparkSession)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        from ..codec.chunks import encode_document

        out = encode_document(left.to_pylist(), right.to_pylist())
        return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([out], pa.binary())})

    return ops.groupBy("doc_id").cogroup(changes.groupBy("doc_id")).applyInArrow(run, "doc_id bigint, content binary")
