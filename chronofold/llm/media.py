"""Media columns (operator 9): payloads stored as lossless WebP and read back for features.

A payload is laid out as rows of WIDTH grey samples; a picture holds at most MAX_SIDE rows, and larger payloads become several
pictures, one file after the other.  Payloads are stored with subtract-green and with what makes them smaller: back-references where long
stretches repeat, a palette with several samples a pixel where there are few values, the predictor where differences say less than
samples.  ``webp`` decodes the whole format; cross-colour and colour cache, which tell nothing of grey samples, occur in other pictures only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import webp
from .util import fresh, put, steps

WIDTH = 64


def payload(text: str) -> bytes:
    """The text's UTF-8 bytes with zeros up to a positive multiple of WIDTH."""
    raw = text.encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def stored(data: bytes) -> bytes:
    """WebP files whose samples are ``data``, a positive multiple of WIDTH bytes."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return b"".join(webp.encode_grey(rows[i : i + webp.MAX_SIDE]) for i in range(0, len(rows), webp.MAX_SIDE))


def samples(media: bytes) -> bytes:
    """The grey samples (green channel) of WebP files."""
    return b"".join((px >> np.uint32(8)).astype(np.uint8).tobytes() for px in webp.images(media))


def feature(data: bytes) -> str:
    """An average hash of 64 equal blocks (16 hex digits), the mean sample, and eighths of the sample range in thousandths."""
    a = np.frombuffer(data, np.uint8)
    total, n = int(a.sum(dtype=np.int64)), len(a)
    blocks = a.reshape(64, -1).sum(1, dtype=np.int64)
    bits = int.from_bytes(np.packbits(blocks * 64 > total).tobytes(), "big")
    shares = np.bincount(a >> 5, minlength=8) * 1000 // n
    return f"{bits:016x}:{total // n}:" + "-".join(map(str, shares.tolist()))


def store(df: DataFrame, *, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with the WebP form (binary) of its column ``text``; null is the empty text, equal texts have equal media."""
    ship(df.sparkSession)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([stored(payload(x)) for texts in steps(batch) for x in texts], pa.binary())

    return put(df, **{out: run(F.col(f"`{text}`"))})


def load(df: DataFrame, *, media: str = "media", out: str = "samples") -> DataFrame:
    """``df`` with the samples (binary) of its column of WebP files; null stays null, and what is no lossless WebP fails the task."""
    ship(df.sparkSession)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else samples(x) for x in batch.to_pylist()], pa.binary())

    return put(df, **{out: run(F.col(f"`{media}`"))})


def round_trip(df: DataFrame, *, text: str = "text") -> DataFrame:
    """``df`` with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of its column ``text``.

    Payload and feature are those of the samples read back from the stored form.  Null is the empty text, whose payload is 64 zeros.
    Every row stays; columns of these names are replaced.
    """
    ship(df.sparkSession)
    kinds = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}

    @F.arrow_udf(f"struct<{','.join(f'{k}:{v}' for k, v in kinds.items())}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for texts in steps(batch):
                for x in texts:
                    media = stored(payload(x))
                    back = samples(media)
                    rows.append((len(x.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64() if v == "bigint" else pa.string()) for i, v in enumerate(kinds.values())], [*kinds])

    at = fresh(df, "round_trip")
    out = put(df, **{at: run(F.col(f"`{text}`"))})
    return put(out, **{c: F.col(f"{at}.{c}") for c in kinds}).drop(at)
