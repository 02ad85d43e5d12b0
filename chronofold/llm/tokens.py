"""Token counts (operator 1).

Batch encoding in Arrow functions that return lengths only.  Batches are balanced by bytes, and texts are split at safe
boundaries (see ``pieces``): the library encodes each distinct piece of a batch once, whatever the length of the text, and a
text's count is the sum over its pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .pieces import cut
from .util import put, steps

#: Pieces whose counts a worker remembers; beyond that it starts anew, so its memory is bounded.
REMEMBERED = 400_000
#: Bytes of pieces that the library encodes in one call.
CALL_BYTES = 1 << 18

_loaded: dict = {}


class PieceCounts:
    """Counts of tokens by piece, for one vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def learn(self, known: dict[str, int], new: list[str], lead: str) -> None:
        start = 0
        while start < len(new):
            stop, size = start, 0
            while stop < len(new) and size < CALL_BYTES:
                size += 8 + len(new[stop])
                stop += 1
            some = new[start:stop]
            known.update(zip(some, map(len, self.library.encode_batch_fast([lead + x for x in some], add_special_tokens=False)), strict=True))
            start = stop

    def of(self, texts: list[str]) -> list[int]:
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first, self.later = {}, {}
        parts = [cut(x) for x in texts]
        for known, some, lead in ((self.first, {"\n"}.union(*(p[0] for p in parts)), ""), (self.later, set().union(*(p[1] for p in parts)), " ")):
            if new := [x for x in some if x not in known]:
                self.learn(known, new, lead)
        first, later = self.first.__getitem__, self.later.__getitem__
        return [sum(map(first, a)) + sum(map(later, b)) + n * first("\n") for a, b, n in parts]


def counts(path: str) -> PieceCounts:
    if path not in _loaded:
        _loaded[path] = PieceCounts(path)
    return _loaded[path]


def token_counts(df: DataFrame, path: str, *, text: str = "text", limit: int = 1024) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of its column ``text``.

    ``path`` names a vocabulary file for the tokenizers library, which every executor must have.  No special tokens are added;
    strings of special tokens inside a text count as the library's default has it.  Null and empty texts have 0 bytes and 0
    tokens.  Columns of ``df`` called like the results are replaced; rows are neither dropped nor merged.
    """
    ship(df.sparkSession)

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counts(path)
        for batch in batches:
            yield pa.array([n for texts in steps(batch) for n in own.of(texts)], pa.int64())

    out = put(df, n_bytes=F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), n_tokens=count(F.col(f"`{text}`")))
    return put(out, over_limit=F.col("n_tokens") > limit)
