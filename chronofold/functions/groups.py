"""Arrow tables that hold whole groups, from batches that come sorted by the group's key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[list[dict]]:
    """Rows (as dicts) of complete groups, about ``rows`` at a time; one larger group is given as it is."""
    held: list[dict] = []
    #: Where the last group begins.
    first = 0
    key = lambda r: tuple(r[k] for k in keys)
    for batch in batches:
        n = len(held)
        held += batch.to_pylist()
        if len(held) == n:
            continue
        last, k = key(held[-1]), len(held)
        while k > n and key(held[k - 1]) == last:
            k -= 1
        if k > n or not n or key(held[n - 1]) != last:
            first = k
        if len(held) >= rows and first:
            yield held[:first]
            held, first = held[first:], 0
    if held:
        yield held


def split(rows: list[dict], keys: list[str]) -> Iterator[list[dict]]:
    """The groups, one by one."""
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or any(rows[i][k] != rows[start][k] for k in keys):
            yield rows[start:i]
            start = i
