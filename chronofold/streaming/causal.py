"""Changes as they arrive, given on only once what they depend on has been.

State is kept by document: the hashes given on, and the changes that wait.  A change that comes again is dropped.  There is no watermark: a
change waits for its dependencies however late they are; ``waiting`` of a batch shows what does.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.ship import ship

OUT = "doc_id bigint, hash binary, actor binary, seq bigint, start_op bigint, max_op bigint, deps array<binary>, place bigint"
COLUMNS = ["doc_id", "hash", "actor", "seq", "start_op", "max_op", "deps"]


def released(known: dict, waiting: dict, new: list[dict]) -> list[dict]:
    """Takes new changes in; returns those that can go on, dependencies first.  ``known`` numbers hashes in that order."""
    waiting |= {c["hash"]: c for c in new if c["hash"] not in known}
    first = sorted(waiting.values(), key=lambda c: (c["max_op"], c["hash"]))
    needs = {c["hash"]: {d for d in c["deps"] if d not in known} for c in first}
    after: dict = {}
    for h, ds in needs.items():
        for d in ds:
            after.setdefault(d, []).append(h)
    ready, out = deque(h for h, ds in needs.items() if not ds), []
    while ready:
        h = ready.popleft()
        known[h] = len(known)
        out.append(waiting.pop(h) | {"place": known[h]})
        for x in after.get(h, ()):
            needs[x].discard(h)
            if not needs[x]:
                ready.append(x)
    return out


def _plain(r: dict) -> dict:
    return r | {"hash": bytes(r["hash"]), "actor": bytes(r["actor"]), "deps": [bytes(d) for d in r["deps"]]}


def release(changes: DataFrame) -> DataFrame:
    """The stream of changes (the columns COLUMNS) in causal order, each once, with ``place``, its number within its document."""
    ship(changes.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, waiting = pickle.loads(state.get[0]) if state.exists else ({}, {})
        new = [_plain(r) for f in frames for r in f.to_dict("records")]
        out = released(known, waiting, new)
        state.update((pickle.dumps((known, waiting)),))
        yield pd.DataFrame(out, columns=[*COLUMNS, "place"])

    return changes.select(*COLUMNS).groupBy("doc_id").applyInPandasWithState(step, OUT, "held binary", "append", GroupStateTimeout.NoTimeout)


def release_batch(changes: DataFrame) -> DataFrame:
    """The same over a table."""
    ship(changes.sparkSession)

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(released({}, {}, [_plain(r) for r in frame.to_dict("records")]), columns=[*COLUMNS, "place"])

    return changes.select(*COLUMNS).groupBy("doc_id").applyInPandas(step, OUT)


def waiting(changes: DataFrame) -> DataFrame:
    """The changes of a table that nothing yet lets go on."""
    done = release_batch(changes).select("doc_id", "hash")
    return changes.join(done, ["doc_id", "hash"], "left_anti").withColumn("n_missing", F.size("deps"))
