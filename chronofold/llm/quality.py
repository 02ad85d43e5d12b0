"""Quality classifier (operator 8).

Random indexing: a word has a sparse ternary index vector, found by its hash, and its word vector is the sum of the index vectors of its
neighbours over the whole corpus, plus its own.  Words are hashed into BUCKETS, so that the vectors are a table of fixed size whatever the
corpus: words of one bucket share theirs (the README gives the rate and what it costs).  Documents are pooled to the mean of their words' vectors;
a two-layer numpy network scores them, and a temperature fitted on rows that it has not been trained on calibrates its probabilities.

Sums of index vectors are whole numbers, so that word vectors do not depend on how the rows are dealt out, nor scores beyond rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .util import put, steps

#: Token buckets, dimensions, entries of an index vector that are not zero, neighbours on each side.
BUCKETS, DIMENSIONS, ENTRIES, WINDOW = 4096, 32, 4, 2
FEATURES = DIMENSIONS + WINDOW + 2
#: Labelled rows that the network is fitted on, at most: those with the least hashes of their ids.
MOST_LABELLED = 20_000
#: Bytes that are taken apart at once; longer texts are cut at white space or, without any, wherever they are.
CHUNK = 1 << 19
#: Neighbours that a task counts before it folds its table of pairs into sums: no count of the table can run over.
FOLD = 1 << 30

# Byte classes: 0 white space and controls, 1 letters (and all beyond ASCII), 2 digits, 3 punctuation.
_CLASS = np.array([0 if b <= 32 or b == 127 else 2 if 48 <= b <= 57 else 1 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 3 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_STEP = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for x in (_STEP, pow(_STEP, -1, 1 << 64)):
            factors = np.full(n, x, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and first byte of each token: runs of letters (lower-cased), of punctuation, of digits (all alike).

    A run of two or more capitals has the bucket of the class of such runs.
    """
    a = np.frombuffer(raw, np.uint8)
    kind = _CLASS[a]
    cut = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(a) else np.empty(0, np.int64)
    end = np.append(cut[1:], len(a))
    some = kind[cut] > 0 if len(a) else np.empty(0, bool)
    cut, end = cut[some], end[some]
    if not len(cut):
        return np.empty(0, np.int64), cut
    up, down = powers(len(a) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[a] + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    mixed = (total[end] - total[cut]) * down[cut]
    capitals = np.concatenate([[0], np.cumsum(_UPPER[a])])
    size = end - cut
    shout = (size > 1) & (capitals[end] - capitals[cut] == size)
    mixed = np.where(kind[cut] == 2, np.uint64(1), np.where(shout, np.uint64(2), mixed))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(52)).astype(np.int64) % BUCKETS, cut


def parts(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Chunks of texts: their bytes, and the number and first byte of each text in them; texts are set apart by a zero byte."""
    held, rows, starts, size = [], [], [], 0
    for k, text in enumerate(texts):
        raw, at = text.encode(), 0
        while True:
            stop = at + CHUNK
            if stop < len(raw):
                stop = max(raw.rfind(b" ", at + 1, stop), raw.rfind(b"\n", at + 1, stop))
                stop = stop if stop > at else at + CHUNK
            piece = raw[at:stop]
            if held and size + len(piece) > CHUNK:
                yield b"\0".join(held), np.array(rows), np.array(starts)
                held, rows, starts, size = [], [], [], 0
            held.append(piece), rows.append(k), starts.append(size)
            size += len(piece) + 1
            at = stop
            if at >= len(raw):
                break
    if held:
        yield b"\0".join(held), np.array(rows), np.array(starts)


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, as many entries of each sign."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIMENSIONS), np.int64)
    for row in out:
        row[rng.choice(DIMENSIONS, ENTRIES, replace=False)] = [1, -1] * (ENTRIES // 2)
    return out


def context_sums(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Over the whole column: for each bucket the sum of its neighbours' index vectors, and how often it occurs."""
    ship(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, seen, sums, since = np.zeros(BUCKETS * BUCKETS, np.int32), np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, DIMENSIONS), np.int64), 0
        own = index_vectors().astype(np.float64)

        def fold() -> None:
            table = pairs.reshape(BUCKETS, BUCKETS)
            for k in range(0, BUCKETS, 256):  # whole numbers below 2**53 are exact
                rows = table[k : k + 256].astype(np.float64)
                sums[k : k + 256] += (rows @ own).astype(np.int64)
                sums[:] += (rows.T @ own[k : k + 256]).astype(np.int64)
            pairs[:] = 0

        for batch in batches:
            for texts in steps(batch.column(0)):
                for raw, _, starts in parts(texts):
                    t, at = tokens(raw)
                    seen += np.bincount(t, minlength=BUCKETS)
                    owner = np.searchsorted(starts, at, "right")
                    for d in range(1, WINDOW + 1):
                        same = owner[d:] == owner[:-d]
                        np.add.at(pairs, t[:-d][same] * BUCKETS + t[d:][same], 1)
                    since += len(t) * WINDOW
                    if since > FOLD:
                        fold()
                        since = 0
        if seen.any():
            fold()
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), *(pa.array(sums[some, i]) for i in range(DIMENSIONS))], ["bucket", "n", *(f"v{i}" for i in range(DIMENSIONS))])

    names = ["n", *(f"v{i}" for i in range(DIMENSIONS))]
    by_task = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(gather, "bucket long, " + ", ".join(f"{c} long" for c in names))
    rows = by_task.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # BUCKETS rows at most
    sums, seen = np.zeros((BUCKETS, DIMENSIONS), np.int64), np.zeros(BUCKETS, np.int64)
    sums[rows["bucket"]] = rows[names[1:]].to_numpy()
    seen[rows["bucket"]] = rows["n"]
    return sums, seen


def word_vectors(sums: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A unit vector of each bucket's usual context, set off against that of the corpus, plus its own unit index vector."""
    mean = sums / np.maximum(seen, 1)[:, None] - sums.sum(0) / max(seen.sum(), 1)
    size = np.linalg.norm(mean, axis=1, keepdims=True)
    return (np.divide(mean, size, out=np.zeros_like(mean), where=size > 0) + index_vectors() / np.sqrt(ENTRIES)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """A row per text: the mean vector of its tokens, that mean's length, the mean products of vectors 1 to WINDOW tokens apart (how
    much a text repeats itself), and log(1 + tokens).  Zeros without tokens."""
    sums, n = np.zeros((len(texts), DIMENSIONS + WINDOW)), np.zeros(len(texts), np.int64)
    for raw, rows, starts in parts(texts):
        t, at = tokens(raw)
        if not len(t):
            continue
        owner = np.searchsorted(starts, at, "right") - 1
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        who = rows[owner[first]]
        np.add.at(n, who, np.diff(np.append(first, len(t))))
        for k in range(0, len(first), 512):
            begin, stop = first[k], first[k + 512] if k + 512 < len(first) else len(t)
            own, cut = vectors[t[begin:stop]], first[k : k + 512] - begin
            np.add.at(sums[:, :DIMENSIONS], who[k : k + 512], np.add.reduceat(own, cut, axis=0, dtype=np.float64))
            for d in range(1, WINDOW + 1):
                near = np.zeros(len(own))
                near[d:] = np.einsum("ij,ij->i", own[d:], own[:-d]) * (owner[begin + d : stop] == owner[begin : stop - d])
                np.add.at(sums[:, DIMENSIONS + d - 1], who[k : k + 512], np.add.reduceat(near, cut))
    sums /= np.maximum(n, 1)[:, None]
    return np.column_stack([sums, np.linalg.norm(sums[:, :DIMENSIONS], axis=1), np.log1p(n)])


class Network:
    """Two layers with a tanh between; inputs are standardised, the logit divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, hidden: int = 32, rounds: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> None:
        self.constant = None
        if len(np.unique(y)) < 2 or len(y) < 10:
            self.constant = (y.sum() + 1) / (len(y) + 2)
            return
        rng = np.random.default_rng(11)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[used].mean(0), x[used].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        n = x.shape[1]
        w = [rng.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(rounds):
            rng.shuffle(used)
            for k in range(0, len(used), batch):
                some = used[k : k + batch]
                h = np.tanh(z[some] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[some]) / len(some)
                back = np.outer(d, w[2]) * (1 - h * h)
                step += 1
                for i, g in enumerate((z[some].T @ back + decay * w[0], back.sum(0), h.T @ d + decay * w[2], d.sum(keepdims=True))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if len(held):
            logit, sign = self.logits(x[held]), 2 * y[held] - 1
            grid = np.geomspace(0.25, 8, 81)
            self.temperature = float(grid[np.argmin([np.logaddexp(0, -sign * logit / t).mean() for t in grid])])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def held_out(id):
    """Whether a row's label is kept from training: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> tuple[np.ndarray, Network]:
    """Word vectors over all of ``docs``, and a network fitted on the labelled rows that are not held out.

    Of those, ``most`` are used: the ones with the least hashes of their ids.  Rows without an id or a label are not used; an id counts as
    often as it is labelled, with the text whose hash is least where several rows have it.
    """
    ship(docs.sparkSession)
    vectors = word_vectors(*context_sums(docs, text))
    sc = docs.sparkSession.sparkContext
    own = sc.broadcast(vectors)
    chosen = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).where("id is not null and y is not null")
    chosen = chosen.where(~held_out(F.col("id")))
    # only hashes up to where the least of them are expected to end, so that few more than ``most`` rows meet for the choice
    share = min(1.0, 1.2 * most / max(1, chosen.count()))
    chosen = chosen.where(F.xxhash64("id").cast("double") <= (2 * share - 1) * 2.0**63).orderBy(F.xxhash64("id"), "id", "y").limit(most)

    @F.arrow_udf("array<double>")
    def pool(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.concatenate([np.empty((0, FEATURES)), *(pooled(texts, own.value) for texts in steps(batch))])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    chosen = F.broadcast(chosen)
    said = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(chosen.select("id").distinct()), "id")
    said = said.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    # a row for each chosen label at most
    rows = said.select("id", pool("text").alias("x")).join(chosen, "id").orderBy(F.xxhash64("id"), "id", "y").toPandas()
    x = np.array(rows["x"].tolist()).reshape(-1, FEATURES)
    own.unpersist()
    return vectors, Network(x, rows["y"].to_numpy())


def score(docs: DataFrame, vectors: np.ndarray, network: Network, *, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5, else 0); null and empty texts are scored as texts without tokens."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((vectors, network))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors, network = model.value
        for batch in batches:
            yield pa.array(np.concatenate([np.empty(0), *(network(pooled(texts, vectors)) for texts in steps(batch))]), pa.float64())

    out = put(docs, score=run(F.col(f"`{text}`")))
    return put(out, predicted=(F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``docs`` with held_out, score and predicted.  Without labels of both kinds every score is the share of label 1, smoothed.

    Only texts are inputs of a score.  Every row stays; columns of these names are replaced.
    """
    vectors, network = fit(docs, labels, id=id, text=text, label=label)
    return put(score(docs, vectors, network, text=text), held_out=held_out(F.col(f"`{id}`")))
