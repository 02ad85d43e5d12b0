"""Benchmark decontamination (operator 2), DataFrame functions only.

Winnowing: of every window of WINDOW - K + 1 consecutive K-gram hashes the least is kept as a fingerprint, so that any shared run of
WINDOW words shares one.  Fingerprints of documents are joined to those of the benchmark; each hit is extended to the windows of
WINDOW words around it, which are joined to the benchmark's windows word by word.  Items shorter than WINDOW words have one window of
their own length, which no fingerprint covers: their lengths are few (below WINDOW), and runs of these lengths are looked up as they are.

Hits depend on a text alone, so they are gathered by the text's digest, and those of its copies fall together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import LOWER, UPPER
from .util import fresh, let, put, shared, small

WINDOW, K = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Keys over which the copies of one text are dealt when hits are joined to documents.
SALTS = 16


#: The same without lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


#: What separates words, of ASCII.
APART = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """The runs of digits, letters and all beyond ASCII, with A to Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + APART, LOWER + " " * len(APART)), " "), "")


def grams(w: Column, n: int) -> Column:
    """Every run of ``n`` words, joined by spaces."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))


def hashes(w: Column) -> Column:
    """For each K-gram its hash in the upper half of a long, its place in the lower: the least of a window is its first least hash."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(K - 1)), lambda i: F.shiftleft(F.hash(F.slice(w, i, K)).cast("long"), 32) + i)


def winnowed(h: Column) -> Column:
    n = WINDOW - K + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - F.lit(n - 1)), lambda i: F.array_min(F.slice(h, i, n))))


def windows_of(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """The distinct windows of the benchmark: its words (gram), their number and the items that hold it."""
    w = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("w")).where(F.size("w") > 0)
    whole = w.where(F.size("w") < WINDOW).select("item", F.size("w").alias("n"), F.array_join("w", " ").alias("gram"))
    runs = w.where(F.size("w") >= WINDOW).select("item", F.lit(WINDOW).alias("n"), F.explode(grams(F.col("w"), WINDOW)).alias("gram"))
    return whole.unionByName(runs).groupBy("n", "gram").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """Per distinct text that holds a window: its digest, hit words and items.

    Fingerprints are exploded by themselves; the words of a text are fetched again, by its digest, only if one of them is found.
    """
    w = docs.select(digest_of(F.col(f"`{text}`")).alias("digest"), words(F.col(f"`{text}`")).alias("w"))
    long = windows.where(F.col("n") == WINDOW)
    prints = long.select(F.explode(let(let(F.split("gram", " "), hashes), winnowed)).alias("v")).select(F.shiftright("v", 32).alias("print")).distinct()
    found = w.where(F.size("w") >= WINDOW).select("digest", F.explode(let(hashes(F.col("w")), winnowed)).alias("v"))
    found = found.select("digest", (F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("at"), F.shiftright("v", 32).alias("print"))
    found = shared(found.join(small(prints), "print", "left_semi").groupBy("digest").agg(F.collect_set("at").alias("ats")))
    starts = F.array_distinct(F.flatten(F.transform("ats", lambda at: F.sequence(F.greatest(F.lit(1), at - F.lit(WINDOW - K)), F.least(at, F.size("w") - F.lit(WINDOW - 1))))))
    runs = F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice("w", i, WINDOW), " ").alias("gram")))
    again = docs.select(digest_of(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text")).join(small(found), "digest").select("digest", "ats", words(F.col("text")).alias("w"))
    found = again.select("digest", F.explode(runs).alias("g")).select("digest", F.lit(WINDOW).alias("n"), "g.*")
    for n in sorted(r.n for r in windows.where(F.col("n") < WINDOW).select("n").distinct().collect()):  # WINDOW - 1 rows at most
        # runs are looked up by hash, and only those found are written out
        keys = windows.where(F.col("n") == n).select(F.xxhash64(F.split("gram", " ")).alias("key")).distinct()
        run = F.transform(F.sequence(F.lit(1), F.size("w") - F.lit(n - 1)), lambda i: let(F.slice("w", i, n), lambda x: F.struct(i.alias("start"), F.xxhash64(x).alias("key"), x.alias("near"))))  # noqa: B023
        short = w.where(F.size("w") >= n).select("digest", F.explode(run).alias("g")).select("digest", "g.*").join(small(keys), "key", "left_semi")
        found = found.unionByName(short.select("digest", F.lit(n).alias("n"), "start", F.array_join("near", " ").alias("gram")))
    found = found.join(small(windows), ["n", "gram"]).select("digest", F.struct("start", "n").alias("span"), "items")
    each = found.groupBy("digest").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    cover = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("free")), lambda s, x: F.struct((s["n"] + F.greatest(x["start"] + x["n"] - F.greatest(s["free"], x["start"]), F.lit(0))).alias("n"), F.greatest(s["free"], x["start"] + x["n"]).alias("free")))["n"]
    return each.select("digest", cover.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit (words inside a benchmark window), n_items, items (ids as sorted strings) and contaminated (n_hit > 0).

    A null or empty text has no words, and neither hits nor is hit.  Every row of ``docs`` stays, repeated ones too; columns of these
    names are replaced.  Repeated items count once for each distinct id; a null id counts as none.
    """
    t = F.col(f"`{text}`")
    found = hits(docs, windows_of(benchmark, item_id, item_text), text)
    digest, salt, hit = (fresh(docs, x) for x in ("digest", "salt", "hit"))
    # hits are few texts as a rule; where they are too many to broadcast, a text with very many copies is dealt over SALTS keys
    out = put(docs, n_words=F.regexp_count(F.coalesce(t, F.lit("")), F.lit(WORD)).cast("long"), **{digest: digest_of(t), salt: F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    found = found.select(F.col("digest").alias(digest), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), F.struct("n_hit", "n_items", "items").alias(hit))
    out = out.join(found, [digest, salt], "left")
    h, none = F.col(hit), F.lit(0).cast("long")
    return put(out, n_hit=F.coalesce(h["n_hit"], none), n_items=F.coalesce(h["n_items"], none), items=F.coalesce(h["items"], F.array().cast("array<string>")), contaminated=h.isNotNull()).drop(digest, salt, hit)
