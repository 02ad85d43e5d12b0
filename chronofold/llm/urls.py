"""URL filters (operator 10), DataFrame functions only.

Sort-merge range join.  A host's canonical key is its labels from last to first, each followed by a dot, so that a host and all its
subdomains have the keys of one interval: from ``org.example.`` up to ``org.example/``.  Intervals of rule hosts are nested or apart.
Distinct hosts are sorted together with the intervals' ends; a running last-value over that order holds the stack of the rules active
there (an opening sets the rule host's own stack, a closing that of what encloses it).  Paths are compared within the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import fresh, put

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "array<struct<host:string,path:string,verdict:string>>"


def lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    return (F.coalesce(f(rest), F.lit("")) for f in (lambda x: lower(F.regexp_extract(x, "^[^/?#]*", 0)), lambda x: F.regexp_extract(x, "^[^/?#]*([^?#]*)", 1)))


def canonical(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def stacks(rules: DataFrame) -> DataFrame:
    """For each rule host the rules that hold there (stack) and those that hold around it (outer)."""
    rules = rules.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path")], "verdict").distinct()
    rules = rules.groupBy(lower(F.col("host")).alias("host")).agg(F.array_sort(F.collect_set(F.struct("host", "path", "verdict"))).alias("own"))
    labels = F.split("host", r"\.")
    above = rules.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("around"))
    found = above.join(rules.select(F.col("host").alias("around"), "own"), "around")
    empty = F.filter(F.first("own"), lambda x: F.lit(False))
    return found.groupBy("host").agg(
        F.flatten(F.collect_list("own")).alias("stack"),
        F.coalesce(F.flatten(F.collect_list(F.when(F.col("around") != F.col("host"), F.col("own")))), empty).alias("outer"),
    )


def judge(df: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", buckets: int | None = None) -> DataFrame:
    """``df`` with host, path, rule and verdict of its column ``url``.

    ``rules`` has host, path and verdict (allow or block).  A rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest (host and path together, then host) wins; without one rule is null and verdict ``default``.  Null urls and
    those without ``://`` have empty host and path.  Each row of ``df`` stays, repeated ones too; its columns of these names are
    replaced.  Hosts are swept once each, spread over ``buckets`` by hash (the session's shuffle partitions by default); every bucket
    has all rules, so rules are the side that has to be small.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(f"`{url}`"))
    df = put(df, host=host, path=path)
    at = stacks(rules).withColumn("key", canonical(F.col("host"))).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    opening = at.select("bucket", "key", F.lit(1).alias("turn"), F.lit(None).cast("string").alias("host"), F.col("stack"))
    closing = at.select("bucket", F.regexp_replace("key", r"\.$", "/").alias("key"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("host"), F.col("outer").alias("stack"))
    hosts = df.select("host").distinct()
    hosts = hosts.select(F.pmod(F.xxhash64("host"), F.lit(n)).cast("int").alias("bucket"), canonical(F.col("host")).alias("key"), F.lit(2).alias("turn"), "host", F.lit(None).cast(RULES).alias("stack"))
    sweep = W.partitionBy("bucket").orderBy("key", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    active = opening.unionByName(closing).unionByName(hosts).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("turn = 2").select("host", "stack")
    stack, key = fresh(df, "stack"), fresh(df, "of_host")
    out = df.join(active.select(F.col("host").alias(key), F.col("stack").alias(stack)), F.col("host") == F.col(key), "left")
    fits = F.filter(stack, lambda r: F.startswith(F.col("path"), r["path"]))
    size = lambda r: F.length(r["host"]) + F.length(r["path"])
    best = F.array_max(F.transform(fits, lambda r: F.struct(size(r).alias("size"), F.length(r["host"]).alias("inner"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    return put(out, rule=best["rule"], verdict=F.coalesce(best["verdict"], F.lit(default))).drop(stack, key)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict)."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1, numPartitions=1).select(F.inline(rows))
