"""Op logs out of plain tables, so that the operators can be held against SQL over the same tables.

The texts below run in both engines.  ``events`` gives each user a document of map ops by three replicas, each of which overwrites only
its own last op on a key; counters are numbered by replica, so that ties between replicas occur.  ``conversations`` gives each
conversation a document with a map ``chat`` that holds a text ``turns``, one element a turn, some of them deleted or overwritten by others.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FLOAT, INT, MAKE_MAP, MAKE_TEXT, MARK, NULL, STRING, conform, scalar

OPS_SQL = """
SELECT e.*, lag(ctr) OVER (PARTITION BY doc_id, map_key, actor ORDER BY ctr) AS p_ctr, lead(ctr) OVER (PARTITION BY doc_id, map_key, actor ORDER BY ctr) AS s_ctr
FROM (
  SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS BIGINT) AS ctr,
         lpad(CAST(event_id % 3 AS VARCHAR(5)), 32, '0') AS actor,
         concat('k', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20 AS VARCHAR(10))) AS map_key,
         CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 5 ELSE 1 END AS action, value, ts, event_id, event_type
  FROM {events}
) e
"""

#: A change is what a replica did in a day; every fifth also depends on the other replicas' latest change of an earlier day.
CHANGES_SQL = """
SELECT doc_id, actor, day, start_op, max_op, CAST(row_number() OVER (PARTITION BY doc_id, actor ORDER BY day) AS BIGINT) AS seq
FROM (
  SELECT doc_id, actor, CAST(ts AS DATE) AS day, min(ctr) AS start_op, max(ctr) AS max_op FROM {ops} GROUP BY doc_id, actor, CAST(ts AS DATE)
) g
"""
DEPS_SQL = """
SELECT doc_id, actor, seq, actor AS dep_actor, seq - 1 AS dep_seq FROM {changes} WHERE seq > 1
UNION ALL
SELECT c.doc_id, c.actor, c.seq, o.actor AS dep_actor, max(o.seq) AS dep_seq
FROM {changes} c JOIN {changes} o ON c.doc_id = o.doc_id AND c.actor <> o.actor AND o.day < c.day
WHERE c.seq % 5 = 0 GROUP BY c.doc_id, c.actor, c.seq, o.actor
"""

#: kind 0 inserts, 1 deletes, 2 overwrites.  An element is the op (turn + 3) of actor ..0; refs are ids of elements, 0 the head.
TURNS_SQL = """
SELECT conv_id AS doc_id, CAST(turn + 3 AS BIGINT) AS ctr, lpad('0', 32, '0') AS actor, 0 AS kind,
       CAST(CASE WHEN turn = 0 THEN 0 WHEN turn % 3 = 0 THEN turn - 1 + 2 ELSE turn + 2 END AS BIGINT) AS ref, text AS s FROM {conversations}
UNION ALL
SELECT conv_id, CAST(turn + 1000 AS BIGINT), lpad('1', 32, '0'), 1, CAST(turn + 3 AS BIGINT), NULL FROM {conversations} WHERE turn % 5 = 4
UNION ALL
SELECT conv_id, CAST(turn + 2000 AS BIGINT), lpad('2', 32, '0'), 2, CAST(turn + 3 AS BIGINT), role FROM {conversations} WHERE turn % 7 = 2
"""
A0, A3 = "0" * 32, "0" * 31 + "3"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster keeps checkpoints; one of this machine only for a local master, whose tasks see it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root}/{name}-{uuid.uuid4().hex}"


_written: dict[tuple, str] = {}


def once(spark: SparkSession, name: str, sf: str, make) -> DataFrame:
    """The table that ``make`` gives, written once for each application and input and read from there by every query."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        path = folder(spark, name)
        make().write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table of its own and read back, as what goes from one peer to another is."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hex(column: str):
    return F.unhex(F.col(column))


def _id(ctr, actor):
    return F.struct(ctr.cast("bigint").alias("ctr"), actor.alias("actor"))


def raw_ops(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(OPS_SQL, events=spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props"))


def map_ops(spark: SparkSession, sf: str) -> DataFrame:
    """The events' op log."""
    return once(spark, "ops", sf, lambda: _map_ops(spark, sf))


def _map_ops(spark: SparkSession, sf: str) -> DataFrame:
    r = raw_ops(spark, sf)
    value = F.when(F.col("action") == 5, scalar(INT, l=F.floor("value"))).when((F.col("action") == 1) & F.col("value").isNotNull(), scalar(FLOAT, d=F.col("value"))).otherwise(scalar(NULL))
    none = F.array().cast("array<struct<ctr:bigint,actor:binary>>")
    return conform(r.select(
        "doc_id", F.col("ctr").alias("op_ctr"), _hex("actor").alias("op_actor"), "map_key", "action", value.alias("value"),
        F.when(F.col("p_ctr").isNull(), none).otherwise(F.array(_id(F.col("p_ctr"), _hex("actor")))).alias("pred"),
    ))


def raw_changes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(CHANGES_SQL, ops=raw_ops(spark, sf))


def change_hash(doc: str, actor: str, seq: str):
    return F.unhex(F.sha2(F.concat_ws(":", F.col(doc).cast("string"), F.col(actor), F.col(seq).cast("string")), 256))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """The events' change graph."""
    return once(spark, "changes", sf, lambda: _changes(spark, sf))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    c = raw_changes(spark, sf)
    deps = spark.sql(DEPS_SQL, changes=c).groupBy("doc_id", "actor", "seq").agg(F.collect_set(change_hash("doc_id", "dep_actor", "dep_seq")).alias("deps"))
    c = c.join(deps, ["doc_id", "actor", "seq"], "left")
    return c.select(
        "doc_id", change_hash("doc_id", "actor", "seq").alias("hash"), _hex("actor").alias("actor"), "seq", "start_op", "max_op",
        (F.datediff("day", F.lit("1970-01-01")) * F.lit(86_400_000).cast("long")).alias("time"), F.lit(None).cast("string").alias("message"),
        F.coalesce("deps", F.array().cast("array<binary>")).alias("deps"), F.lit(None).cast("binary").alias("raw"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(TURNS_SQL, conversations=spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def text_ops(spark: SparkSession, sf: str, marks: bool = False) -> DataFrame:
    """The conversations' op log; with ``marks``, each text has a range ``bold`` over its first two elements and one ``note`` after the
    first."""
    return once(spark, "marked" if marks else "texts", sf, lambda: _text_ops(spark, sf, marks))


def _text_ops(spark: SparkSession, sf: str, marks: bool) -> DataFrame:
    t = turns(spark, sf)
    a0, a3, two = F.unhex(F.lit(A0)), F.unhex(F.lit(A3)), F.lit(2).cast("bigint")
    none = F.array().cast("array<struct<ctr:bigint,actor:binary>>")
    value = F.when(F.col("s").isNull(), scalar(NULL)).otherwise(scalar(STRING, s=F.col("s")))
    seq = t.select(
        "doc_id", F.col("ctr").alias("op_ctr"), _hex("actor").alias("op_actor"), two.alias("obj_ctr"), a3.alias("obj_actor"),
        F.when(F.col("ref") > 0, F.col("ref")).alias("elem_ctr"), F.when(F.col("ref") > 0, a0).alias("elem_actor"), (F.col("kind") == 0).alias("insert"),
        F.when(F.col("kind") == 1, 3).otherwise(1).alias("action"), value.alias("value"), F.when(F.col("kind") == 0, none).otherwise(F.array(_id(F.col("ref"), a0))).alias("pred"),
    )
    docs = t.select("doc_id").distinct()
    make = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("op_ctr"), F.lit(None).cast("bigint").alias("obj_ctr"), F.lit("chat").alias("map_key"), F.lit(MAKE_MAP).alias("action")),
        F.struct(two.alias("op_ctr"), F.lit(1).cast("bigint").alias("obj_ctr"), F.lit("turns").alias("map_key"), F.lit(MAKE_TEXT).alias("action")),
    )).alias("m")).select("doc_id", "m.*").withColumn("op_actor", a3).withColumn("obj_actor", F.when(F.col("obj_ctr").isNotNull(), a3)).withColumn("value", scalar(NULL))
    out = conform(seq).unionByName(conform(make))
    if marks:
        rows = [(3000, "bold", None), (3001, None, 4), (3010, "note", 3), (3011, None, None)]
        each = F.array(*[F.struct(F.lit(c).cast("bigint").alias("op_ctr"), F.lit(n).cast("string").alias("mark_name"), F.lit(e).cast("bigint").alias("elem_ctr")) for c, n, e in rows])
        m = docs.select("doc_id", F.explode(each).alias("m")).select("doc_id", "m.*")
        m = m.select("*", a3.alias("op_actor"), two.alias("obj_ctr"), a3.alias("obj_actor"), F.when(F.col("elem_ctr").isNotNull(), a0).alias("elem_actor"), F.lit(MARK).alias("action"), scalar(STRING, s=F.lit("yes")).alias("value"))
        out = out.unionByName(conform(m))
    return out


def clock(ops: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """A clock of three replicas, the same for every document."""
    each = F.array(*[F.struct(F.unhex(F.lit(str(k).rjust(32, "0"))).alias("actor"), F.lit(n).cast("bigint").alias("max_ctr")) for k, n in enumerate(limits)])
    return ops.select("doc_id").distinct().select("doc_id", F.inline(each))


def duck(text: str) -> str:
    """The prelude of an oracle: tables ops, live, changes, deps and turns, as far as ``text`` names them."""
    named = {
        "ops": OPS_SQL.format(events="events"),
        "live": "SELECT * FROM ops WHERE s_ctr IS NULL AND action <> 3",
        "changes": CHANGES_SQL.format(ops="ops"),
        "deps": DEPS_SQL.format(changes="changes"),
        "turns": TURNS_SQL.format(conversations="conversations"),
        "tree": f"""
            SELECT doc_id, ctr, [-ctr] AS path FROM turns WHERE kind = 0 AND ref = 0
            UNION ALL SELECT t.doc_id, t.ctr, list_append(p.path, -t.ctr) FROM turns t JOIN tree p ON t.doc_id = p.doc_id AND t.ref = p.ctr WHERE t.kind = 0""",
        "elements": f"""
            SELECT doc_id, elem_ctr, s, w_ctr, w_actor, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS idx
            FROM (SELECT tree.doc_id, tree.ctr AS elem_ctr, coalesce(o.s, i.s) AS s, coalesce(o.ctr, i.ctr) AS w_ctr, coalesce(o.actor, i.actor) AS w_actor, o.ctr IS NULL AND d.ctr IS NOT NULL AS gone,
                         CAST(row_number() OVER (PARTITION BY tree.doc_id ORDER BY tree.path) - 1 AS BIGINT) AS pos
                  FROM tree JOIN turns i ON i.doc_id = tree.doc_id AND i.ctr = tree.ctr AND i.kind = 0
                  LEFT JOIN turns o ON o.doc_id = tree.doc_id AND o.ref = tree.ctr AND o.kind = 2
                  LEFT JOIN turns d ON d.doc_id = tree.doc_id AND d.ref = tree.ctr AND d.kind = 1) x
            WHERE NOT gone""",
    }
    needs = {"live": ["ops"], "changes": ["ops"], "deps": ["changes"], "tree": ["turns"], "elements": ["tree", "turns"]}
    import re

    wanted: list[str] = []

    def want(name: str) -> None:
        for x in needs.get(name, ()):
            want(x)
        if name not in wanted:
            wanted.append(name)

    for name in named:
        if re.search(rf"\b{name}\b", text):
            want(name)
    if not wanted:
        return text
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text)
    ctes = ", ".join(f"{x} AS ({named[x]})" for x in wanted)
    return f"WITH RECURSIVE {ctes}, {text[own.end():]}" if own else f"WITH RECURSIVE {ctes} {text}"
