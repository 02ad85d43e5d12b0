"""One entry for each query: the Spark callable and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as ch
from ..operators import columns as co
from ..operators import diff as df_
from ..operators import history, maps, marks, merge, mutations, sequence, sync, visibility
from ..schema import ex_id, scalar
from . import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = bridge.duck(sql)
        return f

    return add


def hx(column: str):
    return F.lower(F.hex(column))


def op_columns() -> list:
    """The columns of a map op as they are shown."""
    return ["doc_id", "op_ctr", hx("op_actor").alias("op_actor"), "map_key"]


OP_SQL = "doc_id, ctr AS op_ctr, actor AS op_actor, map_key"
VALUE_SQL = "CASE WHEN action = 1 THEN value END AS value"
EARLY, LATE = (8, 12, 16), (16, 20, 24)


def limit_sql(limits: tuple[int, int, int]) -> str:
    return "(VALUES " + ", ".join(f"('{str(k).rjust(32, '0')}', {n})" for k, n in enumerate(limits)) + ") AS clock(actor, mx)"


def at_sql(limits: tuple[int, int, int], name: str = "seen") -> str:
    """The visible map ops at a clock, as a named table."""
    return f"""{name} AS (SELECT o.* FROM ops o JOIN {limit_sql(limits)} ON o.actor = clock.actor AND o.ctr <= mx
      WHERE action <> 3 AND (s_ctr IS NULL OR s_ctr > mx))"""


def winner_sql(source: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, map_key ORDER BY ctr DESC, actor DESC) AS rn FROM {source}) WHERE rn = 1)"


def live_maps(s, d):
    return visibility.visible(bridge.map_ops(s, d))


def seen_maps(s, d, limits=EARLY):
    ops = bridge.map_ops(s, d)
    return ops, bridge.clock(ops, limits)


# scans and filters


@query(f"SELECT {OP_SQL}, CAST(action AS INT) AS action, {VALUE_SQL}, CASE WHEN action = 5 THEN CAST(floor(value) AS BIGINT) END AS amount, CASE WHEN p_ctr IS NULL THEN 0 ELSE 1 END AS n_pred FROM ops")
def scan_ops(s, d):
    return bridge.map_ops(s, d).select(*op_columns(), F.col("action").cast("int").alias("action"), F.col("value.d").alias("value"), F.col("value.l").alias("amount"), F.size("pred").alias("n_pred"))


@query(f"SELECT {OP_SQL}, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY map_key, ctr, actor) - 1 AS BIGINT) AS row FROM ops")
def ops_sorted(s, d):
    return visibility.numbered(bridge.map_ops(s, d)).select(*op_columns(), "row")


@query(f"SELECT * FROM (SELECT {OP_SQL}, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY map_key, ctr, actor) - 1 AS BIGINT) AS row FROM ops) WHERE row >= 5 AND row < 25")
def op_range(s, d):
    return visibility.op_range(bridge.map_ops(s, d), 5, 25).select(*op_columns(), "row")


@query(f"SELECT r.doc_id, r.op_ctr, r.op_actor, r.map_key, row FROM (SELECT {OP_SQL}, action, s_ctr, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY map_key, ctr, actor) - 1 AS BIGINT) AS row FROM ops) r WHERE row >= 5 AND row < 25 AND s_ctr IS NULL AND action <> 3")
def visible_in_range(s, d):
    return visibility.visible_in_range(bridge.map_ops(s, d), 5, 25).select(*op_columns(), "row")


@query("SELECT doc_id, ctr AS op_ctr, actor AS op_actor, kind = 0 AS insert FROM turns")
def ops_for_obj(s, d):
    return visibility.of_object(bridge.text_ops(s, d), 2, bytes.fromhex(bridge.A3)).select("doc_id", "op_ctr", hx("op_actor").alias("op_actor"), "insert")


@query(f"SELECT {OP_SQL} FROM ops WHERE map_key = 'k3'")
def ops_for_key(s, d):
    return visibility.of_key(bridge.map_ops(s, d), "k3").select(*op_columns())


@query("SELECT doc_id, ctr AS op_ctr, actor AS op_actor FROM turns WHERE (kind = 0 AND ctr = 5) OR (kind <> 0 AND ref = 5)")
def ops_for_element(s, d):
    return visibility.of_element(bridge.text_ops(s, d), 5, bytes.fromhex(bridge.A0)).select("doc_id", "op_ctr", hx("op_actor").alias("op_actor"))


@query(f"SELECT {OP_SQL} FROM live")
def visible_ops(s, d):
    return live_maps(s, d).select(*op_columns())


@query(f"SELECT {OP_SQL} FROM live WHERE map_key = 'k3'")
def visible_for_key(s, d):
    return visibility.of_key(live_maps(s, d), "k3").select(*op_columns())


@query(f"WITH {at_sql(EARLY)} SELECT {OP_SQL} FROM seen")
def visible_at(s, d):
    return visibility.visible_at(*seen_maps(s, d)).select(*op_columns())


@query(f"SELECT o.doc_id, o.ctr AS op_ctr, o.actor AS op_actor, o.map_key FROM ops o JOIN {limit_sql(EARLY)} ON o.actor = clock.actor AND o.ctr <= mx")
def clock_covers(s, d):
    return visibility.covered(*seen_maps(s, d)).select(*op_columns())


@query("SELECT doc_id, p_ctr AS op_ctr, actor AS op_actor, ctr AS succ_ctr, actor AS succ_actor FROM ops WHERE p_ctr IS NOT NULL")
def succ_edges(s, d):
    return visibility.succ_edges(bridge.map_ops(s, d)).select("doc_id", "op_ctr", hx("op_actor").alias("op_actor"), "succ_ctr", hx("succ_actor").alias("succ_actor"))


@query(f"SELECT {OP_SQL}, s_ctr AS succ_ctr FROM ops")
def derive_succ(s, d):
    return visibility.derive_succ(bridge.map_ops(s, d)).select(*op_columns(), F.try_element_at("succ", F.lit(1))["ctr"].alias("succ_ctr"))


@query(f"SELECT {OP_SQL}, p_ctr AS pred_ctr FROM ops")
def derive_pred(s, d):
    return visibility.derive_pred(visibility.derive_succ(bridge.map_ops(s, d))).select(*op_columns(), F.try_element_at("pred", F.lit(1))["ctr"].alias("pred_ctr"))


@query("SELECT doc_id, ctr AS op_ctr, actor AS op_actor, CASE action WHEN 5 THEN 'int' WHEN 3 THEN 'null' ELSE CASE WHEN value IS NULL THEN 'null' ELSE 'float64' END END AS kind, CASE WHEN action = 5 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS shown FROM ops")
def op_to_value(s, d):
    v = visibility.to_value(bridge.map_ops(s, d))
    return v.select("doc_id", "op_ctr", hx("op_actor").alias("op_actor"), "kind", F.when(F.col("kind") == "int", F.col("shown")).alias("shown"))


@query("SELECT action, n, CASE action WHEN 1 THEN 'set' WHEN 3 THEN 'delete' ELSE 'increment' END AS name, FALSE AS makes FROM (SELECT CAST(action AS INT) AS action, count(*) AS n FROM ops GROUP BY action)")
def action_names(s, d):
    a = bridge.map_ops(s, d).groupBy(F.col("action").cast("int").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    return a.select("action", "n", visibility.action_name(F.col("action")).alias("name"), visibility.is_make(F.col("action")).alias("makes"))


@query("SELECT CAST(i AS BIGINT) AS tag, list_extract(['null', 'false', 'true', 'uint', 'int', 'float64', 'string', 'bytes', 'counter', 'timestamp', 'unknown', 'unknown'], i + 1) AS name FROM (SELECT unnest(range(0, 12)) AS i)")
def type_names(s, d):
    return s.range(12).select(F.col("id").alias("tag"), visibility.scalar_name(F.col("id")).alias("name"))


@query(f"SELECT DISTINCT doc_id, id, obj_type FROM (SELECT doc_id, unnest(['_root', '1@{bridge.A3}', '2@{bridge.A3}']) AS id, unnest(['map', 'map', 'text']) AS obj_type FROM turns)")
def obj_types(s, d):
    return visibility.objects(bridge.text_ops(s, d)).select("doc_id", ex_id("obj_ctr", "obj_actor").alias("id"), "obj_type")


@query("SELECT doc_id, CAST(ctr AS VARCHAR) || '@' || actor AS id FROM ops")
def ex_ids(s, d):
    return bridge.map_ops(s, d).select("doc_id", ex_id().alias("id"))


@query("SELECT DISTINCT doc_id, actor FROM ops")
def actors(s, d):
    return visibility.actors(bridge.map_ops(s, d)).select("doc_id", hx("actor").alias("actor"))


@query("SELECT doc_id, actor, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY actor) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT doc_id, actor FROM ops)")
def actor_table(s, d):
    return visibility.actor_table(bridge.map_ops(s, d)).select("doc_id", hx("actor").alias("actor"), "idx")


@query("SELECT doc_id, max(ctr) AS max_op FROM ops GROUP BY doc_id")
def max_op(s, d):
    return visibility.max_op(bridge.map_ops(s, d)).select("doc_id", "max_op")


@query("SELECT doc_id, count(*) AS n_ops FROM ops GROUP BY doc_id")
def op_count(s, d):
    return visibility.max_op(bridge.map_ops(s, d)).select("doc_id", "n_ops")


@query("SELECT doc_id, event_type, CASE WHEN value IS NULL THEN 'null' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS shown FROM ops")
def value_string(s, d):
    v = bridge.raw_ops(s, d).select("doc_id", "event_type", F.when(F.col("value").isNull(), scalar(0)).otherwise(scalar(4, l=F.floor("value"))).alias("v"))
    return v.select("doc_id", "event_type", visibility.value_string(F.col("v")).alias("shown"))


# maps


def totals_sql(limits=None) -> str:
    """What increments of each key add up to, at a clock or now."""
    covered = f"ops o JOIN {limit_sql(limits)} ON o.actor = clock.actor AND o.ctr <= mx" if limits else "ops o"
    return f"(SELECT o.doc_id, o.map_key, CAST(coalesce(sum(floor(o.value)), 0) AS BIGINT) AS total FROM {covered} WHERE o.action = 5 GROUP BY o.doc_id, o.map_key)"


def folded_sql(source: str, limits=None, more: str = "") -> str:
    return f"SELECT w.doc_id, w.ctr AS op_ctr, w.actor AS op_actor, w.map_key, CASE WHEN w.action = 1 THEN w.value END AS value, CASE WHEN w.action = 5 THEN t.total END AS total{more} FROM {winner_sql(source)} w LEFT JOIN {totals_sql(limits)} t ON w.doc_id = t.doc_id AND w.map_key = t.map_key"


def folded_columns() -> list:
    return [*op_columns(), F.col("value.d").alias("value"), F.when(F.col("value.tag") == 8, F.col("value.l")).alias("total")]


PLACE_SQL = ", CAST(row_number() OVER (PARTITION BY w.doc_id ORDER BY w.map_key) - 1 AS BIGINT) AS place"


@query(folded_sql("live"))
def get_winner(s, d):
    return maps.values(bridge.map_ops(s, d)).select(*folded_columns())


@query(f"SELECT {OP_SQL}, {VALUE_SQL} FROM {winner_sql('live')}")
def winning_ops(s, d):
    return maps.winners(live_maps(s, d)).select(*op_columns(), F.col("value.d").alias("value"))


@query(f"SELECT {OP_SQL}, CAST(row_number() OVER (PARTITION BY doc_id, map_key ORDER BY ctr DESC, actor DESC) - 1 AS BIGINT) AS rank FROM live")
def get_all(s, d):
    return maps.all_values(live_maps(s, d)).select(*op_columns(), "rank")


@query("SELECT doc_id, map_key, count(*) AS n FROM live GROUP BY doc_id, map_key HAVING count(*) > 1")
def conflicts(s, d):
    return maps.conflicts(live_maps(s, d)).select("doc_id", "map_key", "n")


@query("SELECT DISTINCT doc_id, map_key FROM live")
def keys(s, d):
    return maps.keys(live_maps(s, d)).select("doc_id", "map_key")


@query("SELECT doc_id, count(DISTINCT map_key) AS length FROM live GROUP BY doc_id")
def length_map(s, d):
    return maps.lengths(live_maps(s, d)).select("doc_id", "length")


@query(folded_sql("live", more=PLACE_SQL))
def map_range(s, d):
    from pyspark.sql import Window as W

    return maps.map_range(bridge.map_ops(s, d)).select(*folded_columns(), (F.row_number().over(W.partitionBy("doc_id").orderBy("map_key")) - 1).cast("long").alias("place"))


@query("SELECT doc_id, map_key, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM ops WHERE action = 5 GROUP BY doc_id, map_key HAVING sum(floor(value)) IS NOT NULL")
def counter_total(s, d):
    return maps.key_sums(bridge.map_ops(s, d)).select("doc_id", "map_key", "total")


@query(f"SELECT DISTINCT doc_id, id, depth, map_key FROM (SELECT doc_id, unnest(['1@{bridge.A3}', '2@{bridge.A3}', '2@{bridge.A3}']) AS id, unnest([0, 0, 1]) AS depth, unnest(['chat', 'turns', 'chat']) AS map_key FROM turns)")
def parents(s, d):
    return maps.parents(bridge.text_ops(s, d)).select("doc_id", ex_id("obj_ctr", "obj_actor").alias("id"), "depth", "map_key")


# history


@query(f"WITH {at_sql(EARLY)} {folded_sql('seen', EARLY)}")
def get_at(s, d):
    return history.get_at(*seen_maps(s, d)).select(*folded_columns())


@query(f"WITH {at_sql(EARLY)} SELECT {OP_SQL}, CAST(row_number() OVER (PARTITION BY doc_id, map_key ORDER BY ctr DESC, actor DESC) - 1 AS BIGINT) AS rank FROM seen")
def get_all_at(s, d):
    return history.get_all_at(*seen_maps(s, d)).select(*op_columns(), "rank")


@query("SELECT DISTINCT doc_id, map_key FROM ops WHERE ctr <= 10 AND action <> 3 AND (s_ctr IS NULL OR s_ctr > 10)")
def keys_at(s, d):
    return history.keys_at(*seen_maps(s, d, (10, 10, 10))).select("doc_id", "map_key")


@query(f"WITH {at_sql(EARLY)} SELECT doc_id, count(DISTINCT map_key) AS length FROM seen GROUP BY doc_id")
def length_at(s, d):
    return history.length_at(*seen_maps(s, d)).select("doc_id", "length")


@query(f"WITH {at_sql(EARLY)} {folded_sql('seen', EARLY, PLACE_SQL)}")
def map_range_at(s, d):
    from pyspark.sql import Window as W

    return history.get_at(*seen_maps(s, d)).select(*folded_columns(), (F.row_number().over(W.partitionBy("doc_id").orderBy("map_key")) - 1).cast("long").alias("place"))


HASH_SQL = "sha256({0}doc_id || ':' || {0}actor || ':' || {0}seq)"
HEADS_SQL = "heads AS (SELECT doc_id, actor, seq FROM changes c WHERE NOT EXISTS (SELECT 1 FROM deps d WHERE d.doc_id = c.doc_id AND d.dep_actor = c.actor AND d.dep_seq = c.seq))"
#: What a read goes back to: each replica's change in the middle of its own.
PAST_SQL = "past AS (SELECT doc_id, actor, CAST(ceil(max(seq) / 2.0) AS BIGINT) AS seq FROM changes GROUP BY doc_id, actor)"


def past(s, d):
    c = bridge.changes(s, d)
    half = c.groupBy("doc_id", "actor").agg(F.ceil(F.max("seq") / 2).alias("seq"))
    return c, c.join(half, ["doc_id", "actor", "seq"]).select("doc_id", "hash")


def reached_sql(start: str) -> str:
    return f"reached AS (SELECT doc_id, actor, seq FROM {start} UNION SELECT d.doc_id, d.dep_actor, d.dep_seq FROM reached r JOIN deps d ON r.doc_id = d.doc_id AND r.actor = d.actor AND r.seq = d.seq)"


@query(f"WITH {HEADS_SQL} SELECT doc_id, {HASH_SQL.format('')} AS hash FROM heads")
def heads(s, d):
    return ch.heads(bridge.changes(s, d)).select("doc_id", hx("hash").alias("hash"))


@query(f"WITH {PAST_SQL}, {reached_sql('past')} SELECT c.doc_id, c.actor, max(c.max_op) AS max_ctr FROM reached r JOIN changes c ON r.doc_id = c.doc_id AND r.actor = c.actor AND r.seq = c.seq GROUP BY c.doc_id, c.actor")
def clock_at(s, d):
    c, at = past(s, d)
    return history.clock_at(history.clocks(c), at).select("doc_id", hx("actor").alias("actor"), "max_ctr")


@query(f"WITH {HEADS_SQL}, {PAST_SQL}, since AS (SELECT h.doc_id, h.actor, h.seq FROM heads h ANTI JOIN past p ON h.doc_id = p.doc_id AND h.actor = p.actor AND h.seq = p.seq UNION SELECT d.doc_id, d.dep_actor, d.dep_seq FROM since r JOIN deps d ON r.doc_id = d.doc_id AND r.actor = d.actor AND r.seq = d.seq ANTI JOIN past p ON d.doc_id = p.doc_id AND d.dep_actor = p.actor AND d.dep_seq = p.seq) SELECT doc_id, {HASH_SQL.format('')} AS hash FROM since")
def changes_since(s, d):
    return ch.since(*past(s, d)).select("doc_id", hx("hash").alias("hash"))


@query(f"WITH {PAST_SQL}, {reached_sql('past')} SELECT doc_id, {HASH_SQL.format('')} AS hash FROM changes c ANTI JOIN reached r ON r.doc_id = c.doc_id AND r.actor = c.actor AND r.seq = c.seq")
def sync_to_send(s, d):
    return ch.lacking(*past(s, d)).select("doc_id", hx("hash").alias("hash"))


@query(f"SELECT doc_id, {HASH_SQL.format('')} AS hash FROM changes WHERE seq % 3 = 0")
def sync_need(s, d):
    c = bridge.changes(s, d)
    return ch.shared_heads(c, c.where("seq % 3 = 0")).select("doc_id", hx("hash").alias("hash"))


@query("SELECT DISTINCT d.doc_id, sha256(d.doc_id || ':' || dep_actor || ':' || dep_seq) AS hash FROM deps d WHERE d.seq % 4 <> 0 AND dep_seq % 4 = 0")
def missing_deps(s, d):
    c = bridge.changes(s, d).where("seq % 4 <> 0")
    return ch.missing(c, c.limit(0)).select("doc_id", hx("hash").alias("hash"))


@query("WITH numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY max_op, actor, seq) - 1 AS BIGINT) AS idx FROM changes) SELECT d.doc_id, a.idx, b.idx AS dep_idx FROM deps d JOIN numbered a ON a.doc_id = d.doc_id AND a.actor = d.actor AND a.seq = d.seq JOIN numbered b ON b.doc_id = d.doc_id AND b.actor = d.dep_actor AND b.seq = d.dep_seq")
def deps_index(s, d):
    return ch.deps_index(bridge.changes(s, d))


@query(f"WITH {HEADS_SQL}, a AS (SELECT doc_id, string_agg(actor || seq, ',' ORDER BY actor, seq) AS x FROM heads GROUP BY doc_id), b AS (SELECT doc_id, string_agg(actor || seq, ',' ORDER BY actor, seq) AS x FROM (SELECT doc_id, actor, max(seq) AS seq FROM changes GROUP BY doc_id, actor) GROUP BY doc_id) SELECT a.doc_id, a.x = b.x AS equal FROM a JOIN b ON a.doc_id = b.doc_id")
def heads_equal(s, d):
    c = bridge.changes(s, d)
    last = c.groupBy("doc_id", "actor").agg(F.max_by("hash", "seq").alias("hash"))
    return ch.heads_equal(ch.heads(c), last)


@query(f"SELECT doc_id, actor, seq, {HASH_SQL.format('')} AS hash FROM changes")
def change_hash(s, d):
    return bridge.changes(s, d).select("doc_id", hx("actor").alias("actor"), "seq", hx("hash").alias("hash"))


# sequences


@query("SELECT doc_id, elem_ctr, w_ctr, w_actor, pos, idx FROM elements")
def list_elements(s, d):
    return sequence.elements(bridge.text_ops(s, d)).select("doc_id", "elem_ctr", F.col("op_ctr").alias("w_ctr"), hx("op_actor").alias("w_actor"), "pos", "idx")


@query("SELECT doc_id, idx, s AS value FROM elements")
def list_items(s, d):
    return sequence.elements(bridge.text_ops(s, d)).select("doc_id", "idx", F.col("value.s").alias("value"))


@query("SELECT doc_id, idx, s AS value FROM elements WHERE idx = 1")
def list_get(s, d):
    return sequence.item(sequence.elements(bridge.text_ops(s, d)), 1).select("doc_id", "idx", F.col("value.s").alias("value"))


@query("SELECT doc_id, elem_ctr, w_ctr FROM elements")
def elem_winner(s, d):
    w = sequence.element_winners(visibility.visible(bridge.text_ops(s, d)))
    return w.select("doc_id", "elem_ctr", F.col("op_ctr").alias("w_ctr"))


@query("SELECT doc_id, count(*) AS length FROM elements GROUP BY doc_id")
def length_seq(s, d):
    return sequence.lengths(sequence.elements(bridge.text_ops(s, d))).select("doc_id", "length")


@query("SELECT doc_id, md5(string_agg(coalesce(s, ''), '' ORDER BY idx)) AS text_md5 FROM elements GROUP BY doc_id")
def text(s, d):
    return sequence.text(sequence.elements(bridge.text_ops(s, d))).select("doc_id", F.md5("text").alias("text_md5"))


#: A clock that has seen the first five turns, no deletion, and the overwrites.
TEXT_CLOCK = (7, 0, 9999, 9)
EARLY_ELEMENTS = """early AS (SELECT doc_id, elem_ctr, coalesce(o_s, s) AS s, coalesce(o_ctr, elem_ctr) AS w_ctr, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS BIGINT) AS idx
  FROM (SELECT tree.doc_id, tree.ctr AS elem_ctr, tree.path, i.s, o.s AS o_s, o.ctr AS o_ctr FROM tree JOIN turns i ON i.doc_id = tree.doc_id AND i.ctr = tree.ctr AND i.kind = 0
        LEFT JOIN turns o ON o.doc_id = tree.doc_id AND o.ref = tree.ctr AND o.kind = 2 WHERE tree.ctr <= 7) x)"""


def text_at_clock(s, d):
    ops = bridge.text_ops(s, d)
    return ops, bridge.clock(ops, TEXT_CLOCK)


@query(f"WITH {EARLY_ELEMENTS} SELECT doc_id, elem_ctr, w_ctr, idx FROM early")
def list_elements_at(s, d):
    return history.elements_at(*text_at_clock(s, d)).select("doc_id", "elem_ctr", F.col("op_ctr").alias("w_ctr"), "idx")


@query(f"WITH {EARLY_ELEMENTS} SELECT doc_id, idx, s AS value FROM early")
def list_items_at(s, d):
    return history.elements_at(*text_at_clock(s, d)).select("doc_id", "idx", F.col("value.s").alias("value"))


@query(f"WITH {EARLY_ELEMENTS} SELECT doc_id, md5(string_agg(coalesce(s, ''), '' ORDER BY idx)) AS text_md5 FROM early GROUP BY doc_id")
def text_at(s, d):
    return history.text_at(*text_at_clock(s, d)).select("doc_id", F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, idx, CAST(elem_ctr AS VARCHAR) || '@{bridge.A0}' AS cursor FROM elements")
def cursor_get(s, d):
    return sequence.cursors(sequence.elements(bridge.text_ops(s, d))).select("doc_id", "idx", "cursor")


@query("SELECT doc_id, 'op' AS kind, elem_ctr AS ctr, FALSE AS before FROM elements")
def cursor_string(s, d):
    c = sequence.cursors(sequence.elements(bridge.text_ops(s, d)))
    return c.select("doc_id", sequence.parse_cursor(F.col("cursor")).alias("c")).select("doc_id", "c.kind", "c.ctr", "c.before")


CURSORS = ["s", "e", f"4@{bridge.A0}", f"7@{bridge.A0}", f"-7@{bridge.A0}"]


@query(f"""WITH docs AS (SELECT doc_id, count(*) AS length FROM elements GROUP BY doc_id), places AS (
  SELECT t.doc_id, t.ctr, e.idx AS own, (SELECT count(*) FROM elements x WHERE x.doc_id = t.doc_id AND x.pos < t.pos) AS n
  FROM (SELECT doc_id, ctr, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS pos FROM tree) t LEFT JOIN elements e ON e.doc_id = t.doc_id AND e.elem_ctr = t.ctr)
SELECT doc_id, 's' AS cursor, CAST(0 AS BIGINT) AS position FROM docs UNION ALL SELECT doc_id, 'e', length FROM docs
UNION ALL SELECT docs.doc_id, ctr || '@{bridge.A0}', coalesce(own, n) FROM docs LEFT JOIN places p ON p.doc_id = docs.doc_id AND ctr IN (4, 7) WHERE ctr IS NOT NULL
UNION ALL SELECT docs.doc_id, '-7@{bridge.A0}', coalesce(own, greatest(n - 1, 0)) FROM docs JOIN places p ON p.doc_id = docs.doc_id AND ctr = 7""")
def cursor_position(s, d):
    ops = bridge.text_ops(s, d)
    wanted = sequence.text_objects(ops).select("*", F.explode(F.array(*map(F.lit, CURSORS))).alias("cursor"))
    return sequence.cursor_positions(ops, wanted).where("position is not null").select("doc_id", "cursor", "position")


# marks

MARKS_SQL = """found AS (SELECT d.doc_id, 'bold' AS name, CAST(0 AS BIGINT) AS start, coalesce(e.idx + 1, n) AS stop FROM (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id) d LEFT JOIN elements e ON e.doc_id = d.doc_id AND e.elem_ctr = 4
  UNION ALL SELECT d.doc_id, 'note', coalesce(e.idx + 1, 0), n FROM (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id) d LEFT JOIN elements e ON e.doc_id = d.doc_id AND e.elem_ctr = 3)"""


@query(f"WITH {MARKS_SQL} SELECT * FROM found WHERE start < stop")
def marks_(s, d):
    return marks.ranges(bridge.text_ops(s, d, marks=True)).select("doc_id", "name", "start", "stop")


@query(f"WITH {MARKS_SQL} SELECT doc_id, name, start, stop FROM found WHERE start <= 1 AND stop > 1")
def marks_at_position(s, d):
    return marks.at_position(marks.ranges(bridge.text_ops(s, d, marks=True)), 1).select("doc_id", "name", "start", "stop")


@query("WITH " + MARKS_SQL.replace("FROM elements GROUP", "FROM early GROUP").replace("JOIN elements e", "JOIN early e").replace("found AS", EARLY_ELEMENTS + ", found AS") + " SELECT doc_id, name, start, stop FROM found WHERE start < stop")
def marks_at(s, d):
    ops = bridge.text_ops(s, d, marks=True)
    return marks.ranges(ops, bridge.clock(ops, (7, 0, 9999, 9999))).select("doc_id", "name", "start", "stop")


@query(f"WITH {MARKS_SQL} SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM found WHERE start < stop GROUP BY doc_id")
def mark_set(s, d):
    m = marks.mark_set(marks.ranges(bridge.text_ops(s, d, marks=True)))
    return m.select("doc_id", F.size("marks").cast("long").alias("n"), F.array_join(F.array_sort(F.map_keys("marks")), ",").alias("names"))


# differences

TOTAL = "(SELECT w.*, t.total FROM {0} w LEFT JOIN {1} t ON w.doc_id = t.doc_id AND w.map_key = t.map_key)"
DIFF_SQL = f"""{at_sql(EARLY, 'seen')}, {at_sql(LATE, 'later')}, a AS {TOTAL.format(winner_sql('seen'), totals_sql(EARLY))}, b AS {TOTAL.format(winner_sql('later'), totals_sql(LATE))}"""


@query(f"""WITH {DIFF_SQL} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.map_key, b.map_key) AS map_key, CASE WHEN b.ctr IS NULL THEN 'deleteMap' ELSE 'putMap' END AS patch, b.ctr AS op_ctr
FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.map_key = b.map_key
WHERE a.ctr IS NULL OR b.ctr IS NULL OR NOT ((a.ctr = b.ctr AND a.actor = b.actor AND b.action <> 5) OR (a.action = b.action AND (CASE WHEN a.action = 5 THEN a.total ELSE a.value END) IS NOT DISTINCT FROM (CASE WHEN b.action = 5 THEN b.total ELSE b.value END)))""")
def diff_map(s, d):
    ops = bridge.map_ops(s, d)
    return df_.diff_maps(ops, bridge.clock(ops, EARLY), bridge.clock(ops, LATE)).select("doc_id", "map_key", "patch", "op_ctr")


@query(f"""WITH {EARLY_ELEMENTS} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(a.elem_ctr) - count(CASE WHEN b.elem_ctr IS NOT NULL THEN a.elem_ctr END) AS deleted, count(b.elem_ctr) - count(CASE WHEN a.elem_ctr IS NOT NULL THEN b.elem_ctr END) AS inserted
FROM early a FULL OUTER JOIN elements b ON a.doc_id = b.doc_id AND a.elem_ctr = b.elem_ctr GROUP BY 1""")
def diff_seq(s, d):
    ops, old = text_at_clock(s, d)
    return df_.diff_counts(ops, old, bridge.clock(ops, (9999, 9999, 9999, 9999))).select("doc_id", "deleted", "inserted")


@query(f"""WITH {EARLY_ELEMENTS}, gone AS (SELECT a.doc_id, 'deleteSeq' AS patch, a.idx FROM early a ANTI JOIN elements b ON a.doc_id = b.doc_id AND a.elem_ctr = b.elem_ctr),
  new AS (SELECT b.doc_id, 'insert' AS patch, b.idx FROM elements b ANTI JOIN early a ON a.doc_id = b.doc_id AND a.elem_ctr = b.elem_ctr),
  both_ AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id, patch ORDER BY idx) AS island FROM (SELECT * FROM gone UNION ALL SELECT * FROM new))
SELECT doc_id, 2 AS depth, 'chat/turns' AS path, patch, CAST(min(idx) AS VARCHAR) AS at, count(*) AS n FROM both_ GROUP BY doc_id, patch, island""")
def diff(s, d):
    ops, old = text_at_clock(s, d)
    return df_.diff(ops, old, bridge.clock(ops, (9999, 9999, 9999, 9999))).select("doc_id", "depth", "path", "patch", "at", "n")


# merging


def halves(s, d):
    """Two replicas' copies of the events' ops: each has all of one actor's, and the early ones of the others."""
    ops = bridge.map_ops(s, d)
    first = F.hex("op_actor").endswith("0")
    return ops, ops.where(first | (F.col("op_ctr") <= 10)), ops.where(~first | (F.col("op_ctr") <= 10))


@query(f"SELECT {OP_SQL} FROM ops")
def merge_ops(s, d):
    _, a, b = halves(s, d)
    return merge.merge_ops(a, b).select(*op_columns())


@query(f"SELECT {OP_SQL} FROM ops WHERE right(actor, 1) = '0' AND ctr > 10")
def merge_new_ops(s, d):
    _, a, b = halves(s, d)
    return merge.new_ops(a, b).select(*op_columns())


@query(f"WITH {HEADS_SQL} SELECT doc_id, {HASH_SQL.format('')} AS hash FROM heads")
def merge_heads(s, d):
    c = bridge.changes(s, d)
    return merge.merge_heads(c.where("seq % 2 = 0"), c.where("seq % 2 = 1 or seq % 3 = 0")).select("doc_id", hx("hash").alias("hash"))


@query(f"SELECT doc_id, {HASH_SQL.format('')} AS hash FROM changes")
def merge_changes(s, d):
    """Two replicas that together hold every change, and both hold every sixth."""
    c = bridge.changes(s, d)
    return merge.merge_changes(c.where("seq % 2 = 0 or seq % 3 = 1"), c.where("seq % 2 = 1")).select("doc_id", hx("hash").alias("hash"))


@query("SELECT doc_id + 1000000 AS doc_id, count(*) AS n_ops, max(ctr) AS max_op FROM ops GROUP BY doc_id")
def fork(s, d):
    ops = bridge.map_ops(s, d)
    to = ops.select("doc_id").distinct().withColumn("new_doc_id", F.col("doc_id") + 1_000_000)
    return visibility.max_op(merge.fork(ops, to)).select("doc_id", "n_ops", "max_op")


# positional columns: by document, what its events hold in order


def column(s, d, value):
    return co.number(bridge.raw_ops(s, d), F.expr(value), "event_id")


AMOUNT, KIND, CLICK = "floor(value)", "event_type", "event_type = 'click'"
COL_SQL = "col AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY event_id) - 1 AS BIGINT) AS pos, CAST(floor(value) AS BIGINT) AS v, event_type AS k, event_type = 'click' AS c FROM ops)"
ACC_SQL = f"{COL_SQL}, acc AS (SELECT *, CAST(sum(coalesce(v, 0)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS acc_after FROM col)"
RUN_SQL = f"{COL_SQL}, marked AS (SELECT *, CASE WHEN lag(k) OVER w IS DISTINCT FROM k OR pos = 0 THEN 1 ELSE 0 END AS new FROM col WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), isle AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marked), runs AS (SELECT doc_id, min(pos) AS start, count(*) AS n, first(k) AS v FROM isle GROUP BY doc_id, island)"


@query(f"WITH {COL_SQL} SELECT doc_id, v FROM col WHERE pos = 3")
def col_get(s, d):
    return co.get(column(s, d, AMOUNT), 3).select("doc_id", "v")


@query(f"WITH {ACC_SQL} SELECT doc_id, pos, acc_after - coalesce(v, 0) AS acc FROM acc")
def col_acc(s, d):
    return co.accumulate(column(s, d, AMOUNT)).select("doc_id", "pos", F.col("acc_before").alias("acc"))


@query(f"WITH {COL_SQL} SELECT doc_id, CAST(sum(CASE WHEN c THEN 1 ELSE 0 END) AS BIGINT) AS acc, count(*) AS n FROM col GROUP BY doc_id")
def col_total(s, d):
    return co.total(column(s, d, CLICK))


@query(f"WITH {ACC_SQL} SELECT doc_id, pos, k AS v, acc_after - coalesce(v, 0) AS acc_before, acc_after FROM acc")
def col_group_acc(s, d):
    a = co.accumulate(column(s, d, AMOUNT)).select("doc_id", "pos", "acc_before", "acc_after")
    return a.join(column(s, d, KIND), ["doc_id", "pos"]).select("doc_id", "pos", "v", "acc_before", "acc_after")


@query(f"WITH {ACC_SQL} SELECT doc_id, min(pos) AS pos FROM acc WHERE acc_after >= 500 GROUP BY doc_id")
def acc_seek(s, d):
    return co.seek(column(s, d, AMOUNT), 500)


@query(f"WITH {COL_SQL}, cut AS (SELECT doc_id, CASE WHEN pos < 2 THEN 0 ELSE 2 END AS side, pos AS k2, v FROM col WHERE pos < 2 OR pos >= 5 UNION ALL SELECT doc_id, 1, k, -k FROM (SELECT DISTINCT doc_id FROM col), (SELECT unnest([0, 1]) AS k)) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY side, k2) - 1 AS BIGINT) AS pos, v FROM cut")
def col_splice(s, d):
    c = column(s, d, AMOUNT)
    new = c.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("v", (-F.col("k")).cast("long"))
    return co.splice(c, 2, 3, new)


@query(f"WITH {COL_SQL} SELECT doc_id, NOT bool_or(pos = 7) AS equal FROM col GROUP BY doc_id")
def col_equal(s, d):
    c = column(s, d, KIND)
    return co.equal(c, c.withColumn("v", F.when(F.col("pos") == 7, "other").otherwise(F.col("v"))))


@query("WITH sorted AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY event_type, event_id) - 1 AS BIGINT) AS pos, event_type AS v FROM ops) SELECT doc_id, min(pos) AS start, max(pos) + 1 AS stop FROM sorted WHERE v = 'purchase' GROUP BY doc_id")
def col_scope(s, d):
    r = bridge.raw_ops(s, d).select("doc_id", F.struct("event_type", "event_id").alias("o"))
    return co.scope(co.number(r, F.col("o.event_type"), "o"), F.lit("purchase"))


@query(f"WITH {COL_SQL} SELECT doc_id, pos FROM col WHERE v = 10")
def find_value(s, d):
    return co.find(column(s, d, AMOUNT), F.lit(10)).select("doc_id", "pos")


@query(f"WITH {COL_SQL} SELECT doc_id, pos, v FROM col WHERE v >= 10 AND v < 20")
def find_range(s, d):
    return co.find(column(s, d, AMOUNT), F.lit(10), F.lit(20)).select("doc_id", "pos", "v")


@query(f"WITH {COL_SQL} SELECT doc_id, pos, v * 2 + 1 AS v FROM col")
def col_remap(s, d):
    return co.remap(column(s, d, AMOUNT), lambda v: v * 2 + 1)


@query(f"WITH {RUN_SQL} SELECT * FROM runs")
def rle_runs(s, d):
    return co.runs(column(s, d, KIND)).select("doc_id", "start", "n", "v")


@query(f"WITH {COL_SQL} SELECT doc_id, pos, k AS v FROM col")
def rle_expand(s, d):
    return co.expand(co.runs(column(s, d, KIND)))


@query(f"WITH {RUN_SQL} SELECT doc_id, start + n - 4 AS n, v FROM runs WHERE start <= 4 AND start + n > 4")
def next_runs(s, d):
    return co.next_runs(column(s, d, KIND), 4)


@query(f"WITH {RUN_SQL}, k AS (SELECT *, CASE WHEN n > 1 THEN 'run' ELSE 'literal' END AS kind FROM runs), m AS (SELECT *, CASE WHEN kind = 'run' OR lag(kind) OVER (PARTITION BY doc_id ORDER BY start) IS DISTINCT FROM 'literal' THEN 1 ELSE 0 END AS new2 FROM k), g AS (SELECT *, sum(new2) OVER (PARTITION BY doc_id ORDER BY start) AS seg FROM m) SELECT doc_id, min(start) AS start, kind, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY doc_id, seg, kind")
def rle_segments(s, d):
    return co.encoded_runs(column(s, d, KIND))


@query(f"WITH {COL_SQL} SELECT doc_id, pos, v - coalesce(lag(v IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS v FROM col")
def delta_encode(s, d):
    return co.deltas(column(s, d, AMOUNT))


@query(f"WITH {COL_SQL} SELECT doc_id, pos, v FROM col")
def delta_decode(s, d):
    return co.undelta(co.deltas(column(s, d, AMOUNT)))


@query(f"WITH {COL_SQL}, m AS (SELECT *, CASE WHEN pos = 0 OR lag(c) OVER (PARTITION BY doc_id ORDER BY pos) <> c THEN 1 ELSE 0 END AS new FROM col), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM m), r AS (SELECT doc_id, min(pos) AS start, count(*) AS n, bool_or(c) AS c FROM i GROUP BY doc_id, island), z AS (SELECT doc_id, start, n FROM r UNION ALL SELECT doc_id, -1, 0 FROM r WHERE start = 0 AND c) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS BIGINT) AS k, n FROM z")
def bool_runs(s, d):
    return co.bool_runs(column(s, d, CLICK))


@query(f"WITH {COL_SQL} SELECT doc_id, pos // 64 AS block, count(*) AS n, min(v) AS low, max(v) AS high, CAST(sum(v) AS BIGINT) AS sum FROM col GROUP BY doc_id, pos // 64")
def zone_map(s, d):
    return co.zone_map(column(s, d, AMOUNT))


@query("SELECT event_id, CASE WHEN event_id * event_id < 128 THEN 1 WHEN event_id * event_id < 16384 THEN 2 WHEN event_id * event_id < 2097152 THEN 3 WHEN event_id * event_id < 268435456 THEN 4 WHEN event_id * event_id < 34359738368 THEN 5 ELSE 6 END::BIGINT AS bytes FROM events")
def uleb_size(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    return e.select("event_id", co.unsigned_size(F.col("event_id") * F.col("event_id")).alias("bytes"))


@query("SELECT event_id, CASE WHEN v BETWEEN -64 AND 63 THEN 1 WHEN v BETWEEN -8192 AND 8191 THEN 2 WHEN v BETWEEN -1048576 AND 1048575 THEN 3 WHEN v BETWEEN -134217728 AND 134217727 THEN 4 ELSE 5 END::BIGINT AS bytes FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * event_id ELSE -event_id * event_id END AS v FROM events)")
def sleb_size(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    return e.select("event_id", co.signed_size(F.when(F.col("event_id") % 2 == 0, F.col("event_id") * F.col("event_id")).otherwise(-F.col("event_id") * F.col("event_id"))).alias("bytes"))


@query("SELECT event_id, event_id & 15 AS tag, event_id >> 4 AS length FROM events")
def value_meta(s, d):
    tag, length = co.value_meta(F.col("event_id"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", tag.alias("tag"), length.alias("length"))


@query(f"WITH o AS (SELECT {OP_SQL}, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY map_key, ctr, actor) - 1 AS BIGINT) AS row FROM ops) SELECT doc_id, op_ctr, op_actor, CASE WHEN row < 2 THEN row ELSE row - 3 END AS row FROM o WHERE row < 2 OR row >= 5")
def ops_splice(s, d):
    rows = visibility.numbered(bridge.map_ops(s, d)).select("doc_id", F.col("row").alias("pos"), F.struct("op_ctr", "op_actor").alias("v"))
    out = co.splice(rows, 2, 3, rows.limit(0).select("doc_id", F.col("pos").alias("k"), "v"))
    return out.select("doc_id", "v.op_ctr", hx("v.op_actor").alias("op_actor"), F.col("pos").alias("row"))


@query("WITH t AS (SELECT doc_id, actor, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY actor) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT doc_id, actor FROM ops)) SELECT o.doc_id, o.ctr AS op_ctr, CASE WHEN t.idx >= 1 THEN t.idx + 1 ELSE t.idx END AS idx FROM ops o JOIN t ON o.doc_id = t.doc_id AND o.actor = t.actor")
def actor_rewrite(s, d):
    ops = bridge.map_ops(s, d)
    at = ops.join(visibility.actor_table(ops).withColumnRenamed("actor", "op_actor"), ["doc_id", "op_actor"])
    return at.select("doc_id", "op_ctr", F.when(F.col("idx") >= 1, F.col("idx") + 1).otherwise(F.col("idx")).alias("idx"))


# edits

ME_SQL = "'" + "f" * 32 + "'"


def me():
    return F.unhex(F.lit("f" * 32))


def commands(ops, *more):
    """Two commands for each document, on k1 and k2 of the root."""
    pair = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("map_key")) for n, k in enumerate(("k1", "k2"))]))
    c = ops.select("doc_id").distinct().select("doc_id", pair.alias("c")).select("doc_id", "c", "c.*")
    return c.select("doc_id", "n", "map_key", F.lit(None).cast("long").alias("obj_ctr"), F.lit(None).cast("binary").alias("obj_actor"), me().alias("actor"), *more)


EDIT_SQL = "tops AS (SELECT doc_id, max(ctr) AS top FROM ops GROUP BY doc_id), held AS (SELECT doc_id, map_key, count(*) AS n_pred FROM live GROUP BY doc_id, map_key), cmd AS (SELECT doc_id, top, unnest([0, 1]) AS n, unnest(['k1', 'k2']) AS map_key FROM tops)"
THERE_SQL = f"{EDIT_SQL}, there AS (SELECT c.doc_id, c.top, c.map_key, h.n_pred, row_number() OVER (PARTITION BY c.doc_id ORDER BY n) AS k FROM cmd c JOIN held h ON c.doc_id = h.doc_id AND c.map_key = h.map_key)"


def new_columns() -> list:
    return ["doc_id", "op_ctr", hx("op_actor").alias("op_actor"), "map_key", F.col("action").cast("int").alias("action"), F.size("pred").cast("long").alias("n_pred")]


@query(f"WITH {EDIT_SQL} SELECT c.doc_id, top + n + 1 AS op_ctr, {ME_SQL} AS op_actor, c.map_key, 1 AS action, coalesce(n_pred, 0) AS n_pred FROM cmd c LEFT JOIN held h ON c.doc_id = h.doc_id AND c.map_key = h.map_key")
def put(s, d):
    ops = bridge.map_ops(s, d)
    return mutations.put(ops, commands(ops, scalar(4, l=F.lit(7)).alias("value"))).select(*new_columns())


@query(f"WITH {EDIT_SQL} SELECT c.doc_id, top + n + 1 AS op_ctr, {ME_SQL} AS op_actor, c.map_key, 2 AS action, coalesce(n_pred, 0) AS n_pred FROM cmd c LEFT JOIN held h ON c.doc_id = h.doc_id AND c.map_key = h.map_key")
def put_object(s, d):
    ops = bridge.map_ops(s, d)
    return mutations.put_object(ops, commands(ops, F.lit(2).alias("action"))).select(*new_columns())


@query(f"WITH {THERE_SQL} SELECT doc_id, top + k AS op_ctr, {ME_SQL} AS op_actor, map_key, 3 AS action, n_pred FROM there")
def delete_key(s, d):
    ops = bridge.map_ops(s, d)
    return mutations.delete_keys(ops, commands(ops)).select(*new_columns())


@query(f"WITH {THERE_SQL} SELECT doc_id, top + k AS op_ctr, {ME_SQL} AS op_actor, map_key, 5 AS action, n_pred FROM there")
def increment(s, d):
    ops = bridge.map_ops(s, d)
    return mutations.increment(ops, commands(ops, F.lit(3).alias("by"))).select(*new_columns())


def text_command(ops, *more):
    return sequence.text_objects(ops).select("*", me().alias("actor"), *more)


TOP_TEXT = "tops AS (SELECT doc_id, max(ctr) AS top FROM turns GROUP BY doc_id)"


def new_elements() -> list:
    return ["doc_id", "op_ctr", "elem_ctr", "insert", F.col("action").cast("int").alias("action"), F.col("value.s").alias("value")]


@query(f"WITH {TOP_TEXT} SELECT t.doc_id, top + 1 AS op_ctr, e.elem_ctr, TRUE AS insert, 1 AS action, 'new' AS value FROM tops t JOIN elements e ON e.doc_id = t.doc_id AND e.idx = 0")
def insert_at(s, d):
    ops = bridge.text_ops(s, d)
    return mutations.insert(ops, text_command(ops, F.lit(1).cast("long").alias("idx"), scalar(6, s=F.lit("new")).alias("value"))).select(*new_elements())


SPLICE_SQL = f"""WITH {TOP_TEXT}, ok AS (SELECT e.doc_id, top FROM elements e JOIN tops t ON e.doc_id = t.doc_id WHERE idx = 1)
SELECT ok.doc_id, top + 1 AS op_ctr, e.elem_ctr, FALSE AS insert, 3 AS action, NULL AS value FROM ok JOIN elements e ON e.doc_id = ok.doc_id AND e.idx = 1
UNION ALL SELECT ok.doc_id, top + 2, e.elem_ctr, TRUE, 1, {{a}} FROM ok JOIN elements e ON e.doc_id = ok.doc_id AND e.idx = 0
UNION ALL SELECT ok.doc_id, top + 3, top + 2, TRUE, 1, {{b}} FROM ok"""


@query(SPLICE_SQL.format(a="'a'", b="'b'"))
def splice(s, d):
    ops = bridge.text_ops(s, d)
    values = F.array(scalar(6, s=F.lit("a")), scalar(6, s=F.lit("b")))
    return mutations.splice(ops, text_command(ops, F.lit(1).cast("long").alias("pos"), F.lit(1).alias("del"), values.alias("values"))).select(*new_elements())


#: Two commands on each text: the second, at 0, comes after the first, at 1, which it has nothing to do with.
TWO_SQL = f"""WITH {TOP_TEXT}, first AS (SELECT e.doc_id, top FROM elements e JOIN tops t ON e.doc_id = t.doc_id WHERE idx = 1), second AS (SELECT t.doc_id, top + CASE WHEN f.top IS NULL THEN 0 ELSE 3 END AS top FROM tops t SEMI JOIN (SELECT doc_id FROM elements) e ON e.doc_id = t.doc_id LEFT JOIN first f USING (doc_id, top))
SELECT f.doc_id, top + 1 AS op_ctr, e.elem_ctr, FALSE AS insert, 3 AS action, NULL AS value FROM first f JOIN elements e ON e.doc_id = f.doc_id AND e.idx = 1
UNION ALL SELECT f.doc_id, top + 2, e.elem_ctr, TRUE, 1, 'é' FROM first f JOIN elements e ON e.doc_id = f.doc_id AND e.idx = 0
UNION ALL SELECT f.doc_id, top + 3, top + 2, TRUE, 1, '😀' FROM first f
UNION ALL SELECT s.doc_id, top + 1, e.elem_ctr, FALSE, 3, NULL FROM second s JOIN elements e ON e.doc_id = s.doc_id AND e.idx = 0
UNION ALL SELECT s.doc_id, top + 2, NULL, TRUE, 1, 'x' FROM second s
UNION ALL SELECT s.doc_id, top + 3, top + 2, TRUE, 1, 'y' FROM second s"""


@query(TWO_SQL)
def splice_text(s, d):
    ops = bridge.text_ops(s, d)
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).cast("long").alias("pos"), F.lit(1).alias("del"), F.lit(t).alias("text")) for n, p, t in ((0, 1, "é😀"), (1, 0, "xy"))]))
    return mutations.splice_text(ops, text_command(ops, both.alias("c")).select("*", "c.*").drop("c")).select(*new_elements())


@query(f"WITH {TOP_TEXT} SELECT t.doc_id, top + 1 AS op_ctr, e.elem_ctr, TRUE AS insert, 2 AS action, NULL AS value FROM tops t JOIN elements e ON e.doc_id = t.doc_id AND e.idx = 0")
def insert_object(s, d):
    ops = bridge.text_ops(s, d)
    return mutations.insert_object(ops, text_command(ops, F.lit(1).cast("long").alias("idx"), F.lit(2).alias("action"))).select(*new_elements())


NESTED = '[{"a": [true, "z"]}, {"$": "text", "value": "hé"}, {"$": "counter", "value": 5}]'
#: The op rows of NESTED after one deletion: (offset, offset of the object or 0 for the text, key, offset of the reference or 0 for the element before, insert, action).
NESTED_ROWS = "(2, 0, NULL, 0, TRUE, 0), (3, 2, 'a', -1, FALSE, 2), (4, 3, NULL, -1, TRUE, 1), (5, 3, NULL, 4, TRUE, 1), (6, 0, NULL, 2, TRUE, 4), (7, 6, NULL, -1, TRUE, 1), (8, 6, NULL, 7, TRUE, 1), (9, 0, NULL, 6, TRUE, 1)"


@query(f"""WITH {TOP_TEXT}, ok AS (SELECT e.doc_id, top FROM elements e JOIN tops t ON e.doc_id = t.doc_id WHERE idx = 1)
SELECT ok.doc_id, top + o AS op_ctr, CASE WHEN p > 0 THEN top + p ELSE 2 END AS obj_ctr, k AS map_key, CASE WHEN r > 0 THEN top + r WHEN r = 0 THEN e.elem_ctr END AS elem_ctr, i AS insert, a AS action
FROM ok JOIN elements e ON e.doc_id = ok.doc_id AND e.idx = 0, (VALUES {NESTED_ROWS}) AS t(o, p, k, r, i, a)
UNION ALL SELECT ok.doc_id, top + 1, 2, NULL, e.elem_ctr, FALSE, 3 FROM ok JOIN elements e ON e.doc_id = ok.doc_id AND e.idx = 1""")
def splice_values(s, d):
    ops = bridge.text_ops(s, d)
    c = text_command(ops, F.lit(1).cast("long").alias("pos"), F.lit(1).alias("del"), F.lit(NESTED).alias("trees"))
    return mutations.splice_trees(ops, c).select("doc_id", "op_ctr", "obj_ctr", "map_key", "elem_ctr", "insert", F.col("action").cast("int").alias("action"))


@query(f"WITH {TOP_TEXT}, ok AS (SELECT e.doc_id, top FROM elements e JOIN tops t ON e.doc_id = t.doc_id WHERE idx = 1) SELECT ok.doc_id, top + 1 AS op_ctr, e.elem_ctr, 'em' AS mark_name FROM ok JOIN elements e ON e.doc_id = ok.doc_id AND e.idx = 0 UNION ALL SELECT ok.doc_id, top + 2, e.elem_ctr, NULL FROM ok JOIN elements e ON e.doc_id = ok.doc_id AND e.idx = 1")
def mark(s, d):
    ops = bridge.text_ops(s, d)
    c = text_command(ops, F.lit(0).alias("n"), F.lit(1).cast("long").alias("start"), F.lit(2).cast("long").alias("stop"), F.lit("em").alias("name"), scalar(2).alias("value"), F.lit(False).alias("expand"))
    return mutations.mark(ops, c).select("doc_id", "op_ctr", "elem_ctr", "mark_name")


TREE = '{"b": [1, {"x": "y"}, null], "a": 2.5, "c": {}, "t": {"$": "text", "value": "é!"}}'
#: The op rows of TREE, breadth first, and of a counter set at the same key: (offset, offset of the object, key, offset of the reference, insert, action, offset of what it overwrites).
TREE_ROWS = "(1, 0, 'tree', 0, FALSE, 0, 0), (2, 1, 'a', 0, FALSE, 1, 0), (3, 1, 'b', 0, FALSE, 2, 0), (4, 1, 'c', 0, FALSE, 0, 0), (5, 1, 't', 0, FALSE, 4, 0), (6, 3, NULL, 0, TRUE, 1, 0), (7, 3, NULL, 6, TRUE, 0, 0), (8, 3, NULL, 7, TRUE, 1, 0), (9, 5, NULL, 0, TRUE, 1, 0), (10, 5, NULL, 9, TRUE, 1, 0), (11, 7, 'x', 0, FALSE, 1, 0), (12, 0, 'tree', 0, FALSE, 1, 1)"


@query(f"SELECT doc_id, top + o AS op_ctr, CASE WHEN p > 0 THEN top + p END AS obj_ctr, k AS map_key, CASE WHEN r > 0 THEN top + r END AS elem_ctr, i AS insert, a AS action, CASE WHEN o2 > 0 THEN top + o2 END AS pred_ctr FROM (SELECT doc_id, max(ctr) AS top FROM ops GROUP BY doc_id), (VALUES {TREE_ROWS}) AS t(o, p, k, r, i, a, o2)")
def batch_create(s, d):
    """A tree at a key, and then a counter at the same key."""
    ops = bridge.map_ops(s, d)
    c = commands(ops, F.when(F.col("c.n") == 0, TREE).otherwise('{"$": "counter", "value": 7}').alias("tree")).withColumn("map_key", F.lit("tree"))
    return mutations.create_trees(ops, c).select("doc_id", "op_ctr", "obj_ctr", "map_key", "elem_ctr", "insert", F.col("action").cast("int").alias("action"), F.try_element_at("pred", F.lit(1))["ctr"].alias("pred_ctr"))


@query(f"WITH {EDIT_SQL} SELECT c.doc_id, top + n + 1 AS op_ctr, c.map_key, coalesce(n_pred, 0) AS n_pred FROM cmd c LEFT JOIN held h ON c.doc_id = h.doc_id AND c.map_key = h.map_key")
def init_hydrate(s, d):
    ops = bridge.map_ops(s, d)
    c = commands(ops, F.lit('"set"').alias("tree"))
    return mutations.create_trees(ops, c).select("doc_id", "op_ctr", "map_key", F.size("pred").cast("long").alias("n_pred"))


# peers, containers and streams


@query(f"SELECT doc_id, {HASH_SQL.format('')} AS hash FROM changes")
def apply_change(s, d):
    """Changes arrive latest first, in three batches, and go on in causal order."""
    from ..streaming import causal

    c, path = bridge.changes(s, d), bridge.folder(s, "stream")
    for k, part in enumerate((c.where("seq % 3 = 0"), c.where("seq % 3 = 2"), c.where("seq % 3 = 1"))):
        part.select(*causal.COLUMNS).write.parquet(f"{path}/in/part={k}")
    stream = s.readStream.schema(c.select(*causal.COLUMNS).schema).option("maxFilesPerTrigger", 100).parquet(f"{path}/in/*")
    q = causal.release(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{path}/out").select("doc_id", hx("hash").alias("hash"))


def word_sql(at: int) -> str:
    """The little-endian number of four bytes of a hash in hex."""
    digits = [(at + k) * 2 + 1 + half for k in (3, 2, 1, 0) for half in (0, 1)]
    return "(" + " + ".join(f"(instr('0123456789abcdef', substr(hash, {p}, 1)) - 1) * {16 ** (7 - i)}" for i, p in enumerate(digits)) + ")"


def probes_sql(source: str, name: str) -> str:
    """The bits (bit, step) that each row (doc_id, hash, size) of ``source`` sets in a filter of ``size`` bits, as a named recursive table."""
    return f"""{name}_ AS (SELECT doc_id, hash, size, 0 AS step, {word_sql(0)} % size AS x, {word_sql(4)} % size AS y, {word_sql(8)} % size AS z FROM {source} WHERE size > 0
      UNION ALL SELECT doc_id, hash, size, step + 1, (x + y) % size, (y + z) % size, z FROM {name}_ WHERE step < 6), {name} AS (SELECT doc_id, hash, size, step, x AS bit FROM {name}_)"""


NAMED_SQL = f"named AS (SELECT doc_id, actor, seq, max_op, {HASH_SQL.format('')} AS hash FROM changes)"


@query(f"WITH {NAMED_SQL}, sized AS (SELECT n.doc_id, hash, size FROM named n JOIN (SELECT doc_id, CAST(ceil(count(*) * 10 / 8.0) * 8 AS BIGINT) AS size FROM changes GROUP BY doc_id) z ON n.doc_id = z.doc_id), {probes_sql('sized', 'probe')} SELECT doc_id, hash, size, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY step) AS bits FROM probe GROUP BY doc_id, hash, size")
def bloom_probes(s, d):
    """For each change the bits that it sets in a filter of all changes of its document."""
    from ..functions.bloom import BITS, probes
    from ..functions.ship import ship

    ship(s)

    @F.arrow_udf("array<bigint>")
    def bits(hashes, sizes):
        import pyarrow as pa

        return pa.array([probes(h, n) for h, n in zip(hashes.to_pylist(), sizes.to_pylist(), strict=True)], pa.list_(pa.int64()))

    c = bridge.changes(s, d)
    size = c.groupBy("doc_id").agg((F.ceil(F.count(F.lit(1)) * BITS / 8) * 8).cast("long").alias("size"))
    return c.join(size, "doc_id").select("doc_id", hx("hash").alias("hash"), "size", F.array_join(bits("hash", "size").cast("array<string>"), ",").alias("bits"))


#: A peer that has what comes before ``past``; lost: what its filter does not hold; sent: that, and all that depends on it.
FILTER_SQL = f"""{PAST_SQL}, {reached_sql('past')}, {NAMED_SQL}, held AS (SELECT n.* FROM named n SEMI JOIN reached r ON r.doc_id = n.doc_id AND r.actor = n.actor AND r.seq = n.seq),
  sizes AS (SELECT doc_id, CAST(ceil(count(*) * 10 / 8.0) * 8 AS BIGINT) AS size FROM held GROUP BY doc_id),
  in_filter AS (SELECT h.doc_id, hash, size FROM held h JOIN sizes z ON h.doc_id = z.doc_id), {probes_sql('in_filter', 'set_bits')},
  asked AS (SELECT n.doc_id, hash, coalesce(size, 0) AS size FROM named n LEFT JOIN sizes z ON n.doc_id = z.doc_id), {probes_sql('asked', 'ask_bits')},
  lost AS (SELECT DISTINCT a.doc_id, a.hash FROM ask_bits a ANTI JOIN set_bits b ON a.doc_id = b.doc_id AND a.bit = b.bit UNION SELECT doc_id, hash FROM asked WHERE size = 0),
  sent AS (SELECT n.doc_id, n.actor, n.seq, n.hash FROM named n SEMI JOIN lost l ON n.doc_id = l.doc_id AND n.hash = l.hash
    UNION SELECT n.doc_id, n.actor, n.seq, n.hash FROM sent s JOIN deps d ON d.doc_id = s.doc_id AND d.dep_actor = s.actor AND d.dep_seq = s.seq JOIN named n ON n.doc_id = d.doc_id AND n.actor = d.actor AND n.seq = d.seq)"""


def answered(s, d):
    """The answer to a peer's first message; what the peer has, and its state; the changes that go with the answer."""
    c, held = peer(s, d)
    held = bridge.stored(held, "held")
    theirs, at_peer = (bridge.stored(x, "said") for x in sync.generate(held, bridge.stored(sync.new_states(held), "states")))
    states = bridge.stored(sync.receive(c, sync.new_states(c), theirs, c.limit(0))[1], "states")
    m = bridge.stored(sync.generate(c, states)[0], "said")
    return m, held, at_peer, sync.sent_changes(c, m)


def peer(s, d):
    """All changes, and those that a peer has."""
    c, at = past(s, d)
    return c, c.join(history.ancestors(c, at), ["doc_id", "hash"], "left_semi")


@query(f"WITH {FILTER_SQL} SELECT doc_id, hash FROM sent")
def sync_filtered(s, d):
    """What to send a peer that has sent a filter of what it has had since the shared heads; never less than it lacks but for false hits."""
    c, held = peer(s, d)
    return ch.to_send(c, ch.bloom_filters(held)).select("doc_id", hx("hash").alias("hash"))


@query(f"WITH {FILTER_SQL}, {HEADS_SQL}, sending AS (SELECT doc_id, count(*) AS n_send FROM sent GROUP BY doc_id) SELECT h.doc_id, h.n_heads, CAST(0 AS BIGINT) AS n_need, coalesce(n_send, 0) AS n_send, CAST(1 AS BIGINT) AS n_have FROM (SELECT doc_id, count(*) AS n_heads FROM heads GROUP BY doc_id) h LEFT JOIN sending x ON h.doc_id = x.doc_id")
def sync_message(s, d):
    """The answer to a peer's first message."""
    m = answered(s, d)[0]
    n = lambda x: F.size(x).cast("long")
    return m.select("doc_id", n("heads").alias("n_heads"), n("need").alias("n_need"), n("send").alias("n_send"), n("have").alias("n_have"))


@query(f"WITH {FILTER_SQL}, {HEADS_SQL}, got AS (SELECT doc_id, hash FROM held UNION SELECT doc_id, hash FROM sent), named_heads AS (SELECT doc_id, {HASH_SQL.format('')} AS hash FROM heads) SELECT h.doc_id, (SELECT count(*) FROM got g WHERE g.doc_id = h.doc_id) AS n_changes, count(g.hash) = count(*) AS settled, count(g.hash) AS n_heads_here FROM named_heads h LEFT JOIN got g ON g.doc_id = h.doc_id AND g.hash = h.hash GROUP BY h.doc_id")
def sync_receive(s, d):
    """The peer takes the answer in: what it has then, and whether the heads are shared."""
    m, held, at_peer, arrived = answered(s, d)
    got, after = sync.receive(held, at_peer, m, arrived)
    count = got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_changes"))
    here = F.size(F.array_intersect("shared", "their_heads")).cast("long")
    return after.where("their_heads is not null").join(count, "doc_id").select("doc_id", "n_changes", (F.array_sort("shared") == F.array_sort("their_heads")).alias("settled"), here.alias("n_heads_here"))


def committed(s, d):
    # deletions of nothing, and what overwrites deletions, have no place in a container: here without any
    ops = visibility.derive_pred(visibility.derive_succ(bridge.map_ops(s, d).where("action <> 3"))).drop("succ")
    first = ops.groupBy("doc_id", F.col("op_actor").alias("actor")).agg(F.lit(1).cast("long").alias("seq"))
    meta = first.select("*", F.lit(0).cast("long").alias("time"), F.lit("all").alias("message"), F.array().cast("array<binary>").alias("deps"))
    return ops, mutations.commit(ops, meta)


@query("SELECT doc_id, actor, CAST(1 AS BIGINT) AS seq, min(ctr) AS start_op, max(ctr) AS max_op FROM ops WHERE action <> 3 GROUP BY doc_id, actor")
def commit(s, d):
    return committed(s, d)[1].select("doc_id", hx("actor").alias("actor"), "seq", "start_op", "max_op")


@query(f"SELECT {OP_SQL}, CAST(action AS INT) AS action, {VALUE_SQL}, CASE WHEN p_action <> 3 THEN p_ctr END AS pred_ctr FROM (SELECT *, lag(action) OVER (PARTITION BY doc_id, map_key, actor ORDER BY ctr) AS p_action FROM ops) WHERE action <> 3")
def load_containers(s, d):
    """Every document written as a container, and read back."""
    from ..sources import container

    ops, changes = committed(s, d)
    back, _ = container.read(container.write(ops, changes))
    return back.select(*op_columns(), F.col("action").cast("int").alias("action"), F.col("value.d").alias("value"), F.try_element_at("pred", F.lit(1))["ctr"].alias("pred_ctr"))
