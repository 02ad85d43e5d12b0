"""Documents built by edits, and what reads, histories, merges, ranges, cursors and diffs say of them."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronofold import schema as S
from chronofold.operators import changes as ch
from chronofold.operators import columns as co
from chronofold.operators import diff, history, maps, marks, merge, mutations, sequence, visibility

A, B1, B2 = bytes.fromhex("aabbccdd00112233aabbccdd00112233"), bytes.fromhex("11" * 8 + "aa" * 8), bytes.fromhex("22" * 8 + "aa" * 8)
LIST = (1, A)


def ops(spark, *rows):
    return S.ops(spark, list(rows))


def values(df, *more):
    """{key: shown} of winners."""
    return {r.map_key: r.shown for r in visibility.to_value(maps.winners(visibility.visible(df))).collect()}


def clock(spark, *pairs, doc=1):
    return spark.createDataFrame([(doc, a, n) for a, n in pairs], "doc_id long, actor binary, max_ctr long")


def chain(text, start=2, actor=A, obj=LIST, ref=None):
    """Rows that type a text."""
    out = []
    for k, c in enumerate(text):
        out.append({"id": (start + k, actor), "obj": obj, "elem": ref, "insert": True, "value": c})
        ref = (start + k, actor)
    return out


def grown(df, new):
    """``df`` with new ops, as a table of its own: a batch of edits is written before the next one reads it."""
    return df.sparkSession.createDataFrame(df.unionByName(new).toArrow(), df.schema)


def typed(spark, text):
    return ops(spark, {"id": (1, A), "key": "text", "action": S.MAKE_TEXT}, *chain(text))


def read(df, clock=None):
    r = sequence.text(sequence.elements(df, clock)).first()
    return r.text if r else ""


def command(spark, **more):
    """One command on the text made by (1, A)."""
    c = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("obj_ctr"), F.lit(bytearray(A)).alias("obj_actor"), F.lit(bytearray(B1)).alias("actor"))
    for k, v in more.items():
        c = c.withColumn(k, v if not isinstance(v, (int, str, bool)) else F.lit(v))
    return c


SCALARS = [("str", "hello world", "hello world"), ("empty_str", "", ""), ("unicode", "Hello 🌍 café résumé", "Hello 🌍 café résumé"), ("int", -42, "-42"), ("uint", (S.UINT, 2**64 - 1), "18446744073709551615"),
           ("float", 3.141592653589793, "3.141592653589793"), ("true", True, "true"), ("false", False, "false"), ("null", None, "null"), ("bytes", b"\xde\xad\xbe\xef", "deadbeef"), ("timestamp", (S.TIMESTAMP, -1000000), "-1000000"), ("counter", (S.COUNTER, 100), "100"), ("", 1, "1")]


def test_scalars(spark):
    df = ops(spark, *[{"id": (i + 1, A), "key": k, "value": v} for i, (k, v, _) in enumerate(SCALARS)])
    assert values(df) == {k: shown for k, _, shown in SCALARS}
    assert maps.lengths(visibility.visible(df)).first().length == len(SCALARS)


def test_types_are_part_of_values(spark):
    df = spark.range(1).select(S.scalar(4, l=F.lit(1)).alias("i"), S.scalar(3, u=F.lit(1)).alias("u"), S.scalar(8, l=F.lit(1)).alias("c"))
    same = lambda a, b: df.select(visibility.value_equal(F.col(a), F.col(b))).first()[0]
    assert same("i", "i") and not same("i", "u") and not same("i", "c")


def test_concurrent_edits(spark):
    df = ops(spark, {"id": (1, B1), "key": "x", "value": 1}, {"id": (2, B1), "key": "shared", "value": "initial"}, {"id": (3, B1), "key": "shared", "value": "from-actor1", "pred": [(2, B1)]}, {"id": (4, B1), "key": "only1", "value": "hello"},
             {"id": (3, B2), "key": "shared", "value": "from-actor2", "pred": [(2, B1)]}, {"id": (4, B2), "key": "only2", "value": "world"})
    assert values(df) == {"x": "1", "shared": "from-actor2", "only1": "hello", "only2": "world"}
    assert [(r.map_key, r.n) for r in maps.conflicts(visibility.visible(df)).collect()] == [("shared", 2)]
    at = history.get_at(df, clock(spark, (B1, 2)))
    assert {r.map_key: r.value.s for r in at.collect()}["shared"] == "initial"
    # actors are compared as bytes, whatever order they came in
    assert values(merge.merge_ops(df.where(F.col("op_actor") == F.lit(bytearray(B2))), df))["shared"] == "from-actor2"


def test_counters(spark):
    df = ops(spark, {"id": (1, A), "key": "n", "value": (S.COUNTER, 0)}, {"id": (2, A), "key": "n", "action": S.INCREMENT, "value": 5, "pred": [(1, A)]}, {"id": (3, A), "key": "n", "action": S.INCREMENT, "value": -2, "pred": [(2, A)]},
             {"id": (4, B1), "key": "n", "action": S.INCREMENT, "value": 10, "pred": [(3, A)]}, {"id": (1, B1), "key": "n", "value": (S.COUNTER, 1000)}, {"id": (2, B1), "key": "m", "value": (S.COUNTER, 7)}, {"id": (3, B1), "key": "m", "value": "gone", "pred": [(2, B1)]})
    assert {r.map_key: r.total for r in maps.key_sums(df).collect()} == {"n": 1013, "m": 7}
    assert sorted((r.map_key, bytes(r.op_actor), r.total) for r in maps.counters(df).collect()) == [("n", B1, 1000), ("n", A, 13)]


def test_deletion(spark):
    df = ops(spark, *[{"id": (i, A), "key": k, "value": "stays"} for i, k in enumerate(("keep", "remove", "also"), 1)], *[{"id": (i + 3, A), "key": k, "action": S.DELETE, "pred": [(i, A)]} for i, k in ((2, "remove"), (3, "also"))])
    assert values(df) == {"keep": "stays"}


def brute_order(rows):
    """Document order by insertion, one element at a time, as a replica would."""
    out = []
    for id, ref in sorted(rows):
        i = 0 if ref is None else out.index(ref) + 1
        while i < len(out) and out[i] > id:
            i += 1
        out.insert(i, id)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_element_order(spark, seed):
    rng = random.Random(seed)
    ids, rows = [], []
    for ctr in range(2, 60):
        for actor in rng.sample([A, B1, B2], rng.randrange(1, 3)):
            ref = rng.choice([None, *[i for i in ids if i[0] < ctr]]) if rng.random() < 0.5 else (max((i for i in ids if i[0] < ctr), default=None))
            rows.append(((ctr, actor), ref))
        ids = [r[0] for r in rows]
    df = ops(spark, *[{"id": i, "obj": LIST, "elem": ref, "insert": True, "value": "x"} for i, ref in rows])
    got = [(r.elem_ctr, bytes(r.elem_actor)) for r in sequence.document_order(df).orderBy("pos").collect()]
    assert got == brute_order(rows)


def test_long_texts_do_not_recurse(spark):
    ids = [(i, A) for i in range(1, 50_001)]
    assert sequence.preorder(ids, [(None, None), *ids[:-1]]) == list(range(50_000))


def test_list_fixture(spark):
    df = ops(spark, {"id": (1, A), "key": "list", "action": S.MAKE_LIST}, *chain("abcde"))
    step = lambda df, pos, n, vs: grown(df, mutations.splice(df, command(spark, pos=F.lit(pos).cast("long"), **{"del": n}, values=mutations.text_values(F.lit(vs)))))
    for pos, n, vs in ((2, 1, ""), (1, 0, "X"), (2, 2, "YZ")):
        df = step(df, pos, n, vs)
    assert read(df) == "aXYZe"
    assert mutations.splice(df, command(spark, pos=F.lit(9).cast("long"), **{"del": 0}, values=mutations.text_values(F.lit("q")))).count() == 0


def two(df, a, b):
    """Two commands of one batch."""
    return df.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select("doc_id", "obj_ctr", "obj_actor", "actor", "n", *[F.when(F.col("n") == 0, F.lit(a[k])).otherwise(F.lit(b[k])).alias(k) for k in a])


@pytest.mark.parametrize(("a", "b", "want"), [((1, 0, "XX"), (4, 0, "YY"), "aXXbcdYYef"), ((4, 1, "YY"), (0, 2, "Q"), "QcdYYf"), ((2, 0, "1"), (2, 0, "2"), "ab21cdef"), ((1, 3, ""), (2, 3, "-"), "a-f"), ((0, 6, "new"), (9, 0, "x"), "new")])
def test_two_splices_of_a_batch(spark, a, b, want):
    """Places are those from before the batch."""
    df = typed(spark, "abcdef")
    c = two(command(spark), *[{"pos": p, "del": n, "text": t} for p, n, t in (a, b)]).withColumn("pos", F.col("pos").cast("long"))
    new = mutations.splice_text(df, c)
    assert read(grown(df, new)) == want
    ids = [r.op_ctr for r in new.orderBy("op_ctr").collect()]
    assert ids == list(range(8, 8 + len(ids)))
    unnumbered = mutations.splice_text(df, c.drop("n"))
    assert sorted(r.op_ctr for r in unnumbered.collect()) == ids


def test_nested_values_in_lists(spark):
    df = ops(spark, {"id": (1, A), "key": "list", "action": S.MAKE_LIST}, *chain("abc"))
    trees = '[{"k": [1, {"$": "text", "value": "hé"}]}, 5, {"$": "map", "value": {"$": 1, "value": 2}}, {"$": "bytes", "value": "00ff"}, {"$": "uint", "value": 18446744073709551615}, {"$": "timestamp", "value": -3}]'
    new = mutations.splice_trees(df, command(spark, pos=F.lit(1).cast("long"), **{"del": 1}, trees=trees))
    df = grown(df, new)
    rows = {(r.op_ctr, bytes(r.op_actor)): r for r in df.collect()}
    items = [r for r in sequence.elements(df).orderBy("idx").collect() if (r.obj_ctr, bytes(r.obj_actor)) == LIST]
    assert [(r.action, r.value.tag, r.value.l, r.value.u, r.value.b) for r in items[1:7]] == [(S.MAKE_MAP, 0, None, None, None), (S.SET, S.INT, 5, None, None), (S.MAKE_MAP, 0, None, None, None), (S.SET, S.BYTES, None, None, bytearray(b"\x00\xff")), (S.SET, S.UINT, None, 2**64 - 1, None), (S.SET, S.TIMESTAMP, -3, None, None)]
    assert len(items) == 8 and items[0].value.s == "a" and items[7].value.s == "c"
    assert sorted(r.map_key for r in rows.values() if r.map_key and r.obj_ctr == items[3].op_ctr) == ["$", "value"]
    texts = [r.text for r in sequence.text(sequence.elements(df)).collect()]
    assert "hé" in texts
    made = grown(df, mutations.insert_object(df, command(spark, idx=F.lit(0).cast("long"), action=S.MAKE_TEXT)))
    assert sequence.elements(made).where("obj_ctr = 1 and idx = 0").first().action == S.MAKE_TEXT


def test_counters_in_winners(spark):
    df = ops(spark, {"id": (1, A), "key": "n", "value": (S.COUNTER, 10)}, {"id": (2, A), "key": "n", "action": S.INCREMENT, "value": 5, "pred": [(1, A)]}, {"id": (2, B1), "key": "n", "action": S.INCREMENT, "value": -2, "pred": [(1, A)]},
             {"id": (3, A), "key": "m", "value": (S.COUNTER, 1)}, {"id": (4, A), "key": "k", "action": S.INCREMENT, "value": 3, "pred": [(9, A)]}, {"id": (5, A), "key": "x", "value": 1}, {"id": (6, A), "key": "x", "action": S.DELETE, "pred": [(5, A)]})
    shown = lambda df: {r.map_key: (r.kind, r.shown) for r in visibility.to_value(df).collect()}
    assert shown(maps.values(df)) == {"n": ("counter", "13"), "m": ("counter", "1"), "k": ("counter", "3")}
    assert shown(maps.values(df, clock(spark, (A, 2)))) == {"n": ("counter", "15")} and shown(history.get_at(df, clock(spark, (A, 1)))) == {"n": ("counter", "10")}
    back = diff.diff_maps(df, clock(spark, (A, 2), (B1, 1)), clock(spark, (A, 2), (B1, 2))).collect()
    assert [(r.map_key, r.patch, r.value.l) for r in back] == [("n", "putMap", 13)]
    flags = visibility.flagged(df, clock(spark, (A, 5)), clock(spark, (A, 9)))
    assert {(r.op_ctr, r.live_0, r.live_1) for r in flags.where("map_key = 'x'").collect()} == {(5, True, False), (6, False, False)}


def test_deep_paths(spark):
    df = ops(spark, *[{"id": (i, A), "obj": (i - 1, A) if i > 1 else None, "key": f"k{i}", "action": S.MAKE_MAP} for i in range(1, 1201)])
    up = maps.parents(df).where("obj_ctr = 1200")
    assert up.count() == 1200 and up.where("depth = 1199").first().map_key == "k1"


def test_text_edits_count_code_points(spark):
    df = typed(spark, "Hello World")
    df = grown(df, mutations.splice_text(df, command(spark, pos=F.lit(5).cast("long"), **{"del": 6}, text=" Gö😀")))
    assert read(df) == "Hello Gö😀"
    df = grown(df, mutations.splice_text(df, command(spark, pos=F.lit(8).cast("long"), **{"del": 1}, text="!")))
    assert read(df) == "Hello Gö!"
    df = grown(df, mutations.set_elements(df, command(spark, idx=F.lit(0).cast("long"), value=S.scalar(6, s=F.lit("J")))))
    assert read(df) == "Jello Gö!"
    assert read(df, clock(spark, (A, 12))) == "Hello World"


def test_map_edits(spark):
    df = ops(spark, {"id": (1, A), "key": "x", "value": 1}, {"id": (2, B1), "key": "x", "value": 2})
    base = command(spark).withColumn("obj_ctr", F.lit(None).cast("long")).withColumn("obj_actor", F.lit(None).cast("binary"))
    c = base.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("map_key")) for n, k in enumerate(("x", "x", "y"))])).alias("c")).select("*", "c.*").drop("c")
    new = mutations.put(df, c.withColumn("value", S.scalar(4, l=F.col("n"))))
    rows = sorted((r.op_ctr, r.map_key, [p.ctr for p in r.pred]) for r in new.collect())
    assert rows == [(3, "x", [1, 2]), (4, "x", [3]), (5, "y", [])]
    df = grown(df, new)
    assert values(df) == {"x": "1", "y": "2"}
    gone = mutations.delete_keys(df, base.withColumn("n", F.lit(0)).withColumn("map_key", F.lit("none")))
    assert gone.count() == 0 and mutations.increment(df, base.withColumn("n", F.lit(0)).withColumn("map_key", F.lit("none")).withColumn("by", F.lit(1))).count() == 0
    df = grown(df, mutations.delete_keys(df, base.withColumn("n", F.lit(0)).withColumn("map_key", F.lit("x"))))
    assert values(df) == {"y": "2"}


def test_trees_and_parents(spark):
    import json

    tree = {"config": {"debug": True, "port": 8080, "nested": {"deep": 42}}, "items": ["first", 2, True, {"key": "v"}, ["a", "b"]], "e": {}, "ü": None, "f": 2.5}
    base = command(spark, n=0, map_key="root", tree=json.dumps(tree)).withColumn("obj_ctr", F.lit(None).cast("long")).withColumn("obj_actor", F.lit(None).cast("binary"))
    one = ops(spark, {"id": (1, A), "key": "x", "value": 1})
    df = grown(one.limit(0), mutations.create_trees(one, base))
    rows = df.collect()
    assert [r.op_ctr for r in sorted(rows, key=lambda r: r.op_ctr)] == list(range(2, 2 + len(rows)))

    def build(obj):
        mine = [r for r in rows if (r.obj_ctr, r.obj_actor) == obj]
        value = lambda r: build((r.op_ctr, r.op_actor)) if r.action in (S.MAKE_MAP, S.MAKE_LIST) else {0: None, 1: False, 2: True}.get(r.value.tag, next((x for x in r.value[1:] if x is not None), None))
        if any(r.insert for r in mine):
            return [value(mine[i]) for i in sequence.preorder([(r.op_ctr, r.op_actor) for r in mine], [(r.elem_ctr, r.elem_actor) for r in mine])]
        return {r.map_key: value(r) for r in mine}

    assert build((None, None))["root"] == tree
    inner = [r for r in rows if r.map_key == "key"][0]
    up = maps.parents(df, sequence.elements(df)).where(F.col("obj_ctr") == inner.obj_ctr).orderBy("depth").collect()
    assert [(r.map_key, r.idx) for r in up] == [(None, 3), ("items", None), ("root", None)]


def test_history_by_clock(spark):
    df = ops(spark, {"id": (1, A), "key": "x", "value": 1}, {"id": (2, A), "key": "x", "value": 2, "pred": [(1, A)]}, {"id": (3, A), "key": "y", "value": "hello"}, {"id": (4, B1), "key": "y", "action": S.DELETE, "pred": [(3, A)]})
    at = lambda *p: {r.map_key: r.shown for r in visibility.to_value(history.get_at(df, clock(spark, *p))).collect()}
    assert at((A, 1)) == {"x": "1"} and at((A, 3)) == {"x": "2", "y": "hello"} and at((A, 3), (B1, 4)) == {"x": "2"} and at() == {}


def graph(spark, rows):
    h = lambda i: hashlib.sha256(b"%d" % i).digest()
    return spark.createDataFrame([(1, h(i), a, s, m, m, 0, None, [h(d) for d in deps], None) for i, a, s, m, deps in rows], S.schema(S.CHANGES)), h


def test_change_graph(spark):
    c, h = graph(spark, [(1, A, 1, 1, []), (2, A, 2, 5, [1]), (3, B1, 1, 4, [1]), (4, B2, 1, 6, [2, 3]), (5, A, 3, 7, [4]), (6, B1, 2, 8, [4, 99])])
    named = {h(i): i for i in range(100)}
    num = lambda df: sorted(named[bytes(r.hash)] for r in df.collect())
    table = lambda *i: spark.createDataFrame([(1, h(x)) for x in i], "doc_id long, hash binary")
    assert num(ch.heads(c)) == [5, 6] and num(ch.missing(c, table(2, 77))) == [77, 99]
    assert num(history.ancestors(c, table(4))) == [1, 2, 3, 4]
    # the protocol's set stops at what is had, and still reaches its ancestors another way
    assert num(ch.since(c, table(2))) == [1, 3, 4, 5, 6] and num(ch.lacking(c, table(2))) == [3, 4, 5, 6]
    assert num(ch.dependents(c, table(3))) == [3, 4, 5, 6]
    clocks = {bytes(r.actor): r.max_ctr for r in history.clock_at(history.clocks(c), table(4, 55)).collect()}
    assert clocks == {A: 5, B1: 4, B2: 6}
    assert num(ch.to_send(c, ch.bloom_filters(table(1, 2, 3)))) in ([4, 5, 6], [5, 6], [6]) and num(ch.to_send(c, ch.bloom_filters(table(1, 2, 3)), need=table(2), sent=table(5))) == [2, 4, 6]
    assert num(merge.merge_heads(c.where("seq = 1"), c)) == [5, 6]


def test_merging_is_a_union(spark):
    one = ops(spark, {"id": (1, A), "key": "x", "value": 1}, {"id": (2, A), "key": "a", "value": "from doc1"})
    two = ops(spark, {"id": (1, A), "key": "x", "value": 1}, {"id": (2, B1), "key": "b", "value": "from doc2"}, {"id": (3, B1), "key": "x", "value": 3, "pred": [(1, A)]})
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(merge.merge_ops(one, two)) == rows(merge.merge_ops(two, one)) == rows(merge.merge_ops(merge.merge_ops(one, two), two))
    assert values(merge.merge_ops(one, two)) == {"x": "3", "a": "from doc1", "b": "from doc2"}
    assert [r.op_ctr for r in merge.new_ops(two, one).orderBy("op_ctr").collect()] == [2, 3]


def test_marks(spark):
    df = typed(spark, "hello world")
    mark = lambda df, a, b, name, n=0: grown(df, mutations.mark(df, command(spark, n=n, start=F.lit(a).cast("long"), stop=F.lit(b).cast("long"), name=name, value=S.scalar(2), expand=True)))
    df = mark(mark(df, 0, 5, "bold"), 2, 11, "italic")
    found = lambda df: sorted((r.name, r.start, r.stop) for r in marks.ranges(df).collect())
    assert found(df) == [("bold", 0, 5), ("italic", 2, 11)] and read(df) == "hello world"
    assert mutations.mark(df, command(spark, n=0, start=F.lit(3).cast("long"), stop=F.lit(12).cast("long"), name="x", value=S.scalar(2), expand=False)).count() == 0
    assert {r.name for r in marks.at_position(marks.ranges(df), 3).collect()} == {"bold", "italic"} and {r.name for r in marks.at_position(marks.ranges(df), 7).collect()} == {"italic"}
    # the anchor of a beginning is deleted: the range goes on from the start of the text
    cut = grown(df, mutations.splice_text(df, command(spark, pos=F.lit(1).cast("long"), **{"del": 1}, text="")))
    assert found(cut) == [("bold", 0, 4), ("italic", 0, 10)]
    # concurrent ranges of one name stay apart
    both = mark(typed(spark, "abcdef"), 0, 2, "c")
    other = mark(typed(spark, "abcdef"), 1, 5, "c").withColumn("op_actor", F.when(F.col("action") == S.MARK, F.lit(bytearray(B2))).otherwise(F.col("op_actor")))
    assert found(grown(both.limit(0), merge.merge_ops(both, other))) == [("c", 0, 2), ("c", 1, 5)]
    assert marks.mark_set(marks.ranges(df)).first().marks["bold"][0].stop == 5


def test_cursors(spark):
    df = typed(spark, "abcde")
    names = [r.cursor for r in sequence.cursors(sequence.elements(df)).orderBy("idx").collect()]
    df = grown(df, mutations.splice_text(df, command(spark, pos=F.lit(1).cast("long"), **{"del": 2}, text="XYZ")))
    assert read(df) == "aXYZde"
    wanted = spark.createDataFrame([(1, 1, A, c) for c in ["s", "e", *names, "-" + names[1], "-" + names[2], "999@00", "junk"]], "doc_id long, obj_ctr long, obj_actor binary, cursor string")
    got = {r.cursor: r.position for r in sequence.cursor_positions(df, wanted).collect()}
    assert got == {"s": 0, "e": 6, names[0]: 0, names[1]: 4, names[2]: 4, names[3]: 4, names[4]: 5, "-" + names[1]: 3, "-" + names[2]: 3, "999@00": None, "junk": None}
    by_id = {r.cursor: r.position for r in sequence.cursor_positions(df, wanted, by_id=True).collect()}
    assert by_id[names[1]] == 4 and by_id["-" + names[2]] == 0


def test_diff(spark):
    df = ops(spark, {"id": (1, A), "key": "text", "action": S.MAKE_TEXT}, *chain("hello"), {"id": (7, A), "key": "x", "value": 1}, {"id": (8, A), "key": "z", "value": 9})
    df = df.unionByName(ops(spark, *chain(" world", start=9, ref=(6, A)), {"id": (15, A), "obj": LIST, "elem": (2, A), "action": S.DELETE, "pred": [(2, A)]}, {"id": (16, A), "key": "x", "value": 2, "pred": [(7, A)]}, {"id": (17, A), "key": "y", "value": 3},
             {"id": (18, A), "key": "z", "value": 9, "pred": [(8, A)]}))
    old, new = clock(spark, (A, 8)), clock(spark, (A, 99))
    got = sorted((r.path, r.patch, r["at"], r.n, r.text) for r in diff.diff(df, old, new).collect())
    assert got == sorted([("", "putMap", "x", None, None), ("", "putMap", "y", None, None), ("text", "deleteSeq", "0", 1, ""), ("text", "insert", "4", 6, " world")])
    assert diff.diff(df, new, new).count() == 0
    c = diff.diff_counts(df, old, new).first()
    assert (c.deleted, c.inserted) == (1, 6)
    back = sorted((r.patch, r.map_key) for r in diff.diff_maps(df, new, old).collect())
    assert back == [("deleteMap", "y"), ("putMap", "x")]


def test_columns(spark):
    v = [None, None, 5, 5, 5, 1, 2, 3, None, 0]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)] + [(2, 0, None)], "doc_id long, pos long, v long")
    assert [(r.kind, r.n) for r in co.encoded_runs(df).orderBy("start").collect()] == [("null", 2), ("run", 3), ("literal", 3), ("null", 1), ("literal", 1)]
    assert sorted(map(tuple, co.expand(co.runs(df)).select("doc_id", "pos", "v").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert [r.v for r in co.undelta(co.deltas(df)).where("doc_id = 1").orderBy("pos").collect()] == v
    assert [r.v for r in co.deltas(df).where("doc_id = 1").orderBy("pos").collect()] == [None, None, 5, 0, 0, -4, 1, 1, None, -3]
    assert co.seek(df, 12).first().pos == 4 and co.next_runs(df, 3).first().n == 2
    assert {r.doc_id: r.equal for r in co.equal(df, df.where("doc_id = 1")).collect()} == {1: True, 2: False}
    assert co.fill(spark, 3, 4).where("v is null").count() == 4
    edges = spark.createDataFrame([(x,) for x in (0, 63, 64, 127, 128, 8191, 8192, 16383, 16384, 2**62)], "v long")
    from chronofold.functions import leb128

    for r in edges.select("v", co.unsigned_size(F.col("v")).alias("u"), co.signed_size(F.col("v")).alias("s"), co.signed_size(-F.col("v")).alias("m")).collect():
        assert (r.u, r.s, r.m) == (len(leb128.unsigned(r.v)), len(leb128.signed(r.v)), len(leb128.signed(-r.v)))


def test_containers(spark, tmp_path):
    from chronofold.sources import container

    df = typed(spark, "hello").unionByName(ops(spark, {"id": (7, B1), "obj": LIST, "elem": (2, A), "action": S.DELETE, "pred": [(2, A)]}, {"id": (8, B1), "key": "ü", "value": (S.UINT, 2**64 - 1)}))
    meta = spark.createDataFrame([(1, A, 1, 5, "one", []), (1, B1, 1, -5, None, [])], "doc_id long, actor binary, seq long, time long, message string, deps array<binary>")
    changes = mutations.commit(df, meta)
    data = container.write(df, changes).first().content
    with open(tmp_path / "one.doc", "wb") as f:
        f.write(data)
    with open(tmp_path / "bad.doc", "wb") as f:
        f.write(bytes(data[:-1]))
    back, got = container.read(container.files(spark, str(tmp_path), "one.doc"))
    assert read(back) == "ello" and values(back)["ü"] == str(2**64 - 1)
    assert {bytes(r.hash) for r in got.collect()} == {bytes(r.hash) for r in changes.collect()}
    assert container.read(container.files(spark, str(tmp_path)), strict=False)[1].count() == 2
    clocks = history.clock_at(history.clocks(got), got)
    assert read(back, clocks) == "ello"


def test_stream_holds_early_changes(spark):
    from chronofold.streaming import causal

    rows = [{"doc_id": 1, "hash": h, "actor": A, "seq": 1, "start_op": m, "max_op": m, "deps": d} for h, m, d in ((b"1", 1, []), (b"2", 2, [b"1"]), (b"3", 3, [b"1"]), (b"4", 4, [b"2", b"3"]), (b"5", 5, [b"9"]))]
    known, waiting, out = {}, {}, []
    for i in (3, 2, 4, 1, 1, 0, 3):
        out += [r["hash"] for r in causal.released(known, waiting, [rows[i]])]
    assert out == [b"1", b"2", b"3", b"4"] and list(waiting) == [b"5"]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, hash binary, actor binary, seq long, start_op long, max_op long, deps array<binary>")
    assert causal.waiting(df).count() == 1 and causal.release_batch(df).count() == 4
