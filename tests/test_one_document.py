"""A document by hand: edit, commit, fork, merge, go back, save."""

from chronofold.document import ROOT, AutoCommit, Document, random_actor

A, B = b"\xaa" * 16, b"\xbb" * 16


def test_life_of_a_document(spark):
    d = Document.new(spark, A).put(ROOT, "x", 1)
    d, notes = d.put_object(ROOT, "notes", "text")
    d = d.splice_text(notes, 0, 0, "hello").put(ROOT, "n", (8, 3)).commit("first", 1000)
    first = d.heads()
    other = d.fork(B).put(ROOT, "x", 3).increment(ROOT, "n", 4)
    d = d.put(ROOT, "x", 2).splice_text(notes, 5, 0, " world").mark(notes, 0, 5, "bold", True)
    m = d.merge(other)
    assert m.get_all(ROOT, "x") == [2, 3] and m.get(ROOT, "x") == 3 and m.get(ROOT, "n") == 7 and len(m.heads()) == 2
    assert m.keys() == ["n", "notes", "x"] and m.text(notes) == "hello world" and m.length(notes) == 11 and m.marks(notes) == [(0, 5, "bold")]
    assert m.get(ROOT, "x", first) == 1 and m.text(notes, first) == "hello" and m.get(ROOT, "none") is None
    assert [p[:3] for p in m.diff(first, m.heads())] == [("", "putMap", "n"), ("", "putMap", "x"), ("notes", "insert", "5")]
    back = Document.load(spark, m.save(), b"\xcc" * 16)
    assert back.heads() == m.heads() and back.get(ROOT, "x") == 3 and back.text(notes) == "hello world" and back.text(notes, first) == "hello"
    c = back.cursor(notes, 6)
    assert back.splice_text(notes, 0, 6, "").cursor_position(notes, c) == 0


def test_auto_commit(spark):
    times = iter(range(1000, 2000))
    d = AutoCommit.new(spark, A, clock=lambda: next(times))
    d.set_message("first")
    d.put(ROOT, "x", 1)
    items = d.put_object(ROOT, "items", "list")
    d.splice_trees(items, 0, 0, ["a", {"k": 2}])
    inner = d.insert_object(items, 1, "text")
    d.delete(ROOT, "none")
    rows = sorted((r.seq, r.message, r.time) for r in d.changes.collect())
    assert rows == [(1, "first", 1000), (2, None, 1001), (3, None, 1002), (4, None, 1003)] and d.pending.count() == 0
    assert d.list_items(items)[0] == "a" and d.list_items(items)[1] == inner and d.length(items) == 3
    other = d.fork(B)
    other.put(ROOT, "x", 5)
    d.merge(other)
    assert d.get(ROOT, "x") == 5 and AutoCommit.load(spark, d.save()).get(ROOT, "x") == 5
    assert len(random_actor()) == 16 and random_actor() != random_actor()
