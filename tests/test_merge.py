from loomspark.operators import evidence as V
from loomspark.operators import merge as M
from pyspark.sql import functions as F

NEW = "filepath string, ordinal int, content_hash string, name string, parent int"


def counts(rows):
    out = {}
    for r in rows:
        out[r.action] = out.get(r.action, 0) + 1
    return out.get("kept", 0), out.get("inserted", 0), out.get("deleted", 0)


def test_merge_keeps_ids(spark):
    none = spark.createDataFrame([], "id long, filepath string, content_hash string, name string")
    v1 = spark.createDataFrame([("f", 0, "h1", "a", None), ("f", 1, "h2", "b", 0)], NEW)
    first = M.merge_chunks(none, v1).collect()
    assert counts(first) == (0, 2, 0)
    assert {(r.ordinal, r.id, r.parent_id) for r in first} == {(0, 1, None), (1, 2, 1)}
    stored = spark.createDataFrame([(1, "f", "h1", "a"), (2, "f", "h2", "b")], none.schema)
    v2 = spark.createDataFrame([("f", 0, "h2", "b", None), ("f", 1, "h3", "c", 0)], NEW)
    second = M.merge_chunks(stored, v2).collect()
    assert counts(second) == (1, 1, 1)
    assert {(r.action, r.id, r.parent_id) for r in second} == {("kept", 2, None), ("inserted", 3, 2), ("deleted", 1, None)}


def test_equal_chunks_pair_in_order(spark):
    stored = spark.createDataFrame([(5, "f", "h", "a"), (3, "f", "h", "a"), (9, "g", "h", "a")], "id long, filepath string, content_hash string, name string")
    new = spark.createDataFrame([("f", k, "h", "a", None) for k in range(3)], NEW)
    rows = M.merge_chunks(stored, new).collect()
    assert {r.ordinal: r.id for r in rows if r.action == "kept"} == {0: 3, 1: 5}
    assert [r.id for r in rows if r.action == "inserted"] == [10] and [r.id for r in rows if r.action == "deleted"] == [9]


def test_upsert_and_cascade(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "filepath string, v int, more string")
    new = spark.createDataFrame([("b", 2), ("c", 2), (None, 2)], "filepath string, v int")
    assert sorted(map(tuple, M.upsert(stored, new, "filepath").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    left = M.cascade({"t": stored}, new.where("v = 2"))
    assert [r.filepath for r in left["t"].collect()] == ["a"]


def test_resolution_tiers(spark):
    defs = spark.createDataFrame(
        [(1, "f", "a.py"), (2, "f", "b.py"), (3, "only", "z.py"), (4, "load_all", "p.py"), (5, "load_all", "q.py"), (6, "load_all", "r.py"), (7, "g", "lib.py"), (8, "g", "m.py"), (9, "plain", "m.py"), (10, "plain", "n.py")],
        "id long, name string, filepath string",
    )
    calls = spark.createDataFrame([(100, "a.py", n) for n in ("f", "only", "load_all", "g", "plain", "none")], "caller_id long, filepath string, callee string")
    chunks = spark.createDataFrame([("a.py", "import os, lib\nx = 1"), ("a.py", None)], "filepath string, content string")
    rows = V.resolved(calls, defs, V.imports(chunks)).collect()
    assert {(r.callee, r.definition_id, r.tier) for r in rows} == {("f", 1, 1), ("g", 7, 2), ("only", 3, 3), ("load_all", 4, 4), ("load_all", 5, 4)}


def test_stub_and_packing(spark):
    texts = ["def f(a):\n    return 1\n", "\n@d\ndef f(\n  a,\n  b):\n  x", "", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(V.stub(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == ["def f(a):", "@d\ndef f(\n  a,", "", "one"]
    hits = spark.createDataFrame([(1, 1, 1, 500, 300), (1, 2, 2, 50, 10), (1, 3, 3, 30, 15), (1, 4, 4, 40, 20), (2, 9, 1, 10, 5)], "query_id long, id long, rank int, body_tokens int, stub_tokens int")
    got = {(r.query_id, r.id): (r.form, r.cost) for r in V.packed(hits, 100).collect()}
    assert got == {(1, 1): ("stub", 300), (1, 2): ("omitted", 0), (1, 3): ("omitted", 0), (1, 4): ("omitted", 0), (2, 9): ("body", 10)}
    got = {r.id: r.form for r in V.packed(hits.where("query_id = 1 AND id > 1"), 100).collect()}
    assert got == {2: "body", 3: "stub", 4: "stub"}


def test_expansion_and_places(spark):
    chunks = spark.createDataFrame(
        [(1, "a.py", "f", 1, 9, "code", 5), (5, "a.py", None, 1, 1, "class_header", None), (2, "b.py", "g", 1, 4, "code", None), (3, "b.py", "h", 5, 9, "code", None), (4, "c.py", None, 1, 2, "module", None), (None, "x", "f", 1, 2, "code", None)],
        "id long, filepath string, symbol_name string, start_line int, end_line int, chunk_type string, parent_id long",
    )
    symbols = spark.createDataFrame([(70, "g", "b.py", 2), (71, "h", "b.py", 50), (None, "f", "a.py", 1)], "id long, name string, filepath string, line int")
    assert [tuple(r) for r in V.located(symbols, chunks).collect()] == [(70, 2)]
    calls = spark.createDataFrame([(1, 2, 1), (3, 1, 1), (1, 3, 11)], "caller_id long, callee_id long, place int")
    seeds = spark.createDataFrame([(9, 1, 1.0), (9, 2, 0.5), (9, 4, 1.0)], "query_id long, id long, score double")
    got = {r.id: (r.role, round(r.score, 6)) for r in V.expanded(seeds, chunks, calls).collect()}
    assert got == {1: ("seed", 1.0), 2: ("seed", 0.6), 4: ("seed", 0.3), 5: ("parent", 0.5), 3: ("caller", 0.6)}
