from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import graph as G
from loomspark.operators import telemetry as M

CHUNKS = "id long, chunk_type string, symbol_name string, project string, content string, n string"
LOG = "id long, timestamp double, tool string, total_ms double, cache_hit boolean, stages map<string,double>"


def test_calls_and_centrality(spark):
    rows = [
        (1, "code", "load", "p", "def load():\n  parse(1)\n  parse(2)\n  print(3)", ""),
        (1, "code", "load", "p", "def load():\n  parse(1)\n  parse(2)\n  print(3)", ""),
        (2, "code", "parse", None, "def parse(x):\n  load()", ""),
        (3, "md", "x", "p", "load()", ""),
        (4, "code", None, "p", None, ""),
    ]
    names = spark.createDataFrame([("parse",), ("load",), (None,)], "name string")
    refs = G.call_refs(spark.createDataFrame(rows, CHUNKS), names)
    assert {(r.caller, r.callee, r.n) for r in refs.collect()} == {("load", "parse", 2), ("parse", "load", 1)}
    assert {(r.project, r.callee, r.n_refs, r.score) for r in G.centrality(refs).collect()} == {("p", "parse", 2, 1.0), (None, "load", 1, 1.0)}
    assert G.call_refs(spark.createDataFrame([], CHUNKS), names).count() == 0


def test_reach_stops_at_depth_and_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("b", "c"), (None, "z")], "source string, target string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    assert {(r.name, r.distance) for r in G.reach(edges, seeds, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_latency_and_stages(spark):
    rows = [(i, float(i), "t", float(i), i % 4 == 0, {"s": float(i)}) for i in range(1, 101)]
    rows += [rows[0], (101, 1.0, None, None, None, None), (102, 1.0, "t", float("nan"), None, {}), (None, 1.0, "t", 5.0, True, None)]
    log = spark.createDataFrame(rows, LOG)
    got = M.latency_summary(log).collect()
    assert [tuple(r) for r in got] == [("t", 100, 1.0, 100.0, 50.5, 51.0, 96.0, 100.0)]
    # only the percentiles are those of the last requests
    some = M.latency_summary(log, recent=10).first()
    assert (some.n, some.least, some.p50) == (100, 1.0, 96.0)
    whole = M.latency_summary(log, overall=True).first()
    assert (whole.tool, whole.n, whole.least, whole.p95) == (None, 100, 1.0, 96.0)
    stages = {r.stage: (r.n, r.p50, r.p95) for r in M.stage_percentiles(log).collect()}
    assert stages == {"s": (100, 51.0, 95.0), "total": (100, 51.0, 95.0)}
    assert {(r.tool, r.n, r.hits) for r in M.cache_rate(log).collect()} == {("t", 101, 25), (None, 1, 0)}
    assert M.latency_summary(log.limit(0)).count() == 0


def test_stage_percentiles_of_every_request(spark):
    n = M.RETAINED + 51
    log = spark.range(1, n + 1).selectExpr("id", "0D AS timestamp", "'t' AS tool", "CAST(id AS double) AS total_ms", "true AS cache_hit", "map('s', CAST(id % 7 AS double)) AS stages")
    log = log.unionByName(log.limit(5))
    got = {r.stage: (r.n, r.p50, r.p95) for r in M.stage_percentiles_all(log).collect()}
    some = sorted(i % 7 for i in range(1, n + 1) if i % 7)
    at = lambda k, p: round((k - 1) * p / 100)
    assert got == {"total": (n, 1.0 + at(n, 50), 1.0 + at(n, 95)), "s": (len(some), some[at(len(some), 50)], some[at(len(some), 95)])}


def test_sync_status(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], "filepath string, sha256 string")
    stored = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4"), ("n", None)], "filepath string, sha256 string")
    got = dict(tuple(r) for r in M.sync_status(disk, stored).collect())
    assert got == {"a": "added", "b": "skipped", "c": "updated", "d": "pruned", "n": "skipped"}


def test_text_functions(spark):
    lines = "\n".join(f"l{i}" for i in range(1, 131))
    df = spark.createDataFrame([(lines,), ("",), (None,)], "text string")
    got = df.select(F.explode(X.line_windows(F.col("text"), 60, 10)).alias("w")).select("w.start_line", "w.end_line").collect()
    assert [tuple(r) for r in got] == [(1, 60), (51, 110), (101, 130), (1, 1)]
    one = spark.createDataFrame([("a  \n\n\n\nb \t", " Get  USER\tname ", "abc")], "a string, q string, t string")
    shown = one.select(X.compact_blank(F.col("a")), X.normalize_query(F.col("q")), X.token_estimate(F.col("t")), X.words(F.lit(None).cast("string")))
    assert tuple(shown.first()) == ("a\n\nb", "get user name", 1, [])
