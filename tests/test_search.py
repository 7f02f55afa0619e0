import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import terms as T
from loomspark.functions import text as X
from loomspark.operators import search as S
from loomspark.operators import vectors as V


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,expanded,base",
    [
        ("getUserName", ["get", "user", "name", "getusername", "get_user_name"], ["get", "user", "name"]),
        ("where is HTTPServer in get_user", ["http", "server", "httpserver", "http_server", "get", "user", "getuser", "get_user"], ["http", "server", "get", "user"]),
        ("the a of self", [], []),
        ("", [], []),
        (None, [], []),
    ],
)
def test_terms_of_a_question(spark, text, expanded, base):
    assert one(spark, T.expanded_terms, text) == expanded
    assert one(spark, T.base_terms, text) == base


def test_identifier_words_and_last_component(spark):
    assert one(spark, T.identifier_words, "x = loadConfig(plain, my_file)") == ["load", "config", "my", "file"]
    assert one(spark, T.last_component, "a.b.cD (part 1)") == "cD"
    assert one(spark, T.simple_tokens, "loadConfig a b2") == ["load", "config", "b2"]


@pytest.mark.parametrize("text", ["\n\n\na\n", "a \r\nb", "", "\n", "\n\n", "a\n\n\n\nb  \n \n\t\nc", "  \n\n x\r\r\ry", " a\n\n", "\n \n\na\n\n\n"])
def test_compaction(spark, text):
    want, blank = [], False
    for line in (x.rstrip() for x in text.splitlines()):
        if line or not blank:
            want.append(line)
        blank = not line
    assert one(spark, X.compact_blank, text) == "\n".join(want)


def test_normalized_query(spark):
    assert one(spark, X.normalize_query, "\tFoo  bar\n") == "foo bar"


FIELDS = {"name": 8.0, "content": 1.0}
DOCS = [
    (1, "load", "reads the config of a server"),
    (2, "loader", "unrelated words stand here in a long row of many words about nothing at all"),
    (3, None, "config " + "x " * 30 + "load"),
    (4, "other", "nothing"),
    (5, "x", None),
]


def brute(docs, terms, core):
    words = {i: {"name": re.findall(r"\w+", (n or "").lower()), "content": re.findall(r"\w+", (c or "").lower())} for i, n, c in docs}
    size = {i: sum(map(len, w.values())) for i, w in words.items()}
    mean = sum(size.values()) / len(docs)

    def scores(test):
        tf = {i: sum(FIELDS[f] * sum(map(test, ws)) for f, ws in w.items()) for i, w in words.items()}
        held = {i for i, x in tf.items() if x}
        raw = math.log((len(docs) - len(held) + 0.5) / (len(held) + 0.5)) if held else 0
        idf = raw if raw > 0 else 1e-6
        return {i: idf * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for i in held}

    total = {}
    for t in terms:
        for i, s in scores(lambda w: w.startswith(t)).items():
            total[i] = total.get(i, 0) + s
    exact = [scores(lambda w: w == t) for t in core]
    for i in set.intersection(*map(set, exact)) if len(core) > 1 else ():
        more = sum(e[i] for e in exact)
        total[i] += more
        for ws in words[i].values():
            places = [(k, w) for k, w in enumerate(ws) if w in core]
            if any({w for p, w in places if k <= p <= k + S.NEAR + 1} >= set(core) for k, _ in places):
                total[i] += more
                break
    return {i: round(s, 6) or S.LEAST for i, s in total.items()}


def test_search_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "id long, name string, content string")
    asked = spark.createDataFrame([(1, "load the config"), (2, "server"), (3, "the of"), (None, "load")], "q long, text string")
    terms = S.question_terms(asked, "q", "text")
    found = {}
    for r in S.search(docs, FIELDS, terms, 10).collect():
        found.setdefault(r.query_id, {})[r.id] = r.score
    want = {1: brute(DOCS, ["load", "config"], ["load", "config"]), 2: brute(DOCS, ["server"], ["server"])}
    assert set(found) == set(want)
    for q, rows in want.items():
        assert set(found[q]) == set(rows) and all(abs(found[q][i] - s) < 2e-6 for i, s in rows.items())
    assert S.search(docs.where("false"), FIELDS, terms, 10).count() == 0
    assert S.search(docs, FIELDS, terms.where("false"), 10).count() == 0


def test_filters_and_repeated_rows(spark):
    rows = [(1, "a/b.py", "p", "python", "code"), (2, "a/bc.py", "p", "go", "md"), (3, "A/B/c.py", "q", "python", "code")]
    chunks = spark.createDataFrame(rows, "id long, filepath string, project string, language string, chunk_type string")
    files = spark.createDataFrame([("a/b.py", 5.0), ("a/bc.py", 1.0)], "filepath string, last_modified double")
    ids = lambda **k: sorted(r.id for r in S.narrowed(chunks, files, **k).collect())
    assert ids() == [1, 2, 3] and ids(projects=[]) == [] and ids(projects=["p"], languages=["go"]) == [2]
    assert ids(prefix="a/b") == [3] and ids(prefix="a") == [1, 2, 3] and ids(since=2.0) == [1] and ids(types=["md"]) == [2]
    again = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "c", None), (None, "d", None)], "id long, name string, more string")
    assert sorted(map(tuple, S.one_row_per_id(again, "id", ["name", "more"]).collect())) == [(1, "b", "x"), (2, "c", None)]


def test_blend_and_tail(spark):
    listed = spark.createDataFrame([(1, 10, 0.0200, 1), (1, 11, 0.0199, 2), (1, 12, 0.0100, 3)], "query_id long, id long, score double, rank int")
    names = spark.createDataFrame([(10, "m.other"), (11, "m.target"), (12, "m.used")], "id long, name string")
    terms = spark.createDataFrame([(1, "target", True)], "query_id long, term string, core boolean")
    central = spark.createDataFrame([("used", 1.0)], "name string, score double")
    got = {r.id: (r.score, r.rank) for r in S.blended(listed, names, terms, central).collect()}
    assert got == {11: (round(0.7 * 0.99 + 0.05, 6), 1), 10: (0.7, 2), 12: (0.25, 3)}
    tail = {r.id: r.score for r in S.with_tail(listed.where("rank = 1"), listed, 1).collect()}
    assert tail == {10: 0.02, 11: round(0.02 * (1 - 1 / 3), 6), 12: round(0.02 * (1 - 2 / 3), 6)}


@pytest.mark.parametrize("blocks", [0, 32])
def test_nearest_in_blocks_and_of_mixed_lengths(spark, monkeypatch, blocks):
    monkeypatch.setattr(V, "BROADCAST_BLOCKS", blocks)
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=3 if i % 7 else 2).tolist() for i in range(60)} | {60: [0.0, 0.0, 0.0], 61: []}
    rows = spark.createDataFrame([(i, v) for i, v in vectors.items()] + [(None, [1.0]), (62, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in V.nearest(rows, rows.where("vec_id % 5 = 0"), 4, block=4).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q in range(0, 61, 5):
        want = sorted((round(1 - float(unit(vectors[q]) @ unit(v)), 6) + 0.0, i) for i, v in vectors.items() if len(v) == len(vectors[q]))[:4]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_snippets(spark):
    text = "a b " * 30 + "Load the config loaded " + "c " * 40
    hits = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, id long")
    texts = spark.createDataFrame([(1, text), (2, ""), (3, "x load")], "id long, text string")
    terms = spark.createDataFrame([(1, "load", True), (1, "config", True)], "query_id long, term string, core boolean")
    got = {r.id: r for r in S.snippets(hits, texts, terms).collect()}
    assert got[1].n_marked == 3 and got[1].snippet.split().count("«load»") == 1 and len(got[1].snippet.split()) == 32
    assert (got[2].n_marked, got[2].snippet) == (0, "") and got[3].snippet == "x «load»"
