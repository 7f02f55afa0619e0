import math
import random
import re

from pyspark.sql import functions as F

from loomspark.operators import lexical as L
from loomspark.operators import vectors as V

DOCS = "doc_id long, title string, text string, term string"


def brute(docs, asked, weights, k):
    """docs: id -> tuple of fields; asked: id -> text."""
    split = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    words = {i: [split(f) for f in fields] for i, fields in docs.items()}
    size = {i: sum(map(len, fields)) for i, fields in words.items()}
    mean = sum(size.values()) / len(size)
    tf = lambda i, t: sum(w * f.count(t) for w, f in zip(weights, words[i]))
    out = []
    for q, text in asked.items():
        score = {}
        for t in set(split(text)):
            with_t = [i for i in docs if tf(i, t)]
            if not with_t:
                continue
            idf = math.log((len(docs) - len(with_t) + 0.5) / (len(with_t) + 0.5))
            for i in with_t:
                score[i] = score.get(i, 0) + max(idf, 0 if idf > 0 else 1e-6) * tf(i, t) * 2.2 / (tf(i, t) + 1.2 * (0.25 + 0.75 * size[i] / mean))
        best = sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out += [(q, i, round(s, 6), r) for r, (i, s) in enumerate(best, 1)]
    return sorted(out)


def test_bm25_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["parse", "Index", "träger", "x9", "token", "merge", "café"]
    docs = {i: (rng.choice([None, "", "Parse token"]), " ".join(rng.choices(vocabulary, k=rng.randrange(40)))) for i in range(30)}
    docs[30], docs[31] = (None, None), ("", "merge " * 5000)
    rows = [(i, *f, "clash") for i, f in docs.items()]
    df = spark.createDataFrame([*rows, *rows[:7], (None, "parse", "parse", "")], DOCS)
    asked = {1: "parse, MERGE the index?", 2: "", 3: "träger x9", 4: "absent"}
    terms = L.query_words(spark.createDataFrame([*asked.items(), (5, None)], "q long, s string"), "q", "s")
    got = L.bm25(df, "doc_id", {"title": 8.0, "text": 1.0}, terms, 5)
    assert sorted(tuple(r) for r in got.select("query_id", "id", "score", "rank").collect()) == brute(docs, asked, (8.0, 1.0), 5)
    assert L.bm25(df.limit(0), "doc_id", {"text": 1.0}, terms, 5).count() == 0


def test_fusion_scaling_and_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    fused = L.fuse([a, b], 3).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in fused] == [(11, 1), (10, 2), (12, 3)]
    assert fused[0].score == round(1 / 61 + 1 / 62, 9)
    scored = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 5.0), (3, 1, 0.0)], "query_id long, id long, score double")
    assert [(r.query_id, r.id, r.scaled) for r in L.min_max(scored).orderBy("query_id", "id").collect()] == [(1, 1, 1.0), (1, 2, 0.0), (1, 3, 0.5), (2, 1, 1.0), (3, 1, 0.0)]


def test_diversify_moves_the_fourth_of_a_file_back(spark):
    rows = [(1, r, "a" if r <= 5 else f"f{r}") for r in range(1, 9)]
    got = L.diversify(spark.createDataFrame(rows, "query_id long, rank int, file string"), "file").orderBy("place")
    assert [r["rank"] for r in got.collect()] == [1, 2, 3, 6, 7, 8, 4, 5]


def test_nearest_against_brute_force(spark):
    rng = random.Random(3)
    vecs = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(60)}
    vecs[60], vecs[61] = vecs[7], [0.0] * 4
    schema = "vec_id long, embedding array<float>, distance string"
    df = spark.createDataFrame([*[(i, v, "") for i, v in vecs.items()], (None, vecs[0], ""), (99, None, ""), (98, [1.0], "")], schema)

    def far(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return round(1 - sum(x * y for x, y in zip(a, b)) / n, 4) if n else 1.0

    got = V.nearest(df, df.where("vec_id % 20 = 0"), 4, block=2)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(round(r.distance, 4))
    assert found == {q: sorted(far(vecs[q], v) for v in vecs.values())[:4] for q in (0, 20, 40, 60)}
    assert V.nearest(df.limit(0), df.limit(0), 4).count() == 0
    assert V.nearest(df.limit(0), df.where("vec_id = 0"), 4).count() == 0


def test_normalize(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    assert tuple(row.select(V.l2_normalize(F.col("a")), V.l2_normalize(F.col("z"))).first()) == ([0.6, 0.8], None)
