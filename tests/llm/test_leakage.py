import random

from loomspark.llm import leakage as L

WORDS = [a + b for a in "ka lo mi nu pe ra si to vu ze".split() for b in "bar den fik gol hum jat".split()]


def passage(seed, n=60):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + str(k % 7) for k in range(n)]


def test_leaks(spark):
    p = passage(1)
    shared = passage(2, 40)
    q = passage(3, 30) + shared
    r = shared + passage(4, 30)
    items = spark.createDataFrame([(1, " ".join(p), "a"), (2, " ".join(q), "a"), (3, " ".join(r), "a"), (4, None, "a")], "item_id long, passage string, text string")
    noise = " ".join(passage(9, 300))
    altered = [w if k % 10 else "zzz" for k, w in enumerate(p[5:45])]
    docs = [
        (1, noise + " " + " ".join(p[10:40]) + " " + noise),
        (2, " ".join(p[10:25])),
        (3, "\n> ".join(p[:30]).upper()),
        (4, noise + " ".join(altered)),
        (5, " ".join(shared)),
        (6, noise),
        (7, None),
        (8, ""),
    ]
    df = spark.createDataFrame([(*d, 1) for d in docs + docs[:1]], "doc_id long, text string, item_id int")
    found = sorted((r.doc_id, r.item_id) for r in L.leaks(df, items).collect())
    assert found == [(1, 1), (3, 1), (4, 1)]
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(df, items, items_per_pass=1).collect()) == found
    assert L.leaks(df.where("false"), items).count() == 0
    assert L.leaks(df, items.where("false")).count() == 0


def test_any_two_altered_words_of_an_excerpt(spark):
    p = passage(5)
    noise = passage(9, 40)
    docs, true = [], set()
    for a in range(22):
        for b in range(a + 1, 22):
            true.add(len(docs))
            docs.append(" ".join([*noise, *["zzzz" if k in (a, b) else w for k, w in enumerate(p[10:32])], *noise[::-1]]))
    for a in range(1, 15):  # three altered words are one too many
        docs.append(" ".join([*noise, *["zzzz" if k in (a, a + 3, a + 5) else w for k, w in enumerate(p[10:32])], *noise[::-1]]))
    for other in ("z" * 80, "https://example.org/" + "ab/" * 40, "my_" * 60):  # one word, however long
        true.add(len(docs))
        docs.append(" ".join([*noise, *[other if k == 11 else w for k, w in enumerate(p[10:32])], *noise]))
    for mark in ("<b data-a=" + "x" * 150 + ">{}</b>", '<a title="' + "x y " * 50 + '" hidden>{}</a>', "[{}](https://example.org/a-rather-long/path/to/some/page.html)", '<span class="' + "long " * 40 + '">{}</span>'):
        true.add(len(docs))
        docs.append(" ".join([*noise, *[mark.format(w) if k == 11 else w for k, w in enumerate(p[10:32])], *noise]))
    gone = p[:12] + p[15:36]  # three missing words in a row
    true.add(len(docs))
    docs.append(" ".join([*noise, *gone, *noise]))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(p))], "item_id long, passage string")
    assert {r.doc_id for r in L.leaks(df, items).collect()} == true


def test_short_words():
    rng = random.Random(3)
    for most in (1, 2, 3):
        missed = 0
        for _ in range(40):
            p = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, most))) for _ in range(60)]
            patterns = L.Patterns([(1, " ".join(p))])
            held = p[10:34]
            for k in rng.sample(range(24), 3):
                held[k] = "qqqzz"
            text = "words before " * 5 + " ".join(held) + " and words after it" * 5
            squeezed = L.squeeze(text)
            found = patterns.search(L._codes(squeezed))
            hits = [(int(w), int(n), int(k)) for at, owners, places in found for w, n, k in zip(at, owners, places)]
            missed += 1 not in patterns.confirm(squeezed, hits, *L._edges(L.plain(text)))
        assert missed == 0
