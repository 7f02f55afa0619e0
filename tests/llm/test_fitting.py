import numpy as np
import pytest

from loomspark.llm import packing as P
from loomspark.llm import splitting as S
from loomspark.llm import tokens as T

DOC = "doc_id long, text string, container string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    prose = "The quick index maps words to rows. It is merged at night, when nobody looks!\n"
    rows = [
        (1, "# Top\n\n" + prose * 30 + "\n## Next\n\n" + "- item of a list\n" * 80 + "\n```\n" + "x = 1\n\n" * 60 + "```\n"),
        (2, "a" * 5000),
        (3, "無空白の文章です。" * 300),
        (4, "short"),
        (5, ""),
        (6, None),
        (None, "no id"),
        (7, "wörd \u200b🙂 " * 400),
        (8, "\r\n \t\n" * 500),
        (9, "<|endoftext|>" * 200),
    ]
    return spark.createDataFrame([(*r, "a", "b") for r in rows], DOC)


@pytest.mark.parametrize("limit,overlap", [(64, 0), (64, 8), (200, 40)])
def test_pieces(docs, limit, overlap):
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {}
    for r in S.split_texts(docs, limit=limit, overlap=overlap).orderBy("doc_id", "piece").collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {i for i, t in texts.items() if i and t and T.counts([t])[0] > limit}
    for i, pieces in found.items():
        text = texts[i]
        assert "".join(text[p.core_begin : p.until] for p in pieces) == text
        assert [p.piece for p in pieces] == list(range(pieces[0].n_pieces))
        for p in pieces:
            assert p.text == text[p.begin : p.until]
            assert p.n_tokens == T.counts([p.text])[0] <= limit
            assert p.core_begin == 0 or overlap == 0 or p.begin < p.core_begin
    assert {p.boundary for p in found[1][:-1]} <= {"heading", "paragraph", "markup", "list", "line", "code", "sentence"}


def test_repeated_and_empty(docs):
    assert S.split_texts(docs.where("doc_id = 2").union(docs.where("doc_id = 2"))).groupBy("doc_id", "piece").count().where("count <> 2").count() == 0
    assert S.split_texts(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        S.split_texts(docs, limit=5, overlap=5)


def test_packing_places_everything_once(spark, docs):
    placed = P.pack_texts(docs.union(docs), capacity=300, block_items=5)
    rows = placed.collect()
    sizes = {r.item: r.n_tokens for r in T.sizes(docs).collect() if r.n_tokens}
    parts = {}
    for r in sorted(rows, key=lambda r: (r.item, r.part)):
        assert r.begin == parts.get(r.item, 0) and r.until - r.begin == r.n_tokens <= 300
        assert r.n_tokens == 300 or r.until == sizes[r.item]
        parts[r.item] = r.until
    assert parts == sizes
    loads = {}
    for r in rows:
        loads[r.container] = loads.get(r.container, 0) + r.n_tokens
    assert max(loads.values()) <= 300
    assert P.pack_texts(docs.where("false")).count() == 0
    assert P.fill_report(placed, 300).agg({"n_tokens": "sum"}).first()[0] == sum(sizes.values())


def test_fill_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(rng.integers(1, 51, 200))[::-1]
        gaps, want = [], []
        for s in sizes:
            fits = [g for g in gaps if g >= s]
            if fits:
                gaps[gaps.index(min(fits))] -= s
            else:
                gaps.append(50 - s)
        got = P.fill(sizes, 50)
        want = sorted(50 - g for g in gaps)
        assert sorted(np.bincount(got, weights=sizes).astype(int)) == want


def test_tiers_are_packed_and_gaps_filled_from_shorter_ones():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 257, 3000))[::-1]
    placed = {}
    for tiers in (1, 2, 4):
        lengths = P.window_sizes(256, tiers)
        tier = np.searchsorted(-np.array(lengths), -sizes, "right") - 1
        box, held, window = P.pack_tiers(sizes, tier, 256, tiers)
        assert (window >= 0).all() and (held <= tier).all()
        load = np.bincount(window, weights=sizes)
        of = dict(zip(window.tolist(), held.tolist()))
        assert all(load[w] <= lengths[k] for w, k in of.items())
        assert np.bincount(box, weights=sizes).max() <= 256
        assert 1 - sizes.sum() / (256 * (box.max() + 1)) < 0.01
        placed[tiers] = (held, box)
    assert len(set(placed[4][0].tolist())) > 2 and (placed[4][1] != placed[1][1]).any()


def test_step_groups_are_level():
    cost = np.random.default_rng(2).uniform(1, 2, 800)
    groups = P.balance(cost, 8)
    load = np.bincount(groups, weights=cost)
    assert np.bincount(groups).max() == 8 and load.max() / load.min() < 1.05
