import random

import pytest

from loomspark.operators import hierarchy as H

SCHEMA = "id long, parent_id long, qualified_name string, block string"


def brute(links):
    """Path of ids from the root, or the smallest id of the cycle it ends in."""
    trees, loops = {}, {}
    for n in links:
        seen, at = [], n
        while at in links and at not in seen:
            seen.append(at)
            at = links[at]
        if at in seen:
            loops[n] = min(seen[seen.index(at):])
        else:
            trees[n] = seen[::-1]
    return trees, loops


@pytest.mark.parametrize("spread", [1, 40_000])
def test_against_brute_force(spark, spread):
    rng = random.Random(spread)
    ids = [k * spread for k in range(10)]
    links = {i: rng.choice([None, *ids, 10**9, ids[0]]) for i in ids}
    df = spark.createDataFrame([(i, p, f"n{i}", "x") for i, p in links.items()] * 2, SCHEMA)
    trees, loops = brute(links)
    tree = H.hierarchy(df).cache()
    found = {r.id: r for r in tree.collect()}
    assert {i: r.path_ids for i, r in found.items()} == trees
    assert all(r.root == trees[i][0] and r.depth == len(trees[i]) - 1 for i, r in found.items())
    below = {i: sum(i in path[:-1] for path in trees.values()) for i in trees}
    assert {i: r.n_descendants for i, r in found.items()} == below
    assert {(r.cycle_id, r.id) for r in H.cyclic_nodes(df).collect()} == {(c, i) for i, c in loops.items()}
    pairs = {(r.id, r.descendant_id) for r in H.descendants(tree).collect()}
    assert pairs == {(a, i) for i, path in trees.items() for a in path[:-1]}


def test_deep_chain_across_blocks(spark):
    n = 5
    df = spark.createDataFrame([(k * H.BLOCK_IDS, (k - 1) * H.BLOCK_IDS if k else None, None, "") for k in range(n)], SCHEMA)
    last = H.hierarchy(df).orderBy("depth", ascending=False).first()
    assert (last.depth, last.root, last.path) == (n - 1, 0, "/" * (n - 1))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1, "a", None), (1, 1, None, None)], SCHEMA)
    assert H.hierarchy(df).count() == 0
    assert [tuple(r) for r in H.cyclic_nodes(df).collect()] == [(1, 1)]
    assert H.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("base", [0, 1 << 60])
def test_cycle_in_block_with_children_in_another(spark, base):
    b = H.BLOCK_IDS
    links = {1: 1, 2: 1, b + 7: 2, 3: 4, 4: 3, 5: 4, 6: 5, b + 8: 6, 7: b + 8, 2 * b: 7, 8: 9_999, b + 9: 8, 10: None, b + 10: 10, 2 * b - 1: 10, b - 1: 2 * b - 1}
    links = {base + i: None if p is None else base + p for i, p in links.items()}
    df = spark.createDataFrame([(i, p, f"n{i}", "x") for i, p in links.items()], SCHEMA)
    trees, loops = brute(links)
    tree = H.hierarchy(df).cache()
    assert {r.id: r.path_ids for r in tree.collect()} == trees
    assert {(r.cycle_id, r.id) for r in H.cyclic_nodes(df).collect()} == {(c, i) for i, c in loops.items()}
    assert {(r.id, r.descendant_id) for r in H.descendants(tree).collect()} == {(a, i) for i, path in trees.items() for a in path[:-1]}


@pytest.mark.parametrize("heads", [0, 100_000])
def test_hashed_ids(spark, heads):
    """Most links crosses blocks: a long chain, a wide root, a far cycle with a tail, and what hangs on a cycle of a block."""
    n, mix = 300, lambda k: (k * 0x9E3779B97F4A7C15) % (1 << 62)
    links = {mix(k): mix(k - 1) if k else None for k in range(n)}
    links |= {mix(n + k): mix(5) for k in range(500)}
    links |= {mix(9000 + k): mix(9000 + (k + 1) % 7) for k in range(7)} | {mix(9100): mix(9003), mix(9101): mix(9100)}
    links |= {1: 1, 2: 1, mix(9200): 2, mix(9201): mix(9200)}
    trees, loops = brute(links)
    df = spark.createDataFrame([(i, p, f"n{i}", "x") for i, p in links.items()], SCHEMA)
    found = {r.id: r for r in H.hierarchy(df, path_ids=False, heads=heads, block_nodes=40).collect()}
    assert set(found) == set(trees)
    below = dict.fromkeys(trees, 0)
    for path in trees.values():
        for a in path[:-1]:
            below[a] += 1
    for i, path in trees.items():
        r = found[i]
        assert (r.root, r.depth, r.n_descendants, r.path) == (path[0], len(path) - 1, below[i], "/".join(f"n{a}" for a in path))
    assert {(r.cycle_id, r.id) for r in H.cyclic_nodes(df, heads=heads, block_nodes=40).collect()} == {(c, i) for i, c in loops.items()}


@pytest.mark.parametrize("spread,heads", [(1, 1000), (20_000, 1000), (20_000, 0)])
def test_lists_sent_upward(spark, spread, heads):
    rng = random.Random(7)
    ids = [k * spread for k in range(60)]
    links = {i: rng.choice([None, ids[0], *ids[: max(1, k)]]) if k % 9 else rng.choice(ids) for k, i in enumerate(ids)}
    df = spark.createDataFrame([(i, p, None, "x") for i, p in links.items()], SCHEMA)
    trees, _ = brute(links)
    want = {(a, i, len(path) - 1 - d) for i, path in trees.items() for d, a in enumerate(path[:-1])}
    rows = [tuple(r) for r in H.descendant_lists(df, heads=heads, block_nodes=5).collect()]
    assert len(rows) == len(want) and set(rows) == want
