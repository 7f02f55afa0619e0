"""Parent links to whole hierarchies: path, depth, root, descendants, cycles.

Leaves are peeled bottom-up.  Runs of ``BLOCK_IDS`` neighbouring ids are dealt by
hash to blocks of about ``BLOCK_NODES`` nodes, which the number of nodes sets,
and within a block the peeling runs to its end in one task: each node sends its subtree size and, as an
interval of the block's order, the list of its descendants to its parent; what
is never peeled lies on a cycle.  In reverse peel order every node takes height
and path from its parent.

Links that cross blocks are few where neighbours have neighbouring ids, and as
many as nodes where ids are hashed.  The trees of a block are contracted to
their heads, and each head is linked to the head of the tree its parent stands
in.  Up to ``HEADS`` heads are one block of the same peeling; beyond that
number pointers are doubled, so that the rounds are the logarithm of the longest
chain of heads, and each reads the heads only.  A second pass over the blocks
adds what the heads found: sizes sent up from other blocks, and root, depth and
path handed down.  Blocks follow the ids and never the links, however skewed
these are, and messages to one parent are added up before they travel.

Defined cases
-------------
* null id: no node, dropped.  Repeated ids: one node; the smallest non-null
  parent and the greatest non-null name hold, should the rows disagree.
* a parent that names no node ends the chain like a null.
* a node that is its own parent is a cycle of length one.
* null name: the path has ``""`` at its place.
* columns other than the three named are ignored; an empty table gives an
  empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import cut

_SHIFT = 12
#: Neighbouring ids that stay together, and nodes that a task peels at a time.
BLOCK_IDS = 1 << _SHIFT
BLOCK_NODES = 1 << 14
#: Heads that one task peels; of three longs and a path each.
HEADS = 1 << 17
_CHARS_AT_ONCE = 1 << 23
_ROWS_AT_ONCE = 1 << 18

_HEADS = "id long, attach long, size long, asked boolean, top long, height int, low long, cycle_id long, path string, path_ids array<long>"
_SOLVED = "id long, root long, depth int, cycle_id long, total long, path string, path_ids array<long>"
_LINKS = "id long, up long, attach long, step int, low long, size long, path string, path_ids array<long>"
_OUT = "id long, root long, depth int, cycle_id long, below long, path string, path_ids array<long>"
_PAIRS = "id long, descendant_id long, distance int, head long"


def _peel(parent: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Layers in which a forest of parents (-1: none) is peeled, what is left, and the summed weights."""
    n = len(parent)
    total = weight.copy()
    left = np.bincount(parent[parent >= 0], minlength=n)
    rest = np.ones(n, bool)
    layers = []
    layer = np.flatnonzero(left == 0)
    while len(layer):
        rest[layer] = False
        layers.append(layer)
        up = layer[parent[layer] >= 0]
        to = parent[up]
        np.add.at(total, to, total[up])
        np.subtract.at(left, to, 1)
        to = np.unique(to)
        layer = to[left[to] == 0]
    return layers, rest, total


def _least_on_cycles(parent: np.ndarray, rest: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The least ``low`` of its cycle for every node that peeling has left."""
    out = np.full(len(parent), -1, np.int64)
    seen = ~rest
    for i in np.flatnonzero(rest).tolist():
        ring = []
        while not seen[i]:
            seen[i] = True
            ring.append(i)
            i = parent[i]
        if ring:
            out[ring] = low[ring].min()
    return out


class _Block:
    """The peeled nodes of one block."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        pdf = pd.concat(list(batches)).sort_values("id", ignore_index=True)
        self.pdf = pdf
        self.ids = pdf["id"].to_numpy(np.int64)
        n = len(self.ids)
        self.known = pdf["known"].to_numpy(bool)
        self.pid = pdf["pid"].to_numpy(np.int64)
        at = np.minimum(np.searchsorted(self.ids, self.pid), n - 1)
        self.parent = np.where(self.known & (self.ids[at] == self.pid), at, -1)
        self.far = pdf["far"].to_numpy(bool)
        self.layers, rest, self.size = _peel(self.parent, pdf["weight"].to_numpy(np.int64))
        cycle = _least_on_cycles(self.parent, rest, self.ids)
        lost = rest.copy()
        self.top, self.height, self.low = np.arange(n), np.zeros(n, np.int32), self.ids.copy()
        for layer in reversed(self.layers):
            layer = layer[self.parent[layer] >= 0]
            up = self.parent[layer]
            lost[layer], cycle[layer] = lost[up], cycle[up]
            inner = ~rest[up]
            a, b = layer[inner], up[inner]
            self.top[a], self.height[a], self.low[a] = self.top[b], self.height[b] + 1, np.minimum(self.low[a], self.low[b])
        self.lost, self.cycle = lost, cycle  # on a cycle of the block, or with a chain into one

    def trail(self, i: int) -> list[int]:
        """Nodes from the head of the tree down to ``i``."""
        out = []
        while i >= 0:
            out.append(i)
            i = self.parent[i]
        return out[::-1]


def _nullable(values: np.ndarray, null: np.ndarray):
    out = pd.array(values, dtype="Int64")
    out[null] = pd.NA
    return out


def _objects(values: list | None, n: int) -> pd.Series:
    """A column of strings or lists, which an empty frame has as well."""
    return pd.Series([None] * n if values is None else values, dtype=object)


def _heads(named: bool, listed: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = _Block(batches)
        asked = b.pdf["asked"].to_numpy(bool)
        at = np.flatnonzero(b.far | asked)
        names = b.pdf["name"].fillna("").tolist() if named else None
        trails = [b.trail(i) if asked[i] and not b.lost[i] else [] for i in at] if named or listed else []
        yield pd.DataFrame(
            {
                "id": b.ids[at],
                "attach": _nullable(b.pid[at], ~b.far[at]),
                "size": b.size[at],
                "asked": asked[at],
                "top": b.ids[b.top[at]],
                "height": b.height[at],
                "low": b.low[at],
                "cycle_id": _nullable(b.cycle[at], ~b.lost[at]),
                "path": _objects(["/".join(names[i] for i in t) for t in trails] if named else None, len(at)),
                "path_ids": _objects([b.ids[t].tolist() for t in trails] if listed else None, len(at)),
            }
        )

    return run


def _solve_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Root, depth, cycle, size and path of contracted heads, peeled as one block."""
    pdf = pd.concat(list(batches)).sort_values("id", ignore_index=True)
    ids, up = pdf["id"].to_numpy(np.int64), pdf["up"].to_numpy(np.int64)
    at = np.minimum(np.searchsorted(ids, up), len(ids) - 1)
    parent = np.where(ids[at] == up, at, -1)
    layers, rest, total = _peel(parent, pdf["size"].to_numpy(np.int64))
    cycle = _least_on_cycles(parent, rest, pdf["low"].to_numpy(np.int64))
    lost = rest.copy()
    root, depth = up.copy(), pdf["step"].to_numpy(np.int32).copy()
    named, listed = pdf["path"].notna().any(), pdf["path_ids"].notna().any()
    paths, lists = pdf["path"].tolist(), [None if x is None else list(x) for x in pdf["path_ids"]]
    for layer in reversed(layers):
        layer = layer[parent[layer] >= 0]
        over = parent[layer]
        lost[layer], cycle[layer] = lost[over], cycle[over]
        root[layer] = root[over]
        depth[layer] += depth[over]
        for i, j in zip(layer.tolist(), over.tolist()) if named or listed else ():
            if lost[i]:
                continue
            if named:
                paths[i] = f"{paths[j]}/{paths[i]}"
            if listed:
                lists[i] = lists[j] + lists[i]
    yield pd.DataFrame({
        "id": ids, "root": root, "depth": depth, "cycle_id": _nullable(cycle, ~lost), "total": total, "path": _objects(paths if named else None, len(ids)), "path_ids": _objects(lists if listed else None, len(ids)),
    })


def _solve_by_doubling(links: DataFrame) -> DataFrame:
    """As ``_solve_heads``, in rounds of joins over the heads, for more of them than a task may hold."""
    n = links.count()
    step = cut(links.select("id", F.col("up").alias("next"), "low").join(links.select(F.col("id").alias("next")), "next", "left_semi"), "hierarchy-ring")
    for _ in range(max(1, n.bit_length())):
        ahead = step.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        step = cut(step.join(ahead, "next").select("id", F.col("next2").alias("next"), F.least("low", "low2").alias("low")), "hierarchy-ring")
        if step.isEmpty():
            break
    # who still has a head before it after n steps has a cycle there
    ring = step.select(F.col("next").alias("at")).distinct().join(step.select(F.col("id").alias("at"), F.col("low").alias("cycle_id")), "at")
    lost = step.select("id", F.col("next").alias("at")).join(ring, "at").select("id", "cycle_id")
    trees = links.join(lost, "id", "left_anti")
    at = F.col("up").alias("next"), F.col("up").alias("root"), F.col("step").alias("depth"), F.col("size").alias("total"), "path", "path_ids"
    state = cut(trees.select("id", *at), "hierarchy-heads")
    while True:
        # the sizes of all that stand below the head that many links away are sent to it
        sent = state.groupBy(F.col("next").alias("id")).agg(F.sum("total").alias("more"))
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("root").alias("r2"), F.col("depth").alias("d2"), F.col("path").alias("p2"), F.col("path_ids").alias("i2"))
        new = state.join(ahead, "next", "left").join(sent, "id", "left").select(
            "id",
            F.col("n2").alias("next"),
            F.coalesce("r2", "root").alias("root"),
            (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"),
            F.when(F.col("p2").isNotNull(), F.concat_ws("/", "p2", "path")).otherwise(F.col("path")).alias("path"),
            F.coalesce(F.concat("i2", "path_ids"), "path_ids").alias("path_ids"),
        )
        state = cut(new, "hierarchy-heads")
        if state.where("next IS NOT NULL").isEmpty():
            break
    none = F.lit(None)
    solved = state.select("id", "root", "depth", none.cast("long").alias("cycle_id"), "total", "path", "path_ids")
    sizes = links.join(lost, "id").select("id", none.cast("long").alias("root"), none.cast("int").alias("depth"), "cycle_id", F.col("size").alias("total"), none.cast("string").alias("path"), none.cast("array<long>").alias("path_ids"))
    return solved.unionByName(sizes)


class _Solution:
    """Nodes in blocks, and the solved heads of the trees that hang in other blocks."""

    def __init__(self, df: DataFrame, id_col: str, parent_col: str, name_col: str | None, listed: bool = False, heads: int = HEADS, block_nodes: int = BLOCK_NODES):
        name = F.max(F.col(name_col).cast("string")) if name_col else F.lit(None).cast("string")
        nodes = (
            df.where(F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).cast("long").alias("id"))
            .agg(F.min(F.col(parent_col).cast("long")).alias("pid"), name.alias("name"))
        )
        nodes = cut(nodes, "hierarchy-nodes")
        blocks = max(1, -(-nodes.count() // block_nodes))
        block = lambda c: F.pmod(F.xxhash64(F.shiftright(F.col(c), _SHIFT)), F.lit(blocks))
        self.nodes = nodes = nodes.withColumn("block", block("id")).withColumn("far", F.col("pid").isNotNull() & (block("pid") != F.col("block")))
        far = nodes.where("far").select(F.col("pid").alias("id")).distinct()
        first = nodes.join(far.withColumn("asked", F.lit(True)), "id", "left")
        rows = self._rows(first, F.coalesce("asked", F.lit(False)).alias("asked"), F.lit(1).cast("long").alias("weight"))
        found = cut(rows.groupBy("block").applyInPandas(_heads(name_col is not None, listed), _HEADS), "hierarchy-heads")
        up = found.where("asked").select(
            F.col("id").alias("attach"), F.col("top").alias("up"), (F.col("height") + 1).alias("step"), "low", "cycle_id", "path", "path_ids"
        )
        links = found.where("attach IS NOT NULL").select("id", "attach", "size").join(up, "attach")
        links = cut(links, "hierarchy-links")
        # a head that hangs in a cycle of another block is solved; one whose parent is no node is a root and stays out
        done = links.where("cycle_id IS NOT NULL")
        open_ = links.where("cycle_id IS NULL").drop("cycle_id")
        if open_.limit(heads + 1).count() <= heads:
            solved = open_.groupBy((F.col("id") * 0).alias("all")).applyInPandas(_solve_heads, _SOLVED)
        else:
            solved = _solve_by_doubling(open_)
        self._lead(solved, done, open_, name_col, listed)

    def _lead(self, solved, done, open_, name_col, listed) -> None:
        # heads below one that hangs in another block's cycle end at its cycle: their root is that head or its tree
        ends = done.select(F.col("id").alias("root"), F.col("cycle_id").alias("c2"))
        solved = solved.join(ends, "root", "left").withColumn("cycle_id", F.coalesce("cycle_id", "c2")).drop("c2")
        flat = done.select("id", F.lit(None).cast("long").alias("root"), F.lit(None).cast("int").alias("depth"), "cycle_id", F.col("size").alias("total"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<long>").alias("path_ids"))
        self.heads = cut(solved.select(*flat.columns).unionByName(flat), "hierarchy-solved")
        # one message per parent: the sizes of all trees that hang below it in other blocks
        self.sent = self.heads.where("cycle_id IS NULL").select("id", "total").join(open_.select("id", "attach"), "id").groupBy(F.col("attach").alias("id")).agg(F.sum("total").alias("more"))

    @staticmethod
    def _rows(nodes: DataFrame, *more) -> DataFrame:
        # a long column with nulls would reach pandas as floats, which hold 53 bits
        return nodes.select("block", "id", F.coalesce("pid", F.lit(0)).alias("pid"), F.col("pid").isNotNull().alias("known"), "far", "name", *more)

    def second(self, run, schema: str) -> DataFrame:
        told = self.heads.select("id", "root", F.col("depth").alias("over"), F.col("cycle_id").alias("ring"), F.col("path").alias("prefix"), F.col("path_ids").alias("prefix_ids"))
        more = [(F.lit(1) + F.coalesce("more", F.lit(0))).alias("weight"), F.coalesce("root", F.lit(0)).alias("root"), "over", F.coalesce("ring", F.lit(0)).alias("ring"), F.col("ring").isNotNull().alias("rung"), "prefix", "prefix_ids"]
        rows = self._rows(self.nodes.join(self.sent, "id", "left").join(told, "id", "left"), *more)
        return rows.groupBy("block").applyInPandas(run, schema)


def _told(b: _Block):
    """Per node: whether its tree hangs below a head, root, depth, cycle and whether there is one."""
    hung = b.pdf["over"].notna().to_numpy()
    over = b.pdf["over"].fillna(0).to_numpy(np.int32)
    root = np.where(hung, b.pdf["root"].to_numpy(np.int64), b.ids)
    rung = b.pdf["rung"].to_numpy(bool)
    lost = b.lost | rung[b.top]
    cycle = np.where(b.lost, b.cycle, b.pdf["ring"].to_numpy(np.int64)[b.top])
    return hung[b.top], root[b.top], over[b.top] + b.height, cycle, lost


def _trees(named: bool, listed: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = _Block(batches)
        _, root, depth, _, lost = _told(b)
        names = b.pdf["name"].fillna("").tolist()
        prefix, before = b.pdf["prefix"].tolist(), b.pdf["prefix_ids"].tolist()
        order = np.argsort(b.height, kind="stable")
        order = order[~lost[order]].tolist()
        parent, height = b.parent.tolist(), b.height.tolist()
        # a path is held until the next level has been made from it
        held, fresh, level, out, chars = {}, {}, 0, [], 0

        def batch():
            at = np.array([i for i, _, _ in out], np.int64)
            return pd.DataFrame(
                {
                    "id": b.ids[at], "root": root[at], "depth": depth[at], "cycle_id": pd.array([pd.NA] * len(at), dtype="Int64"), "below": b.size[at] - 1,
                    "path": _objects([p for _, p, _ in out] if named else None, len(at)), "path_ids": _objects([x for _, _, x in out] if listed else None, len(at)),
                }
            )

        for i in order:
            if height[i] > level:
                held, fresh, level = fresh, {}, height[i]
            if parent[i] >= 0:
                path, trail = held[parent[i]]
                path = f"{path}/{names[i]}" if named else ""
                trail = [*trail, int(b.ids[i])] if listed else ()
            else:
                path = names[i] if prefix[i] is None else f"{prefix[i]}/{names[i]}"
                trail = [*(() if before[i] is None else before[i]), int(b.ids[i])] if listed else ()
            fresh[i] = path, trail
            out.append((i, path, trail))
            chars += len(path) + 64 + 8 * len(trail)
            if chars > _CHARS_AT_ONCE:
                yield batch()
                out, chars = [], 0
        yield batch()

    return run


def _rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    b = _Block(batches)
    _, _, _, cycle, lost = _told(b)
    yield pd.DataFrame({"id": b.ids[lost], "cycle_id": cycle[lost]})


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Descendants inside the block, and nodes that hang below a head of another block.

    The list that a node sends to its parent is the stretch of the block's
    order that begins behind the node; the parent's holds those of its children.
    """
    b = _Block(batches)
    hung, _, depth, _, lost = _told(b)
    inside = _peel(b.parent, np.ones(len(b.ids), np.int64))[2]
    place, free = np.zeros(len(b.ids), np.int64), np.zeros(len(b.ids), np.int64)
    at = 0
    for layer in reversed(b.layers):
        for i in layer[~lost[layer]].tolist():
            j = b.parent[i]
            if j < 0:
                place[i], at = at, at + inside[i]
            else:
                place[i] = free[j]
                free[j] += inside[i]
            free[i] = place[i] + 1
    order = np.zeros(at, np.int64)
    order[place[~lost]] = np.flatnonzero(~lost)

    def pairs(some):
        a = np.repeat(some, inside[some] - 1)
        d = np.concatenate([order[place[i] + 1 : place[i] + inside[i]] for i in some]) if len(some) else a
        return pd.DataFrame({"id": b.ids[a], "descendant_id": b.ids[d], "distance": b.height[d] - b.height[a], "head": pd.array([pd.NA] * len(a), dtype="Int64")})

    some, rows = [], 0
    for i in np.flatnonzero(~lost & (inside > 1)).tolist():
        some.append(i)
        rows += int(inside[i]) - 1
        if rows > _ROWS_AT_ONCE:
            yield pairs(np.array(some))
            some, rows = [], 0
    yield pairs(np.array(some, np.int64))
    at = np.flatnonzero(hung & ~lost)
    yield pd.DataFrame({"id": b.ids[at], "descendant_id": b.ids[at], "distance": depth[at], "head": pd.array(b.ids[b.top[at]], dtype="Int64")})


def hierarchy(
    df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", name_col: str = "qualified_name", path_ids: bool = True, **sizes: int
) -> DataFrame:
    """One row per node whose chain of parents ends.

    Columns: ``id, root, depth`` (0 at a root), ``path`` (names from the root,
    joined by ``/``), where asked for ``path_ids`` (ids from the root to the
    node), and ``n_descendants``.  Nodes on or below a cycle are left to
    :func:`cyclic_nodes`.  ``sizes`` may set ``heads`` and ``block_nodes``.
    """
    solution = _Solution(df, id_col, parent_col, name_col, path_ids, **sizes)
    ids = ["path_ids"] if path_ids else []
    return solution.second(_trees(True, path_ids), _OUT).select("id", "root", "depth", "path", *ids, F.col("below").alias("n_descendants"))


def descendants(tree: DataFrame) -> DataFrame:
    """All descendants of each node of :func:`hierarchy` with ``path_ids``, one row per pair.

    The list of a node is kept as rows ``(id, descendant_id, distance)``, so that
    a root above a third of all nodes never becomes one row.
    """
    return (
        tree.where("depth > 0")
        .select(F.col("id").alias("descendant_id"), "depth", F.posexplode(F.slice("path_ids", F.lit(1), F.col("depth"))).alias("at", "id"))
        .select("id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
    )


def descendant_lists(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", **sizes: int) -> DataFrame:
    """``(id, descendant_id, distance)`` as :func:`descendants` has it, from lists sent upward.

    Inside a block the lists are made while its trees are peeled; the list of a
    head goes, row by row, to every node above it in other blocks.
    """
    solution = _Solution(df, id_col, parent_col, None, True, **sizes)
    found = cut(solution.second(_lists, _PAIRS), "hierarchy-lists")
    above = solution.heads.where("cycle_id IS NULL").select(F.col("id").alias("head"), "path_ids")
    far = found.where("head IS NOT NULL").join(above, "head").select("descendant_id", F.col("distance").alias("depth"), F.posexplode("path_ids").alias("at", "id"))
    return found.where("head IS NULL").drop("head").unionByName(far.select("id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance")))


def cyclic_nodes(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", **sizes: int) -> DataFrame:
    """``(cycle_id, id)`` of every node on a cycle or with a chain into one."""
    return _Solution(df, id_col, parent_col, None, False, **sizes).second(_rings, "id long, cycle_id long").select("cycle_id", "id")
