"""Items packed into containers of one fixed capacity.

Hierarchical multi-length packing.  Every tier has a context size of its own,
the capacity divided by ``RATIO`` from tier to tier, and takes the items that
need it.  From the longest to the shortest each tier is packed into windows of
its size; then the gaps of these windows are filled from the shorter tiers, and
only what finds no gap is packed in its own tier.  A container holds one window
of the longest tier or ``RATIO`` windows of the next for each.  Containers are
then dealt to step groups so that the groups of a block cost about the same, the
cost of a container being the sum of its squared item sizes.

Only ids and sizes are shuffled, to blocks of about ``block_items`` items by a
hash of the id, so that no source, size or kind is a hot key.  Every block is
packed on its own and loses less than one container at its end.

Defined cases
-------------
* null ids and null texts are no items; an item without tokens is placed nowhere.
* repeated rows of an id are one item, with the greatest size.
* an item above the capacity is divided into parts of exactly the capacity and a
  rest; ``begin`` and ``until`` are its token positions.  No other is divided.
* equal sizes are taken in the order of their ids.
* an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import tokens

CAPACITY = 2048
TIERS = 4
RATIO = 2
GROUP = 8
BLOCK_ITEMS = 20_000

_PLACED = "container long, step_group long, item long, part int, begin long, until long, n_tokens int, tier int, window long, window_tier int"


class _Gaps:
    """Windows by the size of their gap; ``open_`` has the bit g set where one has a gap of g."""

    def __init__(self) -> None:
        self.open_ = 0
        self.by: dict[int, list[int]] = {}

    def add(self, gap: int, window: int) -> None:
        if gap:
            self.by.setdefault(gap, []).append(window)
            self.open_ |= 1 << gap

    def fit(self, size: int) -> int:
        """Puts ``size`` into the smallest gap that holds it; the window, or -1."""
        fits = self.open_ >> size
        if not fits:
            return -1
        gap = size + (fits & -fits).bit_length() - 1
        held = self.by[gap]
        window = held.pop()
        if not held:
            self.open_ ^= 1 << gap
        self.add(gap - size, window)
        return window


def window_sizes(capacity: int, tiers: int) -> list[int]:
    """Context size of each tier: the capacity, and ``RATIO`` times less from tier to tier."""
    return [max(1, capacity // RATIO**k) for k in range(tiers)]


def pack_tiers(size: np.ndarray, tier: np.ndarray, capacity: int, tiers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container of each item, the tier whose window holds it, and the window.

    ``size`` must fall.  Tier by tier, from the longest: what is left of the
    tier is packed by best fit into windows of its own context size, and then
    the gaps of these windows are filled from the shorter tiers, again the
    largest item first and each into the smallest gap that holds it.  Windows
    are laid into containers from the longest to the shortest; ``RATIO`` windows
    of a tier take the room of one of the next longer.
    """
    n = len(size)
    window = np.full(n, -1, np.int64)
    sizes = size.tolist()
    lengths = window_sizes(capacity, tiers)
    tier_of: list[int] = []
    for k in range(tiers):
        gaps = _Gaps()
        for i in np.flatnonzero((tier == k) & (window < 0)).tolist():
            at = gaps.fit(sizes[i])
            if at < 0:
                at = len(tier_of)
                tier_of.append(k)
                gaps.add(lengths[k] - sizes[i], at)
            window[i] = at
        for i in np.flatnonzero((tier > k) & (window < 0)).tolist():
            if not gaps.open_:
                break
            window[i] = gaps.fit(sizes[i])
    held = np.array(tier_of, np.int64)
    unit = RATIO ** (tiers - 1 - held)
    box = (np.cumsum(unit) - unit) // RATIO ** (tiers - 1)
    return box[window], held[window], window


def fill(size: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each of the falling sizes, packed by best fit as a single tier."""
    return pack_tiers(size, np.zeros(len(size), np.int64), capacity, 1)[2]


def balance(cost: np.ndarray, group: int) -> np.ndarray:
    """Step group of each container: dealt to and fro in falling order of cost."""
    groups = max(1, math.ceil(len(cost) / group))
    rank = np.empty(len(cost), np.int64)
    rank[np.argsort(-cost, kind="stable")] = np.arange(len(cost))
    turn, at = np.divmod(rank, groups)
    return np.where(turn % 2 == 0, at, groups - 1 - at)


def _pack(capacity: int, group: int, tiers: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "item", "part"], ascending=[False, True, True], ignore_index=True)
        size = pdf["n_tokens"].to_numpy(np.int64)
        box, held, window = pack_tiers(size, pdf["tier"].to_numpy(np.int64), capacity, tiers)
        cost = np.bincount(box, weights=size.astype(float) ** 2)
        base = int(pdf["block"].iat[0]) << 32
        return pd.DataFrame(
            {
                "container": base + box, "step_group": base + balance(cost, group)[box], "item": pdf["item"], "part": pdf["part"],
                "begin": pdf["begin"], "until": pdf["begin"] + size, "n_tokens": pdf["n_tokens"], "tier": pdf["tier"],
                "window": base + window, "window_tier": held,
            }
        )

    return run


def pack(
    sizes: DataFrame, n_items: int, capacity: int = CAPACITY, tiers: int = TIERS, group: int = GROUP, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """Places ``(item, n_tokens)``; ``n_items`` sets the number of blocks only."""
    if capacity < 1 or tiers < 1 or group < 1:
        raise ValueError("capacity, tiers and group must be at least 1")
    blocks = max(1, math.ceil(n_items / block_items))
    once = sizes.where("item IS NOT NULL AND n_tokens > 0").groupBy("item").agg(F.max("n_tokens").cast("int").alias("all"))
    parts = once.select("item", "all", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / capacity).cast("int"))).alias("part"))
    begin = F.col("part").cast("long") * capacity
    size = F.least(F.lit(capacity), F.col("all") - begin).cast("int")
    tier = F.lit(tiers - 1)
    for k, shorter in reversed(list(enumerate(window_sizes(capacity, tiers)[1:]))):
        tier = F.when(F.col("n_tokens") > shorter, k).otherwise(tier)
    items = parts.select(
        F.pmod(F.xxhash64("item", "part"), F.lit(blocks)).alias("block"), "item", "part", begin.alias("begin"), size.alias("n_tokens")
    ).withColumn("tier", tier)
    return items.groupBy("block").applyInPandas(_pack(capacity, group, tiers), _PLACED)


def pack_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = tokens.TOKENIZER, **more
) -> DataFrame:
    """Texts sized by ``tokenizer`` and placed; one row per item or part."""
    return pack(tokens.sizes(df, id_col, text_col, tokenizer), df.count(), capacity, **more)


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """By the longest window of a container: containers, items, tokens, unused share."""
    boxes = placed.groupBy("container").agg(F.min("window_tier").alias("tier"), F.count("*").alias("k"), F.sum("n_tokens").alias("t"))
    return boxes.groupBy("tier").agg(
        F.count("*").alias("n_containers"), F.sum("k").alias("n_items"), F.sum("t").alias("n_tokens"),
        (1 - F.sum("t") / (F.count("*") * capacity)).alias("unused"),
    )
