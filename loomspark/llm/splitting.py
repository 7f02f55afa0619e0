"""Texts above a limit cut into overlapping pieces at natural boundaries.

Structure-tree packing.  Headings, markup, fences, lists, indentation, blank
lines and lines give every line start a level; the stretches between boundaries
of a level are the nodes of the tree at that level, and those of the next deeper
level their children.  Sibling subtrees are merged up to the limit, and only a
node above it is descended into: below the lines, by sentences, words and, for a
text without any break, tokens.

Sizes are positions in the tokens of the whole text.  A piece begins ``overlap``
tokens before the end of its predecessor.  A piece is counted again on its own;
should a cut have changed the tokens around it so that it exceeds the limit, it
is packed again with a smaller share.

Defined cases
-------------
* null ids and null texts, and texts of up to ``limit`` tokens, give no pieces.
* the pieces of a text, without their overlaps, are the whole text in order.
* fewer tokens overlap only where the preceding pieces hold fewer, or where the
  cut would fall within one character's tokens.
* repeated rows give repeated pieces; an empty table gives none; other columns
  are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import tokens

LIMIT = 512
OVERLAP = 48

_PIECE = "doc_id long, piece int, n_pieces int, begin long, core_begin long, until long, n_tokens int, boundary string, text string"
_HEAD = re.compile(r"(#{1,6})[ \t]|<h([1-6])\b", re.I)
_FENCE = re.compile(r"[ \t]*(?:```|~~~)")
_RULE = re.compile(r"(?:-{3,}|\*{3,}|_{3,}|={3,})\s*$")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|\d+[.)])[ \t]")
_BLOCK = re.compile(r"[ \t]*</?(?:section|article|div|table|ul|ol|pre|p|tr|li)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])")
_WORD = re.compile(r"(?<=\s)(?=\S)|(?<=[,;，、])")

# levels of boundaries: 1-6 headings, then
_PARAGRAPH, _MARKUP, _LIST, _FENCED, _LINE, _SENT, _WRD, _TOK = 7, 8, 9, 15, 16, 17, 18, 19
_NAME = {_PARAGRAPH: "paragraph", _MARKUP: "markup", _FENCED: "code", _LINE: "line", _SENT: "sentence", _WRD: "word", _TOK: "token"}


def _name(level: int) -> str:
    return "end" if level == 0 else "heading" if level < _PARAGRAPH else _NAME.get(level, "list")


def line_boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of lines but the first, and their levels."""
    places, levels = [], []
    at, fence, blank = 0, False, False
    for line in text.splitlines(keepends=True):
        if _FENCE.match(line):
            level = _LINE if fence else _PARAGRAPH
            fence = not fence
        elif fence:
            level = _FENCED if blank else _LINE
        elif m := _HEAD.match(line):
            level = len(m[1]) if m[1] else int(m[2])
        elif not line.strip():
            level = _LINE
        elif blank or _RULE.match(line):
            indent = len(line) - len(line.lstrip())
            level = _PARAGRAPH if not indent else _MARKUP
        elif _BLOCK.match(line):
            level = _MARKUP
        elif _ITEM.match(line):
            level = min(_LIST + (len(line) - len(line.lstrip())) // 2, _FENCED - 1)
        else:
            level = _LINE
        if at:
            places.append(at)
            levels.append(level)
        blank = not line.strip()
        at += len(line)
    return np.array(places, np.int64), np.array(levels, np.int64)


class _Tree:
    """The tree of one text; a node is a stretch and the level of its children."""

    def __init__(self, text: str, path: str, starts: np.ndarray):
        self.text, self.path, self.starts = text, path, starts
        self.places, self.levels = line_boundaries(text)

    def size(self, a: int, b: int) -> int:
        return int(np.searchsorted(self.starts, b) - np.searchsorted(self.starts, a))

    def children(self, a: int, b: int, level: int) -> tuple[list[int], int]:
        """Inner boundaries of the highest level at or below ``level``, and it."""
        if level <= _LINE:
            lo, hi = np.searchsorted(self.places, [a + 1, b])
            inner = self.levels[lo:hi]
            deep = inner[inner >= level]
            if len(deep):
                top = int(deep.min())
                return self.places[lo:hi][inner <= top].tolist(), top
        for k, pattern in ((_SENT, _SENTENCE), (_WRD, _WORD)):
            if level <= k:
                cut = [m.end() for m in pattern.finditer(self.text, a, b) if a < m.end() < b]
                if cut:
                    return cut, k
        lo, hi = np.searchsorted(self.starts, [a + 1, b])
        return np.unique(self.starts[lo:hi]).tolist(), _TOK

    def pack(self, a: int, b: int, level: int, budget: int) -> list[tuple[int, int, int]]:
        """``(begin, end, level of the end)`` of merged siblings up to the budget."""
        cuts, here = self.children(a, b, level)
        out: list[tuple[int, int, int]] = []
        if not cuts:  # a single character: nothing to cut
            return [(a, b, 0)]
        edges = np.array([a, *cuts, b], np.int64)
        at = np.searchsorted(self.starts, edges)
        i, n = 0, len(edges) - 1
        while i < n:
            # the farthest sibling that still fits
            j = int(np.searchsorted(at, at[i] + budget, "right")) - 1
            if j > i:
                j = min(j, n)
                out.append((int(edges[i]), int(edges[j]), here))
                i = j
            else:
                if here < _TOK:
                    below = self.pack(int(edges[i]), int(edges[i + 1]), here + 1, budget)
                    below[-1] = (*below[-1][:2], here)
                    out += below
                else:
                    out.append((int(edges[i]), int(edges[i + 1]), here))
                i += 1
                # the rest of a divided node takes its next siblings in
                k = int(np.searchsorted(at, np.searchsorted(self.starts, out[-1][0]) + budget, "right")) - 1
                if k > i:
                    k = min(k, n)
                    out[-1] = (out[-1][0], int(edges[k]), here)
                    i = k
        return out

    def back(self, at: int, overlap: int) -> int:
        """The place ``overlap`` tokens before ``at``."""
        return int(self.starts[max(0, int(np.searchsorted(self.starts, at)) - overlap)]) if overlap and at else at

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
        """``(begin, core begin, end, tokens, level)`` in order."""
        todo = [(*p, limit - overlap) for p in reversed(self.pack(0, len(self.text), 1, limit - overlap))]
        out = []
        while todo:
            a, b, level, budget = todo.pop()
            begin = self.back(a, overlap)
            n = tokens.counts([self.text[begin:b]], self.path)[0]
            smaller = min(budget, self.size(a, b)) - max(1, n - limit)
            if n > limit and smaller > 0:
                parts = self.pack(a, b, 1, smaller)
                if len(parts) > 1:
                    parts[-1] = (*parts[-1][:2], level)
                    todo += [(*p, smaller) for p in reversed(parts)]
                    continue
            if n > limit:  # what precedes the core gives way
                for keep in range(overlap, -1, -1):
                    begin = self.back(a, keep)
                    n = tokens.counts([self.text[begin:b]], self.path)[0]
                    if n <= limit:
                        break
            out.append((begin, a, b, n, level))
        begin, a, b, n, _ = out[-1]
        out[-1] = (begin, a, b, n, 0)
        return out


def split_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = tokens.TOKENIZER
) -> DataFrame:
    """One row per piece: places in characters, tokens, kind of boundary, text.

    Nothing is shuffled.  A text of no more bytes than ``limit`` cannot have more
    tokens and is passed over before Python sees it.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and the limit")

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            out = []
            for doc, text, starts in zip(pdf["doc_id"].tolist(), texts, tokens.starts(texts, tokenizer)):
                if len(starts) <= limit:
                    continue
                found = _Tree(text, tokenizer, starts).pieces(limit, overlap)
                out += [(doc, k, len(found), a, c, b, t, _name(v), text[a:b]) for k, (a, c, b, t, v) in enumerate(found)]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "n_pieces", "begin", "core_begin", "until", "n_tokens", "boundary", "text"])

    rows = df.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) > limit))
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, _PIECE)
