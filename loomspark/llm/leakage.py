"""Evaluation passages that leak into a corpus.

Wu-Manber multi-pattern search over the letters and digits of each text.  Every
passage gives test strings that begin at its words, of ``SEED`` signs or, where
``RUN`` words hold fewer, of the next length of ``LENGTHS``.  For each length a
shift table over blocks of signs tells how far the search may jump, a
suffix-hash bucket selects the test strings that can end where no jump is
possible, and an alignment of words, which allows one word in eight to be altered
or missing at any place, confirms or rejects the occurrence.  The search runs through many
stretches of text at a time, one step of each per vector operation.

Any stretch of 22 words with two of them altered keeps a run of seven words
(24 with three: six), a test string begins at every word of a passage that is
not shared, and it ends within ``RUN`` words, so no stretch is lost before the
comparison.

Defined cases
-------------
* null or empty texts and passages, and null ids, give no rows; nothing else is
  skipped and whole texts are searched.
* letter case, punctuation, spacing, line layout, markup, escapes, lookalike
  and invisible characters make no difference.
* words of a passage that lie in wording of ``SHARED`` or more words which
  passages of other items have too do not count.
* a repeated document id or item gives its pairs once.
* other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 22
ONE_IN = 8
SHARED = 8
SEED = 16
#: Words that stay side by side wherever one in eight of a stretch is altered.
RUN = 6
#: Lengths of test strings with the block of their shift table; short words give the short ones.
LENGTHS = {SEED: 6, 8: 4, 6: 4}
ITEMS_PER_PASS = 5000
_STRETCH = 1024
_BITS = 20
_CHARS_AT_ONCE = 2_000_000

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans(
    "абвгԁеѕһіјкӏмнорсԛгтуԝхүьАВЕЅІЈКМНОРСТУХԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγειικνορτυχϲϳɑɡıⅼℓøØłŁđĐ",
    "abbrdeshijkimhopcqrtywxybabesijkmhopctyxqwabezhikmnoptyxayeiikvoptuxcjagilloolldd",
)
_ESCAPED = re.compile(r"\\+(?:u\{?([0-9a-fA-F]{4,6})\}?|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|[nrtbfv0](?![a-z]{0,1}:)|.)", re.S)
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ATTR = r"\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s\"'<>`]+))?"
_TAG = re.compile(rf"</?[A-Za-z][^<>\n]{{0,120}}>|<[A-Za-z][\w:.-]*(?:{_ATTR})*\s*/?>|<[A-Za-z][\w:-]*\s+[\w:@.-]+=[\"'][^<>\n]*>|<!--.*?-->", re.S)
_TARGET = re.compile(r"\]\((?:[#./][^()\s]*|[^()\s/]*/[^()\s]*|[^()\s]*\.(?:md|html?))(?:[ \t]+\"[^\"\n]*\")?\)")
_PREFIX = re.compile(r"^[ \t>#*/|;%+-]*(?:\[?\(?\d{1,6}\)?\]?[ \t]*[.:|)\]>]+[ \t]?|\d{1,6}\t|[ \t]*\d{1,6}[ \t]{2,})", re.M)
_NOT_WORD = re.compile(r"[\W_]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_DROP = bytes(c for c in range(128) if not chr(c).isalnum())


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code:
        try:
            return chr(int(code, 16))
        except (ValueError, OverflowError):
            return " "
    return " "


def plain(text: str) -> str:
    """``text`` in lower case, without layout prefixes, markup and escapes."""
    if "\\" in text:
        text = _ESCAPED.sub(_unescape, text)
    if "%" in text:
        text = _PERCENT.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _TARGET.sub("]", text)
    text = _PREFIX.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_LOOKALIKES)).translate(_LOOKALIKES)
        text = "".join(c for c in text if c.isascii() or unicodedata.category(c) not in ("Mn", "Me", "Cf", "Cc"))
    return text.lower()


def squeeze(text: str) -> str:
    """The letters and digits of :func:`plain`."""
    return _joined(plain(text))


def _joined(text: str) -> str:
    """The letters and digits of a plain text."""
    if text.isascii():
        return text.encode().translate(_LOWER, _DROP).decode()
    return _NOT_WORD.sub("", text)


def _words(text: str) -> list[str]:
    return [w for w in _NOT_WORD.split(plain(text)) if w]


_ALNUM = np.array([chr(c).isalnum() for c in range(128)])
_SPACE = np.array([chr(c).isspace() for c in range(128)])


def _edges(text: str) -> tuple[list[int], list[int]]:
    """Where words, and stretches without white space, begin and end among the letters and digits of a plain text."""
    if text.isascii():
        raw = np.frombuffer(text.encode(), np.uint8)
        held = _ALNUM[raw]
        upto = np.cumsum(held)
        ends = upto[held & ~np.append(held[1:], False)]
        return [0, *ends.tolist()], np.unique(np.concatenate([[0], upto[_SPACE[raw]], upto[-1:]])).tolist()
    words = [0, *accumulate(len(w) for w in _NOT_WORD.split(text) if w)]
    return words, [0, *accumulate(n for w in text.split() if (n := len(_NOT_WORD.sub("", w))))]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_MIX = np.array([1, 131, 17161, 2248091, 294499921, 4219586051 & 0xFFFFFFFF], np.uint64)
_POW = np.array([pow(1_000_003, k, 1 << 64) for k in range(SEED)], np.uint64)


def _blocks(codes: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
    """Hash of the block of ``block`` signs that ends at each place of ``last``."""
    h = np.zeros(len(last), np.uint64)
    for k in range(block):
        h += codes[last - k].astype(np.uint64) * _MIX[k]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def _strings(codes: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` signs that end at each place of ``last``."""
    h = np.zeros(len(last), np.uint64)
    for k in range(length):
        h += codes[last - k].astype(np.uint64) * _POW[k]
    return h


class _Strings:
    """Shift table and suffix buckets of test strings of one length."""

    def __init__(self, length: int, block: int, flat: np.ndarray, last: list[int], owner: list[int], place: list[int]):
        self.length, self.block = length, block
        ends = np.array(last, np.int64)
        self.shift = np.full(1 << _BITS, length - block + 1, np.int16)
        for back in range(length - block, -1, -1):
            np.minimum.at(self.shift, _blocks(flat, ends - back, block), np.int16(back))
        whole = _strings(flat, ends, length)
        order = np.argsort(whole, kind="stable")
        self.hash = whole[order]
        self.owner = np.array(owner, np.int64)[order]
        self.place = np.array(place, np.int64)[order]

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a test string begins, and its number."""
        none = np.zeros(0, np.int64)
        if len(codes) < self.length:
            return none, none
        at = np.arange(self.length - 1, len(codes), _STRETCH, dtype=np.int64)
        end = np.minimum(at + _STRETCH, len(codes))
        stops = []
        while len(at):
            jump = self.shift[_blocks(codes, at, self.block)]
            stop = at[jump == 0]
            if len(stop):
                stops.append(stop)
            at = at + np.maximum(jump, 1)
            on = at < end
            at, end = at[on], end[on]
        if not stops:
            return none, none
        stop = np.sort(np.concatenate(stops))
        h = _strings(codes, stop, self.length)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        where = np.repeat(stop, n) - (self.length - 1)
        which = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return where, which


class Patterns:
    """Test strings and passages of one block of items."""

    def __init__(self, items: list[tuple[int, str]], shared_in: dict[tuple[str, ...], int] | None = None):
        self.items, self.words, self.counts, self.counted, self.starts, self.text = [], [], [], [], [], []
        listed = [(i, _words(p)) for i, p in items]
        seen = shared_in if shared_in is not None else shared_wording(listed)
        at = 0
        codes = []
        found: dict[int, tuple[list, list, list]] = {length: ([], [], []) for length in LENGTHS}
        for item, words in listed:
            counts = np.ones(len(words), bool)
            for k in range(len(words) - SHARED + 1):
                if seen.get(tuple(words[k : k + SHARED]), 0) > 1:
                    counts[k : k + SHARED] = False
            if counts.sum() < MIN_WORDS - MIN_WORDS // ONE_IN:
                continue
            text = "".join(words)
            starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            n = len(self.items)
            self.items.append(item)
            self.words.append(words)
            self.counts.append(counts)
            self.counted.append(np.flatnonzero(counts).tolist())
            self.starts.append(starts)
            self.text.append(text)
            for k in np.flatnonzero(counts[: len(words) - RUN + 1]).tolist():
                # the run that is left unaltered holds RUN words at least; where these are short, so is the test string
                run = int(starts[k + RUN] - starts[k])
                length = next((x for x in LENGTHS if x <= run), 0)
                if length:
                    last, owner, place = found[length]
                    last.append(at + int(starts[k]) + length - 1)
                    owner.append(n)
                    place.append(k)
            codes.append(_codes(text))
            at += len(text)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        self.strings = [_Strings(length, LENGTHS[length], flat, *f) for length, f in found.items() if f[0]]

    def search(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places where test strings begin, with the passage and the word in it, by length of the string."""
        hits = []
        for held in self.strings:
            where, which = held.search(codes)
            hits.append((where, held.owner[which], held.place[which]))
        return hits

    def alone(self, text: str, at: int, n: int, k: int, edges: list[int]) -> bool:
        """Whether the ``RUN`` short words from word ``k`` of passage ``n`` on stand at ``at``, between edges of words."""
        starts = self.starts[n]
        run = self.text[n][starts[k] : starts[k + RUN]]
        return text.startswith(run, at) and _is_edge(edges, at) and _is_edge(edges, at + len(run))

    def _likely(self, n: int, text: str, at: int, k: int, wide: list[int]) -> bool:
        """Whether enough words of some ``MIN_WORDS`` around word ``k`` stand anywhere near ``at``.

        Every stretch that counts has such words near one of its test strings:
        where up to one word in eight differs, some ``MIN_WORDS`` of them hold at
        most ``_FEW`` that do.  An unaltered word is one run of letters and digits.
        """
        words, starts, counted = self.words[n], self.starts[n], self.counted[n]
        here = bisect_left(counted, k)
        near = counted[max(0, here - 2 * MIN_WORDS) : here + 2 * MIN_WORDS + RUN]
        if len(near) < MIN_WORDS:
            return False
        spare = 2 * _FEW
        low = _reach(wide, at, int(starts[k] - starts[near[0]]) + spare * _GAP, spare)
        high = at + int(starts[near[-1] + 1] - starts[k]) + spare * _GAP
        past = bisect_right(wide, high) + spare
        window = text[low : wide[past] if past < len(wide) else len(text)]
        upto = [0, *accumulate(words[j] in window for j in near)]
        return any(b - a >= MIN_WORDS - _FEW for a, b in zip(upto, upto[MIN_WORDS:]))

    def confirm(self, text: str, hits: list[tuple[int, int, int]], edges: list[int], wide: list[int]) -> dict[int, int]:
        """Items whose passage the text holds, with the longest stretch in words.

        ``edges`` are the places in ``text`` where its words begin and end,
        ``wide`` those where what stands between white space does.
        """
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, n, k in hits:
            if self.starts[n][k + RUN] - self.starts[n][k] >= SEED or self.alone(text, at, n, k, edges):
                by[n].append((at, k))
        found = {}
        for n, places in by.items():
            done: set[tuple[int, int]] = set()
            best, starts, apart, last = 0, self.starts[n], None, 0
            for at, k in sorted(places):
                # a hit that continues one that was turned down just before, word by word, saw the same words
                if (at, k) in done or at - int(starts[k]) == apart and k <= last:
                    continue
                if not self._likely(n, text, at, k, wide):
                    apart, last = at - int(starts[k]), k + MIN_WORDS
                    continue
                best = max(best, self._stretch(n, text, at, k, edges, wide, done))
            if best:
                found[self.items[n]] = best
        return found

    def _stretch(self, n: int, text: str, at: int, k: int, edges: list[int], wide: list[int], done: set) -> int:
        words, counts = self.words[n], self.counts[n].astype(np.int64)
        limit = int(counts.sum()) // ONE_IN
        p = at
        for j in range(k, len(words)):
            if not text.startswith(words[j], p):
                break
            done.add((p, j))
            p += len(words[j])
        after = _aligned(words[k:], counts[k:], text, at, edges, wide, limit)
        # backwards as far as the words before can reach, each altered one as wide as the widest there is
        reach = _reach(wide, at, int(self.starts[n][k]) + _GAP * (k + 1), k)
        back, back_wide = ([at - e for e in reversed(x[bisect_left(x, reach) : bisect_right(x, at)])] for x in (edges, wide))
        before = _aligned([w[::-1] for w in words[:k][::-1]], counts[:k][::-1], text[reach:at][::-1], 0, back, back_wide, limit)
        # counted words i..j: at most one in eight of them may differ
        new = np.concatenate([[0], np.cumsum(counts)])
        lengths = new[None, k:] - new[k::-1, None]
        fits = (lengths >= MIN_WORDS) & (before[:, None] + after[None, :] <= lengths // ONE_IN)
        return int(lengths[fits].max()) if fits.any() else 0


#: Signs of inserted text, as of a note or a mark, that may stand within a passage besides an altered word.
_GAP = 26
#: Words that differ in the best ``MIN_WORDS`` of a stretch, at most.
_FEW = 4


def _reach(wide: list[int], at: int, signs: int, k: int) -> int:
    """The place before ``at`` behind which ``signs`` signs and ``k`` whole stretches without white space lie."""
    here = bisect_left(wide, at - signs)
    return min(max(0, at - signs), wide[max(0, here - k)]) if wide else max(0, at - signs)


def _aligned(words, counts, text, at, edges, wide, limit) -> np.ndarray:
    """Fewest counted words that differ when the first 0, 1, 2.. words are aligned with ``text`` from ``at`` on.

    Altered or missing words may stand anywhere, ends included.  Where no more
    words of the text than of the passage are passed over, or no more stretches
    without white space, which a link or an identifier of any length is, a single
    whole word brings both together again; other inserted text of up to ``_GAP``
    signs asks for three words.  States are taken by rising number of differences, up to ``limit``.
    """
    n = len(words)
    cost = np.concatenate([[0], np.cumsum(counts)]).tolist()
    best = [limit + 1] * (n + 1)
    heap, seen = [(0, 0, at)], set()
    while heap:
        wrong, k, p = heapq.heappop(heap)
        while (k, p) not in seen:
            seen.add((k, p))
            best[k] = min(best[k], wrong)
            if k == n or not text.startswith(words[k], p):
                break
            w = wrong + cost[k + 1] - cost[k]
            if len(words[k]) < 5 and w <= limit and not (_is_edge(edges, p) and _is_edge(edges, p + len(words[k]))):
                # a short word found inside another one may be chance
                for q in {*edges[(e := bisect_right(edges, p)) : e + 1], *wide[(e := bisect_right(wide, p)) : e + 1]}:
                    heapq.heappush(heap, (w, k + 1, q))
            p += len(words[k])
            k += 1
        else:
            continue
        if k == n:
            continue
        first, first_wide = bisect_right(edges, p), bisect_right(wide, p)
        skipped = 0
        for j in range(k, n):
            w = wrong + cost[j] - cost[k]
            if w > limit:
                break
            best[j] = min(best[j], w)
            word = words[j]
            if j > k:
                for q in {p, *edges[first : first + j - k], *wide[first_wide : first_wide + j - k]}:
                    if text.startswith(word, q) and (len(word) > 4 or _is_edge(edges, q) and _is_edge(edges, q + len(word))):
                        heapq.heappush(heap, (w, j, q))
            nxt = "".join(words[j : j + 3])
            if len(nxt) >= 5:
                q = text.find(nxt, p, p + skipped + _GAP + len(nxt))
                if q >= 0:
                    heapq.heappush(heap, (w, j, q))
            skipped += len(word)
        else:
            if (w := wrong + cost[n] - cost[k]) <= limit:
                best[n] = min(best[n], w)
    return np.array(best, np.int64)


def _is_edge(edges, q) -> bool:
    k = bisect_left(edges, q)
    return k < len(edges) and edges[k] == q


def shared_wording(listed: list[tuple[int, list[str]]]) -> dict[tuple[str, ...], int]:
    """How many items have each run of ``SHARED`` words."""
    owners: dict[tuple[str, ...], set] = defaultdict(set)
    for item, words in listed:
        for k in range(len(words) - SHARED + 1):
            owners[tuple(words[k : k + SHARED])].add(item)
    return {g: len(v) for g, v in owners.items()}


def _search(patterns):
    def run(batches):
        tables = patterns.value
        for pdf in batches:
            docs, items, lengths = [], [], []
            ids, texts = pdf.iloc[:, 0].tolist(), pdf.iloc[:, 1].tolist()
            i = 0
            while i < len(ids):
                held, parts, starts, at = [], [], [], 0
                while i < len(ids) and at < _CHARS_AT_ONCE:
                    flat = plain(texts[i])
                    s = _joined(flat)
                    if len(s) >= SEED:
                        held.append((ids[i], s, flat))
                        starts.append(at)
                        parts += [s, "\0" * SEED]
                        at += len(s) + SEED
                    i += 1
                if not held:
                    continue
                codes = _codes("".join(parts))
                starts = np.array(starts)
                by = defaultdict(list)
                for where, owner, place in tables.search(codes):
                    doc = np.searchsorted(starts, where, "right") - 1
                    for d, w, n, k in zip(doc.tolist(), (where - starts[doc]).tolist(), owner.tolist(), place.tolist()):
                        by[d].append((w, n, k))
                for d, hits in by.items():
                    edges, wide = _edges(held[d][2])
                    for item, n in tables.confirm(held[d][1], hits, edges, wide).items():
                        docs.append(held[d][0])
                        items.append(item)
                        lengths.append(n)
            yield pd.DataFrame({"doc_id": docs, "item_id": items, "words": lengths})

    return run


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """``(doc_id, item_id, words)``: documents that hold material of a passage.

    ``words`` is the length of the longest stretch.  The items, a held-out set of
    known size, are read to the driver; beyond ``items_per_pass`` they are
    searched in several passes over the documents, so that no broadcast exceeds
    what one pass needs.  Documents are never shuffled.
    """
    spark = documents.sparkSession
    held = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(item_id, passage).distinct().orderBy(item_id)
    held = [(r[0], r[1]) for r in held.toLocalIterator()]
    seen = shared_wording([(i, _words(p)) for i, p in held])
    rows = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text)
    out = None
    for k in range(0, max(1, len(held)), items_per_pass):
        patterns = spark.sparkContext.broadcast(Patterns(held[k : k + items_per_pass], seen))
        found = rows.mapInPandas(_search(patterns), "doc_id long, item_id long, words int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
