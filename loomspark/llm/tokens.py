"""Token sizes by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level vocabulary as ranks; a file in the JSON form of the ``tokenizers`` library serves as well.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level vocabularies of this family divide a text before they merge.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space too long for the pattern's look-ahead, which would overflow its stack.
_GAP = re.compile(r"[^\S\x1c-\x1f]{4096,}")
_CHARS_AT_ONCE = 1 << 20


def _is_ranks(path: str) -> bool:
    return path.endswith(".tiktoken")


@lru_cache(maxsize=2)
def ranks(path: str):
    """The encoding of a file of ranks, that of an undivided part, and the bytes of each token; loaded once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(known.values()) + 1, np.int64)
    for token, rank in known.items():
        lengths[rank] = len(token)
    name = os.path.basename(path)
    parts = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
    whole = tiktoken.Encoding(name, pat_str=r"(?s).+", mergeable_ranks=known, special_tokens={})
    return parts, whole, lengths


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a JSON file, loaded once per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their spellings in a text are ordinary text
    found.no_truncation()
    found.no_padding()
    return found


def _encode(text: str, path: str) -> list[int]:
    """The tokens of a text; a long gap is one part but for its last character, as the pattern has it."""
    parts, whole, _ = ranks(path)
    out: list[int] = []
    at = 0
    for gap in _GAP.finditer(text):
        end = gap.end() - (gap.end() < len(text))
        out += parts.encode_ordinary(text[at : gap.start()])
        out += whole.encode_ordinary(text[gap.start() : end])
        at = end
    return out + parts.encode_ordinary(text[at:] if at else text)


def _token_starts(text: str, path: str) -> np.ndarray:
    lengths = ranks(path)[2]
    size = lengths[np.asarray(_encode(text, path), np.int64)]
    at = np.cumsum(size) - size
    if text.isascii():
        return at
    raw = np.frombuffer(text.encode(), np.uint8)
    return (np.cumsum((raw & 0xC0) != 0x80) - 1)[at]


def _batches(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    chars = 0
    for text in texts:
        held.append(text)
        chars += len(text)
        if chars >= _CHARS_AT_ONCE:
            yield held
            held, chars = [], 0
    if held:
        yield held


def starts(texts: list[str], path: str = TOKENIZER) -> Iterator[np.ndarray]:
    """For each text, the character at which each of its tokens begins."""
    if _is_ranks(path):
        yield from (_token_starts(text, path) for text in texts)
        return
    for held in _batches(texts):
        for found in tokenizer(path).encode_batch(held, add_special_tokens=False):
            yield np.fromiter((a for a, _ in found.offsets), np.int64, len(found))


def counts(texts: list[str], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text, encoded a bounded number of characters at a time."""
    if _is_ranks(path):
        return [len(_encode(text, path)) for text in texts]
    return [len(e) for held in _batches(texts) for e in tokenizer(path).encode_batch_fast(held, add_special_tokens=False)]


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``(item, n_tokens)`` per row, without a shuffle; null ids and texts are dropped."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"item": pdf["item"], "n_tokens": counts(pdf["text"].tolist(), path)})

    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInPandas(run, "item long, n_tokens int")
