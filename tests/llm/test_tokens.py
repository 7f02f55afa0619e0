import random

import numpy as np
import pytest

from loomspark.llm import tokens as T

JSON = "/opt/tokenizers/byte_bpe_50k.json"
GAPS = [" " * 5000, "\n" * 4096, " \n\t\u3000" * 3000, "\x1c" * 5000]
TEXTS = ["", " ", "it's  don't\n\n  x", "naïve 字字 \U0001f600é 12", "<|endoftext|>"]


@pytest.mark.parametrize("gap", GAPS)
def test_long_gaps(gap):
    texts = [gap, gap + "a", "a" + gap, f"a{gap}b {gap}!", gap + "\n" + gap]
    assert T.counts(texts) == T.counts(texts, JSON)


def test_ranks_equal_the_json_form():
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices(" \n\tabÀ字1!'s\U0001f600\x1c", k=rng.randrange(300))) for _ in range(200)]
    assert T.counts(texts) == T.counts(texts, JSON)
    for text, one, two in zip(texts, T.starts(texts), T.starts(texts, JSON)):
        assert np.array_equal(one, two), text


def test_very_long_gap():
    assert T.counts([" " * 10**6 + "x"])[0] > 0
