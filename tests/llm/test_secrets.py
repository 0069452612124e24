"""The spans that entropy adds, against windows counted anew at each place."""

import math
import random
import string
from collections import Counter

import pytest

from logweave.llm import secrets


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def test_incremental_entropy():
    rng = random.Random(1)
    for n in (1, 5, 19, 20, 21, 80):
        for letters in ("ab", "0123456789abcdef", string.ascii_letters):
            text = "".join(rng.choice(letters) for _ in range(n))
            want = max(entropy(text[max(0, i - 20):i]) for i in range(1, n + 1))
            assert secrets.most_entropy(text) == pytest.approx(want)


def spans(text):
    return [text[a:b] for a, b in secrets.entropy_spans(text)]


@pytest.mark.parametrize("text, want", [
    ("AbC9xY7zQ1wE5rT8uI3o", ["AbC9xY7zQ1wE5rT8uI3o"]),
    ("see 9F86D081884C7D659A2F here", ["9F86D081884C7D659A2F"]),
    # joined to a name or path: the part of the narrower class is found
    ("key_9F86D081884C7D659A2F", ["9F86D081884C7D659A2F"]),
    ("/files/9f86d081884c7d659a2feaa0", ["9f86d081884c7d659a2feaa0"]),
    ("9F86D081884C7D659A2F-x-AbC9xY7zQ1wE5rT8uI3o", ["9F86D081884C7D659A2F-x-AbC9xY7zQ1wE5rT8uI3o"]),
    ("9f86d081884c7d659a2f/aaaaaaaaaaaaaaaaaaaaaaaa", ["9f86d081884c7d659a2f"]),
    # known forms
    ("123e4567-e89b-12d3-a456-426614174000", []),
    ("the/quick/brown-fox/jumps_over/the/lazy/dog", []),
    ("getUserNameFromDatabaseTable", []),
    ("12345678901234567890123", []),
    ("sha256-9f86d081884c7d659a2feaa0c55ad015", []),
    ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", []),
    # letters alone whose case is random
    ("qLzXvRbNkTwYpJhGfDsAmC", ["qLzXvRbNkTwYpJhGfDsAmC"]),
])
def test_spans(text, want):
    assert spans(text) == want


def test_long_and_empty_texts():
    assert spans("") == [] and spans("x" * 100_000) == []
    assert spans("word " * 20_000 + "AbC9xY7zQ1wE5rT8uI3o") == ["AbC9xY7zQ1wE5rT8uI3o"]
