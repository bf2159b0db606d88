"""The banded edit distance against the whole table, and on lines of a million characters."""

from __future__ import annotations

import random
import time

import pytest

from cuelake.llm.lines import within_edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text) + 1)
        how = rng.randrange(3)
        text = text[:k] + (rng.choice("abcé") if how else "") + text[k + (how != 1) :]
    return text


@pytest.mark.parametrize("most", [1, 2, 3])
def test_short(most):
    rng = random.Random(most)
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 5))
        assert within_edits(a, b, most) == (distance(a, b) <= most), (a, b)


def test_long_lines_take_time_in_proportion():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    took = {}
    for n in (250_000, 1_000_000):
        one = text[:n]
        began = time.perf_counter()
        assert within_edits("x" + one[1:-1] + "y", one, 2)
        assert not within_edits("x" + one[1 : n // 2] + "zz" + one[n // 2 :], one[:-1] + "w", 2)
        took[n] = time.perf_counter() - began
    assert took[1_000_000] < 8 * took[250_000]
