"""Passages that repeat, at any offset."""

from __future__ import annotations

import random

import pytest
from graphloom.llm import spans


@pytest.mark.parametrize("vocabulary", [1, 2, 9, 2000])
@pytest.mark.parametrize("stops", [0.0, 0.04, 0.15])
def test_any_passage_of_51_words_holds_a_run(vocabulary, stops):
    rng = random.Random(vocabulary * 7 + int(100 * stops))
    word = lambda v: f"w{rng.randrange(v)}" + ("." if rng.random() < stops else "," if rng.random() < stops / 2 else "")
    for _ in range(300):
        passage = " ".join(word(vocabulary) for _ in range(rng.randrange(51, 90)))
        a, b = (" ".join([*(word(3000) for _ in range(rng.randrange(40))), passage, *(word(3000) for _ in range(rng.randrange(40)))]) for _ in range(2))
        x, y = (set(h.tolist()) for h in spans.runs([a.encode(), b.encode()])[0])
        assert x & y


def test_one_word_repeated_is_cut(spark):
    rows = [(k, f"Start {k} of it. {'alpha ' * 60}end {k}") for k in range(12)] + [(k, f"Start {k} of it. {f'u{k} ' * 60}end {k}") for k in range(12, 24)]
    got = spans.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_removed"] > 0 for r in got)
