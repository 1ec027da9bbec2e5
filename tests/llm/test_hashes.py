"""Distinct words stay distinct, whatever their hashes."""

from __future__ import annotations

import hashlib
import math
from pathlib import Path

import pytest
from graphloom.llm import bpe, packing, pieces, queries


def thue_morse(a, b, n):
    """Words that polynomial hashes modulo a power of two can't tell apart from their mirror image."""
    x = [0]
    while len(x) < n:
        x += [1 - k for k in x]
    return "".join((a, b)[k] for k in x)


WORDS = [thue_morse("pfii", "yuoz", 64), thue_morse("yuoz", "pfii", 64), "x" * 300, "x" * 299 + "y", "abcdefgh", "abcdefghi", "abcdefgi", "z" * 256, "z" * 257, "one", "two"]


@pytest.fixture(scope="module")
def spec():
    return Path(queries.tokenizer_path()).read_text()


@pytest.fixture(params=["own hash", "one hash a size", "one hash"])
def hashing(request, monkeypatch):
    real = pieces.batch

    def weak(*args, **kw):
        b = real(*args, **kw)
        b.hashes[:] = 1 if request.param == "one hash" else b.sizes
        return b

    if request.param != "own hash":
        monkeypatch.setattr(pieces, "batch", weak)


def test_tokens_of_colliding_words(spec, hashing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    texts = [*WORDS, " ".join(WORDS), " ".join(reversed(WORDS)), ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    packs, codes = packing._Cache(spec), bpe.Encoded(spec)
    for _ in range(2):
        ids, n = packs.encode([t.encode() for t in texts])
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        n, digests, _ = codes.digest([t.encode() for t in texts])
        assert digests == [hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest() for w in want]


def test_counts_of_colliding_words(spark, monkeypatch):
    """Words of one hash are noticed and the hash is drawn again."""
    from graphloom.llm import lm

    rows = [(k, w) for k, w in enumerate(WORDS[:2] * 4)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["n_known"] for r in got} == {2}
    n, v = got[0]["train_tokens"], 3
    held = [r for r in got if not r["held_out"]]
    assert n == 2 * len(held)
    for r in got:
        c = sum(x["doc_id"] % 2 == r["doc_id"] % 2 for x in held)
        assert abs(r["base_score"] - math.log10((c + 1) / (n + v + 1)) - math.log10((len(held) + 1) / (n + v + 1))) < 1e-9
