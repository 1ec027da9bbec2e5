"""The class-conditional models against a version in plain Python, and scores under another order of rows."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from graphloom.llm import toxicity
from pyspark.sql import functions as F


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    usual = [f"w{k}" for k in range(120)]
    bad = ["grizzlefop", "snarkwit", "blatherskite"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(usual, k=rng.randint(5, 60))
        toxic = rng.random() < 0.4
        for _ in range(2 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def naive(taught):
    """The difference of both models' log-likelihoods a token, by the formulas."""
    uni, bi, left = [Counter(), Counter()], [Counter(), Counter()], defaultdict(set)
    for text, c in taught:
        w = toxicity.tokens(text)
        uni[c].update(w)
        for v, x in zip(w, w[1:]):
            bi[c][v, x] += 1
            left[x].add(v)
    known = {w for c in uni for w in c if uni[0][w] + uni[1][w] >= 2}
    pairs = {p for c in bi for p in c if bi[0][p] + bi[1][p] >= 2 and p[0] in known and p[1] in known}
    of = defaultdict(list)
    for v, x in pairs:
        of[v].append(x)
    all_left = sum(len(left[w]) for w in known) + 0.5 * (len(known) + 1)

    def p(c, w, v):
        n, kinds = sum(uni[c][x] for x in known), sum(uni[c][x] > 0 for x in known)
        shared = (len(left[w]) + 0.5 if w in known else 0.5) / all_left
        low = (max((uni[c][w] if w in known else 0) - 0.75, 0) + 0.75 * kinds * shared) / n
        total = sum(bi[c][v, x] for x in of[v]) if v in known else 0
        if not total:
            return low
        return (max((bi[c][v, w] if (v, w) in pairs else 0) - 0.75, 0) + 0.75 * sum(bi[c][v, x] > 0 for x in of[v]) * low) / total

    def difference(text):
        w = toxicity.tokens(text)
        return sum(math.log(p(1, x, v)) - math.log(p(0, x, v)) for v, x in zip([None, *w], w)) / len(w)

    return difference


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_models_are_kneser_ney(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD", held)
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, _ = toxicity.train(d, lab)
    taught, _ = toxicity.sampled(d, lab, "doc_id", "text", toxicity.SAMPLE)
    want = naive([(r["text"], r["toxic"]) for r in taught.where("NOT held").collect()])
    texts = [t for _, t in docs[:60]] + ["unseen words alone", "grizzlefop", "w1 grizzlefop w2 neverseen w3"]
    got = toxicity.features(model.value, [toxicity.tokens(t) for t in texts])[:, 0]
    assert all(abs(g - want(t)) < 1e-9 for g, t in zip(got, texts))


def test_scores_dont_depend_on_order(spark):
    """Half of the labelled rows are copies with the other label."""
    docs, labels = corpus()
    docs += [(1000 + i, t) for i, t in docs]
    labels += [(1000 + i, 1 - t) for i, t in labels]
    run = lambda d, lab, n: {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(spark.createDataFrame(d, "doc_id long, text string").repartition(n), spark.createDataFrame(lab, "doc_id long, toxic int").repartition(n)).collect()}
    first = run(docs, labels, 1)
    rng = random.Random(1)
    rng.shuffle(docs)
    rng.shuffle(labels)
    assert run(docs, labels, 7) == first
    taught, _ = toxicity.sampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", 10_000)
    # Toxic wins where copies disagree; a copy that is held out has no say.
    by_text = defaultdict(set)
    crc = {r["doc_id"]: r["k"] for r in spark.createDataFrame(labels, "doc_id long, toxic int").select("doc_id", toxicity.crc_mod("doc_id", 5).alias("k")).collect()}
    text = dict(docs)
    for i, t in labels:
        if crc[i]:
            by_text[text[i]].add(t)
    assert {r["text"]: r["toxic"] for r in taught.select("text", "toxic").collect()} == {t: max(x) for t, x in by_text.items()}


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels = corpus(200)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    taught, _ = toxicity.sampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", 10_000)
    for r in taught.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n"), F.max(F.octet_length("text")).alias("m")).collect():
        assert 1500 < r["n"] < 2000 + r["m"]
