"""Operator 4: toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary text, count tokens and share their
backoff: below a class's bigrams lie its unigrams, and below these the
continuation counts of both classes together, so an expression that is rare in
either class is smoothed by what all text says of it.  A document is compared by
its log-likelihood a token under the one model less that under the other.
Beside this stand the ratios of the same two models over counts of documents, as
far as documents support them: their mean, and the mean of the `PEAKS` highest,
as a few words can make a long text toxic and a text may repeat a word often.  A logistic curve, fitted on labelled rows that the counts don't hold,
turns these and the length into a score.

The models come from a bounded sample of labelled texts: of each class the
`sample` texts whose hashed ids are least, as far as they have `SAMPLE_BYTES`
together.  They are broadcast; what is broadcast is bounded by that sample.
All texts are scored whole.  Scores don't depend on the order of rows.

Defined cases: a null or wordless text scores by the curve's constant; a doc id
with several labels is toxic if one says so, and so is a text that occurs under
several ids, which counts once, under its least id; labels without a document,
null labels and null ids teach nothing; if no class or only one is labelled,
every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Ids, crc_mod, discard, local, map_rows, materialise

#: Labelled texts a class that the models may learn from, and their bytes together.
SAMPLE, SAMPLE_BYTES = 8_000, 64 << 20
#: Bigrams and words seen less often in the sample are left to the backoff.
LEAST = 2
DISCOUNT = 0.75
#: Tokens of a text that count as its most telling.
PEAKS = 3
#: Documents (or uses of a bigram) at which half of a supported ratio is believed.
HALF = 4.0
#: A context moves a supported ratio by this at most: near copies in the sample repeat their contexts.
MOST_SHIFT = 1.0
#: Counts that a task holds before it passes them on.
HELD = 1 << 20
WORDS = re.compile(r"\w+")
#: A row whose id's crc32 is 0 modulo this is held out.
FOLDS = 5


def tokens(text: str | None) -> list[str]:
    """Lower-case words without punctuation."""
    return WORDS.findall((text or "").lower())


def word_hashes(unique: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in unique), np.uint64, len(unique))


class Model(NamedTuple):
    """Sorted words and bigrams; counts have a column for ordinary and one for toxic text."""

    words: np.ndarray
    unigram: np.ndarray  # P_c(w), a row for each word and one for unknown words
    support: np.ndarray  # n / (n + HALF) of the word's counts
    total: np.ndarray  # n_c(v .)
    types: np.ndarray  # T_c(v .)
    pairs: np.ndarray
    seen: np.ndarray  # n_c(v, w)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Places of words; -1 for unknown ones."""
        if not len(self.words):
            return np.full(len(h), -1)
        spot = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[spot] == h, spot, -1)

    def ratios(self, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P_toxic - log P_ordinary of each token, and the same as far as it is supported; `first` marks tokens without one before."""
        lower = self.unigram[at]
        before = np.empty_like(at)
        before[1:], before[0] = at[:-1], -1
        before[first] = -1
        n, t = self.total[before], self.types[before]
        hit = np.zeros((len(at), 2))
        both = np.flatnonzero((before >= 0) & (at >= 0))
        if len(self.pairs) and len(both):
            key = before[both].astype(np.int64) << 32 | at[both]
            spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            same = self.pairs[spot] == key
            hit[both[same]] = self.seen[spot[same]]
        p = (np.maximum(hit - DISCOUNT, 0) + DISCOUNT * t * lower) / np.maximum(n, 1)
        upper = np.log(np.where(n > 0, p, lower))
        lower = np.log(lower)
        one, two = lower[:, 1] - lower[:, 0], upper[:, 1] - upper[:, 0]
        # A context speaks as far as both classes know it.
        pair, known = hit.sum(1), n.min(1)
        return two, one * self.support[at] + np.clip((two - one) * pair / (pair + HALF) * known / (known + HALF), -MOST_SHIFT, MOST_SHIFT)


def build(words: tuple, pairs: tuple) -> Model:
    """Model of (hash, ordinary, toxic, continuations) and (first, second, ordinary, toxic) columns."""
    h, o, t, c = (np.asarray(x) for x in words)
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, count, cont = h[order], np.stack([o, t], 1)[order].astype(float), c[order].astype(float)
    # One unknown word stands for all: it has half a continuation.
    shared = np.append(cont + 0.5, 0.5) / (cont.sum() + 0.5 * (len(h) + 1))
    n, kinds = np.maximum(count.sum(0), 1), np.maximum((count > 0).sum(0), 1)
    unigram = (np.append(np.maximum(count - DISCOUNT, 0), [[0, 0]], 0) + DISCOUNT * kinds * shared[:, None]) / n
    a, b, po, pt = (np.asarray(x) for x in pairs)
    at = lambda x: np.searchsorted(h, x.astype(np.int64).view(np.uint64))
    known = np.isin(a.astype(np.int64).view(np.uint64), h) & np.isin(b.astype(np.int64).view(np.uint64), h)
    a, b, seen = at(a[known]), at(b[known]), np.stack([po, pt], 1)[known].astype(float)
    key = a.astype(np.int64) << 32 | b
    order = np.argsort(key)
    key, seen, a = key[order], seen[order], a[order]
    # The last row is that of tokens without a known one before.
    total, types = np.zeros((2, len(h) + 1, 2))
    np.add.at(total, a, seen)
    np.add.at(types, a, (seen > 0).astype(float))
    pooled = np.append(count.sum(1), 0)
    return Model(h, unigram, pooled / (pooled + HALF), total, types, key, seen)


def features(models: tuple[Model, Model], texts: list[list[str]]) -> np.ndarray:
    """Per text: difference of the models' log-likelihoods a token, mean supported ratio, mean of its peaks, log length.

    The models of both classes are over counts of tokens and of documents.
    """
    ids = Ids()
    flat = np.fromiter((ids[w] for ws in texts for w in ws), np.int64)
    out = np.zeros((len(texts), 4))
    if not len(flat):
        return out
    h = word_hashes(list(ids))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    first = (end - size)[size > 0]
    whole, supported = (m.ratios(m.places(h)[flat], first)[k] for k, m in enumerate(models))
    # Sums in the order of tokens, so that a text's don't depend on the texts beside it.
    text = np.repeat(np.arange(len(texts)), size)
    some = np.maximum(size, 1)
    out[:, 0] = np.bincount(text, whole, len(texts)) / some
    out[:, 1] = np.bincount(text, supported, len(texts)) / some
    out[:, 3] = np.log1p(size)
    for k in np.flatnonzero(size):
        r = supported[end[k] - size[k] : end[k]]
        out[k, 2] = np.sort(np.partition(r, len(r) - PEAKS)[-PEAKS:] if len(r) > PEAKS else r).mean()
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton's method with a small ridge; (mean, scale, coefficients)."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1]) * 1e-1
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, th, toxic, held, text) of the sampled texts, and the number of labelled texts of each class."""
    rows = labels.select(labels[id_col].alias("id"), labels["toxic"].alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").where(crc_mod("id", FOLDS) != 0)
    rows = rows.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("th", F.xxhash64("text"))
    # No texts travel here: an id, a hash and a size.
    met = texts.select("id", "th", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(rows, "id")
    kinds = materialise(met.groupBy("th").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id"), F.max("size").cast("long").alias("size")), "labels")
    sizes = {r["toxic"]: r["n"] for r in kinds.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = [kinds.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id", "th").limit(sample) for c in (0, 1)]
    # At most two samples of rows, so one window over them is bounded; a quarter is for the curve.
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id", "th").rowsBetween(Window.unboundedPreceding, -1))
    chosen = part[0].union(part[1]).withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < SAMPLE_BYTES)
    chosen = chosen.select("id", "th", "toxic", (F.xxhash64("id", F.lit(1)) % 4 == 0).alias("held"))
    taught = materialise(texts.join(F.broadcast(chosen), ["id", "th"]).dropDuplicates(["id", "th"]), "taught")
    discard(kinds)
    return taught, sizes


def count(batches):
    """(w, v, toxic, n, d): counts of words (v null) and bigrams, and the documents with them."""
    one, two, docs, both, ids = Counter(), Counter(), Counter(), Counter(), Ids()

    def out():
        h = word_hashes(list(ids)).view(np.int64)
        if one:
            yield [int(h[w]) for w, _ in one], [None] * len(one), [t for _, t in one], list(one.values()), [docs[k] for k in one]
        if two:
            yield [int(h[w]) for _, w, _ in two], [int(h[v]) for v, _, _ in two], [t for _, _, t in two], list(two.values()), [both[k] for k in two]
        for c in (one, two, docs, both, ids):
            c.clear()

    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"]):
            at = [ids[w] for w in tokens(text)]
            one.update((w, toxic) for w in at)
            docs.update((w, toxic) for w in set(at))
            two.update((v, w, toxic) for v, w in zip(at, at[1:]))
            both.update((v, w, toxic) for v, w in set(zip(at, at[1:])))
            if len(one) + len(two) > HELD:
                yield from out()
    yield from out()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """(model, curve) of the labelled rows that are not held out; (None, share) without two classes."""
    spark = docs.sparkSession
    taught, sizes = sampled(docs, labels, id_col, text_col, sample)
    if not (sizes.get(0) and sizes.get(1)):
        return None, float(sizes.get(1, 0) > 0)
    of = lambda c, n: F.sum(F.when(F.col("toxic") == c, F.col(n)).otherwise(0))
    counted = map_rows(taught.where(~F.col("held")).select("text", "toxic"), "w long, v long, toxic int, n long, d long", count, 512)
    table = materialise(counted.groupBy("v", "w").agg(*(of(c, n).alias(f"{n}{c}") for n in "nd" for c in (0, 1))), "counts")
    cont = table.where("v IS NOT NULL").groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    model = []
    for n in "nd":
        own = table.select("v", "w", F.col(f"{n}0").alias("o"), F.col(f"{n}1").alias("t")).where(f"o + t >= {LEAST}")
        one = local(own.where("v IS NULL").join(cont, "w", "left").select("w", "o", "t", F.coalesce("c", F.lit(0)).alias("c")))
        two = local(own.where("v IS NOT NULL"))
        model.append(build(tuple(one[c] for c in "wotc"), tuple(two[c] for c in "vwot")))
    held = spark.sparkContext.broadcast(tuple(model))

    def measure(batches):
        for b in batches:
            yield b["toxic"], *features(held.value, [tokens(t) for t in b["text"]]).T

    measured = local(map_rows(taught.where("held").select("text", "toxic"), "toxic int, a double, b double, c double, d double", measure, 512))
    discard(taught, table)
    y, x = measured["toxic"].astype(float), np.column_stack([measured[c] for c in "abcd"])
    if not 0 < y.sum() < len(y):
        return None, sizes[1] / (sizes[0] + sizes[1])
    order = np.lexsort((*x.T, y))
    y, x = y[order], x[order]
    per = {c: sizes[c] / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, per[1], per[0])
    return held, fit_curve(x, y, weight / weight.mean())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per document: id, whether its label is held out, score and prediction."""
    held, curve = train(docs, labels, id_col, text_col, sample)

    def rows(batches):
        for b in batches:
            if held is None:
                s = np.full(len(b["text"]), curve)
            else:
                mean, scale, w = curve
                x = features(held.value, [tokens(t) for t in b["text"]])
                s = 1 / (1 + np.exp(-np.clip(((x - mean) / scale * w[:-1]).sum(1) + w[-1], -30, 30)))
            yield b["doc_id"], b["held_out"], s, (s >= 0.5).astype(np.int32)

    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(docs[id_col].alias("doc_id"), (crc_mod(docs[id_col], FOLDS) == 0).alias("held_out"), docs[text_col].alias("text"))
    return map_rows(df, f"doc_id {kind}, held_out boolean, score double, predicted int", rows, 256)
