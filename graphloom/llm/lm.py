"""Operator 2: language-model scoring with a hashed maximum-entropy model.

Outcomes are units: the end token, the most frequent words, and buckets of the
other words by a hash of their last letters.  The softmax is factored by classes of
classes: WIDTH classes hold WIDTH classes each, which hold WIDTH units each, and a
unit's probability is the product of three softmaxes, each given the context and
the class so far.  Every factor is a maximum-entropy model over the same features
- bigram, skip and trigram of the words before - hashed together with the class
so far into the factor's table of weights.  Units are dealt to classes by what
precedes them, so that a class holds units of one sort (in one language, say).
A word has its relative frequency within its bucket (one added, and one for an
unknown word), so words that training never met have a probability too.

Size: the tables have one row for every `TOKENS_A_ROW` training tokens, as a
power of two between the ends of `ROWS`; the upper end keeps them small enough
to broadcast.  Word counts have no bound: every training token is counted, with
map-side aggregation.  Words of more than 1/`HEAD` of all tokens are at most
HEAD in number; they are broadcast and answer nearly all tokens.  The rest go
through a shuffle join on the word's 64-bit hash, rows of rare words only, so no
key is hot.

Words are told apart by their hash; a second hash with a random key proves that
no two words of all documents share the first.  If two do, another is drawn.

Training: in each round every task takes gradient steps (AdaGrad on minibatches)
over its share of that round's slice of the training documents, from the same
weights; the tasks' rows are averaged by how often each task used them.  The
slices together are all training documents.

Defined cases: a null text is an empty one (the end token alone); a null id is
in fold 0; repeated rows count as often as they come; with no training rows all
counts are 0 and units are equally likely.
"""

from __future__ import annotations

import secrets
from typing import NamedTuple

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import crc_mod, discard, local, map_rows, materialise
from graphloom.llm.pieces import BLANK, Table, edges, hashed

FOLDS, HELD_OUT = 7, 2
#: The end token's hash: no word has it.
END = 0
#: Words of more than one token in so many are broadcast.
HEAD = 1 << 17
#: Factors of the softmax and outcomes of each; the first units are single words (the end token is unit 0), the others buckets of endings.
FACTORS, WIDTH, BUCKETS = 3, 16, 1024
UNITS = WIDTH**FACTORS
ALONE = UNITS - BUCKETS
#: Training tokens for each row of the weight tables, and the least and most rows.
TOKENS_A_ROW, ROWS = 128, (1 << 13, 1 << 17)
ROUNDS, RATE, START, BOUND, BATCH = 2, 0.25, 0.5, 20.0, 4096
#: Input partitions that one task learns from; rows of the tables that travel together.
LEARNS, BLOCK = 4, 256
#: Frequent units that tell what a unit follows.
SIGNS = 64
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 1 << 20
#: The table has no key 0, the end token's hash.
FLIP = np.uint64(0x5851F42D4C957F2D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Tokens(NamedTuple):
    """A batch's tokens end to end, each text closed by the end token: hashes, buckets of endings, bounds of texts."""

    hashes: np.ndarray
    endings: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    proof: np.ndarray  # the second hash, if a key is given


def tokens(texts: list[bytes | None], seed: int = 0, key: int | None = None) -> Tokens:
    """Lower-cases A-Z, cuts and hashes all words of a batch in numpy."""
    texts = [t or b"" for t in texts]
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    starts, ends = edges(BLANK[data])
    every = hashed(data, starts, ends, *([seed] if key is None else [seed, key]))[1]
    h, proof = every[0].view(np.int64), every[-1].view(np.int64)
    size = ends - starts
    code = data[ends - 1].astype(np.int64)
    for k in (2, 3):
        code |= np.where(size >= k, data[ends - np.minimum(k, size)], 0).astype(np.int64) << (8 * (k - 1))
    e = ((code * 0x9E3779B1 >> 11) % BUCKETS).astype(np.int32)
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    upto = np.searchsorted(starts, np.cumsum(length))
    sizes = np.diff(upto, prepend=0) + 1
    return Tokens(np.insert(h, upto, END), np.insert(e, upto, 0), np.cumsum(sizes) - sizes, sizes, np.insert(proof, upto, END))


class Counts(NamedTuple):
    """What every task knows of the training tokens: bounded in size."""

    seed: int
    tokens: int
    distinct: int
    head: Table  # hashes of frequent words and the end token
    head_count: np.ndarray
    head_unit: np.ndarray  # of words that are a unit alone, else -1
    share: np.ndarray  # tokens of each unit
    within: np.ndarray  # log10(N_bucket + V_bucket + 1); 0 for single words
    signs: np.ndarray  # units that tell what others follow
    rows: int
    place: np.ndarray  # of each unit: its classes and its place in the last, as digits to the base WIDTH
    priors: list[np.ndarray]  # for each factor, a row for each class so far: logs of the outcomes' shares


def count_words(docs: DataFrame, seed: int, key: int) -> DataFrame:
    """(h, e, c, sound): hash, bucket and training count of the distinct tokens of documents (held_out, text).

    `sound` is false where two words have one hash.
    """

    def rows(batches):
        table = Table(HELD_WORDS)
        kinds = {"h": np.int64, "p": np.int64, "e": np.int32, "c": np.int64}
        held = {n: np.zeros(HELD_WORDS, t) for n, t in kinds.items()}

        def out(n):
            return [held[k][:n].copy() for k in "hpec"]

        for b in batches:
            t = tokens(b["text"], seed, key)
            counted = np.repeat(~np.array(b["held_out"], bool), t.sizes)
            at = table.find(t.hashes.view(np.uint64) ^ FLIP)
            fresh = np.flatnonzero(at < 0)
            distinct, first, back = np.unique(t.hashes[fresh], return_index=True, return_inverse=True)
            if table.n + len(distinct) > HELD_WORDS:
                yield out(table.n)
                table.clear()
                held["c"][:] = 0
                fresh = np.arange(len(at))
                distinct, first, back = np.unique(t.hashes, return_index=True, return_inverse=True)
                if len(distinct) > HELD_WORDS:
                    alike = t.proof == t.proof[first][back]
                    yield distinct, t.proof[first], t.endings[first], np.bincount(back, counted).astype(np.int64)
                    yield from _odd(t, np.flatnonzero(~alike))
                    continue
            n = table.n
            table.add(distinct.view(np.uint64) ^ FLIP, np.arange(n, n + len(distinct)))
            first = fresh[first]
            at[fresh] = n + back
            held["h"][n : table.n], held["p"][n : table.n], held["e"][n : table.n] = distinct, t.proof[first], t.endings[first]
            held["c"][: table.n] += np.bincount(at, counted, minlength=table.n).astype(np.int64)
            yield from _odd(t, np.flatnonzero(t.proof != held["p"][at]))
        if table.n:
            yield out(table.n)

    made = map_rows(docs.select("held_out", "text"), "h long, p long, e int, c long", rows, 512)
    return made.groupBy("h").agg(F.min("e").alias("e"), F.sum("c").alias("c"), (F.min("p") == F.max("p")).alias("sound"))


def _odd(t: Tokens, at: np.ndarray):
    """Tokens whose hash another word has: rows of their own, so that the group shows both."""
    if len(at):
        yield t.hashes[at], t.proof[at], t.endings[at], np.zeros(len(at), np.int64)


def counted(docs: DataFrame, tries: int = 8) -> tuple[int, DataFrame]:
    """(seed, count table) of a hash that tells all words of the documents apart."""
    for seed in range(tries):
        table = materialise(count_words(docs, seed, secrets.randbits(63)), "word-counts")
        if table.where("NOT sound").isEmpty():
            return seed, table
        discard(table)
    raise RuntimeError("no hash tells the words apart")


def _frequent(tokens: int):
    """A word of more than 1/HEAD of the training tokens, or the end token."""
    return (F.col("c") * HEAD > tokens) | (F.col("h") == END)


def gather(table: DataFrame, seed: int) -> Counts:
    """Totals, the head and the units' sizes of a count table."""
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    # Fewer than HEAD words can have more than total / HEAD each.
    head = local(table.where(_frequent(total)).select("h", "e", "c"))
    h, e, c = (head[k].astype(np.int64) for k in ("h", "e", "c"))
    own = np.full(len(h), -1)
    top = np.lexsort((h, -c))
    top = top[h[top] != END][: ALONE - 1]
    own[top] = np.arange(1, len(top) + 1)
    own[h == END] = 0
    mass, kinds = np.zeros(UNITS), np.zeros(UNITS)
    for r in table.where("c > 0").groupBy("e").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        mass[ALONE + r["e"]], kinds[ALONE + r["e"]] = r["c"], r["v"]
    alone = np.flatnonzero((own >= 0) & (c > 0))
    np.subtract.at(mass, ALONE + e[alone], c[alone])
    np.subtract.at(kinds, ALONE + e[alone], 1)
    mass[own[alone]] = c[alone]
    within = np.where(np.arange(UNITS) < ALONE, 0.0, np.log10(mass + kinds + 1))
    found = Table(max(HEAD, len(h)))
    found.add(h.view(np.uint64) ^ FLIP, np.arange(len(h)))
    signs = np.argsort(-mass, kind="stable")[:SIGNS]
    rows = int(np.clip(1 << max(0, int(total) // TOKENS_A_ROW).bit_length(), *ROWS))
    counts = Counts(seed, int(total), int(distinct), found, c, own, mass, within, signs, rows, np.arange(UNITS), [])
    return _placed(counts, counts.place)


def _placed(counts: Counts, place: np.ndarray) -> Counts:
    """The counts with units in classes, and the shares that follow."""
    mass = np.empty(UNITS)
    mass[place] = counts.share + 1 / UNITS
    priors = []
    for k in range(FACTORS):
        each = mass.reshape(WIDTH**k, WIDTH, -1).sum(2)
        priors.append(np.log(each / each.sum(1, keepdims=True)).astype(np.float32))
    return counts._replace(place=place, priors=priors)


def classes(docs: DataFrame, counts) -> np.ndarray:
    """Units in an order of which every class is a stretch: halved again and again along what most tells apart the units that they follow."""

    def follow(batches):
        c = counts.value
        sign = np.full(UNITS, -1)
        sign[c.signs] = np.arange(len(c.signs))
        seen = np.zeros(UNITS * SIGNS, np.int64)
        for b in batches:
            t = tokens(b["text"], c.seed)
            u = units(t, c)[0]
            before = np.concatenate([[-1], sign[u[:-1]]])
            before[t.starts] = -1
            k = np.flatnonzero(before >= 0)
            seen += np.bincount(u[k] * SIGNS + before[k], minlength=len(seen))
        for k in range(0, len(seen), 1 << 14):
            if seen[k : k + (1 << 14)].any():
                yield [k], [seen[k : k + (1 << 14)].tobytes()]

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["k"], b["n"]):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
        if total:
            yield list(total), [x.tobytes() for x in total.values()]

    made = map_rows(docs.select("text"), "k int, n binary", follow, 512)
    seen = np.zeros(UNITS * SIGNS)
    # As many blocks as the table has, however large the input.
    for r in map_rows(made.repartition("k"), "k int, n binary", add).collect():
        seen[r["k"] : r["k"] + len(r["n"]) // 8] = np.frombuffer(r["n"], np.int64)
    x = seen.reshape(UNITS, SIGNS)
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    parts = [np.argsort(-counts.value.share, kind="stable")]
    while len(parts) < UNITS // WIDTH:
        halves = []
        for p in parts:
            y = x[p] - x[p].mean(0)
            _, axis = np.linalg.eigh(y.T @ y)
            p = p[np.argsort(np.round(y @ axis[:, -1], 9), kind="stable")]
            halves += [p[: len(p) // 2], p[len(p) // 2 :]]
        parts = halves
    place = np.empty(UNITS, np.int64)
    place[np.concatenate(parts)] = np.arange(UNITS)
    return place


def units(t: Tokens, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Each token's unit, and its place among the frequent words (-1: rare)."""
    place = counts.head.find(t.hashes.view(np.uint64) ^ FLIP)
    own = np.where(place >= 0, counts.head_unit[place], -1) if len(counts.head_unit) else place
    return np.where(t.hashes == END, 0, np.where(own >= 0, own, ALONE + t.endings)), place


def contexts(t: Tokens) -> np.ndarray:
    """Hashes of each token's features: bigram, skip and trigram; a text begins with two blanks."""
    h = t.hashes.view(np.uint64)
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[t.starts] = 1
    two[t.starts] = 1
    two[t.starts[t.sizes > 1] + 1] = 1
    f = np.stack([one * MIX[0], two * MIX[1], one * MIX[2] ^ two * MIX[3]])
    f ^= f >> np.uint64(29)
    return f * MIX[0]


def rows_of(f: np.ndarray, before: np.ndarray, factor: int, rows: int) -> np.ndarray:
    """Features' rows, with the class so far, in a factor's table."""
    x = (f ^ (before.astype(np.uint64) + np.uint64(UNITS * factor)) * MIX[3]) * MIX[2]
    x ^= x >> np.uint64(32)
    return (x * MIX[1] >> np.uint64(65 - rows.bit_length())).astype(np.int64)


def factors(at: np.ndarray, f: np.ndarray, c: Counts):
    """For each factor: its number, its priors and rows for each token, and the outcome."""
    for k in range(FACTORS):
        so_far = at // WIDTH ** (FACTORS - k - 1)
        before = so_far // WIDTH
        yield k, np.take(c.priors[k], before, 0), rows_of(f, before, k, c.rows), so_far % WIDTH


def logits(weights: np.ndarray, prior: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = np.take(weights, f[0], 0)
    z += np.take(weights, f[1], 0)
    z += np.take(weights, f[2], 0)
    z += prior
    return z


def _sums(z: np.ndarray) -> np.ndarray:
    """Of each row: a product with ones is faster than a sum over a short axis."""
    return z @ np.ones(z.shape[1], z.dtype)


def log_chosen(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log of the softmax at y; weights stay within bounds, so that exp can't overflow."""
    own = z[np.arange(len(z)), y]
    np.exp(z, out=z)
    return own - np.log(_sums(z))


def log_units(w: np.ndarray, c: Counts, f: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Natural log of each unit's probability after features; `w` has the factors' weights."""
    out = np.zeros(len(unit))
    at = c.place[unit]
    for lo in range(0, len(unit), BATCH):
        for k, prior, rows, y in factors(at[lo : lo + BATCH], f[:, lo : lo + BATCH], c):
            out[lo : lo + BATCH] += log_chosen(logits(w[k], prior, rows), y)
    return out


def row_sums(z: np.ndarray, f: np.ndarray, few: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sum of z over each row's uses, uses): rows' first, second ... uses are added all together."""
    # Row and place in one number: sorting numbers is faster than sorting places.
    both = np.sort(f.ravel() << 20 | np.arange(f.size))
    rows, order = both >> 20, both & (1 << 20) - 1
    begin = np.flatnonzero(np.diff(rows, prepend=-1))
    n = np.diff(begin, append=len(rows))
    by = np.argsort(-n.astype(np.int16), kind="stable")
    begin, n, token = begin[by], n[by], order % f.shape[1]
    sums = np.take(z, token[begin], 0)
    more = np.searchsorted(-n, -np.arange(few + 1), "left")
    for k in range(1, few):
        m = more[k]
        if not m:
            break
        sums[:m] += np.take(z, token[begin[:m] + k], 0)
    for j in range(more[few]):
        sums[j] += np.take(z, token[begin[j] + few : begin[j] + n[j]], 0).sum(0)
    return rows[begin], sums, n


def step(weights: np.ndarray, grown: np.ndarray, used: np.ndarray, prior: np.ndarray, f: np.ndarray, y: np.ndarray) -> None:
    """One minibatch: expected less observed outcome, summed over each row's uses."""
    z = logits(weights, prior, f)
    np.exp(z, out=z)
    z *= (1 / _sums(z))[:, None]
    z[np.arange(len(y)), y] -= 1
    rows, g, n = row_sums(z, f)
    grown[rows] += _sums(g * g) / g.shape[1]
    used[rows] += n
    g *= (-RATE / np.sqrt(grown[rows] + START))[:, None]
    g += np.take(weights, rows, 0)
    weights[rows] = np.clip(g, -BOUND, BOUND, out=g)


def train_round(docs: DataFrame, counts, weights) -> np.ndarray:
    """The factors' weights after a round over these documents; `counts` and `weights` are broadcasts."""

    def learn(batches):
        w, c = weights.value.astype(np.float32), counts.value
        grown, used = np.zeros((2, FACTORS, c.rows), np.float32)
        for b in batches:
            t = tokens(b["text"], c.seed)
            f, at = contexts(t), c.place[units(t, c)[0]]
            for lo in range(0, len(at), BATCH):
                for k, prior, rows, y in factors(at[lo : lo + BATCH], f[:, lo : lo + BATCH], c):
                    step(w[k], grown[k], used[k], prior, rows, y)
        w, used = w.reshape(-1, BLOCK, WIDTH), used.reshape(-1, BLOCK)
        w[used == 0] = 0
        for k in np.flatnonzero(used.any(1)).tolist():
            yield [k], [used[k].tobytes()], [w[k].astype(np.float16).tobytes()]

    def mean(batches):
        total: dict[int, list] = {}
        for b in batches:
            for k, n, w in zip(b["k"], b["n"], b["w"]):
                n = np.frombuffer(n, np.float32).astype(float)
                w = np.frombuffer(w, np.float16).reshape(BLOCK, WIDTH) * n[:, None]
                if k in total:
                    total[k][0] += n
                    total[k][1] += w
                else:
                    total[k] = [n, w]
        for k, (n, w) in total.items():
            yield [k], [(n > 0).tobytes()], [(w / np.maximum(n, 1)[:, None]).astype(np.float16).tobytes()]

    few = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // LEARNS)
    made = map_rows(docs.select("text").coalesce(few), "k int, n binary, w binary", learn, 512)
    out = weights.value.copy().reshape(-1, BLOCK, WIDTH)
    # As many blocks as the tables have, however large the input.
    for r in map_rows(made.repartition("k"), "k int, n binary, w binary", mean).collect():
        seen = np.frombuffer(r["n"], bool)
        out[r["k"]][seen] = np.frombuffer(r["w"], np.float16).reshape(BLOCK, WIDTH)[seen]
    return out.reshape(weights.value.shape)


def train(docs: DataFrame, rounds: int = ROUNDS):
    """(count table, broadcast counts, broadcast weights) of documents (id, held_out, text); those held out teach nothing."""
    sc = docs.sparkSession.sparkContext
    seed, table = counted(docs)
    counts = sc.broadcast(gather(table, seed))
    docs = docs.where(~F.col("held_out"))
    counts = sc.broadcast(_placed(counts.value, classes(docs, counts)))
    weights = sc.broadcast(np.zeros((FACTORS, counts.value.rows, WIDTH), np.float16))
    for r in range(rounds):
        part = docs.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(rounds)) == r) if rounds > 1 else docs
        weights = sc.broadcast(train_round(part, counts, weights))
    return table, counts, weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per document: token counts, the unigram base score and the model's log10 probability."""
    df = docs.select(docs[id_col].alias("id"), (crc_mod(docs[id_col], FOLDS) == HELD_OUT).alias("held_out"), docs[text_col].cast("binary").alias("text"))
    table, counts, weights = train(df, rounds)
    total = counts.value

    def rows(batches):
        c, w = counts.value, weights.value.astype(np.float32)
        # The last place, -1, is that of words with no count here.
        logs, some = np.append(np.log10(c.head_count + 1.0), 0.0), np.append(c.head_count > 0, False).astype(np.int64)
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            t = tokens(b["text"], c.seed)
            u, place = units(t, c)
            own = logs[place]
            # Words that are units alone owe nothing within.
            inside = np.where(u < ALONE, 0.0, own - c.within[u])
            p = log_units(w, c, contexts(t), u)
            k = len(t.sizes)
            rare = np.flatnonzero((place < 0) & (t.hashes != END))
            doc, h = np.repeat(np.arange(k), t.sizes)[rare], t.hashes[rare]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(h, prepend=0) != 0))
            times = np.diff(first, append=len(h)).astype(np.int32)
            cut = np.searchsorted(doc[first], np.arange(1, k))
            per = lambda x: np.add.reduceat(x, t.starts)
            yield (
                range(at, at + k),
                b["id"],
                b["held_out"],
                t.sizes,
                per(some[place]),
                per(own),
                per(p) / np.log(10) + per(inside),
                np.split(h[first], cut),
                np.split(times, cut),
            )
            at += k

    kind = df.schema["id"].dataType.simpleString()
    part = materialise(map_rows(df, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, own double, lm double, hs array<long>, ts array<int>", rows, 512), "scored")
    rare = part.select("row", F.inline(F.arrays_zip("hs", "ts"))).toDF("row", "h", "t")
    # A rare word is never a unit alone, so its count goes to both scores.
    found = rare.join(table.where(~_frequent(total.tokens) & (F.col("c") > 0)).select("h", "c"), "h").groupBy("row").agg(F.sum("t").alias("k"), F.sum(F.col("t") * F.log10(F.col("c") + 1.0)).alias("s"))
    joined = part.drop("hs", "ts").join(found, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unit = float(np.log10(total.tokens + total.distinct + 1))
    return joined.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("k")).alias("n_known"),
        F.lit(total.tokens).cast("long").alias("train_tokens"),
        (F.col("own") + zero("s") - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("lm") + zero("s")).alias("score"),
    )
