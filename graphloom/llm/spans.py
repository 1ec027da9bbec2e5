"""Operator 9: substring dedup by sliding sentence spans.

A sentence ends behind `.`, `!` or `?` (quotes and brackets may follow) before
white space, or at a line's end.  A run starts at each sentence and takes in the
next ones until it has `min_words` words.  Each run is hashed from its words'
hashes, the hashes meet globally, and every sentence that a repeated run covers
goes, unless the run is the first of its kind: that of the smallest id, then the
earliest.

Sentences of up to `LONG` words are never divided.  A longer one is divided
behind `,`, `;` and `:`, and a part that still has more than `LONG` words behind
the word of least hash of every `WINDOW` words, the last of equals: passages of
running text without a stop must be found too.  A boundary is the same wherever
its surroundings are, so a passage of `min_words` + 2 x (`LONG` - 1) words (51)
or more holds a whole run wherever it begins and ends.  What a removed run
leaves of a long sentence stays.

Runs are told apart by two independent 64-bit hashes, the second with a random
key, before anything is removed.  Hash groups are counted with map-side
aggregation.  Only runs whose hash repeats are joined back; a hash with more
than 1 / HEAVY of all runs meets them by broadcast, the others by a shuffle, so a
passage that a third of all documents share is never one group in a task.

Defined cases: a null text stays null and has no sentences; texts of fewer than
`min_words` words have no runs; rows with a null id come after all others;
repeated rows (id and text) count as one document and are treated alike; an
empty table gives an empty result; columns keep their names and order.
"""

from __future__ import annotations

import secrets
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, map_rows, materialise, share_join, utf8
from graphloom.llm.pieces import BLANK, edges, hashed

#: Words at which a run is long enough.
MIN_WORDS = 25
#: Words of a sentence that is not divided; in longer parts without a comma, of so many words in a row one ends a unit.
LONG, WINDOW = 14, 8
#: Bases for sums over words.
BASES = (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STOP, CLAUSE, CLOSE = (np.zeros(256, bool) for _ in range(3))
STOP[list(b".!?")] = CLAUSE[list(b",;:")] = CLOSE[list(b"\"')]}")] = True


class Units(NamedTuple):
    """Words and units - sentences, or parts of long ones - of a batch of texts end to end."""

    starts: np.ndarray  # first byte of each word
    hashes: tuple[np.ndarray, np.ndarray]  # of each word, A-Z lower-cased
    first: np.ndarray  # first word of each unit
    upto: np.ndarray  # words up to the end of each text


def units(texts: list[bytes], key: int = 1) -> Units:
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    starts, ends = edges(BLANK[data])
    upto = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
    if not len(starts):
        return Units(starts, (np.empty(0, np.uint64),) * 2, starts, upto)
    h, both = hashed(data, starts, ends, 0, key)
    closed = CLOSE[data[ends - 1]] & (h.sizes > 1)
    close = data[ends - 1 - closed]
    lines = np.cumsum(data == 10)
    last = STOP[close]
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
    last[upto[upto > 0] - 1] = True
    clause = last | CLAUSE[close] & (_sizes(last) > LONG)
    cut = clause | least(h.hashes, np.cumsum(clause) - clause) & (_sizes(clause) > LONG)
    return Units(starts, (both[0], both[1]), np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1]), upto)


def _sizes(last: np.ndarray) -> np.ndarray:
    """For each word, the number of words of its stretch."""
    n = np.diff(np.flatnonzero(last), prepend=-1)
    return np.repeat(n, n)


def least(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Words that have the least hash of some window of their part, the last of equals."""
    out = np.zeros(len(h), bool)
    n = len(h) - WINDOW + 1
    if n > 0:
        low, at = h[WINDOW - 1 :].copy(), np.arange(WINDOW - 1, len(h))
        for k in range(WINDOW - 2, -1, -1):
            less = h[k : k + n] < low
            np.copyto(low, h[k : k + n], where=less)
            np.copyto(at, np.arange(k, k + n), where=less)
        out[at[part[:n] == part[WINDOW - 1 :]]] = True
    return out


def sentences(data: bytes) -> list[tuple[int, int]]:
    """Bounds of a text's units in UTF-8, the space behind each included."""
    u = units([data])
    at = u.starts[u.first].tolist()
    return list(zip([0, *at[1:]], [*at[1:], len(data)])) if at else []


def runs(texts: list[bytes], min_words: int = MIN_WORDS, key: int = 1) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each text: both hashes and the length in units of the run from each unit, as far as there are words enough."""
    u = units(texts, key)
    end_of = np.append(u.first[1:], len(u.starts))
    text = np.searchsorted(u.upto, u.first, "right")
    stop = np.searchsorted(end_of, u.first + min_words)
    k = np.arange(len(u.first))
    whole = stop < len(end_of)
    whole[whole] = end_of[stop[whole]] <= u.upto[text[whole]]
    k, stop, text = k[whole], stop[whole], text[whole]
    lo, hi = u.first[k], end_of[stop]
    cut = np.searchsorted(text, np.arange(1, len(texts)))
    h, g = (np.split(_summed(x, lo, hi, base).view(np.int64), cut) for x, base in zip(u.hashes, BASES))
    return h, g, np.split((stop - k + 1).astype(np.int32), cut)


def _summed(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hash of the words lo .. hi: their sum by powers of a base, mixed with their number."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(base, len(words))[:-1], out=sums[1:])
    out = (sums[hi] - sums[lo]) * _powers(pow(base, -1, 1 << 64), len(words))[lo]
    out ^= out >> np.uint64(29)
    out = out * np.uint64(0xBF58476D1CE4E5B9) + (hi - lo).astype(np.uint64)
    return out ^ out >> np.uint64(32)


def _powers(x: int, n: int) -> np.ndarray:
    """1, x, x^2 ... modulo 2^64."""
    out = np.full(n + 1, x, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def without(text: str | None, gone: list[tuple[int, int]] | None) -> tuple[str | None, int]:
    """The text without the units of the runs (start, length), and how many went."""
    if not text or not gone:
        return text, 0
    data = utf8(text)
    bounds = sentences(data)
    cut = np.zeros(len(bounds) + 1, int)
    for p, k in gone:
        cut[p] += 1
        cut[p + k] -= 1
    cut = np.cumsum(cut[:-1]) > 0
    left = b"".join(data[s:e] for (s, e), c in zip(bounds, cut) if not c)
    return left.decode("utf-8", "surrogatepass"), int(cut.sum())


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text hash, runs, first_ids): of documents (id, text), the runs that are not the first of their kind."""
    df = docs.select("id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    key = secrets.randbits(63)

    def rows(batches):
        for b in batches:
            h, g, size = runs([t or b"" for t in b["text"]], min_words, key)
            some = [k for k, x in enumerate(h) if len(x)]
            yield [b["id"][k] for k in some], [b["th"][k] for k in some], *([x[k] for k in some] for x in (h, g, size))

    kind = docs.schema["id"].dataType.simpleString()
    made = materialise(map_rows(df, f"id {kind}, th long, hashes array<long>, proofs array<long>, sizes array<int>", rows, 256), "runs")
    z = F.col("z")
    flat = made.select("id", "th", F.posexplode(F.arrays_zip("hashes", "proofs", "sizes")).alias("pos", "z")).select("id", "th", "pos", z["hashes"].alias("h"), z["proofs"].alias("g"), z["sizes"].alias("size"))
    twice = materialise(flat.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-hashes")
    total = made.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    again = materialise(share_join(flat, twice, ["h"], total), "repeated-runs")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "pos")
    first = materialise(again.groupBy("h", "g").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-runs")
    later = share_join(again, first, ["h", "g"], again.count()).where(order > F.col("first"))
    gone = later.groupBy("id", "th").agg(F.collect_set(F.struct("pos", "size")).alias("gone"), F.array_sort(F.collect_set(F.when(~F.col("first.id").eqNullSafe(F.col("id")), F.col("first.id")))).alias("first_ids"))
    gone = materialise(gone, "gone")
    discard(made, twice, again, first)
    return gone


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the text cut, `_n_removed` and `_first_ids`; columns as they were."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    i, t = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    gone = repeated(plain.select(F.col(i).alias("id"), F.col(t).alias("text")), min_words)
    # The same plan at every size: texts meet their own runs in a shuffle, without a sort.
    joined = plain.join(gone.hint("shuffle_hash"), F.col(i).eqNullSafe(F.col("id")) & (F.xxhash64(t) == F.col("th")), "left").drop("id", "th")

    def rows(batches):
        for b in batches:
            columns = list(b.values())
            cut = [without(text, g and [(x["pos"], x["size"]) for x in g]) for text, g in zip(b[t], columns[-2])]
            columns[names.index(text_col)] = [c[0] for c in cut]
            yield [*columns[:-2], [c[1] for c in cut], [x or [] for x in columns[-1]]]

    id_kind = plain.schema[i].dataType
    schema = plain.withColumn("_n", F.lit(0).cast("long")).withColumn("_f", F.lit(None).cast(f"array<{id_kind.simpleString()}>")).schema
    return map_rows(joined, schema, rows, 256).toDF(*names, "_n_removed", "_first_ids")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: how many units (sentences, or parts of long ones) went, the other documents that hold them first, and the text left."""
    cut = marked(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "doc_id", "text")
    return cut.select("doc_id", F.col("_n_removed").alias("n_removed"), F.col("_first_ids").alias("first_doc_ids"), "text")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents without repeated passages; those of which nothing is left go, and a length column follows the text."""
    cut = marked(docs, id_col, text_col)
    if length_col in docs.columns:
        cut = cut.withColumn(length_col, F.when(F.col("_n_removed") > 0, F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    blank = (F.col("_n_removed") > 0) & ~F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    return cut.where(~F.coalesce(blank, F.lit(False))).select(*docs.columns)
