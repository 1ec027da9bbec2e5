"""Operator 6: concatenate and cut.

Pass one tokenizes every document and writes its ids with the running token
count of its partition; the partitions' totals (a number each) are summed to
global offsets.  Pass two gives each document its place in one endless row of
ids and cuts that row into fixed windows; a document that crosses a window's end
gives one piece for each window.  Only the last window is padded.

Defined cases: a null text is an empty one and gives the end id alone; repeated
rows are packed as often as they come; the order is that of the input's splits;
an empty table gives an empty result.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import file_text, map_rows, materialise
from graphloom.llm.pieces import Pieces, numbered, room

#: Ids of a sequence, the id after each document.
WINDOW = 2048
END = 1
#: Pieces that a worker keeps before it starts anew.
CACHE = 1 << 20
#: Pieces that the library tokenizes in one string.
CALL = 256


class _Cache:
    """Ids of pieces that this worker's tokenizer has met, in one flat array."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = Pieces(CACHE)
        self.clear()

    def clear(self) -> None:
        self.ids = np.empty(1 << 16, np.uint32)
        self.start = np.empty(1 << 15, np.int64)
        self.size = np.empty(1 << 15, np.int32)
        self.n = self.used = 0

    def learn(self, new: list[str]) -> np.ndarray:
        """Numbers of new pieces; they are tokenized many to a call, parted by a space."""
        begin = self.n
        for k in range(0, len(new), CALL * 64):
            part = new[k : k + CALL * 64]
            lots = [part[i : i + CALL] for i in range(0, len(part), CALL)]
            for lot, e in zip(lots, self.tokenizer.encode_batch(list(map(" ".join, lots)), add_special_tokens=False)):
                ends = np.cumsum(np.fromiter(map(len, lot), np.int64, len(lot)) + 1)
                ids = np.array(e.ids, np.uint32)
                at = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
                self._keep(ids, np.bincount(np.searchsorted(ends, at, "right"), minlength=len(lot)))
        return np.arange(begin, self.n)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.n, self.n + len(sizes)
        self.ids = room(self.ids, self.used + len(ids))
        self.start, self.size = room(self.start, m), room(self.size, m)
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[n:m] = sizes
        self.start[n:m] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = m, self.used + len(ids)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a batch of texts end to end, and each text's number of ids."""
        at, count = numbered(texts, self.known, self.learn, self.clear)
        size = self.size[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = ends[np.concatenate([[0], np.cumsum(count)])]
        ids = self.ids[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, np.diff(bounds)


@lru_cache(1)
def _cache(spec: str) -> _Cache:
    return _Cache(spec)


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its ids with the end id as little-endian 32-bit, and its place in its partition."""

    held = file_text(docs.sparkSession, path)

    def rows(batches):
        part, at = TaskContext.get().partitionId(), 0
        cache = _cache(held.value)
        for b in batches:
            ids, n = cache.encode([t or b"" for t in b["text"]])
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, END).astype("<u4")
            n = n + 1
            yield b["doc_id"], [part] * len(n), at + np.cumsum(n) - n, n, [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]
            at += int(n.sum())

    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return map_rows(df, f"doc_id {kind}, part int, at long, doc_tokens long, ids binary", rows, 512)


def pack(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents in their sequences; with_ids adds the pieces' ids as bytes."""
    spark = docs.sparkSession
    first = materialise(tokenized(docs, path, id_col, text_col), "tokenized")
    # One number a partition.
    totals = sorted((r["part"], r["n"]) for r in first.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in totals]).tolist()
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, base long")
    placed = first.join(F.broadcast(base), "part").withColumn("g", F.col("base") + F.col("at"))
    end = F.col("g") + F.col("doc_tokens")

    def piece(s):
        lo, hi = F.greatest(F.col("g"), s * window), F.least(end, (s + 1) * window)
        start, length = lo - F.col("g"), hi - lo
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        fields = [start.alias("start"), length.alias("length"), F.crc32(ids).alias("ids_crc32"), s.alias("sequence_id"), (lo - s * window).alias("offset")]
        return F.struct(*fields, *[ids.alias("ids")] * with_ids)

    windows = F.sequence(F.expr(f"g div {window}"), F.expr(f"(g + doc_tokens - 1) div {window}"))
    cut = placed.select("doc_id", "doc_tokens", F.inline(F.transform(windows, piece)))
    return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, of pieces with ids: a row holds at most a window's ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
