"""Operator 10: BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round finds every adjacent
pair's rank by binary search over sorted pair keys, takes each word's lowest
rank with one segmented minimum, and merges all its occurrences at once.  Texts
are cut at white space first, as no token crosses it; each distinct piece is
encoded once and kept in a bounded cache of the worker.

Defined cases: a null text is an empty one; both give no tokens and the hash of
an empty string.  Texts of any length are encoded whole.  Rows are independent,
so repeated rows, null ids and extra columns need no rule.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

from graphloom.llm.common import file_text, map_rows
from graphloom.llm.pieces import Pieces, numbered

#: Python's str.split() also cuts at these four; the tokenizer's \s doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
WHITE = regex.compile("[\t-\r \x85\xa0  -     　]+")
#: Pieces that a worker keeps before it starts anew.
CACHE = 1 << 20
#: Up to here Python's and the library's character classes are the same.
LATIN = "\u024f"


def pieces(text: str) -> list[str]:
    """A text cut at white space, as the tokenizers library sees it."""
    if ODD_SPACE.search(text):
        return [x for x in WHITE.split(text) if x]
    return text.split()


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Bpe:
    """A word-level BPE model of a tokenizers JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in chain(vocab.items(), self.special.items())}
        self.added = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        # Character classes of rare scripts differ by Unicode version; the library's own rules hold there.
        self.rare_normal = Tokenizer.from_str(text).normalizer.normalize_str
        self.rare_split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]))))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(keys))[order], made
        # All occurrences of a pair may go at once only if what a merge makes is used by later merges alone.
        first = np.full(max(self.tokens) + 1, -1)
        first[made[::-1]] = np.arange(len(made))[::-1]
        at = np.arange(len(made))
        self.ordered = bool(((first[left] < at) & (first[right] < at)).all())

    def normal(self, piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", piece))

    def split(self, piece: str) -> list[str | int]:
        """Words of a piece without white space, normalised; special tokens as their ids."""
        if self.added is not None and "<" in piece and (parts := self.added.split(piece))[1:]:
            return list(chain.from_iterable([self.special[p]] if k % 2 else self.words(p) for k, p in enumerate(parts)))
        return self.words(piece)

    def words(self, piece: str) -> list[str]:
        if piece and max(piece) > LATIN:
            return [w for w, _ in self.rare_split(self.rare_normal(piece))]
        return self.pattern.findall(self.normal(piece))

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, all words together in merge rounds."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(raw)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.keys)
        while len(sym):
            at = np.full(len(sym), none)
            if len(sym) > 1:
                key = sym[:-1] << 32 | sym[1:]
                spot = np.minimum(np.searchsorted(self.keys, key), none - 1)
                hit = (self.keys[spot] == key) & (word[:-1] == word[1:])
                at[:-1][hit] = self.rank[spot[hit]]
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(at, starts)
            size = np.diff(starts, append=len(sym))
            live = np.repeat(low < none, size)
            if not live.all():
                done.append((word[~live], sym[~live]))
            best = np.repeat(low, size)
            take = (at == best) & live
            if self.ordered:
                take = _alternate(take)
            else:
                spots = np.flatnonzero(take)
                take[:] = False
                take[spots[np.diff(word[spots], prepend=-1) > 0]] = True
            sym = np.where(take, self.made[np.minimum(at, none - 1)], sym)
            stay = live.copy()
            stay[1:] &= ~take[:-1]
            sym, word = sym[stay], word[stay]
        ids = np.concatenate([s for _, s in done]) if done else sym
        owner = np.concatenate([w for w, _ in done]) if done else word
        order = np.argsort(owner, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(owner, minlength=len(raw)))[:-1]) if len(raw) else []

    def encode_pieces(self, new: list[str]) -> list[list[int]]:
        """Ids of each piece; words that pieces share are encoded once."""
        split = [self.split(p) for p in new]
        unique = list(dict.fromkeys(w for ws in split for w in ws if isinstance(w, str)))
        ids = {w: x.tolist() for w, x in zip(unique, self.encode_words(unique))}
        return [list(chain.from_iterable([w] if isinstance(w, int) else ids[w] for w in ws)) for ws in split]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.encode_pieces(pieces(text or ""))))

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def _alternate(take: np.ndarray) -> np.ndarray:
    """Of each run of overlapping pairs, the first, third, fifth ..."""
    spots = np.flatnonzero(take)
    if not len(spots):
        return take
    new = np.diff(spots, prepend=-2) > 1
    begin = np.maximum.accumulate(np.where(new, spots, 0))
    out = np.zeros_like(take)
    out[spots[(spots - begin) % 2 == 0]] = True
    return out


@lru_cache(2)
def model(spec: str) -> Bpe:
    """The model of a tokenizer file's text, made once a worker."""
    return Bpe(spec)


class Encoded:
    """Pieces that this worker has encoded: number of ids, ids and tokens as text, by number."""

    def __init__(self, spec: str):
        self.bpe, self.known = model(spec), Pieces(CACHE)
        self.clear()

    def clear(self) -> None:
        self.size: list[int] = []
        self.ids: list[str] = []
        self.shown: list[str] = []

    def learn(self, new: list[str]) -> range:
        begin = len(self.size)
        for k in range(0, len(new), 50_000):
            for ids in self.bpe.encode_pieces(new[k : k + 50_000]):
                self.size.append(len(ids))
                self.ids.append(" ".join(map(str, ids)))
                self.shown.append(" ".join(map(self.bpe.tokens.__getitem__, ids)))
        return range(begin, len(self.size))

    def digest(self, texts: list[bytes]) -> tuple[list[int], list[str], list[str]]:
        """Per text: number of ids, and the hashes of ids and tokens."""
        at, count = numbered(texts, self.known, self.learn, self.clear)
        ends = np.cumsum(count).tolist()
        at = at.tolist()
        n, ids, shown, lo = [], [], [], 0
        for hi in ends:
            own, lo = at[lo:hi], hi
            sizes = list(map(self.size.__getitem__, own))
            if 0 in sizes:
                own = [a for a, s in zip(own, sizes) if s]
            n.append(sum(sizes))
            ids.append(hashlib.sha256(" ".join(map(self.ids.__getitem__, own)).encode()).hexdigest())
            shown.append(hashlib.sha256(" ".join(map(self.shown.__getitem__, own)).encode()).hexdigest())
        return n, ids, shown


@lru_cache(1)
def _encoded(spec: str) -> Encoded:
    return Encoded(spec)


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens and the SHA-256 of its ids and of its decoded text."""

    held = file_text(docs.sparkSession, path)

    def rows(batches):
        cache = _encoded(held.value)
        for b in batches:
            yield b["doc_id"], *cache.digest([t or b"" for t in b["text"]])

    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return map_rows(df, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows, 512)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its token ids (array<int>) and the decoded text."""

    held = file_text(docs.sparkSession, path)

    def rows(batches):
        bpe = model(held.value)
        for b in batches:
            split = [pieces(t or "") for t in b["text"]]
            unique = list(dict.fromkeys(chain.from_iterable(split)))
            known = dict(zip(unique, bpe.encode_pieces(unique)))
            ids = [list(chain.from_iterable(map(known.__getitem__, ps))) for ps in split]
            yield b["doc_id"], ids, list(map(bpe.decode, ids))

    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_rows(df, f"doc_id {kind}, ids array<int>, decoded string", rows, 256)
