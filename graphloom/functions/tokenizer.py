"""WordPiece and byte-level BPE tokenizers over loaded vocabularies, as Arrow-batched functions.

A vocabulary is a dict of bounded size held by the session; it travels to the
executors once, as a broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.store import ship

#: Special ids of the word-piece vocabulary.
PAD, UNK, CLS, SEP, MASK = 0, 100, 101, 102, 103
UNKNOWN = "[UNK]"
LONGEST = 100
#: Ranges of ideographs, each a token of its own.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2F800, 0x2FA1F))
_IDEOGRAPH = "".join(f"{chr(a)}-{chr(b)}" for a, b in IDEOGRAPHS)
_MARKS = r"!-/:-@\[-`{-~"
BASIC = re.compile(f"[{_MARKS}]|[{_IDEOGRAPH}]|[^ \\t-\\r{_MARKS}{_IDEOGRAPH}]+")
_LOWER = {k: k + 32 for k in range(65, 91)}
#: The byte-level end token.
END_OF_TEXT = 50256


@dataclass
class Vocabulary:
    """Tokens and ids, either way."""

    ids: dict[str, int]
    tokens: dict[int, str] = field(init=False)

    def __post_init__(self):
        self.tokens = {i: t for t, i in self.ids.items()}

    def token_to_id(self, token: str, default: int = UNK) -> int:
        return self.ids.get(token, default)

    def id_to_token(self, i: int) -> str:
        return self.tokens.get(i, UNKNOWN)

    def __contains__(self, token: str) -> bool:
        return token in self.ids

    def __len__(self) -> int:
        return len(self.ids)


class WordPiece:
    """Greedy longest match of lower-case words; what isn't covered is unknown."""

    def __init__(self, vocabulary: Vocabulary, longest: int = LONGEST):
        self.vocabulary, self.longest = vocabulary, longest

    def basic(self, text: str) -> list[str]:
        return BASIC.findall(text.translate(_LOWER))

    def pieces(self, word: str) -> list[str]:
        if len(word.encode()) > self.longest:
            return [UNKNOWN]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.vocabulary:
                    out.append(piece)
                    at = end
                    break
            else:
                return [UNKNOWN]
        return out

    def tokenize(self, text: str) -> list[str]:
        return [p for w in self.basic(text) for p in self.pieces(w)]

    def encode(self, text: str, longest: int | None = 512, special: bool = True) -> list[int]:
        """Ids, cut at the length if there is one: the closing mark may fall off."""
        ids = [self.vocabulary.token_to_id(t) for t in self.tokenize(text)]
        return ([CLS, *ids, SEP] if special else ids)[:longest]


class ByteLevelBpe:
    """Byte-level BPE with merge rules "A B" in order of rank."""

    WORD = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+")

    def __init__(self, vocabulary: Vocabulary, merges: list[str]):
        self.vocabulary = vocabulary
        self.rank = {m: k for k, m in enumerate(merges)}
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.char = {b: chr(b if b in shown else next(rest)) for b in range(256)}
        self.byte = {c: b for b, c in self.char.items()}

    def merge(self, word: str) -> list[str]:
        parts = list(word)
        while len(parts) > 1:
            ranked = [(self.rank.get(f"{a} {b}"), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min((r for r, _ in ranked if r is not None), default=None)
            if best is None:
                break
            out, k = [], 0
            while k < len(parts):
                if k < len(ranked) and ranked[k][0] == best:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def tokenize(self, text: str) -> list[str]:
        return [p for w in self.WORD.findall(text) for p in self.merge("".join(self.char[b] for b in w.encode()))]

    def encode(self, text: str) -> list[int]:
        return [self.vocabulary.token_to_id(t, 0) for t in self.tokenize(text)]

    def decode(self, ids: list[int]) -> str:
        raw = bytes(self.byte[c] for i in ids if i != END_OF_TEXT for c in self.vocabulary.id_to_token(i) if c in self.byte)
        return raw.decode("utf-8", "replace")


def encoder(df: DataFrame, tokenizer, column: str, **options) -> Column:
    """Ids of a text column by a tokenizer that is broadcast."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: held.value.encode(t or "", **options))

    return encode(column)


def padded(ids: Column, length: int) -> Column:
    """(ids, mask, type ids) cut or filled to a length."""
    ids = F.slice(ids, 1, length)
    n = F.size(ids)
    fill = lambda x: F.array_repeat(F.lit(x), F.greatest(F.lit(length) - n, F.lit(0)))
    return F.struct(F.concat(ids, fill(PAD)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), fill(0)).alias("mask"), F.array_repeat(F.lit(0), length).alias("type_ids"))
