"""Operator 1: secret scan by assignment-aware lexing.

Three base patterns are matched over the whole text.  Beside them, lines that
hold an assignment sign (also subscripts, type annotations, `#define`, triple
quotes and block scalars) are lexed as source or configuration: names, operators,
string literals and bare values become name-literal pairs; constants propagate
through later assignments, `+`, `+=` and `${NAME}`; a literal counts as a secret
if the sensitivity of a name that it reaches and its own make-up score enough.
So does a constant put together from literals, as a whole, if it has at most
`JOINED` characters (longer ones count by their literals alone).  Such a literal
is a span of kind `pair` unless a base span covers it.

Constants are nodes of a graph that later constants share, and a literal is
visited again only for a more sensitive name, so the work is in proportion to
the text however constants are combined.

Defined cases: a null text is an empty one; both have no spans.  Rows are
independent, so null ids, repeated rows and extra columns need no rule.  Texts
and lines of any length are read whole.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame

from graphloom.llm.common import map_rows

#: Fixed patterns: group 2 of an assignment is the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 12
KINDS = ("assign", "access", "hex", "pair")

#: Weights of the parts of a target's name.
NAME_WEIGHT = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "passcode": 3.0,
    "secret": 3.0, "credential": 2.5, "credentials": 2.5, "token": 2.5, "apikey": 3.0,
    "privatekey": 3.0, "accesskey": 3.0, "secretkey": 3.0, "bearer": 2.0, "auth": 1.5,
    "private": 1.0, "api": 1.0, "access": 1.0, "key": 1.5, "signing": 1.0, "encryption": 1.0,
    "client": 0.5, "salt": 1.5, "webhook": 1.0, "dsn": 1.5, "connectionstring": 2.5,
}
#: A literal of this much or more, together with its name, is a secret.
ENOUGH = 5.0
#: Values that stand for one.
STAND_IN = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|0+|1234567890?|changeme|change_me|placeholder|example.*|your[-_].*|dummy.*|test|none|null|true|false|undefined|redacted|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")

TOKEN = re.compile(
    r"""(?P<triple>\"{3}(?:\\[\s\S]|[^\\])*?\"{3}|'{3}(?:\\[\s\S]|[^\\])*?'{3})"""
    r"""|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)"""
    r"""|(?P<op>:=|\+=|=>|==|!=|<=|>=|[=:+])"""
    r"""|(?P<ref>\$\{[A-Za-z_]\w*\}|\$[A-Za-z_]\w*)"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)"""
    r"""|(?P<raw>[A-Za-z0-9/@%~^!?_.-][^\s"'`,;()\[\]{}]*)"""
    r"""|(?P<other>\S)"""
)
BARE = re.compile(r"""[^\s"'`,;()\[\]{}]+""")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
SIGNS = frozenset((":", "=", ":=", "=>", "+="))
DEFINE = re.compile(r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)[ \t]+(\S.*)$", re.MULTILINE)
#: A key whose value is the more indented lines below.
SCALAR = re.compile(r"""([ \t-]*)["']?([A-Za-z_][\w.-]*)["']?[ \t]*:[ \t]*[|>][+-]?\d?[ \t]*$""")
#: Characters of a constant that is scored as a whole.
JOINED = 4096


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three base patterns, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    """How sensitive a target's name is: the weights of its parts and of neighbours joined."""
    parts = [p.lower() for p in PARTS.findall(name.rpartition(".")[2])]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return max(max((NAME_WEIGHT.get(x, 0.0) for x in joined), default=0.0), sum(sorted((NAME_WEIGHT.get(x, 0.0) for x in parts), reverse=True)[:2]))


def literal_score(value: str) -> float:
    """How much a literal looks made by chance: length, entropy and kinds of characters."""
    if len(value) < 6 or any(c.isspace() for c in value) or STAND_IN.match(value) or "://" in value and "@" not in value:
        return -9.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(n, 24) / 12 + entropy / 3 + (kinds - 2) * 0.75


def lines(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the logical lines that hold an assignment sign: a line ending in one, `+`, `(` or a backslash goes on, as does one in triple quotes."""
    at, n = 0, len(text)
    while at < n:
        colon, equal = text.find(":", at), text.find("=", at)
        if colon < 0 and equal < 0:
            return
        sign = equal if colon < 0 else colon if equal < 0 else min(colon, equal)
        start = text.rfind("\n", at, sign) + 1 or at
        end = text.find("\n", sign)
        end = n if end < 0 else end
        while end < n and text[sign:end].rstrip()[-1:] in ("=", ":", "+", "(", "\\") and text[sign:end].strip():
            sign = end
            end = text.find("\n", end + 1)
            end = n if end < 0 else end
        for quote in ('"' * 3, "'" * 3):
            if text.count(quote, start, end) % 2 and (close := text.find(quote, end)) >= 0:
                end = text.find("\n", close)
                end = n if end < 0 else end
        yield start, end
        at = end + 1


def typed(tokens: list[tuple[str, str, int, int]], k: int) -> int:
    """The place behind the `=` that follows a type annotation at k on the same line; 0 if there is none."""
    depth = 0
    for n in range(k, min(len(tokens), k + 64)):
        kind, word = tokens[n][:2]
        if word in ("[", "(", "<", "{"):
            depth += 1
        elif word in ("]", ")", ">", "}"):
            depth -= 1
            if depth < 0:
                return 0
        elif word == "=" and not depth:
            return n + 1 if n > k else 0
        elif kind == "op" or kind in ("string", "ref") and not depth or word in (",", ";") and not depth:
            return 0
    return 0


def declared(text: str, tokens: list[tuple[str, str, int, int]], k: int) -> str | None:
    """The name before the type at k that is followed by a sign and a string: `token string = "..."`."""
    if k + 2 >= len(tokens) or tokens[k + 2][0] != "string" or tokens[k + 1][1] not in ("=", ":="):
        return None
    at = k - 1
    while at >= 0 and tokens[at][1] in ("*", "[", "]", "&"):
        at -= 1
    if at < 0 or tokens[at][0] != "name" or not text[tokens[at][3] : tokens[at + 1][2]].isspace():
        return None
    return tokens[at][1]


@dataclass(eq=False)
class Constant:
    """What a name holds: literals (spans), other constants, and all of it as one string if that isn't too long."""

    literals: list[tuple[int, int]]
    parts: list[Constant]
    value: str | None
    weight: float = 0.0

    def reached(self, least: float) -> Iterator[Constant]:
        """This constant and those it holds that no name of such a weight has reached before."""
        todo = [self]
        while todo:
            c = todo.pop()
            if c.weight < least:
                c.weight = least
                yield c
                todo += c.parts


def constant(text: str, found: list[tuple[int, int] | Constant]) -> Constant:
    """The constant put together from literals and constants, in order."""
    if len(found) == 1 and isinstance(found[0], Constant):
        return found[0]
    values = [x.value if isinstance(x, Constant) else text[x[0] : x[1]] for x in found]
    whole = None if None in values or sum(map(len, values)) > JOINED else "".join(values)
    return Constant([x for x in found if not isinstance(x, Constant)], [x for x in found if isinstance(x, Constant)], whole)


def inner(kind: str, word: str, start: int, text: str) -> list[tuple[int, int]]:
    """Literals of a string token: what is between the quotes, line by line in triple ones."""
    if kind == "string":
        return [(start + 1, start + len(word) - 1)]
    return [(start + 3 + m.start(), start + 3 + m.end()) for m in re.finditer(r"\S(?:.*\S)?", word[3:-3])]


def assignments(text: str) -> Iterator[tuple[list[str], Constant]]:
    """(names, what they get), in order; constants are followed."""
    known: dict[str, Constant] = {}

    def events():
        return heapq.merge(((lo, 0, hi, None) for lo, hi in lines(text)), ((m.start(), 1, m.end(), m) for m in DEFINE.finditer(text)), key=lambda e: e[:2])

    def keep(names: list[str], found: list, grows: bool = False) -> Iterator[tuple[list[str], Constant]]:
        if grows and names[0] in known:
            found = [known[names[0]], *found]
        if found:
            made = constant(text, found)
            for name in names:
                if re.fullmatch(r"\w+", name):
                    known[name] = made
            yield names, made

    for lo, _, hi, define in events():
        if define:
            tokens = [(m.lastgroup, m.group(), m.start()) for m in TOKEN.finditer(text, define.start(2), hi)]
            found = [x for kind, word, start in tokens if kind in ("string", "triple") for x in inner(kind, word, start, text)]
            found += [known[word] for kind, word, _ in tokens if kind == "name" and word in known]
            yield from keep([define[1]], found)
            continue
        if (m := SCALAR.match(text, lo, hi)) and hi < len(text):
            yield from keep([m[2]], scalar(text, hi + 1, len(m[1])))
            continue
        tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(text, lo, hi)]
        k = 0
        while k + 2 < len(tokens):
            kind, word, start, _ = tokens[k]
            name = word[1:-1] if kind == "string" else word
            sign = k + 2 if tokens[k + 1][1] == "]" else k + 1
            if not (kind in ("name", "string") and sign + 1 < len(tokens) and tokens[sign][1] in SIGNS and name):
                k += 1
                continue
            names = [name]
            if kind == "name" and sign == k + 1 and (of := declared(text, tokens, k)):
                names.append(of)
            grows = tokens[sign][1] == "+="
            annotated = typed(tokens, sign + 1) if tokens[sign][1] == ":" else 0
            found: list[tuple[int, int] | Constant] = []
            k = sign + 1
            while k < len(tokens):
                kind, word, start, end = tokens[k]
                if kind in ("string", "triple"):
                    found += inner(kind, word, start, text)
                elif kind == "ref" and word.strip("${}") in known:
                    found.append(known[word.strip("${}")])
                elif kind == "name" and word in known:
                    found.append(known[word])
                elif kind in ("name", "raw"):
                    bare = BARE.match(text, start, hi)
                    end = bare.end() if bare else end
                    if not (k + 1 < len(tokens) and tokens[k + 1][1] in ("(", "[")):
                        found.append((start, end))
                    while k + 1 < len(tokens) and tokens[k + 1][2] < end:
                        k += 1
                elif word == "(" and not found and k + 1 < len(tokens):
                    k += 1
                    continue
                k += 1
                if k < len(tokens) and tokens[k][1] == "+":
                    k += 1
                elif k < len(tokens) and kind == "string" and tokens[k][0] == "string" and text[end : tokens[k][2]].isspace():
                    pass
                elif annotated:  # what was read is a type; the value is behind its `=`
                    k, annotated, found = max(k, annotated), 0, []
                else:
                    break
            yield from keep(names, found, grows)


def scalar(text: str, at: int, indent: int) -> list[tuple[int, int]]:
    """The lines from a place on that are indented further, stripped."""
    out = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip():
            lead = len(line) - len(line.lstrip())
            if lead <= indent:
                break
            out.append((at + lead, at + len(line.rstrip())))
        at = end + 1
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with the lexer's."""
    base = base_spans(text)
    if ":" not in text and "=" not in text and "define" not in text:
        return base, base
    starts, far = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    found: set[tuple[int, int]] = set()
    for names, made in assignments(text):
        weight = max(map(name_score, names))
        if weight < 1.5:
            continue
        if len(made.literals) + len(made.parts) > 1 and made.value and weight + literal_score(made.value) >= ENOUGH:
            weight = math.inf
        for c in made.reached(weight):
            found.update(x for x in c.literals if x[0] < x[1] and weight + literal_score(text[x[0] : x[1]]) >= ENOUGH)
    own = [(lo, 3, hi) for lo, hi in found if not ((k := bisect_right(starts, lo)) and far[k - 1] >= hi)]
    return base, sorted(base + own) if own else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its spans of each kind."""

    def rows(batches):
        for b in batches:
            found = [all_spans(t or "") for t in b["text"]]
            count = [Counter(k for _, k, _ in spans) for _, spans in found]
            yield (
                b["doc_id"],
                *([c[k] for c in count] for k in range(3)),
                [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
                [joined(spans) for _, spans in found],
                [c[3] for c in count],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return map_rows(df, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_pair long", rows)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones as one, put out of sight."""
    if not text or not (spans := all_spans(text)[1]):
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with secrets masked; a length column, if there, follows the text."""
    names, count = docs.columns, docs.columns.index(length_col) if length_col in docs.columns else None
    at = names.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))

    def rows(batches):
        for b in batches:
            columns = list(b.values())
            new = [redacted(t) for t in columns[at]]
            if count is not None:
                columns[count] = [n if a == t else len(a) for a, t, n in zip(new, columns[at], columns[count])]
            columns[at] = new
            yield columns

    return map_rows(plain, plain.schema, rows).toDF(*names)
