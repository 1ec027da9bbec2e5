"""Patterns: driver-side trees that never enter the space they query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from graphloom import schema


class Pattern:
    """Base of all patterns."""

    def variables(self) -> list[str]:
        """Names of variables in order of first sight."""
        return list(dict.fromkeys(self._variables()))

    def _variables(self) -> Iterator[str]:
        return iter(())

    def has_variables(self) -> bool:
        return bool(self.variables())


@dataclass(frozen=True)
class Var(Pattern):
    """Binds any atom; with a type, atoms of that type alone."""

    name: str
    type: str | None = None

    @classmethod
    def typed(cls, text: str) -> Var:
        """Of `name:Type`: what stands behind the last colon is the type; none accepts all."""
        name, sep, kind = text.rpartition(":")
        return cls(name, kind or None) if sep else cls(text)

    def is_typed(self) -> bool:
        return self.type is not None

    def _variables(self):
        yield self.name


@dataclass(frozen=True)
class Glob(Pattern):
    """Stands for any number of neighbouring children of a link; binds nothing."""

    name: str = "@"


@dataclass(frozen=True)
class Node(Pattern):
    type: str
    name: str

    def key(self) -> str:
        return schema.node_key(self.type, self.name)


@dataclass(frozen=True)
class Link(Pattern):
    type: str
    outgoing: tuple[Pattern, ...]

    def _variables(self):
        for p in self.outgoing:
            yield from p._variables()

    def is_ground(self) -> bool:
        return all(isinstance(p, Node) or isinstance(p, Link) and p.is_ground() for p in self.outgoing)

    def key(self) -> str:
        return schema.link_key(self.type, [p.key() for p in self.outgoing])  # type: ignore[attr-defined]


@dataclass(frozen=True)
class Not(Pattern):
    """Matches what its inner pattern doesn't; binds nothing, sees variables bound before it."""

    inner: Pattern

    def _variables(self):
        return iter(())


def concept(name: str) -> Node:
    return Node("ConceptNode", name)


def link(type_: str, *outgoing: Pattern) -> Link:
    return Link(type_, tuple(outgoing))


def inheritance(a: Pattern, b: Pattern) -> Link:
    return link("InheritanceLink", a, b)


def evaluation(predicate: str, *args: Pattern) -> Link:
    return link("EvaluationLink", Node("PredicateNode", predicate), link("ListLink", *args))


def is_ground(p: Pattern) -> bool:
    return isinstance(p, Node) or isinstance(p, Link) and p.is_ground()


def constants(p: Pattern) -> int:
    """How much a pattern pins down: its ground parts."""
    if isinstance(p, Node):
        return 1
    return sum(map(constants, p.outgoing)) if isinstance(p, Link) else 0


def substitute(p: Pattern, bound: dict[str, Pattern]) -> Pattern:
    """Variables replaced by what they are bound to."""
    if isinstance(p, Var):
        return bound.get(p.name, p)
    if isinstance(p, Link):
        return Link(p.type, tuple(substitute(c, bound) for c in p.outgoing))
    return Not(substitute(p.inner, bound)) if isinstance(p, Not) else p


def unify(a: Pattern, b: Pattern, bound: dict[str, Pattern] | None = None) -> dict[str, Pattern] | None:
    """Bindings under which two patterns are equal, or None; without occurs check and globs."""
    bound = dict(bound or {})
    for x, y in ((a, b), (b, a)):
        if isinstance(x, Var):
            if x.name in bound:
                return bound if bound[x.name] == y else None
            return bound | {x.name: y}
    if isinstance(a, Link) and isinstance(b, Link):
        if a.type != b.type or len(a.outgoing) != len(b.outgoing):
            return None
        for x, y in zip(a.outgoing, b.outgoing):
            if (bound := unify(x, y, bound)) is None:
                return None
        return bound
    return bound if a == b else None
