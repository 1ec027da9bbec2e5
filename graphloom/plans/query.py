"""Conjunctive queries over a knowledge base."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.kb import KnowledgeBase
from graphloom.plans.compiler import MATCH, compile_pattern
from graphloom.plans.pattern import Pattern, constants


@dataclass(frozen=True)
class Clause:
    pattern: Pattern
    optional: bool = False


@dataclass(frozen=True)
class Query:
    """A fluent, immutable query; `execute` gives a DataFrame with a column of atom ids for each variable.

    Mandatory clauses are joined in an order that starts with the most constants
    and goes on by shared variables; an optional clause never moves before one
    that stands ahead of it.  A query needs a mandatory clause.
    """

    kb: KnowledgeBase
    clauses: tuple[Clause, ...] = ()
    negated: tuple[tuple[Pattern, bool], ...] = ()
    filters: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())
    most: int | None = None

    def match(self, p: Pattern) -> Query:
        return replace(self, clauses=(*self.clauses, Clause(p)))

    def optional_match(self, p: Pattern) -> Query:
        return replace(self, clauses=(*self.clauses, Clause(p, True)))

    def not_match(self, p: Pattern, correlated: bool = False) -> Query:
        """No row if the pattern matches at all; correlated: no row that it matches under the row's bindings."""
        return replace(self, negated=(*self.negated, (p, correlated)))

    def filter(self, condition: Column | Callable[[DataFrame], DataFrame]) -> Query:
        f = condition if callable(condition) and not isinstance(condition, Column) else lambda d: d.where(condition)
        return replace(self, filters=(*self.filters, f))

    def _by_truth(self, variable: str, least: float, column: str) -> Query:
        def keep(d: DataFrame) -> DataFrame:
            good = self.kb.atoms.where(F.col(column) >= least).select(F.col("atom_id").alias(variable))
            return d.join(good, variable, "left_semi")

        return self.filter(keep)

    def filter_by_strength(self, variable: str, least: float) -> Query:
        return self._by_truth(variable, least, "tv_s")

    def filter_by_confidence(self, variable: str, least: float) -> Query:
        return self._by_truth(variable, least, "tv_c")

    def limit(self, n: int) -> Query:
        return replace(self, most=n or None)

    # Running

    def ordered(self) -> list[Clause]:
        """Clauses in join order."""
        if not any(not c.optional for c in self.clauses[:1]):
            raise ValueError("a query starts with a mandatory clause")
        out: list[Clause] = []
        known: set[str] = set()
        todo = list(self.clauses)
        while todo:
            free = todo[: next((k for k, c in enumerate(todo) if c.optional), len(todo))] or todo[:1]
            c = max(free, key=lambda c: (bool(known & set(c.pattern.variables())) if known else True, constants(c.pattern)))
            todo.remove(c)
            out.append(c)
            known |= set(c.pattern.variables())
        return out

    def execute(self) -> DataFrame:
        rows: DataFrame | None = None
        nullable: set[str] = set()
        for c in self.ordered():
            own = compile_pattern(self.kb.atoms, c.pattern).drop(MATCH)
            if rows is None:
                rows = own
                continue
            rows, nullable = _join(rows, own, c.optional, nullable)
        for p, correlated in self.negated:
            found = compile_pattern(self.kb.atoms, p).drop(MATCH)
            shared = [v for v in found.columns if v in rows.columns]
            if correlated and shared:
                rows = rows.join(found.select(*shared).distinct(), shared, "left_anti")
            else:
                rows = rows.join(found.limit(1).select(F.lit(1).alias("_")), F.lit(True), "left_anti")
        for f in self.filters:
            rows = f(rows)
        if self.most is not None:
            rows = rows.orderBy(*sorted(rows.columns)).limit(self.most)
        return rows

    def count(self) -> int:
        return self.execute().count()

    def exists(self) -> bool:
        return not self.execute().isEmpty()


#: Rows of a product of clauses that share no variable.
MOST_PRODUCT = 100_000_000


def _join(rows: DataFrame, own: DataFrame, optional: bool, nullable: set[str]) -> tuple[DataFrame, set[str]]:
    """Natural join; a variable that an optional clause may have left unbound agrees with anything.

    Rows are parted by which of these variables are bound, and each part is an
    equality join on those that are.
    """
    shared = [v for v in own.columns if v in rows.columns]
    new = [v for v in own.columns if v not in rows.columns]
    names = [*rows.columns, *new]
    out = _parts(rows, own, shared, [v for v in shared if v in nullable], "left" if optional else "inner")
    return out.select(names), nullable | (set(new) if optional else set())


def _parts(rows: DataFrame, own: DataFrame, keys: list[str], loose: list[str], how: str) -> DataFrame:
    if loose:
        v, *rest = loose
        bound = _parts(rows.where(F.col(v).isNotNull()), own, keys, rest, how)
        return bound.unionByName(_parts(rows.where(F.col(v).isNull()).drop(v), own, [k for k in keys if k != v], rest, how))
    if keys:
        return rows.join(own, keys, how)
    return _product(rows, own, how)


def _product(rows: DataFrame, own: DataFrame, how: str) -> DataFrame:
    """Every row with every match: asked for by clauses without a shared variable, and refused if it is too large."""
    n = rows.count()
    if n and (total := n * own.count()) > MOST_PRODUCT:
        raise ValueError(f"clauses that share no variable have {total} combinations")
    return rows.join(own, F.lit(True), how) if n else rows.join(own.limit(0), F.lit(True), "left")


def find_matches(kb: KnowledgeBase, p: Pattern) -> DataFrame:
    """Bindings of a single pattern."""
    return compile_pattern(kb.atoms, p).drop(MATCH)


def find_by_truth(kb: KnowledgeBase, s: float, c: float = 0.0) -> DataFrame:
    return kb.atoms.where((F.col("tv_s") >= s) & (F.col("tv_c") >= c))


def project(rows: DataFrame, *variables: str) -> DataFrame:
    """The variables alone; rows that bind none of them go."""
    return rows.select(*variables).where(F.coalesce(*variables).isNotNull())


def distinct(rows: DataFrame) -> DataFrame:
    return rows.distinct()


def exists(kb: KnowledgeBase, p: Pattern) -> DataFrame:
    """One row that says whether the pattern matches."""
    return find_matches(kb, p).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def for_each(kb: KnowledgeBase, p: Pattern, callback: Callable) -> None:
    """Calls back on every partition's matches."""
    compile_pattern(kb.atoms, p).foreachPartition(callback)
