"""Patterns to DataFrames.

A link pattern is a filter on type, arity and the ids of its ground children; a
nested link with variables is a join of its own match on the child's id, one for
each level; a repeated variable is an equality.  Ground patterns fold to their
id on the driver.  Types of variables are read off ids, without a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.plans.pattern import Glob, Link, Node, Not, Pattern, Var, is_ground

MATCH = "match_id"


def compile_pattern(atoms: DataFrame, p: Pattern, candidates: DataFrame | None = None) -> DataFrame:
    """(match_id, a column of ids for each variable): every atom that matches, with its bindings."""
    every = atoms if candidates is None else candidates
    if isinstance(p, Var):
        out = every.select(F.col("atom_id").alias(MATCH), F.col("atom_id").alias(p.name))
        return out.where(schema.type_of(p.name) == p.type) if p.type else out
    if isinstance(p, Glob):
        return every.limit(0).select(F.col("atom_id").alias(MATCH))
    if isinstance(p, Not):
        inner = compile_pattern(atoms, p.inner, candidates).select(MATCH)
        return every.select(F.col("atom_id").alias(MATCH)).join(inner, MATCH, "left_anti")
    if is_ground(p):
        return every.where((F.col("type") == p.type) & (F.col("atom_id") == p.key())).select(F.col("atom_id").alias(MATCH))
    return _link(atoms, p, every)


def _link(atoms: DataFrame, p: Link, every: DataFrame) -> DataFrame:
    globs = [k for k, c in enumerate(p.outgoing) if isinstance(c, Glob)]
    if len(globs) > 1:
        return every.limit(0).select(F.col("atom_id").alias(MATCH), *(F.lit(None).cast("string").alias(v) for v in p.variables()))
    rows = every.where((F.col("type") == p.type) & ~F.col("is_node"))
    n = len(p.outgoing)
    if globs:
        g = globs[0]
        rows = rows.where(F.col("arity") >= n - 1)
        at: list[tuple[Pattern, Column]] = [(c, F.col("outgoing")[k]) for k, c in enumerate(p.outgoing[:g])]
        at += [(c, F.element_at("outgoing", k - n)) for k, c in enumerate(p.outgoing) if k > g]
    else:
        rows = rows.where(F.col("arity") == n)
        at = [(c, F.col("outgoing")[k]) for k, c in enumerate(p.outgoing)]
    # Ground children first: they reach the scan.
    for c, child in at:
        if is_ground(c):
            rows = rows.where(child == c.key())
    places = {f"_p{k}": child for k, (_, child) in enumerate(at)}
    rows = rows.select(F.col("atom_id").alias(MATCH), *(v.alias(k) for k, v in places.items()))
    bound: list[str] = []
    for (c, _), place in zip(at, places):
        if is_ground(c):
            continue
        if isinstance(c, Var):
            if c.type:
                rows = rows.where(schema.type_of(place) == c.type)
            if c.name in bound:
                rows = rows.where(F.col(c.name) == F.col(place))
            else:
                rows, bound = rows.withColumn(c.name, F.col(place)), [*bound, c.name]
        elif isinstance(c, Not):
            rows = _without(atoms, rows, c.inner, place, bound)
        else:
            own = compile_pattern(atoms, c).withColumnRenamed(MATCH, "_child")
            shared = [v for v in c.variables() if v in bound]
            own = reduce(lambda d, v: d.withColumnRenamed(v, f"_s_{v}"), shared, own)
            on = [F.col(place) == F.col("_child"), *(F.col(v) == F.col(f"_s_{v}") for v in shared)]
            rows = rows.join(own, reduce(Column.__and__, on)).drop("_child", *(f"_s_{v}" for v in shared))
            bound += [v for v in c.variables() if v not in bound]
    return rows.select(MATCH, *bound)


def _without(atoms: DataFrame, rows: DataFrame, inner: Pattern, place: str, bound: list[str]) -> DataFrame:
    """Rows whose child at a place doesn't match the inner pattern under what is bound."""
    if isinstance(inner, Var):
        if inner.name in bound:
            return rows.where(F.col(place) != F.col(inner.name))
        return rows.where(schema.type_of(place) != inner.type) if inner.type else rows.where("false")
    if is_ground(inner):
        return rows.where(F.col(place) != inner.key())
    own = compile_pattern(atoms, inner).withColumnRenamed(MATCH, "_child")
    shared = [v for v in inner.variables() if v in bound]
    own = own.select("_child", *(F.col(v).alias(f"_s_{v}") for v in shared))
    on = [F.col(place) == F.col("_child"), *(F.col(v) == F.col(f"_s_{v}") for v in shared)]
    return rows.join(own, reduce(Column.__and__, on), "left_anti")


def construct(rows: DataFrame, template: Pattern, s=1.0, c=1.0) -> DataFrame:
    """Link atoms of a template, its variables replaced by each row's bindings; inner links come too."""
    made: list[DataFrame] = []

    def id_of(p: Pattern) -> Column:
        if isinstance(p, Var):
            return F.col(p.name)
        if isinstance(p, Node):
            return F.lit(p.key())
        ids = [id_of(x) for x in p.outgoing]
        made.append(schema.links(rows, p.type, ids, s=s, c=c))
        return schema.link_id(p.type, ids)

    id_of(template)
    return reduce(DataFrame.unionByName, made).dropDuplicates(["atom_id"])


def named(rows: DataFrame, *variables: str) -> DataFrame:
    """Ids of nodes replaced by their names."""
    return reduce(lambda d, v: d.withColumn(v, schema.name_of(v)), variables or rows.columns, rows)
