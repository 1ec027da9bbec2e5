"""Atom types, ids and constructors.

A node's id is `<Type>|<name>`; a link's is `<Type>|<hash of its children's ids>`.
An id is a pure function of content, so adding twice is a group-by, a ground
pattern is an equality on the id, and the type of any atom is read off its id
without a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The closed set of types, nodes first.
NODE_TYPES = ("Node", "ConceptNode", "PredicateNode", "VariableNode", "TypedVariableNode", "GlobNode")
LINK_TYPES = (
    "Link", "InheritanceLink", "ImplicationLink", "EvaluationLink", "ListLink", "OrderedLink", "UnorderedLink",
    "AndLink", "OrLink", "NotLink", "MemberLink", "SubsetLink", "ContextLink", "SequentialLink", "SimultaneousLink",
    "SimilarityLink", "ExecutionLink", "HebbianLink", "SymmetricHebbianLink", "AsymmetricHebbianLink", "InverseHebbianLink",
)
HEBBIAN = ("HebbianLink", "SymmetricHebbianLink", "AsymmetricHebbianLink", "InverseHebbianLink")

ATOMS = "atom_id string, type string, is_node boolean, name string, outgoing array<string>, arity int, embedding array<float>, tv_s double, tv_c double, attention double"
COLUMNS = [c.split()[0] for c in ATOMS.split(", ")]


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def node_id(type_: str, name) -> Column:
    return F.concat(F.lit(f"{type_}|"), as_column(name).cast("string"))


def link_id(type_: str, outgoing: Sequence[Column] | Column) -> Column:
    ids = outgoing if isinstance(outgoing, Column) else F.array(*outgoing)
    return F.concat(F.lit(f"{type_}|"), F.substring(F.sha2(F.array_join(ids, ","), 256), 1, 32))


def node_key(type_: str, name: str) -> str:
    """A node's id, on the driver."""
    return f"{type_}|{name}"


def link_key(type_: str, outgoing: Sequence[str]) -> str:
    """A link's id, on the driver."""
    return f"{type_}|{hashlib.sha256(','.join(outgoing).encode()).hexdigest()[:32]}"


def type_of(atom_id) -> Column:
    """The type of an atom, read off its id."""
    return F.substring_index(as_column(atom_id) if not isinstance(atom_id, str) else F.col(atom_id), "|", 1)


def name_of(atom_id) -> Column:
    """The name of a node, read off its id."""
    c = F.col(atom_id) if isinstance(atom_id, str) else atom_id
    return F.substr(c, F.locate("|", c) + 1)


def packed(atom_id) -> Column:
    """An id as a binary key, one to one: a link's hash takes 16 bytes, not 32 digits."""
    c = as_column(atom_id) if not isinstance(atom_id, str) else F.col(atom_id)
    hashed = c.rlike("^[A-Za-z]+[|][0-9a-f]{32}$")
    short = F.concat(F.lit(b"\x01"), F.encode(type_of(c), "UTF-8"), F.unhex(F.right(c, F.lit(32))))
    return F.when(hashed, short).otherwise(F.concat(F.lit(b"\x00"), F.encode(c, "UTF-8")))


def type_table(spark: SparkSession) -> DataFrame:
    """The types with what they are: 27 rows."""
    return spark.createDataFrame([(t, t in LINK_TYPES) for t in NODE_TYPES + LINK_TYPES], "type string, is_link boolean")


def nodes(df: DataFrame, type_: str, name, s=1.0, c=1.0, embedding=None, attention=0.0) -> DataFrame:
    """Node atoms, one for each row."""
    return df.select(
        node_id(type_, name).alias("atom_id"),
        F.lit(type_).alias("type"),
        F.lit(True).alias("is_node"),
        as_column(name).cast("string").alias("name"),
        F.lit(None).cast("array<string>").alias("outgoing"),
        F.lit(0).alias("arity"),
        as_column(embedding).cast("array<float>").alias("embedding"),
        as_column(s).cast("double").alias("tv_s"),
        as_column(c).cast("double").alias("tv_c"),
        as_column(attention).cast("double").alias("attention"),
    )


def links(df: DataFrame, type_: str, outgoing: Sequence[Column] | Column, s=1.0, c=1.0, attention=0.0) -> DataFrame:
    """Link atoms over children's ids, one for each row."""
    ids = outgoing if isinstance(outgoing, Column) else F.array(*outgoing)
    return df.select(
        link_id(type_, ids).alias("atom_id"),
        F.lit(type_).alias("type"),
        F.lit(False).alias("is_node"),
        F.lit(None).cast("string").alias("name"),
        ids.alias("outgoing"),
        F.size(ids).alias("arity"),
        F.lit(None).cast("array<float>").alias("embedding"),
        as_column(s).cast("double").alias("tv_s"),
        as_column(c).cast("double").alias("tv_c"),
        as_column(attention).cast("double").alias("attention"),
    )


def links_of(edges: DataFrame) -> DataFrame:
    """Link atoms of edges (link_type, src, dst, tv_s, tv_c)."""
    ids, type_ = F.array("src", "dst"), F.col("link_type")
    return edges.select(F.concat(type_, F.lit("|"), F.substring(F.sha2(F.array_join(ids, ","), 256), 1, 32)).alias("atom_id"), type_.alias("type"), *_link_columns(ids), F.col("tv_s"), F.col("tv_c"), F.lit(0.0).alias("attention"))


def _link_columns(ids: Column) -> list[Column]:
    columns = {"is_node": F.lit(False), "name": F.lit(None).cast("string"), "outgoing": ids, "arity": F.size(ids), "embedding": F.lit(None).cast("array<float>")}
    return [v.alias(k) for k, v in columns.items()]


# Constructors by kind: nodes from a name, links from children's ids.


def concept(df, name, **kw):
    return nodes(df, "ConceptNode", name, **kw)


def predicate(df, name, **kw):
    return nodes(df, "PredicateNode", name, **kw)


def inheritance(df, child, parent, **kw):
    return links(df, "InheritanceLink", [child, parent], **kw)


def implication(df, antecedent, consequent, **kw):
    return links(df, "ImplicationLink", [antecedent, consequent], **kw)


def list_link(df, *members, **kw):
    return links(df, "ListLink", members, **kw)


def evaluation(df, predicate_name: str, *args, **kw) -> DataFrame:
    """The evaluation, its predicate and its argument list: a row of each for each row."""
    return (
        links(df, "EvaluationLink", [node_id("PredicateNode", predicate_name), link_id("ListLink", args)], **kw)
        .unionByName(links(df, "ListLink", args))
        .unionByName(nodes(df, "PredicateNode", predicate_name).limit(1))
    )


def and_link(df, *members, **kw):
    return links(df, "AndLink", members, **kw)


def or_link(df, *members, **kw):
    return links(df, "OrLink", members, **kw)


def not_link(df, member, **kw):
    return links(df, "NotLink", [member], **kw)


def member(df, element, group, **kw):
    return links(df, "MemberLink", [element, group], **kw)


def subset(df, part, whole, **kw):
    return links(df, "SubsetLink", [part, whole], **kw)


def context(df, where, what, **kw):
    return links(df, "ContextLink", [where, what], **kw)


def sequential(df, *members, **kw):
    return links(df, "SequentialLink", members, **kw)


def simultaneous(df, *members, **kw):
    return links(df, "SimultaneousLink", members, **kw)


def similarity(df, a, b, **kw):
    return links(df, "SimilarityLink", [a, b], **kw)


def execution(df, procedure, *args, **kw):
    return links(df, "ExecutionLink", [procedure, *args], **kw)


def hebbian(df, a, b, kind: str = "Symmetric", **kw):
    """kind: Symmetric, Asymmetric, Inverse, or empty."""
    return links(df, f"{kind}HebbianLink", [a, b], **kw)
