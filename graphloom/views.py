"""The graph view of the star schema: which rows are which atoms, and the same edges in SQL.

A knowledge base is stored once a session, partitioned by type, and read from
there: a query doesn't derive the base again, and a clause scans the files of
its own type.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema, store
from graphloom.kb import KnowledgeBase
from graphloom.sources import tables


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def concept(prefix: str, column: str) -> Column:
    return schema.node_id("ConceptNode", ident(prefix, column))


def _edges(spark: SparkSession, sf: str) -> list[tuple[DataFrame, Column, Column, Column, Column, str, str]]:
    """(rows, child, parent, strength, confidence, child's prefix, key)."""
    c = F.col
    nation, customer, supplier, part = (load(spark, sf, t) for t in ("nation", "customer", "supplier", "part"))
    return [
        (nation, ident("nation", "n_nationkey"), ident("region", "n_regionkey"), 0.6 + (c("n_nationkey") % 4) / 10.0, F.lit(0.8)),
        (customer, ident("customer", "c_custkey"), ident("nation", "c_nationkey"), 0.5 + (c("c_custkey") % 50) / 100.0, F.lit(0.9)),
        (supplier, ident("supplier", "s_suppkey"), ident("nation", "s_nationkey"), 0.5 + (c("s_suppkey") % 40) / 100.0, F.lit(0.7)),
        (part, ident("part", "p_partkey"), ident("brand", "p_brand"), 1 - c("p_size") / 100.0, c("p_size") / (c("p_size") + 10.0)),
        (part, ident("part", "p_partkey"), ident("type", "p_type"), F.lit(0.9), F.lit(0.9)),
    ]


#: The edges of `taxonomy` in DuckDB's SQL.
EDGES_SQL = """
e AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 0.6::DOUBLE + (n_nationkey % 4) / 10.0::DOUBLE AS s, 0.8::DOUBLE AS c FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 0.5::DOUBLE + (c_custkey % 50) / 100.0::DOUBLE, 0.9::DOUBLE FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 0.5::DOUBLE + (s_suppkey % 40) / 100.0::DOUBLE, 0.7::DOUBLE FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand, 1 - p_size / 100.0::DOUBLE, p_size / (p_size + 10.0::DOUBLE) FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'type:' || p_type, 0.9::DOUBLE, 0.9::DOUBLE FROM part)
"""


#: Where the session keeps a view: by application, tables and name.
_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame], clustered: bool = False) -> KnowledgeBase:
    """The base of these atoms, written to the shared folder at its first use."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = f"{store.checkpoint_dir(spark)}/kb-{name}-{uuid.uuid4().hex}"
        tables.write(KnowledgeBase(make()), path, clustered=clustered)
        _STORED[key] = path
    return tables.read(spark, _STORED[key])


def _taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    links, names = [], []
    for rows, child, parent, s, c in _edges(spark, sf):
        a, b = (schema.node_id("ConceptNode", x) for x in (child, parent))
        links.append(schema.inheritance(rows, a, b, s=s, c=c))
        names += [rows.select(child.alias("_name")), rows.select(parent.alias("_name")).distinct()]
    # Children are keys of their tables, so links are distinct; names are deduplicated before they become atoms.
    nodes = schema.concept(reduce(DataFrame.union, names).distinct(), F.col("_name"))
    return reduce(DataFrame.unionByName, [*links, nodes])


def taxonomy(spark: SparkSession, sf: str) -> KnowledgeBase:
    """Inheritance: nations in regions, customers and suppliers in nations, parts in brands and types."""
    return stored(spark, sf, "taxonomy", lambda: _taxonomy(spark, sf), clustered=True)


def edge_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same as plain edges (link_type, src, dst, tv_s, tv_c) with readable ends."""
    parts = [rows.select(F.lit("InheritanceLink").alias("link_type"), a.alias("src"), b.alias("dst"), s.alias("tv_s"), c.alias("tv_c")) for rows, a, b, s, c in _edges(spark, sf)]
    return reduce(DataFrame.unionByName, parts)


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation(placed, List(customer, order))."""
    return _evaluations(load(spark, sf, "orders"), "placed", concept("customer", "o_custkey"), concept("order", "o_orderkey"), F.lit(1.0), F.lit(0.9))


def contains(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation(contains, List(order, part)): s is one less the mean discount, c the quantity's weight of evidence."""
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.avg("l_discount").alias("d"), F.sum("l_quantity").alias("q"))
    return _evaluations(lines, "contains", concept("order", "l_orderkey"), concept("part", "l_partkey"), 1 - F.col("d"), F.col("q") / (F.col("q") + 10.0))


def _evaluations(rows: DataFrame, predicate: str, a: Column, b: Column, s: Column, c: Column) -> DataFrame:
    args = schema.link_id("ListLink", [a, b])
    return schema.links(rows, "EvaluationLink", [F.lit(schema.node_key("PredicateNode", predicate)), args], s, c).unionByName(schema.links(rows, "ListLink", [a, b]))


def orders(spark: SparkSession, sf: str) -> KnowledgeBase:
    """The orders that customers placed, alone."""
    return stored(spark, sf, "orders", lambda: placed(spark, sf))


def trade(spark: SparkSession, sf: str) -> KnowledgeBase:
    """Taxonomy with orders; a scan of a type that one of them lacks reads none of its files."""
    return KnowledgeBase(taxonomy(spark, sf).atoms.unionByName(orders(spark, sf).atoms))


def market(spark: SparkSession, sf: str) -> KnowledgeBase:
    """Taxonomy with orders and their parts."""
    contents = stored(spark, sf, "contents", lambda: contains(spark, sf))
    return KnowledgeBase(trade(spark, sf).atoms.unionByName(contents.atoms))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Concept nodes with embeddings."""
    return schema.nodes(load(spark, sf, "embeddings"), "ConceptNode", ident("vec", "vec_id"), embedding=F.col("embedding"))


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """Attention of users: sti from values, lti from the number of events."""
    e = load(spark, sf, "events")
    return e.groupBy(ident("user", "user_id").alias("atom_id")).agg(F.sum("value").alias("sti"), F.count(F.lit(1)).cast("double").alias("lti"), F.lit(0.0).alias("vlti"))


BANK_SQL = "b AS (SELECT 'user:' || user_id AS atom_id, sum(value) AS sti, count(*)::DOUBLE AS lti, 0.0::DOUBLE AS vlti FROM events GROUP BY 1)"


def associations(spark: SparkSession, sf: str) -> DataFrame:
    """Hebbian links of users: one for each pair of neighbours in id, by their distance modulo seven."""
    u = load(spark, sf, "events").select("user_id").distinct()
    a, b = u.select(F.col("user_id").alias("x")), u.select((F.col("user_id") - 1).alias("x"), F.col("user_id").alias("y"))
    return a.join(b, "x").select(F.concat(F.lit("user:"), "x").alias("src"), F.concat(F.lit("user:"), "y").alias("dst"), (0.1 + (F.col("x") % 7) / 10.0).alias("tv_s"), F.lit(0.5).alias("tv_c"))


ASSOCIATIONS_SQL = "u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT 'user:' || a.user_id AS src, 'user:' || b.user_id AS dst, 0.1::DOUBLE + (a.user_id % 7) / 10.0::DOUBLE AS s, 0.5::DOUBLE AS c FROM u a JOIN u b ON b.user_id = a.user_id + 1)"


def implications(spark: SparkSession, sf: str) -> DataFrame:
    """Implications along conversations: turn t of a conversation implies turn t + 1."""
    t = load(spark, sf, "conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn")).distinct()
    name = lambda c: F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), c.cast("string"))
    rows = t.select("conv_id", "turn").distinct().join(nxt, ["conv_id", "turn"])
    return rows.select(F.lit("ImplicationLink").alias("link_type"), name(F.col("turn")).alias("src"), name(F.col("turn") + 1).alias("dst"), (0.6 + (F.col("turn") % 4) / 10.0).alias("tv_s"), F.lit(0.8).alias("tv_c"))


IMPLICATIONS_SQL = "i AS (SELECT DISTINCT 'turn:' || a.conv_id || ':' || a.turn AS src, 'turn:' || a.conv_id || ':' || (a.turn + 1) AS dst, 0.6::DOUBLE + (a.turn % 4) / 10.0::DOUBLE AS s, 0.8::DOUBLE AS c FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
