"""What physical plans must and must not hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom import views
from graphloom.plans import pattern as P
from graphloom.plans.query import Query
from graphloom.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_reads_the_stored_base(spark, sf):
    text = plan(QUERIES["flagship"](spark, sf))
    assert "lineitem.parquet" not in text and "SortAggregate" not in text and "BroadcastNestedLoopJoin" not in text
    assert "type#" in text and "PartitionFilters: [isnotnull(type" in text


@pytest.mark.parametrize("name", ["j1_conjunctive", "j2_optional", "j4_negation_correlated", "s2_type_scan"])
def test_clauses_dont_group(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "SortAggregate" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_unbound_variables_join_by_equality(spark, sf):
    kb = views.trade(spark, sf)
    x, y, z = P.Var("x"), P.Var("y"), P.Var("z")
    q = Query(kb).match(P.inheritance(x, P.concept("nation:4"))).optional_match(P.evaluation("placed", x, z)).optional_match(P.evaluation("placed", y, z))
    rows = q.execute()
    assert "CartesianProduct" not in plan(rows)
    bound = rows.where("z IS NOT NULL")
    assert bound.where("x != y").count() == 0 and bound.count() > 0
    # A customer without orders agrees with every order.
    none = rows.where(F.col("z").isNull()).count()
    assert none == 0


def test_point_lookup_reaches_the_scan(spark, sf):
    assert "PushedFilters: [IsNotNull(atom_id), EqualTo(atom_id,ConceptNode|customer:7)]" in plan(views.taxonomy(spark, sf).get("ConceptNode", "customer:7"))
