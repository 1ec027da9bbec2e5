"""Small spaces with known answers, and properties that hold for all."""

from __future__ import annotations

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import numeric, text, tokenizer, truth, vector
from graphloom.functions.truth import TV
from graphloom.kb import KnowledgeBase
from graphloom.operators import attention, cognitive, graph, hebbian, infer, temporal, tensor, vision
from graphloom.plans import compiler, query
from graphloom.plans.pattern import Glob, Node, Not, Var, concept, evaluation, inheritance, link, substitute, unify
from graphloom.plans.query import Query
from graphloom.sources import binary, tables, textual

X, Y, Z = Var("x"), Var("y"), Var("z")


def cid(name):
    return F.lit(schema.node_key("ConceptNode", name))


def space(spark, links, values=None):
    """Concept nodes and links (type, names...) of them."""
    one = spark.range(1)
    values = values or {}
    names = {n for _, *ns in links for n in ns} | set(values)
    parts = [schema.nodes(one, "ConceptNode", n, *values.get(n, (1.0, 1.0))) for n in sorted(names)]
    parts += [schema.links(one, t, [cid(n) for n in ns]) for t, *ns in links]
    return KnowledgeBase.empty(spark).add(*parts)


def edges(spark, rows):
    return spark.createDataFrame(rows, "link_type string, src string, dst string, tv_s double, tv_c double")


def inh(*rows):
    return [("InheritanceLink", *r) for r in rows]


def names(df, *cols):
    return sorted(tuple(r) for r in compiler.named(df.select(*cols)).collect())


# Queries


def test_single_and_conjunctive(spark):
    kb = space(spark, inh(("dog", "mammal"), ("cat", "mammal"), ("dog", "hasLegs")))
    assert names(query.find_matches(kb, inheritance(X, concept("mammal"))), "x") == [("cat",), ("dog",)]
    both = Query(kb).match(inheritance(X, concept("mammal"))).match(inheritance(X, concept("hasLegs")))
    assert names(both.execute(), "x") == [("dog",)] and both.count() == 1 and both.exists()


def test_optional(spark):
    kb = space(spark, inh(("dog", "mammal"), ("cat", "mammal"), ("bat", "wings"), ("bat", "mammal")), {"has-wings": (1.0, 1.0)})
    rows = Query(kb).match(inheritance(X, concept("mammal"))).optional_match(inheritance(X, concept("has-wings"))).execute()
    assert rows.count() == 3
    # A variable that an optional clause left unbound agrees with anything.
    rows = Query(kb).match(inheritance(X, concept("mammal"))).optional_match(link("SubsetLink", X, Y)).match(inheritance(Y, concept("wings"))).execute()
    assert names(rows, "x", "y") == [("bat", "bat"), ("cat", "bat"), ("dog", "bat")]
    with pytest.raises(ValueError):
        Query(kb).optional_match(inheritance(X, Y)).execute()


def test_truth_filters(spark):
    kb = space(spark, inh(("dog", "mammal"), ("cat", "mammal")), {"dog": (0.9, 0.8), "cat": (0.3, 0.8), "mammal": (0.1, 0.1)})
    assert query.find_by_truth(kb, 0.5).where("is_node").count() == 1
    rows = Query(kb).match(inheritance(X, concept("mammal"))).filter_by_strength("x", 0.5).limit(10).execute()
    assert names(rows, "x") == [("dog",)]
    assert Query(kb).match(inheritance(X, concept("mammal"))).filter_by_confidence("x", 0.9).count() == 0


def test_distinct_and_project(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", "c"), (None, "d")], "x string, y string")
    assert query.distinct(rows.select("x")).count() == 3
    assert sorted(r[0] for r in query.project(rows, "x").collect()) == ["a", "a", "b"]


def test_globs(spark):
    kb = space(spark, [("ListLink", "a", "b", "c"), ("ListLink", "a"), ("ListLink", "first", "m1", "m2", "last"), ("InheritanceLink", "a", "b")])
    find = lambda p: compiler.compile_pattern(kb.atoms, p).count()
    assert find(link("ListLink", concept("a"), Glob("@rest"))) == 2
    assert find(link("ListLink", concept("first"), Glob("@mid"), concept("last"))) == 1
    assert find(link("ListLink", concept("b"), Glob())) == 0
    assert find(link("ListLink", Glob(), Glob())) == 0 and find(Glob()) == 0
    assert names(compiler.compile_pattern(kb.atoms, link("ListLink", Glob(), X)), "x") == [("a",), ("c",), ("last",)]


def test_negation(spark):
    kb = space(spark, inh(("dog", "mammal"), ("wolf", "mammal"), ("cat", "block")), {"void": (1, 1)})
    q = Query(kb).match(inheritance(X, concept("mammal")))
    assert q.not_match(inheritance(X, concept("void"))).count() == 2
    assert q.not_match(inheritance(X, concept("block"))).count() == 0
    kb = space(spark, inh(("cat", "animal"), ("block", "animal"), ("cat", "block")))
    q = Query(kb).match(inheritance(X, concept("animal"))).not_match(inheritance(X, concept("block")), correlated=True)
    assert names(q.execute(), "x") == [("block",)]


def test_negation_patterns(spark):
    kb = space(spark, inh(("a", "b"), ("a", "a"), ("c", "b")))
    find = lambda *p: names(compiler.compile_pattern(kb.atoms, link("InheritanceLink", *p)), "x")
    assert find(X, Not(concept("b"))) == [("a",)]
    assert find(X, Not(X)) == [("a",), ("c",)]
    assert find(X, X) == [("a",)]
    assert find(X, Not(Y)) == []
    assert find(X, Var("y", "PredicateNode")) == [] and len(find(X, Var.typed("y:ConceptNode"))) == 3


def test_nested_and_not_of_links(spark):
    one = spark.range(1)
    kb = space(spark, [("ListLink", "a", "b"), ("ListLink", "c", "d")]).add(schema.evaluation(one, "likes", cid("a"), cid("b")), schema.evaluation(one, "likes", cid("c"), cid("d")), schema.evaluation(one, "knows", cid("a"), cid("d")))
    assert names(query.find_matches(kb, evaluation("likes", X, Y)), "x", "y") == [("a", "b"), ("c", "d")]
    p = link("EvaluationLink", Var("p"), Not(link("ListLink", concept("a"), Y)))
    assert names(query.find_matches(kb, p), "p") == [("likes",)]
    made = compiler.construct(query.find_matches(kb, evaluation("likes", X, Y)), link("MemberLink", Y, link("ListLink", X, concept("k"))))
    assert made.where("type = 'MemberLink'").count() == 2 and made.where("type = 'ListLink'").count() == 2


def test_clause_order_does_not_matter(spark):
    kb = space(spark, inh(("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")))
    clauses = [inheritance(X, Y), inheritance(Y, Z), inheritance(X, Z)]
    want = None
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        q = Query(kb)
        for k in order:
            q = q.match(clauses[k])
        got = names(q.execute(), "x", "y", "z")
        assert got == (want := want or got) and got


def test_patterns():
    p = link("InheritanceLink", X, Y)
    assert p.variables() == ["x", "y"] and p.has_variables() and not Not(p).has_variables()
    assert unify(p, inheritance(concept("a"), concept("b"))) == {"x": concept("a"), "y": concept("b")}
    assert unify(link("L", X, X), link("L", concept("a"), concept("b"))) is None
    assert unify(link("L", X), link("L", concept("a"), concept("b"))) is None
    assert substitute(p, {"x": concept("a")}) == inheritance(concept("a"), Y)
    assert Var.typed("v:a:T") == Var("v:a", "T") and Var.typed("v") == Var("v") and Var.typed("v:T").is_typed()


# The space


def test_upsert(spark):
    one = spark.range(1)
    kb = KnowledgeBase.empty(spark).add(schema.concept(one, "a", s=0.2, embedding=F.array(F.lit(1.0))))
    again = kb.add(schema.concept(one, "a", s=0.9)).add(schema.concept(one, "a", embedding=F.array(F.lit(2.0))))
    row = again.atoms.first()
    assert again.count() == 1 and row["tv_s"] == 0.2 and list(row["embedding"]) == [2.0]
    assert kb.add(schema.concept(one, "a", s=0.9), overwrite=True).atoms.first()["tv_s"] == 0.9
    assert kb.merge(kb).count() == 1 and kb.clear().count() == 0


def test_remove(spark):
    kb = space(spark, inh(("a", "b")))
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "atom_id string")
    a, l = "ConceptNode|a", kb.by_type("InheritanceLink").first()["atom_id"]
    assert kb.remove(gone(a)).count() == 3
    assert kb.remove(gone(l)).count() == 2 and kb.remove(gone(l, a)).count() == 1


def test_links_are_ordered(spark):
    kb = space(spark, [("SimilarityLink", "a", "b"), ("SimilarityLink", "b", "a"), ("SimilarityLink", "a", "b")])
    assert kb.by_type("SimilarityLink").count() == 2
    assert schema.link_key("L", ["x", "y"]) == spark.range(1).select(schema.link_id("L", [F.lit("x"), F.lit("y")])).first()[0]


def test_neighbourhood(spark):
    kb = space(spark, inh(("A", "B"), ("B", "C")))
    near = lambda d: graph.neighbourhood(kb, kb.get("ConceptNode", "A"), d).where("atom_id LIKE 'ConceptNode%'").count()
    assert (near(1), near(2), near(4)) == (0, 1, 2)


def test_constructors(spark):
    one = spark.range(1)
    a, b = cid("a"), cid("b")
    made = [schema.predicate(one, "p"), schema.implication(one, a, b), schema.list_link(one, a, b), schema.and_link(one, a, b), schema.or_link(one, a, b), schema.not_link(one, a), schema.member(one, a, b), schema.subset(one, a, b), schema.context(one, a, b), schema.sequential(one, a, b), schema.simultaneous(one, a, b), schema.similarity(one, a, b), schema.execution(one, a, b, b), schema.hebbian(one, a, b), schema.hebbian(one, a, b, "Asymmetric"), schema.hebbian(one, a, b, "Inverse")]
    assert all(m.first()["type"] in schema.NODE_TYPES + schema.LINK_TYPES for m in made)
    assert schema.type_table(spark).count() == 27


# Truth values


def value(spark, t: TV):
    return tuple(spark.range(1).select(t.s, t.c).first())


def near(got, want, tol=1e-5):
    return all(abs(a - b) < tol for a, b in zip(got, want))


@pytest.mark.parametrize(
    "rule, a, b, want",
    [
        (truth.deduction, (0.9, 0.8), (0.8, 0.9), (0.72, 0.711628)),
        (truth.conjunction, (0.8, 0.9), (0.7, 0.85), (0.56, 0.765)),
        (truth.disjunction, (0.8, 0.9), (0.7, 0.85), (0.94, 0.875)),
        (truth.revision, (0.7, 0.8), (0.8, 0.7), (0.746667, 0.595681)),
        (truth.abduction, (0.9, 0.8), (0.85, 0.9), (0.765, 0.257684)),
        (truth.batch_and, (0.8, 0.9), (0.7, 0.85), (0.56, 0.735577)),
        (truth.deduction, (0.9, 0.8), (0.85, 0.9), (0.765, 0.713881)),
    ],
)
def test_rules(spark, rule, a, b, want):
    assert near(value(spark, rule(TV.of(*a), TV.of(*b))), want)


def test_counts_to_truth(spark):
    assert near(value(spark, truth.induction(8, 10)), (0.8, 0.909091))
    assert near(value(spark, truth.negation(TV.of(0.8, 0.9))), (0.2, 0.9))
    assert value(spark, truth.induction(0, 0)) == (0.5, 0.0) and value(spark, truth.revision(TV.of(0.1, 0.0), TV.of(0.9, 0.0))) == (0.5, 0.0)
    with pytest.raises(ValueError):
        truth.batch("AND", TV.of(1, 1))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 1), min_size=4, max_size=4))
def test_truth_stays_in_bounds(spark, v):
    a, b = TV.of(v[0], v[1]), TV.of(v[2], v[3])
    rules = [truth.deduction, truth.abduction, truth.revision, truth.conjunction, truth.disjunction, truth.implication, truth.extensional_similarity, *truth.BATCH.values()]
    row = spark.range(1).select(*(c for f in rules for c in f(a, b))).first()
    assert all(0 <= x <= 1 for x in row)


def test_distribution(spark):
    t = spark.createDataFrame([(0.5, 0.8), (0.7, 0.9), (0.6, 0.85)], "s double, c double")
    assert near(t.agg(F.avg("s"), F.avg("c"), F.var_pop("s"), F.var_pop("c")).first(), (0.6, 0.85, 0.006667, 0.001667))


# Inference


def test_forward_chain(spark):
    e = edges(spark, [("InheritanceLink", a, b, 0.9, 0.9) for a, b in ("AB", "BC", "CD")])
    got = {(r["src"], r["dst"]): (r["tv_s"], r["tv_c"]) for r in infer.forward_chain(e, least=0.1).collect()}
    assert set(got) == {("A", "C"), ("B", "D"), ("A", "D")}
    assert near(got["A", "C"], (0.81, 0.805525)) and near(got["A", "D"], (0.729, 0.717006))
    assert infer.forward_chain(e, least=0.99).count() == 0
    assert infer.forward_chain(e, iterations=1, cap=1).count() == 1


def test_chain_reaches_its_fixed_point(spark):
    e = edges(spark, [("InheritanceLink", a, b, 0.9, 0.9) for a, b in ("AB", "BC", "CA")])
    closed = e.union(infer.forward_chain(e, least=0.0).select(infer.EDGE))
    assert infer.forward_chain(closed, least=0.0).count() == 0


def test_implications(spark):
    nodes = spark.createDataFrame([("A", "ConceptNode", 0.8, 0.9), ("B", "ConceptNode", 0.5, 0.9)], "atom_id string, type string, tv_s double, tv_c double")
    got = {(r["src"], r["dst"]): (r["tv_s"], r["tv_c"]) for r in infer.implication_step(nodes, edges(spark, []), 0.3, 0.0).collect()}
    assert near(got["A", "B"], (0.6, 0.9)) and near(got["B", "A"], (0.9, 0.9))
    imp = lambda *rows: edges(spark, [("ImplicationLink", *r) for r in rows])
    e = imp(("A", "B", 0.8, 0.9), ("B", "C", 0.7, 0.6))
    assert near([(r["tv_s"], r["tv_c"]) for r in infer.implication_chain(e).collect()][0], (0.56, 0.519231))
    assert infer.implication_chain(e, depth=1).count() == 0
    assert infer.implication_chain(imp(("A", "B", 0.8, 0.7), ("B", "C", 0.7, 0.6), ("A", "C", 0.5, 0.5))).count() == 0
    assert infer.implication_chain(imp(("A", "B", 0.8, 0.0), ("B", "C", 0.7, 0.7))).count() == 0


def test_proofs(spark):
    e = edges(spark, [("InheritanceLink", a, b, 0.9, 0.9) for a, b in ("AB", "BC", "CD", "BD", "DA")])
    goal = edges(spark, [("InheritanceLink", "A", "D", 1.0, 1.0)])
    got = infer.prove(e, goal, depth=4)
    assert [list(r["path"]) for r in got.orderBy("depth").collect()] == [["A", "B", "D"], ["A", "B", "C", "D"]]
    assert infer.best_proof(got).count() == 1 and infer.prove(e, goal, proofs=1).count() == 1
    assert "A -> B" in infer.render(got).first()["text"]
    assert infer.middle_terms(e, goal).first()["mid"] == "B"
    assert infer.prove(e, edges(spark, [("InheritanceLink", "A", "Q", 1.0, 1.0)])).count() == 0
    open_ = spark.createDataFrame([("InheritanceLink", "B", None), ("InheritanceLink", None, "D"), ("InheritanceLink", None, None)], "link_type string, src string, dst string")
    assert infer.prove(e, open_, proofs=3).count() == 2 + 2 + 3
    told = {r["dst"]: (r["proved"], r["tv_c"]) for r in infer.can_prove(e, edges(spark, [("InheritanceLink", "A", x, 1.0, 1.0) for x in "DQ"])).collect()}
    assert told["D"][0] and told["Q"] == (False, 0.0)


def test_dense_proofs_end(spark):
    """Every atom of a layer is linked to every one of the next: paths are many, proofs are few."""
    layers = [[f"{k}{x}" for x in "abcdef"] for k in range(5)]
    e = edges(spark, [("InheritanceLink", a, b, 0.9, 0.9) for x, y in zip(layers, layers[1:]) for a in x for b in y] + [("InheritanceLink", "0a", f"dead{k}", 0.9, 0.9) for k in range(50)])
    got = infer.prove(e, edges(spark, [("InheritanceLink", "0a", "4f", 1.0, 1.0), ("InheritanceLink", "0a", "1b", 1.0, 1.0)]), depth=6)
    assert {(r["dst"], r["depth"]) for r in got.collect()} == {("4f", 4), ("1b", 1)} and got.count() == 6


def test_rules_chain(spark):
    e = edges(spark, [("InheritanceLink", "A", "B", 0.9, 0.9), ("InheritanceLink", "B", "C", 0.9, 0.9)])
    flip = lambda d: d.where("link_type = 'InheritanceLink'").select(F.lit("SimilarityLink").alias("link_type"), F.col("dst").alias("src"), F.col("src").alias("dst"), "tv_s", "tv_c")
    assert {(r["src"], r["dst"], r["round"]) for r in infer.forward_chain(e, rules=[flip]).collect()} == {("A", "C", 1), ("B", "A", 1), ("C", "B", 1), ("C", "A", 2)}
    nodes = spark.createDataFrame([("A", 0.5, 0.0), ("B", 0.5, 0.0), ("C", 0.9, 0.9)], "atom_id string, tv_s double, tv_c double")
    made, after = infer.chain(e, nodes, 1)
    values = {r["atom_id"]: r["tv_c"] for r in after.collect()}
    assert made.count() == 1 and values["A"] == 0 and values["B"] > 0.1 and values["C"] == 0.9
    assert {r["atom_id"]: r["tv_c"] for r in infer.chain(e, nodes, 3)[1].collect()}["A"] > 0.1


def test_pipelines(spark):
    e = edges(spark, [("InheritanceLink", a, b, 0.9, 0.9) for a, b in ("AB", "BC")])
    same, fixed, n = infer.Pipeline(e).custom("none", lambda d: d).run(True, 5)
    assert fixed and n == 1 and same.count() == 2
    done, fixed, n = infer.Pipeline(e).deduction().run(True, 5)
    assert fixed and n == 2 and done.count() == 3
    twice = e.union(e.where("src = 'A'"))
    assert infer.Pipeline(twice).revision().run()[0].count() == 2
    nodes = spark.createDataFrame([(x, "ConceptNode", 0.8, 0.9) for x in "ABC"], "atom_id string, type string, tv_s double, tv_c double")
    full = infer.pln_complete_pipeline(e, nodes).run()[0]
    assert {r["link_type"] for r in full.collect()} == {"InheritanceLink", "AndLink", "OrLink", "SimilarityLink", "ImplicationLink"}
    assert infer.pln_full_pipeline(e, nodes).run()[0].count() > infer.pln_pipeline(e).run()[0].count() == 3
    assert infer.forward_pipeline(e, "InheritanceLink").run()[0].count() == 3
    assert infer.hypothesis_pipeline(e, edges(spark, [("InheritanceLink", "A", "C", 1.0, 1.0)])).run()[0].count() == 1
    p = infer.Pipeline(e, nodes).abduction().filter(F.col("src") == "A")
    assert p.run()[0].count() == 1 and p.nodes.where("tv_c < 0.9").count() > 0


def test_fill_and_pairs(spark):
    nodes = spark.createDataFrame([("A", "ConceptNode", 0.8, 0.9), ("B", "ConceptNode", 0.7, 0.85)], "atom_id string, type string, tv_s double, tv_c double")
    have = edges(spark, [("AndLink", "B", "A", 1.0, 0.0)])
    assert infer.conjunction_step(nodes, have).count() == 0
    assert near([(r["tv_s"], r["tv_c"]) for r in infer.fill(have, nodes, truth.conjunction).collect()][0], (0.56, 0.765))
    assert infer.disjunction_step(nodes, have).count() == 1
    done = infer.Pipeline(have, nodes).conjunction().run()[0].collect()
    assert [(r["src"], r["dst"]) for r in done] == [("B", "A")] and near((done[0]["tv_s"], done[0]["tv_c"]), (0.56, 0.765))
    with pytest.raises(ValueError, match="candidates"):
        infer.check_blocks(nodes, "type", 1)


# Attention, association, time


def bank(spark, rows):
    return spark.createDataFrame(rows, "atom_id string, sti double, lti double, vlti double")


def sti(df):
    return {r["atom_id"]: r["sti"] for r in df.collect()}


def test_attention(spark):
    b = bank(spark, [("n1", 100.0, 50.0, 10.0), ("n2", 50.0, 25.0, 5.0), ("n3", 10.0, 5.0, 1.0)])
    b = attention.stimulate(b, spark.createDataFrame([("n2", 60.0)], "atom_id string, amount double"))
    assert sti(b)["n2"] == 110
    b = attention.decay(b, 0.5)
    assert sti(b)["n1"] == 50
    b = attention.transfer(b, spark.createDataFrame([("n1", "n3", 20.0), ("nobody", "n3", 5.0)], "src string, dst string, amount double"))
    assert sti(b) == {"n1": 30, "n2": 55, "n3": 25}
    assert sti(attention.get(b, spark.createDataFrame([("n1",), ("q",)], "atom_id string"))) == {"n1": 30, "q": 0}
    assert [r["atom_id"] for r in attention.focus(b, 26.0, 1).collect()] == ["n2"]


def test_spread(spark):
    b = bank(spark, [("cat", 100.0, 0.0, 0.0), ("dog", 50.0, 0.0, 0.0), ("mammal", 10.0, 0.0, 0.0)])
    h = spark.createDataFrame([("cat", "dog", 0.8, 0.5), ("cat", "mammal", 0.5, 0.5)], "src string, dst string, tv_s double, tv_c double")
    got = sti(attention.spread(b, h, threshold=50.0))
    assert near([got[k] for k in ("cat", "dog", "mammal")], (90, 56.153846, 13.846154)) and abs(sum(got.values()) - 160) < 1e-9
    assert sti(attention.rent(b, least=40.0))["dog"] == 49
    assert sti(attention.wages(b, b))["dog"] == 55


def test_forget(spark):
    b = bank(spark, [("x", 1.0, 100.0, 0.0), ("y", 1.0, 10.0, 0.0), ("z", 1.0, -5.0, 0.0)])
    assert set(sti(attention.forget(b, 0.0))) == {"x", "y", "z"}
    assert set(sti(attention.forget(b, 0.0, least=5.0))) == {"x", "y"}


def test_scores(spark):
    b = attention.from_scores(bank(spark, []), spark.createDataFrame([("a", 0.9), ("b", 0.7), ("c", 0.3), ("d", 0.1)], "atom_id string, score double"))
    assert [round(r["sti"]) for r in attention.top(b, 4).collect()] == [90, 70, 30, 10]


def test_hebbian(spark):
    none = spark.createDataFrame([], "src string, dst string, tv_s double, tv_c double")
    acts = lambda n: spark.createDataFrame([("a", "b")] * n, "src string, dst string")
    assert abs(hebbian.learn(none, acts(10), hebbian.Config(rate=0.2)).first()["tv_s"] - 0.892626) < 1e-6
    h = hebbian.learn(none, acts(5), hebbian.Config(rate=0.5))
    assert abs(h.first()["tv_s"] - 0.96875) < 1e-9 and abs(hebbian.decay(h, hebbian.Config(decay=0.5)).first()["tv_s"] - 0.484375) < 1e-9
    assert hebbian.decay(h, hebbian.Config(decay=0.999)).count() == 0
    assert hebbian.strength(h, "b", "a").count() == 1 and hebbian.associates(h, "b").first()["other"] == "a" and hebbian.associates(h, "b", directed=True).count() == 0
    calm = hebbian.learn(none, acts(1), hebbian.FAST, bank(spark, [("b", 9.0, 0.0, 0.0)]))
    assert abs(calm.first()["tv_s"] - 0.03) < 1e-9


def test_hebbian_cycles(spark):
    none = spark.createDataFrame([], "src string, dst string, tv_s double, tv_c double")
    h = hebbian.run_cycles(none, bank(spark, [(x, 5.0, 0.0, 0.0) for x in "abc"]), 2, hebbian.Config(rate=0.5, decay=0.0))
    assert h.count() == 3 and h.first()["tv_s"] == 0.75 and hebbian.reset(h).count() == 0
    b = bank(spark, [("a", 1.0, 0.0, 0.0)])
    assert attention.size(attention.remove(b, b)) == 0


def test_cycle(spark):
    kb = space(spark, inh(("a", "b"), ("b", "c")))
    b = bank(spark, [(schema.node_key("ConceptNode", n), 50.0, 1.0, 0.0) for n in "abc"])
    none = spark.createDataFrame([], "src string, dst string, tv_s double, tv_c double")
    seen = []
    e = cognitive.Engine(kb, b, none, spark.createDataFrame([("ConceptNode|a", 1.0)], "atom_id string, priority double"))
    e.register("all", inheritance(X, Y), lambda d: seen.append(d.count()))
    found = e.run(2)
    assert len(found) == 2 and seen == [2, 3] and found[0].count() == 1 and found[1].count() == 0 and e.hebbian.count() == 3
    # The conclusion is known, the goal is there and gone, times are logged.
    assert e.kb.count() == kb.count() + 1 and e.goals.count() == 0
    assert {(r["kind"], r["n"]) for r in e.times.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {("created", 1), ("accessed", 6)}
    assert (e.metrics["cycles"], e.metrics["patterns_matched"], e.metrics["new_atoms"], e.metrics["goals_proved"]) == (2, 5, 1, 1)
    goals = spark.createDataFrame([("g1", 2.0, "InheritanceLink", *(schema.node_key("ConceptNode", x) for x in "ac")), ("g2", 1.0, "InheritanceLink", *(schema.node_key("ConceptNode", x) for x in "ca"))], "atom_id string, priority double, link_type string, src string, dst string")
    calm = cognitive.Engine(kb, b, none, goals, mode="REACTIVE")
    assert calm.cycle().count() == 0 and calm.kb.count() == kb.count()
    assert [r["atom_id"] for r in calm.goals.collect()] == ["g2"]
    how, rows_ = cognitive.answer(kb, inheritance(concept("a"), concept("c")), b.select("atom_id"))
    assert how == "proof" and rows_.first()["depth"] == 2
    e.stop()
    assert e.run(1) == []


def test_times(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    log = spark.createDataFrame([("a", "created", t(1), None), ("a", "event", t(2), "old"), ("a", "created", t(3), None), ("a", "event", t(4), "new"), ("b", "accessed", t(5), None)], "atom_id string, kind string, ts timestamp, description string")
    got = {r["atom_id"]: r for r in temporal.times(log).collect()}
    assert got["a"]["created_at"] == t(3) and got["b"]["created_at"] is None
    assert [r["description"] for r in temporal.history(log).collect()] == ["new"]
    assert temporal.between(temporal.times(log), "created_at", t(3), t(3)).count() == 1


# Text, tokens, scenes


def test_text(spark):
    def one(s, f):
        return spark.createDataFrame([(1, s)], "doc_id long, text string").select(f("text")).first()[0]

    assert one("Hello world! This is a test.", text.tokens)[:3] == ["Hello", "world", "!"]
    assert one("Hello, World! 123", text.normalise) == "hello world 123"
    assert len(one("First sentence. Second sentence! Third sentence?", text.sentences)) == 3
    assert one("no end", text.sentences) == ["no end"]
    d = spark.createDataFrame([(1, "Albert Einstein and Marie Curie were scientists."), (2, "Alice visited Paris. Bob liked Alice.")], "doc_id long, text string")
    e = text.entity_table(d)
    assert [(r["text"], r["type"]) for r in e.where("doc_id = 1").orderBy("ord").collect()] == [("Albert Einstein", "PERSON"), ("Marie Curie", "PERSON")]
    assert e.join(d.withColumnRenamed("text", "t"), "doc_id").where("substr(t, start + 1, end - start) != text").count() == 0
    rel = {(r["subject"], r["predicate"], r["object"]) for r in text.relation_table(d).collect()}
    assert ("Alice", "visited", "Paris") in rel and ("Bob", "liked", "Alice") in rel
    atoms = text.graph_of(text.relation_table(d), e)
    assert atoms.where("type = 'EvaluationLink' AND tv_s = 0.7").count() >= 2


def test_generate(spark):
    one = spark.range(1)
    kb = space(spark, [("InheritanceLink", "cat", "mammal"), ("AndLink", "a", "b", "c"), ("MemberLink", "a", "b")]).add(schema.evaluation(one, "likes", cid("a"), cid("b")))
    said = {r["text"] for r in text.sentence_of(kb).collect()}
    assert {"cat is a mammal", "a, b and c", "MemberLink(a, b)", "a likes b"} <= said
    assert text.summary(kb).first()[0] == "a likes b."


def test_word_piece():
    ids = {f"[unused{k}]": k for k in range(100)} | {"[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "[MASK]": 103, "hello": 104, "hel": 105, "##lo": 106, "!": 107}
    t = tokenizer.WordPiece(tokenizer.Vocabulary(ids))
    assert t.encode("hello") == [101, 104, 102] and t.encode("Hello", special=False) == [104]
    assert t.tokenize("hello!helo 日x") == ["hello", "!", "[UNK]", "[UNK]", "[UNK]"] and t.tokenize("a" * 101) == ["[UNK]"]
    assert t.encode("hello hello hello", longest=2) == [101, 104]
    assert t.tokenize("hel") == ["hel"] and len(t.vocabulary) == 108


def test_byte_level():
    base = tokenizer.ByteLevelBpe(tokenizer.Vocabulary({}), [])
    merges = ["T h", "Th e"]
    vocab = {t: k for k, t in enumerate([base.char[b] for b in range(256)] + ["Th", "The"])}
    t = tokenizer.ByteLevelBpe(tokenizer.Vocabulary(vocab), merges)
    assert t.tokenize("The quick")[0] == "The"
    for s in ("The quick brown fox", "é 日本 \n x", ""):
        assert t.decode(t.encode(s)) == s


def test_boxes(spark):
    d = spark.createDataFrame([(1, 0, "top", 0.4, 0.2, 0.2, 0.2, 0.9), (1, 1, "bottom", 0.4, 0.6, 0.2, 0.2, 0.8)], "scene_id long, ord int, label string, x double, y double, width double, height double, confidence double")
    rel = vision.relations(d)
    assert rel.first()["relation"] == "below"
    assert vision.describe(d, rel).first()["description"] == "The scene contains a top and a bottom. The top is below the bottom."
    assert vision.scene_graph(d, rel).count() == 5
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x", "y", "width", "height"))))
    pair = spark.range(1).select(box(0, 0, 0.5, 0.5).alias("a"), box(0.25, 0.25, 0.5, 0.5).alias("b"), box(0.8, 0.8, 0.1, 0.1).alias("c"))
    assert near(pair.select(vision.iou("a", "b"), vision.iou("a", "c")).first(), (0.142857, 0))
    assert vision.ground(d, spark.createDataFrame([("top", "thing")], "label string, concept string")).count() == 1
    assert {r["description"] for r in vision.frame_events(d).collect()} == {"detected_frame_1"}


# Vectors and tensors


def test_vectors(spark):
    t = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 0.0]), ("d", [1.0, 1.0, 1.0]), ("e", None)], "atom_id string, embedding array<double>")
    assert [(r[0], round(r[1], 6)) for r in vector.knn(t, [1.0, 0.0], 2).collect()] == [("a", 1.0), ("b", 0.6)]
    assert vector.knn(t, [1.0, 0.0], 0).count() == 0 and vector.knn(t, [1.0, 0.0], None, None).count() == 4
    q = t.where("atom_id < 'c'")
    assert vector.distance_join(q, q, upper=True).first()["distance"] == pytest.approx(math.sqrt(0.8))
    with pytest.raises(ValueError):
        vector.distance_join(q, q, bound=1)
    one = t.where("atom_id = 'b'")
    assert near(one.select(vector.norm("embedding", 1.0), vector.norm("embedding", float("inf"))).first(), (1.4, 0.8))


def test_special_functions(spark):
    t = spark.createDataFrame([(0.5,), (2.0,)], "x double")
    got = t.select(*(numeric.special(n, F.col("x")) for n in ("erf", "erfc", "lgamma", "digamma")), numeric.special("polygamma", F.col("x"), 1), numeric.special("erfinv", F.col("x") / 4)).collect()
    assert near(got[0], (math.erf(0.5), math.erfc(0.5), math.lgamma(0.5), -1.9635100260, 4.9348022005)) and near(got[1][3:5], (0.4227843351, 0.6449340668))
    assert abs(math.erf(got[1][5]) - 0.5) < 1e-9


def test_tensor_shapes(spark):
    m = spark.createDataFrame([(i, j, float(3 * i + j)) for i in range(2) for j in range(3)], "i int, j int, v double")
    cells = lambda d: {(r["i"], r["j"]): r["v"] for r in d.collect()}
    assert cells(tensor.transpose(m))[2, 1] == 5 and cells(tensor.rot90(m, 2, 3)) == {(2 - j, i): 3.0 * i + j for i in range(2) for j in range(3)}
    assert cells(tensor.matmul(m.withColumnRenamed("j", "k"), tensor.transpose(m).withColumnRenamed("i", "k"))) == {(0, 0): 5, (0, 1): 14, (1, 0): 14, (1, 1): 50}
    assert tensor.trace(m).first()[0] == 4 and tensor.triu(m, 1).count() == 3 and tensor.nonzero(m).count() == 5 and tensor.diagonal(m).count() == 2
    assert tensor.repeat(m, "i", 2, 3).count() == 18 and tensor.repeat_interleave(m, "i", 2).count() == 12 and tensor.chunk(m, "j", 3, 2).where("chunk = 1").count() == 2
    assert tensor.stack([m, m]).count() == 12 and tensor.select(m, "i", 1).count() == 3
    assert [r["row"] for r in tensor.to_dense(m, 3).orderBy("i").collect()] == [[0, 1, 2], [3, 4, 5]]
    assert [r["v"] for r in tensor.arange(spark, 0, 10, 3).orderBy("i").collect()] == [0, 3, 6, 9] and tensor.eye(spark, 3).count() == 3
    one = spark.range(1)
    assert one.select(tensor.cross(F.array(F.lit(1), F.lit(0), F.lit(0)), F.array(F.lit(0), F.lit(1), F.lit(0)))).first()[0] == [0, 0, 1]
    fed = tensor.masked_scatter(m, F.col("v") > 2, spark.createDataFrame([(k, -1.0 * k) for k in range(3)], "i int, v double"), ["i", "j"])
    assert sorted(cells(fed).values()) == [-2, -1, 0, 0, 1, 2]
    assert cells(tensor.index_put(m.where("i = 0"), spark.createDataFrame([(1, 9.0)], "j int, v double"), "j"))[0, 1] == 9
    with pytest.raises(ValueError):
        tensor.cartesian(m, m, bound=10)


def test_linear_algebra(spark):
    t = spark.createDataFrame([([4.0, 1.0, 1.0, 3.0], [1.0, 2.0])], "m array<double>, b array<double>")
    get = lambda c: t.select(c).first()[0]
    assert near(get(tensor.linalg("inverse", F.col("m"), 2)), (3 / 11, -1 / 11, -1 / 11, 4 / 11))
    assert near(get(tensor.solve(F.col("m"), F.col("b"))), (1 / 11, 7 / 11)) and near(get(tensor.solve(F.col("m"), F.col("b"), True)), (1 / 11, 7 / 11))
    for name in ("cholesky", "singular_values", "eigenvalues", "qr_r", "pinverse", "det"):
        assert get(tensor.linalg(name, F.col("m"), 2))
    assert spark.createDataFrame([([0.0] * 4,)], "m array<double>").select(tensor.linalg("inverse", F.col("m"), 2)).first()[0] is None
    assert len(get(tensor.stft(F.col("m"), 2, 1))) == 3


def test_random(spark):
    for kind, kw in (("uniform", {}), ("normal", {}), ("randint", {"high": 5}), ("bernoulli", {"p": 0.5}), ("poisson", {"rate": 2.0}), ("randperm", {})):
        a = tensor.random(spark, 50, kind, seed=1, **kw)
        assert a.count() == 50 and a.orderBy("i").collect() == tensor.random(spark, 50, kind, seed=1, **kw).orderBy("i").collect()
    w = spark.createDataFrame([(k, float(k)) for k in range(10)], "i int, w double")
    assert tensor.multinomial(w, 4).distinct().count() == 4


def test_histogram_edges(spark):
    t = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert sum(r["n"] for r in tensor.histogram(t, "v", 4).collect()) == 2
    t = spark.createDataFrame([(0.0,), (1.0,), (9.0,)], "v double")
    assert [r["n"] for r in tensor.histogram(t, "v", 2, 0.0, 1.0).orderBy("bin").collect()] == [1, 1]


# Sources


def nested(spark):
    one = spark.range(1)
    kb = space(spark, inh(("A", "B"), ("B", "C")), {"odd:[name],%#\n": (0.25, 0.5)})
    ab, bc = (schema.link_id("InheritanceLink", [cid(a), cid(b)]) for a, b in ("AB", "BC"))
    return kb.add(schema.list_link(one, ab, bc, s=0.5), schema.concept(one, "v", embedding=F.array(F.lit(1.5), F.lit(-2.0)), attention=3.0))


def rows(kb, *drop):
    return sorted(str({k: v for k, v in r.asDict().items() if k not in drop}) for r in kb.atoms.collect())


def test_text_round_trip(spark, tmp_path):
    kb = nested(spark)
    textual.write(kb, f"{tmp_path}/t")
    assert rows(textual.read(spark, f"{tmp_path}/t"), "embedding") == rows(kb, "embedding")
    assert any('(ListLink\n  (InheritanceLink' in r["text"] for r in textual.pretty(kb).collect())


def test_binary_round_trip(spark, tmp_path):
    kb = nested(spark)
    data = binary.serialise(kb)
    assert rows(binary.deserialise(spark, data)) == rows(kb)
    (tmp_path / "a.bin").write_bytes(data)
    assert binary.read_files(spark, str(tmp_path)).count() == kb.count()
    parts = binary.to_files(kb, 2)
    assert parts.count() > 1 and rows(binary.from_files(parts)) == rows(kb)
    for bad in (data[:-1], b"XXXX" + data[4:], data[:20]):
        with pytest.raises(ValueError):
            binary.loads(bad)
    out = binary.in_order([r.asDict() for r in kb.atoms.collect()])
    at = {r["atom_id"]: k for k, r in enumerate(out)}
    assert all(at[c] < at[r["atom_id"]] for r in out for c in r["outgoing"] or [])


def test_table_round_trip(spark, tmp_path):
    kb = nested(spark)
    tables.write(KnowledgeBase(kb.atoms, bank(spark, [("a", 1.0, 2.0, 3.0)])), f"{tmp_path}/kb")
    back = tables.read(spark, f"{tmp_path}/kb", ("attention",))
    assert rows(back) == rows(kb) and back.attention.count() == 1
    plan = back.by_type("ListLink")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan


def test_vocabularies(spark, tmp_path):
    (tmp_path / "v.txt").write_bytes(b"[PAD]\r\nhello\nworld\n")
    (tmp_path / "v.json").write_text(json.dumps({"a": 1, "b": 0}))
    (tmp_path / "m.txt").write_text("# v\nT h\n\nTh e\n")
    (tmp_path / "c.json").write_text(json.dumps({"model_name": "m", "hidden_size": 8, "vocab_size": 9}))
    (tmp_path / "x.f4").write_bytes(b"\x00\x00\x80\x3f")
    assert tables.vocabulary(spark, f"{tmp_path}/v.txt") == {"[PAD]": 0, "hello": 1, "world": 2}
    assert tables.vocabulary(spark, f"{tmp_path}/v.json") == {"a": 1, "b": 0}
    assert tables.merges(spark, f"{tmp_path}/m.txt") == ["T h", "Th e"]
    c = tables.model_configs(spark, f"{tmp_path}/c.json").first()
    assert c["hidden_size"] == 8 and c["image_size"] is None
    assert tables.tensor_files(spark, f"{tmp_path}/x.f4").first()["values"] == [1.0]
