"""Inference as dataflow over edge tables (link_type, src, dst, tv_s, tv_c) and node tables (atom_id, type, tv_s, tv_c).

Rules are joins with the truth value as a projection.  Fixed points are
semi-naive: only conclusions of the last round meet the known edges.  Reference
results that depend on an order of pointers are replaced by a stated order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import truth
from graphloom.functions.truth import TV
from graphloom.store import cut, ship

EDGE = ["link_type", "src", "dst", "tv_s", "tv_c"]
TRANSITIVE = ("InheritanceLink", "ImplicationLink")


def edge_view(edges: DataFrame, prefix: str) -> DataFrame:
    return edges.select(*(F.col(c).alias(f"{prefix}_{c}") for c in EDGE))


def best(conclusions: DataFrame) -> DataFrame:
    """Of equal links, the one of most confidence, then strength."""
    top = F.max(F.struct("tv_c", "tv_s"))
    return conclusions.groupBy("link_type", "src", "dst").agg(top.alias("t")).select("link_type", "src", "dst", F.col("t.tv_s").alias("tv_s"), F.col("t.tv_c").alias("tv_c"))


def deduce(first: DataFrame, second: DataFrame) -> DataFrame:
    """A->B with B->C gives A->C of the first's type; A and C differ."""
    a = edge_view(first.where(F.col("link_type").isin(*TRANSITIVE)), "a")
    b = edge_view(second.where(F.col("link_type").isin(*TRANSITIVE)), "b")
    joined = a.join(b, F.col("a_dst") == F.col("b_src")).where("a_src != b_dst")
    tv = truth.deduction(TV.of("a_tv_s", "a_tv_c"), TV.of("b_tv_s", "b_tv_c"))
    return joined.select(F.col("a_link_type").alias("link_type"), F.col("a_src").alias("src"), F.col("b_dst").alias("dst"), tv.s.alias("tv_s"), tv.c.alias("tv_c"))


def deduction_step(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """One pass over all ordered pairs: the best conclusion for each pair of ends."""
    return best(deduce(edges, edges)).where(F.col("tv_c") >= least)


def abduce(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Observed B (atom_id, tv_s, tv_c) and A->B give A: (atom_id, tv_s, tv_c), the best for each."""
    b = observations.select(F.col("atom_id").alias("dst"), F.col("tv_s").alias("o_s"), F.col("tv_c").alias("o_c"))
    tv = truth.abduction(TV.of("o_s", "o_c"), TV.of("tv_s", "tv_c"))
    found = rules.where(F.col("link_type").isin(*TRANSITIVE)).join(b, "dst").select(F.col("src").alias("atom_id"), tv.s.alias("tv_s"), tv.c.alias("tv_c"))
    return found.groupBy("atom_id").agg(F.max(F.struct("tv_c", "tv_s")).alias("t")).select("atom_id", F.col("t.tv_s").alias("tv_s"), F.col("t.tv_c").alias("tv_c"))


def abduction_step(nodes: DataFrame, edges: DataFrame, least_strength: float = 0.7) -> DataFrame:
    """Abduction from strong observations; a premise that has a value of its own is revised."""
    found = abduce(nodes.where(F.col("tv_s") >= least_strength), edges)
    own = nodes.select("atom_id", F.col("tv_s").alias("n_s"), F.col("tv_c").alias("n_c"))
    revised = truth.revision(TV.of("n_s", "n_c"), TV.of("tv_s", "tv_c"))
    has = F.col("n_s").isNotNull()
    return found.join(own, "atom_id", "left").select("atom_id", F.when(has, revised.s).otherwise(F.col("tv_s")).alias("tv_s"), F.when(has, revised.c).otherwise(F.col("tv_c")).alias("tv_c"))


def induction_by_predicate(evaluations: DataFrame) -> DataFrame:
    """(predicate, tv_s): instances and positives (s > 0.5) of predicates with two or more, and their induction."""
    counted = evaluations.groupBy("predicate").agg(F.count_if(F.col("tv_s") > 0.5).alias("positive"), F.count(F.lit(1)).alias("total")).where("total >= 2")
    tv = truth.induction("positive", "total")
    return counted.select("predicate", "positive", "total", tv.s.alias("tv_s"), tv.c.alias("tv_c"))


def induction_step(edges: DataFrame) -> DataFrame:
    """Binary links that share a target become member links with induction over the group."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("dst"))
    tv = truth.induction(F.col("n"), F.col("n"))
    return edges.select("src", "dst", n.alias("n")).select(F.lit("MemberLink").alias("link_type"), "src", "dst", tv.s.alias("tv_s"), tv.c.alias("tv_c")).distinct()


def revise(values: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Left fold by revision of each key's values, in order; the number of them and whether there were several.

    Rows are sorted by key and order; a task folds its batches with the state of
    the key that goes on, so no key's values are held together.
    """
    ship(values.sparkSession)
    dealt = values.select(*keys, "tv_s", "tv_c", order).repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, F.col("tv_s").cast("double").alias("s"), F.col("tv_c").cast("double").alias("c"))
    out = dealt.select(*keys).withColumns({"n": F.lit(0).cast("long"), "changed": F.lit(True), "tv_s": F.lit(0.0), "tv_c": F.lit(0.0)}).schema

    def fold(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        held = None  # the last key with its number of values and truth value

        def emit(columns, n, s, c):
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, f.type) for x, f in zip((n, n > 1, s, c), list(arrow)[len(keys) :]))], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).combine_chunks()
            begin = np.flatnonzero(_changes([t.column(k) for k in keys]))
            size = np.diff(begin, append=b.num_rows)
            s, c = b.column(len(keys)).to_numpy(zero_copy_only=False), b.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            n, a_s, a_c = size.astype(np.int64), s[begin].copy(), c[begin].copy()
            first = t.select(list(keys)).take(pa.array(begin))
            if held is not None:
                before, k, bs, bc = held
                if before.equals(first.slice(0, 1)):
                    a_s[0], a_c[0] = truth.revised(bs, bc, a_s[0], a_c[0])
                    n[0] += k
                else:
                    yield emit([x.combine_chunks() for x in before.columns], np.array([k]), np.array([bs]), np.array([bc]))
            # The k-th values of all keys together.
            live, k = np.flatnonzero(size > 1), 1
            while len(live):
                a_s[live], a_c[live] = truth.revised(a_s[live], a_c[live], s[begin[live] + k], c[begin[live] + k])
                k += 1
                live = live[size[live] > k]
            held = first.slice(len(begin) - 1), int(n[-1]), float(a_s[-1]), float(a_c[-1])
            if len(begin) > 1:
                done = first.slice(0, len(begin) - 1)
                yield emit([x.combine_chunks() for x in done.columns], n[:-1], a_s[:-1], a_c[:-1])
        if held is not None:
            before, k, bs, bc = held
            yield emit([x.combine_chunks() for x in before.columns], np.array([k]), np.array([bs]), np.array([bc]))

    return dealt.mapInArrow(fold, out)


def _changes(columns: list) -> np.ndarray:
    """Whether each row begins a new key."""
    import pyarrow.compute as pc

    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for x in columns:
        if len(x) > 1:
            same = pc.fill_null(pc.equal(x.slice(1), x.slice(0, len(x) - 1)), False)
            both = pc.and_(pc.is_null(x.slice(1)), pc.is_null(x.slice(0, len(x) - 1)))
            new[1:] |= ~np.asarray(pc.or_(same, both).combine_chunks().to_numpy(zero_copy_only=False), bool)
    return new


# Pair steps: quadratic in the candidates of a block, so candidates are thinned and blocked first.


#: Candidates of a block whose pairs a step makes; a step with more is refused, as its result is their square.
MOST_IN_BLOCK = 20_000


def check_blocks(rows: DataFrame, block: str | None, most: int = MOST_IN_BLOCK) -> None:
    """Refuses rows of which a block has more than `most`: one counting job."""
    keys = [block] if block else []
    over = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).limit(1).collect()
    if over:
        raise ValueError(f"{over[0]['n']} candidates in a block; name a finer one, or raise the bound")


def _pairs(nodes: DataFrame, block: str | None, condition: Column) -> DataFrame:
    check_blocks(nodes, block)
    cols = ["atom_id", "tv_s", "tv_c"] + ([block] if block else [])
    a = nodes.select(*(F.col(c).alias(f"a_{c}") for c in cols))
    b = nodes.select(*(F.col(c).alias(f"b_{c}") for c in cols))
    on = (F.col(f"a_{block}") == F.col(f"b_{block}")) & condition if block else condition
    return a.join(b, on)


def _unlinked(pairs: DataFrame, edges: DataFrame, type_: str, symmetric: bool = True) -> DataFrame:
    """Pairs that no link of a type connects yet."""
    have = edges.where(F.col("link_type") == type_)
    if symmetric:
        have = have.select(F.least("src", "dst").alias("l"), F.greatest("src", "dst").alias("g")).distinct()
        return pairs.join(have, (F.least("a_atom_id", "b_atom_id") == F.col("l")) & (F.greatest("a_atom_id", "b_atom_id") == F.col("g")), "left_anti")
    return pairs.join(have.select("src", "dst").distinct(), (F.col("a_atom_id") == F.col("src")) & (F.col("b_atom_id") == F.col("dst")), "left_anti")


def _concluded(pairs: DataFrame, type_: str, rule: Callable[[TV, TV], TV]) -> DataFrame:
    tv = rule(TV.of("a_tv_s", "a_tv_c"), TV.of("b_tv_s", "b_tv_c"))
    return pairs.select(F.lit(type_).alias("link_type"), F.col("a_atom_id").alias("src"), F.col("b_atom_id").alias("dst"), tv.s.alias("tv_s"), tv.c.alias("tv_c"))


def conjunction_step(nodes: DataFrame, edges: DataFrame, least: float = 0.5, block: str | None = None) -> DataFrame:
    """And-links for pairs of strong nodes that have none; `block` names a column that a pair shares."""
    pairs = _pairs(nodes.where(F.col("tv_s") >= least), block, F.col("a_atom_id") < F.col("b_atom_id"))
    return _concluded(_unlinked(pairs, edges, "AndLink"), "AndLink", truth.conjunction)


def disjunction_step(nodes: DataFrame, edges: DataFrame, least: float = 0.3, block: str | None = None) -> DataFrame:
    pairs = _pairs(nodes.where(F.col("tv_s") >= least), block, F.col("a_atom_id") < F.col("b_atom_id"))
    return _concluded(_unlinked(pairs, edges, "OrLink"), "OrLink", truth.disjunction)


def similarity_step(nodes: DataFrame, edges: DataFrame, least: float = 0.5, block: str | None = None) -> DataFrame:
    """Similarity links for pairs of one type (and of one block, if a column is named) whose extensional similarity is enough."""
    known = nodes.where("tv_c > 0").withColumn("_kind", F.struct("type", *([block] if block else [])))
    pairs = _pairs(known, "_kind", F.col("a_atom_id") < F.col("b_atom_id"))
    return _concluded(_unlinked(pairs, edges, "SimilarityLink"), "SimilarityLink", truth.extensional_similarity).where(F.col("tv_s") >= least)


def implication_step(nodes: DataFrame, edges: DataFrame, antecedent: float = 0.5, least: float = 0.5, block: str | None = None) -> DataFrame:
    """Implications for ordered pairs: a strong antecedent, confidence on both sides."""
    pairs = _pairs(nodes.where("tv_c > 0"), block, (F.col("a_atom_id") != F.col("b_atom_id")) & (F.col("a_tv_s") >= antecedent))
    return _concluded(_unlinked(pairs, edges, "ImplicationLink", symmetric=False), "ImplicationLink", truth.implication).where(F.col("tv_s") >= least)


def fill(links_: DataFrame, nodes: DataFrame, rule: Callable[[TV, TV], TV]) -> DataFrame:
    """Binary links without confidence get the value that the rule gives their children."""
    a = nodes.select(F.col("atom_id").alias("src"), F.col("tv_s").alias("a_s"), F.col("tv_c").alias("a_c"))
    b = nodes.select(F.col("atom_id").alias("dst"), F.col("tv_s").alias("b_s"), F.col("tv_c").alias("b_c"))
    tv = rule(TV.of("a_s", "a_c"), TV.of("b_s", "b_c"))
    return links_.where("tv_c = 0").join(a, "src").join(b, "dst").select("link_type", "src", "dst", tv.s.alias("tv_s"), tv.c.alias("tv_c"))


def over_pairs(nodes: DataFrame, rule: Callable[[TV, TV], TV], block: str | None = None) -> DataFrame:
    """A rule over all unordered pairs of nodes (of a block): (src, dst, tv_s, tv_c)."""
    return _concluded(_pairs(nodes, block, F.col("a_atom_id") < F.col("b_atom_id")), "Link", rule).drop("link_type")


class Rule(Protocol):
    """An inference rule: what a working set of edges lets it conclude."""

    name: str

    def __call__(self, edges: DataFrame) -> DataFrame: ...


def deduction_rule(edges: DataFrame) -> DataFrame:
    return deduce(edges, edges)


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"deduction": deduction_rule, "induction": induction_step}


def apply_rules(edges: DataFrame, rules: Sequence[Callable[[DataFrame], DataFrame]] = (deduction_rule,), least: float = 0.1) -> DataFrame:
    """A single step: new conclusions of all rules, the best of each."""
    found = reduce(DataFrame.unionByName, [f(edges).select(EDGE) for f in rules])
    return best(found.where(F.col("tv_c") >= least)).join(edges, ["link_type", "src", "dst"], "left_anti").select(EDGE)


# Fixed points


def forward_chain(
    edges: DataFrame, iterations: int = 100, least: float = 0.1, cap: int | None = None, overwrite: bool = False, focus: DataFrame | None = None, rules: Sequence[Callable[[DataFrame], DataFrame]] = ()
) -> DataFrame:
    """Closure by deduction: conclusions (with `round`) of at least some confidence; asserted links stay.

    cap limits a round's conclusions (most confident first); focus (atom_id) limits premises to links between its atoms;
    rules are asked in every round for what they conclude from all that is known.
    """
    if focus is not None:
        for end in ("src", "dst"):
            edges = edges.join(focus.select(F.col("atom_id").alias(end)), end, "left_semi")
    known = cut(best(edges.select(EDGE)))
    delta, out = known, None
    for k in range(1, iterations + 1):
        found = deduce(delta, known) if k == 1 else deduce(delta, known).union(deduce(known, delta))
        found = reduce(DataFrame.unionByName, [found, *(f(known).select(EDGE) for f in rules)])
        fresh = best(found.where(F.col("tv_c") >= least))
        if not overwrite:
            fresh = fresh.join(known, ["link_type", "src", "dst"], "left_anti")
        else:
            fresh = fresh.join(known.select("link_type", "src", "dst", F.col("tv_c").alias("k_c")), ["link_type", "src", "dst"], "left").where("k_c IS NULL OR tv_c > k_c + 1e-9").drop("k_c")
        if cap is not None:
            fresh = fresh.orderBy(F.desc("tv_c"), "link_type", "src", "dst").limit(cap)
        fresh = cut(fresh.select(EDGE))
        if fresh.isEmpty():
            break
        rows = fresh.withColumn("round", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
        rest = known.join(fresh, ["link_type", "src", "dst"], "left_anti") if overwrite else known
        known, delta = cut(rest.select(EDGE).union(fresh)), fresh
    return out if out is not None else known.limit(0).withColumn("round", F.lit(0))


def chain(edges: DataFrame, nodes: DataFrame, iterations: int = 100, least: float = 0.1, rules: Sequence[Callable[[DataFrame], DataFrame]] = (), **limits) -> tuple[DataFrame, DataFrame]:
    """All default rules in every round: (conclusions, nodes with what abduction gave them).

    Deduction makes links; abduction gives an antecedent the best value that an
    observed consequent lends it, over the antecedent's own; induction counts
    instances and concludes no link (see `induction_by_predicate`).  A round's
    abduction observes the values of the round before; rounds end with the links'.
    """
    known, made = edges.select(EDGE), []
    for k in range(1, iterations + 1):
        lent = abduce(nodes, known).where(F.col("tv_c") >= least).select("atom_id", F.col("tv_s").alias("_s"), F.col("tv_c").alias("_c"))
        nodes = cut(nodes.join(lent, "atom_id", "left").withColumn("tv_s", F.coalesce("_s", "tv_s")).withColumn("tv_c", F.coalesce("_c", "tv_c")).drop("_s", "_c"))
        fresh = cut(forward_chain(known, 1, least, rules=rules, **limits).withColumn("round", F.lit(k)))
        if fresh.isEmpty():
            break
        made.append(fresh)
        known = cut(known.union(fresh.select(EDGE)))
    empty = known.limit(0).withColumn("round", F.lit(0))
    return reduce(DataFrame.unionByName, made, empty), nodes


def implication_chain(edges: DataFrame, depth: int = 3, least: float = 0.0) -> DataFrame:
    """Paths of 2 to `depth` implications with confidence, folded by deduction.

    Of several paths between two ends the shortest wins, then the most
    confident, then the first by name; existing implications stay.
    """
    base = edges.where((F.col("link_type") == "ImplicationLink") & (F.col("tv_c") > 0)).select("src", "dst", "tv_s", "tv_c")
    step = base.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("tv_s").alias("b_s"), F.col("tv_c").alias("b_c"))
    paths = base.withColumn("path", F.array("src", "dst"))
    done: DataFrame | None = None
    for _ in range(2, depth + 1):
        tv = truth.deduction(TV.of("tv_s", "tv_c"), TV.of("b_s", "b_c"))
        joined = paths.join(step, paths["dst"] == step["mid"]).where(~F.array_contains("path", F.col("end")))
        paths = joined.select("src", F.col("end").alias("dst"), tv.s.alias("tv_s"), tv.c.alias("tv_c"), F.concat("path", F.array("end")).alias("path"))
        done = paths if done is None else done.union(paths)
    if done is None:
        return base.limit(0).withColumn("hops", F.lit(0))
    rank = F.struct(F.size("path").alias("n"), (-F.col("tv_c")).alias("c"), F.array_join("path", ",").alias("p"), "tv_s", "tv_c")
    top = done.where(F.col("tv_c") >= least).groupBy("src", "dst").agg(F.min(rank).alias("t"))
    return top.join(base.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.col("t.tv_s").alias("tv_s"), F.col("t.tv_c").alias("tv_c"), (F.col("t.n") - 1).alias("hops"))


def middle_terms(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals A->C (link_type, src, dst): every B with A->B and B->C of the goal's type, with the deduced value."""
    g = goals.select("link_type", "src", "dst").distinct()
    a = edges.select("link_type", "src", F.col("dst").alias("mid"), F.col("tv_s").alias("a_s"), F.col("tv_c").alias("a_c"))
    b = edges.select("link_type", F.col("src").alias("mid"), "dst", F.col("tv_s").alias("b_s"), F.col("tv_c").alias("b_c"))
    tv = truth.deduction(TV.of("a_s", "a_c"), TV.of("b_s", "b_c"))
    return g.join(a, ["link_type", "src"]).join(b, ["link_type", "mid", "dst"]).select("link_type", "src", "dst", "mid", tv.s.alias("tv_s"), tv.c.alias("tv_c"))


PROOF = ["link_type", "src", "dst", "depth", "path", "rule", "tv_s", "tv_c"]


def prove(edges: DataFrame, goals: DataFrame, depth: int = 10, proofs: int = 5, rules: Sequence[Callable[[DataFrame, DataFrame], DataFrame]] = ()) -> DataFrame:
    """Backward chaining: proofs of goals (link_type, src, dst) as acyclic paths.

    (link_type, src, dst, depth, path, rule, tv_s, tv_c), at most `proofs` for each
    goal: shortest first, then the most confident, then by path.  A goal with a
    null end is a pattern: every link that matches it is a proof, most confident
    first.  A rule gets the goals and the edges and gives proofs of its own.

    A round goes on only to atoms from which the goal can still be reached in the
    steps that are left, and only for goals that lack proofs.
    """
    from pyspark.sql import Window

    asked = goals.select("link_type", "src", "dst").distinct()
    g = asked.where("src IS NOT NULL AND dst IS NOT NULL")
    near = _within(edges, g, depth)
    e = edges.select("link_type", F.col("src").alias("at"), F.col("dst").alias("to"), F.col("tv_s").alias("e_s"), F.col("tv_c").alias("e_c"))
    reach = near.select("link_type", "dst", F.col("node").alias("at"), "steps")
    first = e.withColumnRenamed("at", "src")
    front = g.join(first, ["link_type", "src"]).select("link_type", "src", "dst", F.array("src", "to").alias("path"), F.col("to").alias("at"), F.col("e_s").alias("tv_s"), F.col("e_c").alias("tv_c"))
    found: DataFrame | None = None
    for k in range(1, depth + 1):
        front = cut(front.join(reach.where(F.col("steps") <= depth - k), ["link_type", "dst", "at"], "left_semi"))
        if front.isEmpty():
            break
        hit = front.where("at = dst").withColumn("depth", F.lit(k))
        found = hit if found is None else found.unionByName(hit)
        if k == depth:
            break
        # Later proofs are longer, so a goal with enough of them is done.
        done = found.groupBy("link_type", "src", "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= proofs)
        tv = truth.deduction(TV.of("tv_s", "tv_c"), TV.of("e_s", "e_c"))
        open_ = front.where("at != dst").join(done, ["link_type", "src", "dst"], "left_anti").join(e, ["link_type", "at"]).where(~F.array_contains("path", F.col("to")))
        front = open_.select("link_type", "src", "dst", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"), tv.s.alias("tv_s"), tv.c.alias("tv_c"))
    if found is None:
        found = front.withColumn("depth", F.lit(0)).limit(0)
    rule = F.when(F.col("depth") == 1, "direct").otherwise("deduction")
    every = found.withColumn("rule", rule).select(PROOF).withColumn("_g", F.struct("src", "dst"))
    every = every.unionByName(_matched(edges, asked.where("src IS NULL OR dst IS NULL")))
    for f in rules:
        every = every.unionByName(f(asked, edges).select(PROOF).withColumn("_g", F.struct("src", "dst")))
    w = Window.partitionBy("link_type", "_g").orderBy("depth", F.desc("tv_c"), F.array_join("path", ","))
    return every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= proofs).select(PROOF)


def _within(edges: DataFrame, goals: DataFrame, depth: int) -> DataFrame:
    """(link_type, dst, node, steps): the least number of links, below `depth`, from a node to a goal's end."""
    back = edges.select("link_type", F.col("src").alias("node"), F.col("dst").alias("at")).distinct()
    front = goals.select("link_type", "dst").distinct().withColumn("node", F.col("dst"))
    near = cut(front.withColumn("steps", F.lit(0)))
    for k in range(1, depth):
        step = front.withColumnRenamed("node", "at").join(back, ["link_type", "at"]).select("link_type", "dst", "node").distinct()
        front = cut(step.join(near, ["link_type", "dst", "node"], "left_anti"))
        if front.isEmpty():
            break
        near = near.unionByName(front.withColumn("steps", F.lit(k)))
    return near


def _matched(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """Links that match goals with a null end, as proofs of one step; `_g` is the goal."""
    g = goals.select("link_type", F.col("src").alias("g_src"), F.col("dst").alias("g_dst"))
    part = [
        g.where("g_dst IS NULL AND g_src IS NOT NULL").join(edges.withColumn("g_src", F.col("src")), ["link_type", "g_src"]),
        g.where("g_src IS NULL AND g_dst IS NOT NULL").join(edges.withColumn("g_dst", F.col("dst")), ["link_type", "g_dst"]),
        g.where("g_src IS NULL AND g_dst IS NULL").join(edges, "link_type"),
    ]
    rows = reduce(DataFrame.unionByName, part)
    made = rows.select("link_type", "src", "dst", F.lit(1).alias("depth"), F.array("src", "dst").alias("path"), F.lit("match").alias("rule"), "tv_s", "tv_c", F.struct(F.col("g_src").alias("src"), F.col("g_dst").alias("dst")).alias("_g"))
    return made


def can_prove(edges: DataFrame, goals: DataFrame, depth: int = 10) -> DataFrame:
    """Ground goals with whether there is a proof, and the best proof's truth value (else the default)."""
    top = best_proof(prove(edges, goals, depth)).select("link_type", "src", "dst", "tv_s", "tv_c")
    rows = goals.select("link_type", "src", "dst").distinct().join(top, ["link_type", "src", "dst"], "left")
    s, c = truth.DEFAULT
    return rows.select("link_type", "src", "dst", F.col("tv_s").isNotNull().alias("proved"), F.coalesce("tv_s", F.lit(s)).alias("tv_s"), F.coalesce("tv_c", F.lit(c)).alias("tv_c"))


def best_proof(proofs: DataFrame) -> DataFrame:
    """The most confident proof of each goal; ties go to the shorter, then by path."""
    from pyspark.sql import Window

    w = Window.partitionBy("link_type", "src", "dst").orderBy(F.desc("tv_c"), "depth", F.array_join("path", ","))
    return proofs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def render(proofs: DataFrame) -> DataFrame:
    """Proofs as indented text: a line a step."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.concat(F.repeat(F.lit("  "), i), F.element_at("path", i), F.lit(" -> "), F.element_at("path", i + 1)))
    head = F.concat_ws(" ", "rule", "src", F.lit("->"), "dst")
    return proofs.withColumn("text", F.concat_ws("\n", head, F.array_join(steps, "\n")))


# Pipelines


class Pipeline:
    """Ordered steps on a working set of edges (and a table of nodes); each step maps edges to edges.

    `run` repeats the steps until nothing changes or `iterations` are done.
    Conclusions join the working set unless a link of the same ends is there.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges, self.nodes, self.steps, self.stats = edges.select(EDGE), nodes, [], []

    def add(self, name: str, step: Callable[[DataFrame], DataFrame], keep: bool = True) -> Pipeline:
        """keep: the step's rows join the working set; else they replace it."""
        self.steps.append((name, step, keep))
        return self

    def match_pattern(self, link_type: str) -> Pipeline:
        return self.add("pattern", lambda d: d.where(F.col("link_type") == link_type), keep=False)

    def filter(self, condition: Column) -> Pipeline:
        return self.add("filter", lambda d: d.where(condition), keep=False)

    def truth_threshold(self, s: float = 0.0, c: float = 0.0) -> Pipeline:
        return self.add("threshold", lambda d: d.where((F.col("tv_s") >= s) & (F.col("tv_c") >= c)), keep=False)

    def forward_chain(self, iterations: int = 3, least: float = 0.1) -> Pipeline:
        return self.add("forward chain", lambda d: forward_chain(d, iterations, least).select(EDGE))

    def backward_chain(self, goals: DataFrame, depth: int = 5) -> Pipeline:
        return self.add("backward chain", lambda d: best_proof(prove(d, goals, depth)), keep=False)

    def deduction(self, least: float = 0.0) -> Pipeline:
        return self.add("deduction", lambda d: deduction_step(d, least))

    def induction(self) -> Pipeline:
        return self.add("induction", induction_step)

    def _filled(self, name: str, type_: str, rule: Callable[[TV, TV], TV], step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """A step of pairs: links of its type without confidence get the rule's value, and missing ones are made."""

        def run(d: DataFrame) -> DataFrame:
            key = ["link_type", "src", "dst"]
            own = fill(d.where((F.col("link_type") == type_) & (F.col("tv_c") == 0)), self.nodes, rule).select(EDGE)
            made = step(d).select(EDGE).join(d, key, "left_anti").select(EDGE)
            return d.join(own, key, "left_anti").select(EDGE).unionByName(own).unionByName(made)

        return self.add(name, run, keep=False)

    def conjunction(self, least: float = 0.5, block: str | None = None) -> Pipeline:
        return self._filled("conjunction", "AndLink", truth.conjunction, lambda d: conjunction_step(self.nodes, d, least, block))

    def disjunction(self, least: float = 0.3, block: str | None = None) -> Pipeline:
        return self._filled("disjunction", "OrLink", truth.disjunction, lambda d: disjunction_step(self.nodes, d, least, block))

    def similarity(self, least: float = 0.5) -> Pipeline:
        return self._filled("similarity", "SimilarityLink", truth.extensional_similarity, lambda d: similarity_step(self.nodes, d, least))

    def implication(self, antecedent: float = 0.5, least: float = 0.5, block: str | None = None) -> Pipeline:
        return self._filled("implication", "ImplicationLink", truth.implication, lambda d: implication_step(self.nodes, d, antecedent, least, block))

    def implication_chain(self, depth: int = 3, least: float = 0.0) -> Pipeline:
        return self.add("implication chain", lambda d: implication_chain(d, depth, least).withColumn("link_type", F.lit("ImplicationLink")))

    def abduction(self, least: float = 0.7) -> Pipeline:
        """Changes the nodes' values, not the edges."""

        def step(d: DataFrame) -> DataFrame:
            new = abduction_step(self.nodes, d, least).select("atom_id", F.col("tv_s").alias("_s"), F.col("tv_c").alias("_c"))
            self.nodes = cut(self.nodes.join(new, "atom_id", "left").withColumn("tv_s", F.coalesce("_s", "tv_s")).withColumn("tv_c", F.coalesce("_c", "tv_c")).drop("_s", "_c"))
            return d

        return self.add("abduction", step, keep=False)

    def attention_boost(self, boost: Callable[[DataFrame], None]) -> Pipeline:
        """Hands the working set to a function that stimulates its atoms."""

        def step(d: DataFrame) -> DataFrame:
            boost(d)
            return d

        return self.add("attention", step, keep=False)

    def revision(self) -> Pipeline:
        return self.add("revision", lambda d: revise(d.withColumn("ord", F.struct("tv_c", "tv_s")), "link_type", "src", "dst").select(EDGE), keep=False)

    def custom(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return self.add(name, step, keep=False)

    def run(self, until_fixed: bool = False, iterations: int = 1) -> tuple[DataFrame, bool, int]:
        """(working set, converged, iterations done)."""
        now = cut(self.edges)
        size, k = self._size(now), 0
        for k in range(1, iterations + 1):
            before = size
            for name, step, keep in self.steps:
                made = step(now).select(EDGE)
                if keep:
                    made = now.union(made.join(now, ["link_type", "src", "dst"], "left_anti").select(EDGE))
                now = cut(made)
                self.stats.append((k, name, now.count()))
            size = self._size(now)
            if size == before:
                return now, True, k
            if not until_fixed:
                break
        return now, False, k

    @staticmethod
    def _size(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("link_type", "src", "dst", F.round("tv_s", 9), F.round("tv_c", 9)))).first())


def forward_pipeline(edges: DataFrame, link_type: str, least: float = 0.5, rounds: int = 3) -> Pipeline:
    """Links of a pattern, forward chaining, a strength."""
    return Pipeline(edges).match_pattern(link_type).forward_chain(rounds).truth_threshold(s=least)


def hypothesis_pipeline(edges: DataFrame, goals: DataFrame, least: float = 0.6, depth: int = 5) -> Pipeline:
    """Proofs of goals, then a confidence."""
    return Pipeline(edges).backward_chain(goals, depth).truth_threshold(c=least)


def pln_pipeline(edges: DataFrame, s: float = 0.0, c: float = 0.0) -> Pipeline:
    """Deduction, revision, threshold."""
    return Pipeline(edges).deduction(c).revision().truth_threshold(s, c)


def pln_full_pipeline(edges: DataFrame, nodes: DataFrame, s: float = 0.0, c: float = 0.0, least: float = 0.3, similar: float = 0.5, block: str | None = None) -> Pipeline:
    """Deduction, conjunction, disjunction, similarity, revision, threshold."""
    return Pipeline(edges, nodes).deduction(c).conjunction(least, block).disjunction(least, block).similarity(similar).revision().truth_threshold(s, c)


def pln_complete_pipeline(edges: DataFrame, nodes: DataFrame, s: float = 0.0, c: float = 0.0, least: float = 0.3, similar: float = 0.5, antecedent: float = 0.5, implied: float = 0.5, depth: int = 3, block: str | None = None) -> Pipeline:
    """The full pipeline with implications and their chains before revision."""
    p = Pipeline(edges, nodes).deduction(c).conjunction(least, block).disjunction(least, block).similarity(similar)
    return p.implication(antecedent, implied, block).implication_chain(depth, c).revision().truth_threshold(s, c)
