"""The cognitive cycle: modes, goals, learning, and one cycle over the tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import truth
from graphloom.functions.truth import TV
from graphloom.kb import KnowledgeBase
from graphloom.operators import attention, infer
from graphloom.plans.compiler import compile_pattern
from graphloom.plans.pattern import Link, Pattern, is_ground
from graphloom.store import cut


@dataclass(frozen=True)
class Mode:
    """What a mode sets: rounds of forward chaining, depth of proofs, the lti under which atoms are forgotten, goals a cycle."""

    iterations: int
    depth: int
    forget: float
    goals: int | None = 3


#: Presets of the cycle.
MODES = {
    "REACTIVE": Mode(1, 10, -100.0),
    "PROACTIVE": Mode(10, 10, 0.0),
    "GOAL_DIRECTED": Mode(3, 10, -50.0, None),
    "EXPLORATORY": Mode(5, 5, 10.0),
    "BALANCED": Mode(5, 7, 0.0),
}
GOAL_STIMULUS, LEARN_STIMULUS = 50.0, 100.0


def top_goals(goals: DataFrame, mode: str = "BALANCED") -> DataFrame:
    """Goals (atom_id, priority) by priority: the first three, all if goal-directed."""
    ordered = goals.orderBy(F.desc("priority"), "atom_id")
    n = MODES[mode].goals
    return ordered if n is None else ordered.limit(n)


def learned(examples: DataFrame) -> DataFrame:
    """(concept, positive): induction over each concept's examples, given to its first positive one."""
    counted = examples.groupBy("concept").agg(F.count_if("positive").alias("p"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("positive"), F.col("atom_id"))).alias("atom_id")).where("atom_id IS NOT NULL")
    tv = truth.induction("p", "n")
    return counted.select("concept", "atom_id", tv.s.alias("tv_s"), tv.c.alias("tv_c"), F.lit(LEARN_STIMULUS).alias("amount"))


def query_in_focus(kb: KnowledgeBase, p: Pattern, focus: DataFrame) -> DataFrame:
    """Matches whose bindings all lie in the focus (broadcast if it is no larger than the bank's own focus)."""
    held = focus.select("atom_id").distinct()
    if held.limit(attention.MAX_FOCUS + 1).count() <= attention.MAX_FOCUS:
        held = F.broadcast(held)
    rows = compile_pattern(kb.atoms, p)
    for v in p.variables():
        rows = rows.join(held.withColumnRenamed("atom_id", v), v, "left_semi")
    return rows


def answer(kb: KnowledgeBase, p: Pattern, focus: DataFrame, steps: int = 10) -> tuple[str, DataFrame]:
    """("match", bindings in the focus); without any, ("proof", proofs of the pattern, if it is a link of two ends)."""
    rows = query_in_focus(kb, p, focus)
    if not rows.isEmpty() or not (isinstance(p, Link) and len(p.outgoing) == 2):
        return "match", rows
    ends = [x.key() if is_ground(x) else None for x in p.outgoing]
    goal = kb.spark.createDataFrame([(p.type, *ends)], "link_type string, src string, dst string")
    return "proof", infer.prove(kb.edges(p.type), goal, steps)


def batch_inference(atoms: DataFrame, op: str) -> DataFrame:
    """A batch rule applied to every truth value with itself."""
    tv = truth.batch(op, TV.of("tv_s", "tv_c"), TV.of("tv_s", "tv_c"))
    return atoms.select("atom_id", tv.s.alias("tv_s"), tv.c.alias("tv_c"))


#: What an engine counts.
COUNTERS = ("cycles", "atoms_processed", "patterns_matched", "inferences", "attention_updates", "goals_proved", "new_atoms", "seconds")


@dataclass
class Engine:
    """State of a run of cycles; standing patterns are called with each cycle's matches in the focus.

    goals: (atom_id, priority) of links to prove.  `times` logs (atom_id, kind, cycle): conclusions are created, focused atoms accessed.
    """

    kb: KnowledgeBase
    bank: DataFrame
    hebbian: DataFrame
    goals: DataFrame | None = None
    mode: str = "BALANCED"
    patterns: dict[str, tuple[Pattern, Callable[[DataFrame], None]]] = field(default_factory=dict)
    cycles: int = 0
    stopped: bool = False
    times: DataFrame | None = None
    metrics: dict[str, float] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))

    def stop(self) -> None:
        self.stopped = True

    def register(self, name: str, p: Pattern, callback: Callable[[DataFrame], None]) -> None:
        self.patterns[name] = p, callback

    def cycle(self) -> DataFrame:
        """Attention, patterns on the focus, forward inference (not if reactive), proofs of goals, times; returns the conclusions."""
        m, begun = MODES[self.mode], time.time()
        self.cycles += 1
        if self.goals is not None:
            self.bank = attention.stimulate(self.bank, top_goals(self.goals, self.mode).select("atom_id", (F.col("priority") * GOAL_STIMULUS).alias("amount")))
        self.bank, self.hebbian = attention.cycle(self.bank, self.hebbian, self.cycles, m.forget)
        self.bank, self.hebbian = cut(self.bank), cut(self.hebbian)
        focus = cut(attention.focus(self.bank).select("atom_id"))
        matched = 0
        for p, callback in self.patterns.values():
            rows = cut(query_in_focus(self.kb, p, focus))
            matched += rows.count()
            callback(rows)
        found = self._infer(m, focus)
        proved = self._prove(m)
        self._log(focus, "accessed")
        new = found.count()
        for name, n in zip(COUNTERS, (1, self.kb.count(), matched, new + proved, 1, proved, new, time.time() - begun)):
            self.metrics[name] += n
        return found

    def _infer(self, m: Mode, focus: DataFrame) -> DataFrame:
        edges = self.kb.edges()
        if self.mode == "REACTIVE":
            return edges.select(infer.EDGE).limit(0).withColumn("round", F.lit(0))
        found = cut(infer.forward_chain(edges, m.iterations, focus=focus))
        made = schema.links_of(found)
        self._log(made.select("atom_id"), "created")
        self.kb = self.kb.replaced(cut(self.kb.add(made).atoms))
        return found

    def _prove(self, m: Mode) -> int:
        """Goals that are there, or links of two ends (link_type, src, dst) with a proof, are goals no longer."""
        if self.goals is None:
            return 0
        top = cut(top_goals(self.goals, self.mode))
        done = top.join(self.kb.atoms.select("atom_id"), "atom_id", "left_semi").select("atom_id")
        n = 0
        if "src" in top.columns:
            key = ["link_type", "src", "dst"]
            asked = cut(top.join(done, "atom_id", "left_anti").select("atom_id", *key))
            proofs = cut(infer.prove(self.kb.edges(), asked, m.depth).select(key))
            n = proofs.count()
            done = done.union(asked.join(proofs.distinct(), key).select("atom_id"))
        done = cut(done.distinct())
        self.goals = cut(self.goals.join(done, "atom_id", "left_anti"))
        return n + done.count()

    def _log(self, atoms: DataFrame, kind: str) -> None:
        rows = atoms.select("atom_id", F.lit(kind).alias("kind"), F.lit(self.cycles).alias("cycle"))
        self.times = cut(rows if self.times is None else self.times.unionByName(rows))

    def run(self, n: int) -> list[DataFrame]:
        out = []
        for _ in range(n):
            if self.stopped:
                break
            out.append(self.cycle())
        return out
