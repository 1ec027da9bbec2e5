"""Levels of nested spaces against a plain fixed point; what travels for them."""

from __future__ import annotations

import random

import pytest

from graphloom import schema
from graphloom.kb import KnowledgeBase
from graphloom.queries import QUERIES


def naive(atoms, most=16):
    """(id, children or None) -> levels, as rounds over all links."""
    level = {i: 0 for i, held in atoms if held is None}
    for k in range(1, most):
        new = {i: k for i, held in atoms if i not in level and held and all(c in level for c in held)}
        if not new:
            break
        level |= new
    return level


def space(seed):
    """Links over nodes and links up to some 20 deep; missing nodes and links, a cycle, an empty link, a null child, repeated children."""
    rng = random.Random(seed)
    atoms = [(f"ConceptNode|n{k}", None) for k in range(20)]
    ids = [i for i, _ in atoms]
    for k in range(120):
        held = [rng.choice(ids[-12:] if rng.random() < 0.7 else ids) for _ in range(rng.randrange(1, 4))]
        if k % 30 == 7:
            held.append("ConceptNode|none")
        if k % 30 == 9:
            held.append(schema.link_key("ListLink", ["none"]))
        link = rng.choice(["ListLink", "EvaluationLink", "AndLink"])
        i = schema.link_key(link, held) if k % 5 else f"{link}|short{k}"
        if i not in ids:
            atoms.append((i, held))
            if k % 30 not in (7, 9):
                ids.append(i)
    a, b = schema.link_key("ListLink", ["a"]), schema.link_key("ListLink", ["b"])
    return [*atoms, (a, [b]), (b, [a]), ("ListLink|empty", []), ("ListLink|null", [ids[0], None]), ("ListLink|over", [a, ids[0]])]


def kb_of(spark, atoms):
    rows = [(i, i.split("|")[0], held is None, i.split("|")[1], held, len(held or []), None, 1.0, 1.0, 0.0) for i, held in atoms]
    return KnowledgeBase(spark.createDataFrame(rows, schema.ATOMS))


@pytest.mark.parametrize("seed,most", [(1, 16), (2, 16), (3, 3), (4, 1)])
def test_levels(spark, seed, most):
    atoms = space(seed)
    rows = kb_of(spark, atoms).levels(most).collect()
    assert len(rows) == len({r["atom_id"] for r in rows})
    want = naive(atoms, most)
    assert {r["atom_id"]: r["level"] for r in rows} == want
    assert most < 16 or max(want.values()) > 4


def test_whole_spaces(spark):
    """Nodes alone, nothing at all, links that lack nothing."""
    nodes = [("ConceptNode|a", None), ("ConceptNode|b", None)]
    one = schema.link_key("ListLink", ["ConceptNode|a", "ConceptNode|b"])
    for atoms in ([], nodes, [*nodes, (one, ["ConceptNode|a", "ConceptNode|b"])], [*nodes, (one, ["ConceptNode|a", "ConceptNode|b"]), ("NotLink|n", [one])]):
        assert {r["atom_id"]: r["level"] for r in kb_of(spark, atoms).levels().collect()} == naive(atoms)


def test_packed_ids_are_one_to_one(spark):
    h = "0123456789abcdef" * 2
    ids = [f"ListLink|{h}", f"AndLink|{h}", f"ListLink|{h.upper()}", f"ListLink|{h}0", f"|{h}", h, "", "ConceptNode|a", f"ConceptNode|a|{h}", f"ConceptNode|a\n|{h}"]
    keys = [bytes(r[0]) for r in spark.createDataFrame([(i,) for i in ids], "i string").select(schema.packed("i")).collect()]
    assert len(set(keys)) == len(ids) and len(keys[0]) == 1 + len("ListLink") + 16


def test_levels_shuffle_few_bytes(spark, sf):
    """At most 60 bytes a link; the upsert and the joins of whole atoms took over 400."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    rows = QUERIES["s16_topological_levels"](spark, sf).collect()
    links = sum(r["n"] for r in rows if r["level"])
    assert 0 < written() - before < 60 * links
