"""Scenes: boxes with normalised coordinates (x, y, width, height) and what lies between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema

#: Fixed values.
NEAR, SURE = 0.2, 0.8


def centre(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / 2, y + h / 2


def area(w: Column, h: Column) -> Column:
    return w * h


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box structs; 0 if they don't meet or have no area."""
    g = lambda p, f: F.col(f"{p}.{f}")
    w = F.least(g(a, "x") + g(a, "width"), g(b, "x") + g(b, "width")) - F.greatest(g(a, "x"), g(b, "x"))
    h = F.least(g(a, "y") + g(a, "height"), g(b, "y") + g(b, "height")) - F.greatest(g(a, "y"), g(b, "y"))
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = g(a, "width") * g(a, "height") + g(b, "width") * g(b, "height") - inter
    return F.when((w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(inter / union)


def relation(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How a lies to b by centres; the words follow the sign of b less a."""
    dx, dy = bx - ax, by - ay
    return (
        F.when(F.sqrt(dx * dx + dy * dy) < NEAR, "near")
        .when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "right-of").otherwise("left-of"))
        .otherwise(F.when(dy > 0, "below").otherwise("above"))
    )


def relations(detections: DataFrame) -> DataFrame:
    """(scene_id, ord1, ord2, object1, relation, object2, confidence) of each pair of a scene's objects."""
    side = lambda n: detections.select("scene_id", F.col("ord").alias(f"ord{n}"), F.col("label").alias(f"object{n}"), *(c.alias(f"{k}{n}") for c, k in zip(centre(F.col("x"), F.col("y"), F.col("width"), F.col("height")), ("cx", "cy"))))
    pairs = side(1).join(side(2), "scene_id").where("ord1 < ord2")
    return pairs.select("scene_id", "ord1", "ord2", "object1", relation(F.col("cx1"), F.col("cy1"), F.col("cx2"), F.col("cy2")).alias("relation"), "object2", F.lit(SURE).alias("confidence"))


def scene_graph(detections: DataFrame, rels: DataFrame) -> DataFrame:
    """Atoms: objects at (their confidence, 0.9), relations as evaluations at (0.8, 0.8)."""
    best = detections.groupBy("label").agg(F.max("confidence").alias("confidence"))
    nodes = schema.nodes(best, "ConceptNode", F.col("label"), F.col("confidence"), 0.9)
    a, b = schema.node_id("ConceptNode", F.col("object1")), schema.node_id("ConceptNode", F.col("object2"))
    predicate = schema.node_id("PredicateNode", F.col("relation"))
    parts = [
        schema.nodes(rels, "PredicateNode", F.col("relation")),
        schema.links(rels, "ListLink", [a, b]),
        schema.links(rels, "EvaluationLink", [predicate, schema.link_id("ListLink", [a, b])], F.col("confidence"), SURE),
    ]
    for p in parts:
        nodes = nodes.unionByName(p)
    return nodes.dropDuplicates(["atom_id"])


def describe(detections: DataFrame, rels: DataFrame) -> DataFrame:
    """(scene_id, description): what a scene holds, then how its objects lie."""
    labels = F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: F.concat(F.lit("a "), x["label"]))
    things = detections.groupBy("scene_id").agg(labels.alias("ls"))
    n = F.size("ls")
    listed = F.when(n == 1, F.col("ls")[0]).otherwise(F.concat(F.array_join(F.slice("ls", 1, n - 1), ", "), F.lit(" and "), F.element_at("ls", -1)))
    said = rels.groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord1", "ord2", "object1", "relation", "object2"))), lambda x: F.concat(F.lit("The "), x["object1"], F.lit(" is "), x["relation"], F.lit(" the "), x["object2"], F.lit("."))), " ").alias("r"))
    return things.join(said, "scene_id", "left").select("scene_id", F.concat_ws(" ", F.concat(F.lit("The scene contains "), listed, F.lit(".")), F.col("r")).alias("description"))


def ground(detections: DataFrame, concepts: DataFrame) -> DataFrame:
    """Inheritance of objects to concepts (label, concept) at (confidence, 0.85)."""
    rows = detections.join(concepts, "label")
    return schema.links(rows, "InheritanceLink", [schema.node_id("ConceptNode", F.col("label")), schema.node_id("ConceptNode", F.col("concept"))], F.col("confidence"), 0.85).dropDuplicates(["atom_id"])


def frame_events(detections: DataFrame) -> DataFrame:
    """A log row for every object of every frame (scene_id is the frame's number)."""
    return detections.select(schema.node_id("ConceptNode", F.col("label")).alias("atom_id"), F.lit("event").alias("kind"), F.col("scene_id").alias("frame"), F.concat(F.lit("detected_frame_"), F.col("scene_id")).alias("description"))
