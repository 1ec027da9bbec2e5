"""The knowledge base: an immutable bundle of DataFrames and what reads and grows it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schema


class KnowledgeBase:
    """Atoms, and tables about them.  Methods return DataFrames or a new base; nothing runs before an action.

    Atoms of a base have distinct ids: it is made of distinct atoms, or by `empty(spark).add(...)`.
    """

    def __init__(self, atoms: DataFrame, attention: DataFrame | None = None, temporal: DataFrame | None = None, atom_events: DataFrame | None = None):
        self.atoms = atoms
        self.attention, self.temporal, self.atom_events = attention, temporal, atom_events

    @classmethod
    def empty(cls, spark: SparkSession) -> KnowledgeBase:
        return cls(spark.createDataFrame([], schema.ATOMS))

    @property
    def spark(self) -> SparkSession:
        return self.atoms.sparkSession

    def replaced(self, atoms: DataFrame) -> KnowledgeBase:
        return KnowledgeBase(atoms, self.attention, self.temporal, self.atom_events)

    # Reading

    def by_type(self, type_: str) -> DataFrame:
        return self.atoms.where(F.col("type") == type_)

    def get(self, type_: str, name: str) -> DataFrame:
        """The node of a name: an equality on its id, pushed to the scan."""
        return self.atoms.where((F.col("type") == type_) & (F.col("atom_id") == schema.node_key(type_, name)))

    def count(self) -> int:
        return self.atoms.count()

    def clear(self) -> KnowledgeBase:
        return KnowledgeBase(self.atoms.limit(0))

    def incidence(self) -> DataFrame:
        """(link_id, link_type, arity, pos, target_id) of every link."""
        found = self.atoms.where(~F.col("is_node"))
        return found.select(F.col("atom_id").alias("link_id"), F.col("type").alias("link_type"), "arity", F.posexplode("outgoing").alias("pos", "target_id"))

    def incoming(self, atom_id: str | Column) -> DataFrame:
        """Links that hold an atom."""
        return self.incidence().where(F.col("target_id") == atom_id)

    @staticmethod
    def outgoing_atom(i: int | Column) -> Column:
        """The i-th child of a link, null out of bounds."""
        return F.get("outgoing", schema.as_column(i))

    def edges(self, *types: str) -> DataFrame:
        """Links of two children: (link_id, link_type, src, dst, tv_s, tv_c)."""
        found = self.atoms.where((F.col("arity") == 2) & ~F.col("is_node"))
        if types:
            found = found.where(F.col("type").isin(*types))
        return found.select(F.col("atom_id").alias("link_id"), F.col("type").alias("link_type"), F.col("outgoing")[0].alias("src"), F.col("outgoing")[1].alias("dst"), "tv_s", "tv_c")

    # Growing

    def add(self, *parts: DataFrame, overwrite: bool = False) -> KnowledgeBase:
        """Upsert by id: what is there stays; an embedding that comes later replaces an earlier one.

        overwrite=True lets later truth values win too.  Without parts, the
        base's own repeated atoms become one.  Of the base only ids travel.
        """
        if not parts:
            return self.replaced(_once([self.atoms], overwrite))
        new = _once(parts, overwrite)
        atoms = self.atoms
        # Empty where the parts have no embeddings: the optimizer then drops the join.
        later = new.where(F.col("embedding").isNotNull()).select("atom_id", F.col("embedding").alias("_e"))
        atoms = atoms.join(later, "atom_id", "left").withColumn("embedding", F.coalesce("_e", "embedding")).drop("_e")
        if overwrite:
            values = new.select("atom_id", F.struct("tv_s", "tv_c", "attention").alias("_v"))
            atoms = atoms.join(values, "atom_id", "left")
            atoms = atoms.select(*(F.coalesce(F.col("_v")[c], c).alias(c) if c in ("tv_s", "tv_c", "attention") else F.col(c) for c in schema.COLUMNS))
        fresh = new.join(self.atoms.select("atom_id"), "atom_id", "left_anti")
        return self.replaced(atoms.select(schema.COLUMNS).unionByName(fresh.select(schema.COLUMNS)))

    def remove(self, ids: DataFrame) -> KnowledgeBase:
        """Without the atoms named (atom_id), but for those that a link that stays holds."""
        gone = ids.select("atom_id").distinct()
        held = self.incidence().join(gone.withColumnRenamed("atom_id", "link_id"), "link_id", "left_anti").select(F.col("target_id").alias("atom_id"))
        return self.replaced(self.atoms.join(gone.join(held, "atom_id", "left_anti"), "atom_id", "left_anti"))

    def merge(self, other: KnowledgeBase) -> KnowledgeBase:
        return self.add(other.atoms)

    def with_truth(self, values: DataFrame) -> KnowledgeBase:
        """Truth values replaced by (atom_id, tv_s, tv_c)."""
        new = values.select("atom_id", F.col("tv_s").alias("_s"), F.col("tv_c").alias("_c"))
        rows = self.atoms.join(new, "atom_id", "left")
        return self.replaced(rows.withColumn("tv_s", F.coalesce("_s", "tv_s")).withColumn("tv_c", F.coalesce("_c", "tv_c")).select(schema.COLUMNS))

    def levels(self, most: int = 16) -> DataFrame:
        """(atom_id, level): children before parents; a node is 0, a link one above its highest child.

        A link that lacks a child, or is on a cycle, has no level, nor has what holds it.  Only distinct
        children travel to find those that are not there yet; links meet in a shuffle only if they hold one.
        """
        from graphloom.store import stored

        is_node = lambda x: schema.type_of(x).isin(*schema.NODE_TYPES)
        nodes, links = self.atoms.where("is_node").select("atom_id"), self.atoms.where("NOT is_node").select("atom_id", "outgoing")
        # Null is no atom's id, nor is the empty string.
        child = links.select("atom_id", F.explode("outgoing").alias("target")).withColumn("target", F.coalesce("target", F.lit("")))
        below, held = child.where(is_node(F.col("target"))), child.where(~is_node(F.col("target")))
        lost = stored(below.select("target").distinct().join(nodes.withColumnRenamed("atom_id", "target"), "target", "left_anti"), "lost")
        if not lost.isEmpty():
            bad = stored(below.join(lost, "target", "left_semi").select("atom_id").distinct(), "bad")
            links, held = links.join(bad, "atom_id", "left_anti"), held.join(bad, "atom_id", "left_anti")
        inner = F.exists("outgoing", lambda x: ~is_node(F.coalesce(x, F.lit(""))))
        first, above = links.where(~inner & (F.size("outgoing") > 0)).select("atom_id"), links.where(inner)
        key = schema.packed("atom_id").alias("key")
        held = held.select("atom_id", schema.packed("target").alias("key"))
        late = stored(held.select("key").distinct().join(first.select(key), "key", "left_anti"), "late")
        out, waiting = [nodes, first], above.select("atom_id")
        if late.isEmpty():
            out.append(waiting)
        else:
            # Incidences of links with a child that has no level yet.
            held = stored(held.join(late, "key", "left_semi"), "held")
            while len(out) < most:
                rest = stored(held.select("atom_id").distinct(), "waiting")
                new = stored(waiting.join(rest, "atom_id", "left_anti"), "level")
                if new.isEmpty():
                    break
                out.append(new)
                waiting, held = rest, stored(held.join(new.select(key), "key", "left_anti"), "held")
        return reduce(DataFrame.unionByName, [x.withColumn("level", F.lit(k)) for k, x in enumerate(out[:most])])


def _once(parts: Sequence[DataFrame], overwrite: bool) -> DataFrame:
    """One row an id, by one shuffle and sort: the first, with the last embedding (and truth values, if they overwrite)."""
    rows = reduce(DataFrame.unionByName, [p.select(schema.COLUMNS).withColumn("_n", F.lit(k)) for k, p in enumerate(parts)])
    order = Window.partitionBy("atom_id", "type").orderBy("_n")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = ["tv_s", "tv_c", "attention"] if overwrite else []
    rows = rows.withColumns({"_k": F.row_number().over(order), "embedding": F.last("embedding", ignorenulls=True).over(whole)} | {c: F.last(c).over(whole) for c in last})
    return rows.where("_k = 1").select(schema.COLUMNS)
