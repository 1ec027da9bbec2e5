"""Times of atoms: an append-only log (atom_id, kind, ts, description) and what is read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("created", "accessed", "modified", "event")


def times(log: DataFrame) -> DataFrame:
    """Per atom: creation (the last recorded, which starts it anew), last access, last modification; null if never."""
    last = lambda k: F.max(F.when(F.col("kind") == k, F.col("ts"))).alias(f"{k}_at")
    return log.groupBy("atom_id").agg(last("created"), last("accessed"), last("modified"))


def between(table: DataFrame, column: str, low, high) -> DataFrame:
    """Atoms whose time lies between two, both included."""
    return table.where(F.col(column).between(F.lit(low), F.lit(high)))


def history(log: DataFrame, since_creation: bool = True) -> DataFrame:
    """Events of atoms in order, since their last creation."""
    events = log.where(F.col("kind") == "event")
    if since_creation:
        events = events.join(times(log).select("atom_id", "created_at"), "atom_id").where("created_at IS NULL OR ts >= created_at").drop("created_at")
    return events.select("atom_id", "ts", "description")
