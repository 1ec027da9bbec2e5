"""The binary format, byte for byte: a header, then atoms with children before parents.

Header: magic, version (32 bits each), number of atoms (64).  An atom: type
(32), node flag (8); a node's name length (32), name, embedding flag (8), size
(32) and 32-bit floats; a link's arity (32) and children's places (64 each); then
a truth flag (8), strength and confidence, attention (32-bit floats).  All
little-endian.  A large space is many files, each made and parsed in a task:
every file holds its atoms and, again, all that they hold, and reading keeps an
atom once.  `serialise` makes one file of a space that fits in a driver.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.kb import KnowledgeBase
from graphloom.store import cut, ship

#: Fixed values.
MAGIC, FORMAT = 0x41545350, 1
#: Type numbers of the format, in order.
TYPES = (
    "Node", "Link", "ConceptNode", "PredicateNode", "VariableNode", "InheritanceLink", "ImplicationLink", "EvaluationLink", "ListLink",
    "OrderedLink", "UnorderedLink", "AndLink", "OrLink", "NotLink", "MemberLink", "SubsetLink", "ContextLink", "SequentialLink", "SimultaneousLink",
    "SimilarityLink", "ExecutionLink", "HebbianLink", "SymmetricHebbianLink", "AsymmetricHebbianLink", "InverseHebbianLink", "TypedVariableNode", "GlobNode",
)


def in_order(rows: list[dict]) -> list[dict]:
    """Nodes by id, then links after all their children."""
    known = {r["atom_id"]: r for r in rows}
    out = sorted((r for r in rows if r["is_node"]), key=lambda r: r["atom_id"])
    placed = {r["atom_id"] for r in out}
    for start in sorted(r["atom_id"] for r in rows if not r["is_node"]):
        todo = [start]
        while todo:
            at = todo[-1]
            missing = [c for c in known[at]["outgoing"] if c not in placed]
            if at in placed or not missing:
                todo.pop()
                if at not in placed:
                    placed.add(at)
                    out.append(known[at])
            else:
                todo += missing
    return out


def dumps(rows: list[dict]) -> bytes:
    rows = in_order(rows)
    place = {r["atom_id"]: k for k, r in enumerate(rows)}
    out = [struct.pack("<IIQ", MAGIC, FORMAT, len(rows))]
    for r in rows:
        out.append(struct.pack("<IB", TYPES.index(r["type"]), r["is_node"]))
        if r["is_node"]:
            name, vec = r["name"].encode(), r["embedding"]
            out += [struct.pack("<I", len(name)), name, struct.pack("<B", vec is not None)]
            if vec is not None:
                out.append(struct.pack(f"<I{len(vec)}f", len(vec), *vec))
        else:
            out.append(struct.pack(f"<I{len(r['outgoing'])}Q", len(r["outgoing"]), *(place[c] for c in r["outgoing"])))
        out.append(struct.pack("<B3f", 1, r["tv_s"], r["tv_c"], r["attention"]))
    return b"".join(out)


def loads(data: bytes) -> list[dict]:
    """Rows of atoms; ValueError for anything that isn't a whole, sound file."""
    at = 0

    def take(form: str):
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise ValueError("truncated")
        got = struct.unpack_from(form, data, at)
        at += size
        return got

    magic, version, n = take("<IIQ")
    if magic != MAGIC or version != FORMAT:
        raise ValueError("not this format")
    rows: list[dict] = []
    for _ in range(n):
        kind, is_node = take("<IB")
        if kind >= len(TYPES):
            raise ValueError("unknown type")
        row = {"type": TYPES[kind], "is_node": bool(is_node), "name": None, "outgoing": None, "arity": 0, "embedding": None}
        if is_node:
            (size,) = take("<I")
            row["name"] = take(f"<{size}s")[0].decode()
            if take("<B")[0]:
                (size,) = take("<I")
                row["embedding"] = list(take(f"<{size}f"))
            row["atom_id"] = schema.node_key(row["type"], row["name"])
        else:
            (size,) = take("<I")
            places = take(f"<{size}Q")
            if any(p >= len(rows) for p in places):
                raise ValueError("child out of bounds")
            row["outgoing"] = [rows[p]["atom_id"] for p in places]
            row["arity"], row["atom_id"] = size, schema.link_key(row["type"], row["outgoing"])
        row["tv_s"], row["tv_c"] = take("<2f") if take("<B")[0] else (1.0, 1.0)
        (row["attention"],) = take("<f")
        rows.append(row)
    return rows


def serialise(kb: KnowledgeBase) -> bytes:
    return dumps([r.asDict() for r in kb.atoms.collect()])


def deserialise(spark: SparkSession, data: bytes) -> KnowledgeBase:
    rows = loads(data)
    return KnowledgeBase(spark.createDataFrame([tuple(r[c] for c in schema.COLUMNS) for r in rows], schema.ATOMS))


def to_files(kb: KnowledgeBase, atoms_a_file: int = 100_000) -> DataFrame:
    """(file, content): the space as whole files of about so many atoms."""
    spark = kb.spark
    ship(spark)
    n = max(1, -(-kb.count() // atoms_a_file))
    held = kb.incidence().select(F.col("link_id").alias("atom_id"), "target_id").distinct()
    front = cut(kb.atoms.select("atom_id", F.pmod(F.xxhash64("atom_id"), F.lit(n)).cast("int").alias("file")))
    every = front
    while True:
        below = front.join(held, "atom_id").select(F.col("target_id").alias("atom_id"), "file").distinct()
        front = cut(below.join(every, ["atom_id", "file"], "left_anti"))
        if front.isEmpty():
            break
        every = every.unionByName(front)
    rows = every.join(kb.atoms, "atom_id")

    def made(part: pa.Table) -> pa.Table:
        return pa.table({"file": pa.array([part.column("file")[0].as_py()], pa.int32()), "content": pa.array([dumps(part.drop_columns(["file"]).to_pylist())], pa.binary())})

    return rows.groupBy("file").applyInArrow(made, "file int, content binary")


def from_files(files: DataFrame) -> KnowledgeBase:
    """The space of files (content), each parsed in its own task; an atom that several files hold counts once."""
    ship(files.sparkSession)

    def parse(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(loads(bytes(content)), columns=schema.COLUMNS)

    return KnowledgeBase(files.select("content").mapInPandas(parse, schema.ATOMS)).add()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of the binary files below a path."""
    return from_files(spark.read.format("binaryFile").load(path)).atoms
