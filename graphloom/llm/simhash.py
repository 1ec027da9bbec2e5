"""Operator 5: SimHash near-duplicates by pivot distance tables.

A fingerprint has the majority bits of its shingles' hashes.  Equal fingerprints
are one class from then on.  Every class gets a table of Hamming distances to
reference fingerprints.  The references are of two sorts: a base and its
one-bit neighbours, grouped in families, and well-spread ones.

Two fingerprints that differ in at most d bits have, in at least one of the
families over any d bits fewer blocks, the same distances to all of the family's
references relative to the base; these distance patterns are the keys that meet
in a shuffle.  Within a key, pairs whose distances to any spread reference
differ by more than d are discarded (the triangle inequality), and survivors are
verified.  Only a spanning forest of the links leaves a task.  A key with more
classes than a task should hold goes another exact way: every fingerprint meets
its 65 neighbours at one bit or none, and links those that meet.

Defined cases: a null or wordless text has fingerprint zero, linked like any
other; rows with a null id get their class's component but don't name it (null
if no row of the component has an id); repeated rows repeat; extra columns are
not read; an empty table gives an empty result.  Whole texts are hashed.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import lower_words, map_rows, materialise, share_join, ship
from graphloom.llm.components import components

SHINGLE, SEED, LINK_BITS = 3, 42, 2
#: Classes of one key that a task compares; keys with more go by neighbours.
KEY_CLASSES = 16_384
#: A key's expected classes, from which more blocks are taken.
DENSE = 32
#: References that discard pairs.
SPREAD = 24
ONE = np.uint64(1)


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Unsigned XXH64 of each shingle; none for a text without words."""
    w = lower_words(text)
    if not w:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(k)))) if len(w) >= k else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `fp` to the id (or to the columns kept)."""
    kept = keep or []
    df = docs.select(docs[id_col].alias("doc_id"), *kept, docs[text_col].alias("_text"))

    def rows(batches):
        for b in batches:
            text = b.pop("_text")
            yield [*b.values(), [fingerprint(shingle_hashes(t)) for t in text]]

    return map_rows(df, df.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema, rows, 512)


@lru_cache(1)
def references() -> tuple[np.ndarray, np.ndarray]:
    """The base with its 64 one-bit neighbours, and the spread references: fixed for a fixed seed."""
    made = np.random.default_rng(SEED).integers(0, 2**64, SPREAD + 1, dtype=np.uint64)
    base = made[0]
    return np.concatenate([[base], base ^ (ONE << np.arange(64, dtype=np.uint64))]), made[1:]


def distances(fps: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The distance table: a row for each fingerprint, a column for each reference."""
    return np.bitwise_count(fps[:, None] ^ to[None, :]).astype(np.int8)


def families(classes: int, bits: int = LINK_BITS) -> list[np.ndarray]:
    """Groups of one-bit references (bit numbers) of which one is untouched by any `bits` changes.

    64 bits in b blocks leave b - bits whole; the more classes, the more blocks,
    so that a key's expected classes stay few.
    """
    for b in range(bits + 1, 12):
        blocks = np.array_split(np.arange(64), b)
        whole = [np.concatenate(c) for c in combinations(blocks, b - bits)]
        if classes / 2.0 ** min(map(len, whole)) <= DENSE:
            break
    return whole


def keys(fps: np.ndarray, group: list[np.ndarray]) -> list[np.ndarray]:
    """Each family's key: which of its references are nearer than the base."""
    table = distances(fps, references()[0])
    nearer = (table[:, 1:] < table[:, :1]).astype(np.uint64)
    return [(nearer[:, f] << f.astype(np.uint64)).sum(1, dtype=np.uint64) for f in group]


def survivors(table: np.ndarray, fps: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no reference discards and that are links."""
    for k in range(0, table.shape[1], 4):
        near = (np.abs(table[a, k : k + 4] - table[b, k : k + 4]) <= bits).all(1)
        a, b = a[near], b[near]
    linked = np.bitwise_count(fps[a] ^ fps[b]) <= bits
    return a[linked], b[linked]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, again := root[root]):
            root = again
    return root


def links_within(run: np.ndarray, fps: np.ndarray, bits: int = LINK_BITS, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of fingerprints in runs of equal keys (a run's number for each)."""
    table = distances(fps, references()[1])
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    size = np.diff(starts, append=len(run))
    left, right = [], []
    place, own = np.arange(len(run)) - np.repeat(starts, size), np.repeat(size, size)
    for s in range(1, min(small, int(size.max(initial=0)))):
        a = np.flatnonzero((own <= small) & (place + s < own))
        x, y = survivors(table, fps, a, a + s, bits)
        left.append(x), right.append(y)
    for lo, n in zip(starts[size > small], size[size > small]):
        rest = np.arange(lo, lo + n)
        while len(rest):
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                x, front = front[0], front[1:]
                _, y = survivors(table, fps, np.broadcast_to(x, len(rest)), rest, bits)
                if len(y):
                    left.append(np.full(len(y), x)), right.append(y)
                    front = np.concatenate([front, y])
                    rest = np.setdiff1d(rest, y, assume_unique=True)
    root = forest(len(run), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(run))
    out = np.flatnonzero(root != np.arange(len(run)))
    return out, root[out]


def links(classes: DataFrame, bits: int = LINK_BITS, key_classes: int = KEY_CLASSES) -> DataFrame:
    """(u, v): links between distinct fingerprints (`fp`) that connect all that are `bits` or fewer apart."""
    ship(classes.sparkSession)
    group = families(classes.count(), bits)

    def spread(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for f, key in enumerate(keys(fps, group)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), f, np.int32)), pa.array(key.view(np.int64)), b.column(0)], ["family", "key", "fp"])

    dealt = materialise(classes.select("fp").mapInArrow(spread, "family int, key long, fp long"), "pivot-keys")
    big = materialise(dealt.groupBy("family", "key").count().where(F.col("count") > key_classes), "big-keys")
    n_big = big.count()
    rest = dealt
    if n_big:
        rest = dealt.join(F.broadcast(big) if n_big <= 50_000 else big, ["family", "key"], "left_anti")

    def compare(batches):
        held: list[tuple] = []
        count = 0

        def run(parts, last):
            family, key, fps = (np.concatenate(x) for x in zip(*parts))
            change = np.ones(len(key), bool)
            change[1:] = (key[1:] != key[:-1]) | (family[1:] != family[:-1])
            end = len(key) if last else int(np.flatnonzero(change)[-1])
            a, b = links_within(np.cumsum(change)[:end] - 1, fps[:end].view(np.uint64), bits) if end else (np.empty(0, int), np.empty(0, int))
            tail = [(family[end:], key[end:], fps[end:])] if end < len(key) else []
            return pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], ["u", "v"]), tail

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
                count += batch.num_rows
            if count >= 100_000:
                out, held = run(held, False)
                count = sum(len(h[0]) for h in held)
                yield out
        if held:
            yield run(held, True)[0]

    found = rest.repartition("family", "key").sortWithinPartitions("family", "key").mapInArrow(compare, "u long, v long")
    if n_big:
        found = found.union(_by_neighbours(dealt.join(F.broadcast(big) if n_big <= 50_000 else big, ["family", "key"], "left_semi").select("fp").distinct(), bits))
    return found


def _by_neighbours(classes: DataFrame, bits: int) -> DataFrame:
    """Links through meeting points: two fingerprints within two bits share a neighbour at one bit or none.

    At most 65 fingerprints meet at a point, so no group grows with the data.
    """
    if bits != 2:
        raise ValueError("meeting points are for links of two bits")
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = classes.select("fp", F.explode(around).alias("point"))
    # At most 65 fingerprints a point, so this join has no hot key.
    least = met.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "v")
    return met.join(least, "point").select(F.col("fp").alias("u"), "v").where("u != v").distinct()


def component_ids(fps: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """(fp, component_id, n) of rows (doc_id, fp): the least id reachable from each fingerprint, and its rows."""
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "classes")
    roots = materialise(components(links(classes, bits)), "roots")
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return share_join(joined, least, ["root"], classes.count()).select("fp", "component_id", F.col("rows").alias("n"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = LINK_BITS) -> DataFrame:
    """Per document: its fingerprint and its component's least id."""
    fps = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialise(component_ids(fps, bits), "components")
    joined = share_join(fps, classes, ["fp"], fps.count())
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = LINK_BITS) -> DataFrame:
    """One document of each component, the one with the least id; columns as they were."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names)))).withColumn("_at", F.monotonically_increasing_id())
    i, t = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    # Written once, so that a row's number stays its own.
    rows = materialise(plain, "numbered")
    fps = materialise(fingerprints(rows, i, t, keep=["_at"]), "fingerprints")
    classes = materialise(component_ids(fps.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "fp"), bits), "components")
    member = share_join(fps, classes, ["fp"], fps.count())
    best = member.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_at"))["_at"].alias("_at")).select("_at")
    return rows.join(best.hint("shuffle_hash"), "_at", "left_semi").drop("_at").toDF(*names)
