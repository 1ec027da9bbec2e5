"""Operator 7: nearest neighbours by a hierarchical k-means tree, best bin first.

The tree grows with the table, in two storeys.  The upper one is fitted on a
sample (the `sample` rows whose hashed ids are least) of unit vectors, with as
many leaves as make them hold about `UPPER` rows of the table; it is broadcast,
and the sample bounds its size.  Each of its leaves has a lower storey of its
own, fitted on all rows of that leaf in the task that holds them, down to leaves
of `LOWER` rows; it never leaves that task.  Leaves with more than `GROUP_ROWS`
rows - the sample would have to grow beyond about `sample` x 500 rows, or vectors
are nearly one - are split by hashed ids, and each part has its own lower storey.

A query walks the upper storey through a priority queue of nodes by distance to
their centres and goes to the first leaves that it takes out; in each of them it
walks the lower storey in the same way.  How many leaves are visited in each
storey is calibrated: for a bounded set of queries the true neighbours are found
by brute force over all rows, and visits widen to the cheapest pair of numbers
at which these queries reach the target recall.

Equal vectors are equally near, so of each distinct vector only the rows of the
k + 1 smallest ids can be among a query's k nearest; the others are queries
alone.  Scores are double-precision cosines of the original vectors.

Defined cases: null, zero, non-finite vectors, vectors with null components and
rows with a null id take no part, nor do vectors of another dimension than most;
ids that repeat count once, with the best score, and as a query with the least
vector; a query's own id is no neighbour of it; without usable rows the result
is empty.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import local, map_rows, materialise, ship

SAMPLE, BRANCH = 50_000, 8
#: Rows of the table in a leaf of the upper and of the lower storey, and least sample rows of an upper leaf.
UPPER, LOWER, LEAST = 4096, 64, 16
K, RECALL, CALIBRATION = 5, 0.97, 256
#: Rows and queries of one group.
GROUP_ROWS, GROUP_QUERIES = 8192, 2048
#: Scores this near count as equal until they are computed exactly.
SLACK = 1e-9


class Tree(NamedTuple):
    """Nodes' centres; the children of node n are the nodes first[n] .. first[n] + count[n]; leaf[n] is -1 inside."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    leaves: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector: down by the nearest child."""
        node = np.zeros(len(x), np.int64)
        out = np.zeros(len(x), np.int64)
        todo = np.arange(len(x))
        while len(todo):
            node_of = node[todo]
            done = self.leaf[node_of] >= 0
            out[todo[done]] = self.leaf[node_of[done]]
            todo = todo[~done]
            for n in np.unique(node[todo]):
                own = todo[node[todo] == n]
                c = self.centre[self.first[n] : self.first[n] + self.count[n]]
                node[own] = self.first[n] + np.argmax(x[own] @ c.T - (c * c).sum(1) / 2, axis=1)
        return out

    def visits(self, q: np.ndarray, most: int, filled: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first leaves that the queue gives, nearest bin first; more until they hold `need` rows."""
        heap, out, rows = [(0.0, 0)], [], 0
        while heap and (len(out) < most or rows < need):
            _, n = heapq.heappop(heap)
            if self.leaf[n] >= 0:
                out.append(int(self.leaf[n]))
                rows += filled[out[-1]] if filled is not None else 0
                continue
            lo, hi = self.first[n], self.first[n] + self.count[n]
            d = ((self.centre[lo:hi] - q) ** 2).sum(1)
            for k, x in enumerate(d.tolist()):
                heapq.heappush(heap, (x, int(lo + k)))
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cluster number of each vector; some clusters may stay empty."""
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centre.T - (centre * centre).sum(1) / 2, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return own


def fit(x: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = 7) -> Tree:
    """The tree of unit vectors, with at most `leaf` of them in a leaf if they can be told apart."""
    rng = np.random.default_rng(seed)
    members = [np.arange(len(x))]
    centre, first, count, leaves = [x.mean(0)], [0], [0], [-1]
    n, found = 0, 0
    while n < len(members):
        own = members[n]
        parts = []
        if len(own) > leaf:
            label = kmeans(x[own], min(branch, len(own)), rng)
            parts = [p for c in np.unique(label) if len(p := own[label == c])]
        if len(parts) > 1:
            first[n], count[n] = len(members), len(parts)
            for p in parts:
                members.append(p), centre.append(x[p].mean(0)), first.append(0), count.append(0), leaves.append(-1)
        else:
            leaves[n] = found
            found += 1
        n += 1
    return Tree(np.array(centre), np.array(first), np.array(count), np.array(leaves), found)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same for the same two vectors wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def best(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of these rows, each query's k nearest, an id once with its best score: (query's place, row's place, score)."""
    s = unit(q) @ unit(v).T
    s[q_id[:, None] == v_id[None, :]] = -np.inf
    by_id = np.argsort(v_id, kind="stable")
    first = np.flatnonzero(np.diff(v_id[by_id], prepend=v_id[by_id[:1]] - 1))
    of_id = s if len(first) == len(v_id) else np.maximum.reduceat(s[:, by_id], first, axis=1)
    least = np.partition(of_id, -k, axis=1)[:, -k] if of_id.shape[1] > k else np.full(len(s), -np.inf)
    rows, cols = np.nonzero((s >= (least - SLACK)[:, None]) & np.isfinite(s))
    score = np.concatenate([cosines(q[rows[i : i + 50_000]], v[cols[i : i + 50_000]]) for i in range(0, len(rows), 50_000)] or [np.empty(0)])
    if len(first) < len(v_id):
        order = np.lexsort((-score, v_id[cols], rows))
        rows, cols, score = rows[order], cols[order], score[order]
        once = np.ones(len(rows), bool)
        once[1:] = (rows[1:] != rows[:-1]) | (v_id[cols[1:]] != v_id[cols[:-1]])
        rows, cols, score = rows[once], cols[once], score[once]
    order = np.lexsort((v_id[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    begin = np.flatnonzero(np.diff(rows, prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(begin, np.diff(begin, append=len(rows)))
    near = rank < k
    return rows[near], cols[near], score[near]


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x): usable vectors as little-endian doubles."""
    sound = F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("v")).where(F.col("id").isNotNull()).where(sound)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    return map_rows(rows, "id long, x binary", lambda batches: ((b["id"], [np.asarray(v, "<f8").tobytes() for v in b["v"]]) for b in batches), 4096)


def matrix(x) -> np.ndarray:
    x = list(x)
    return np.frombuffer(b"".join(x), "<f8").reshape(len(x), -1)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a query has k rows from each group that it met."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def brute_force(queries: dict, rows: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries among all rows, block by block."""
    held = rows.sparkSession.sparkContext.broadcast((queries["id"], matrix(queries["x"])))

    def search(batches):
        q_id, q = held.value
        for b in batches:
            v_id, v = np.array(b["id"]), matrix(b["x"])
            r, c, s = best(q_id, q, v_id, v, k)
            yield q_id[r], v_id[c], s

    return _top(map_rows(rows, "query_id long, vec_id long, score double", search, 8192), k)


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Of each distinct vector, the rows of the k + 1 smallest ids; a map-side limit keeps common vectors from meeting in one task."""
    w = Window.partitionBy("x").orderBy("id")
    return rows.select("x", "id").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).select("id", "x")


class Storey:
    """The lower storey of a group of rows, which are put in the order of their ids first."""

    def __init__(self, v_id: np.ndarray, v: np.ndarray, leaf: int):
        order = np.argsort(v_id, kind="stable")
        self.id, self.v = v_id[order], v[order]
        u = unit(self.v)
        self.tree = fit(u, leaf)
        own = self.tree.place(u)
        self.rows = np.argsort(own, kind="stable")
        self.size = np.bincount(own, minlength=self.tree.leaves)
        self.begin = np.cumsum(self.size) - self.size
        self.leaf = own

    def search(self, q_id: np.ndarray, q: np.ndarray, visits: int, k: int):
        """(query's place, row's place, score, rows that the query met) of each query's k nearest in the leaves that it visits."""
        to = [self.tree.visits(x, visits, self.size, k + 1) for x in unit(q)]
        met = np.array([self.size[leaves].sum() for leaves in to])
        n = np.fromiter(map(len, to), np.int64, len(to))
        who, leaf = np.repeat(np.arange(len(to)), n), np.fromiter((x for leaves in to for x in leaves), np.int64, n.sum())
        order = np.argsort(leaf, kind="stable")
        who, leaf = who[order], leaf[order]
        begin = np.flatnonzero(np.diff(leaf, prepend=-1))
        found = []
        for lo, hi in zip(begin, [*begin[1:], len(leaf)]):
            rows, asked = self.rows[self.begin[leaf[lo]] :][: self.size[leaf[lo]]], who[lo:hi]
            if len(rows):
                a, b, s = best(q_id[asked], q[asked], self.id[rows], self.v[rows], k)
                found.append((asked[a], rows[b], s))
        a, b, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int),) * 2 + (np.empty(0),)
        # The k best of the group, an id once.
        order = np.lexsort((-s, self.id[b], a))
        a, b, s = a[order], b[order], s[order]
        once = np.ones(len(a), bool)
        once[1:] = (a[1:] != a[:-1]) | (self.id[b[1:]] != self.id[b[:-1]])
        a, b, s = a[once], b[once], s[once]
        order = np.lexsort((self.id[b], -s, a))
        a, b, s = a[order], b[order], s[order]
        near = np.arange(len(a)) - np.searchsorted(a, a) < k
        return a[near], b[near], s[near], met[a[near]]


def _rank_in(tree: Tree, q: np.ndarray, leaf: int) -> int:
    return tree.visits(q, tree.leaves).index(leaf) + 1


def calibrate(need: np.ndarray, recall: float) -> tuple[int, int]:
    """The cheapest numbers of upper and lower visits at which such a share of neighbours (upper rank, lower rank) is found."""
    chosen = (1, 1)
    least = None
    for upper in np.unique(need[:, 0]):
        lower = np.sort(need[need[:, 0] <= upper, 1])
        wanted = int(np.ceil(recall * len(need)))
        if wanted <= len(lower) and wanted and (least is None or upper * lower[wanted - 1] < least):
            least = upper * lower[wanted - 1]
            chosen = int(upper), int(lower[wanted - 1])
    return chosen


def meetings(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, recall: float = RECALL, sample: int = SAMPLE, leaf: int = LOWER, upper: int = UPPER) -> DataFrame:
    """(query_id, vec_id, score, leaf, r, met): what each query finds in each group, and how many rows of it the query met."""
    spark = df.sparkSession
    ship(spark)
    out = "query_id long, vec_id long, score double, leaf int, r long, met long"
    rows = materialise(vectors(df, id_col, vec_col), "vectors")
    distinct = materialise(candidates(rows, k), "candidates")
    total = distinct.count()
    least = local(distinct.orderBy(F.xxhash64("id"), "id", "x").limit(sample).select("x"))["x"]
    if not len(least):
        return spark.createDataFrame([], out)
    tree = fit(unit(matrix(least)), max(LEAST, -(-len(least) * upper // total)))
    held = spark.sparkContext.broadcast(tree)
    placed = materialise(map_rows(distinct, "id long, x binary, leaf int", lambda batches: ((b["id"], b["x"], held.value.place(unit(matrix(b["x"])))) for b in batches), 8192), "placed")
    # A number a leaf of the upper storey: a query goes on until its leaves hold enough rows besides itself.
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count_distinct("id").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    filled = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("nr"))
    grouped = placed.join(F.broadcast(filled), "leaf").withColumn("r", F.pmod(F.xxhash64("id"), F.col("nr").cast("long"))).select("leaf", "r", "id", "x")

    asked = materialise(rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("x").alias("x")), "queries")
    some = local(asked.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(CALIBRATION))
    up, down = calibrate(_needs(tree, some, distinct, grouped, k, leaf), recall) if len(some["id"]) else (1, 1)

    def walk(batches):
        for b in batches:
            yield b["id"], b["x"], [held.value.visits(q, up, sizes, k + 1) for q in unit(matrix(b["x"]))]

    visiting = map_rows(asked, "query_id long, q binary, leaves array<int>", walk, 1024)
    # A row a leaf: how many groups of rows and of queries it is dealt into.
    visited = visiting.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("int").alias("nq"))
    # As many rows as the upper storey has leaves, which the sample bounds.
    deal = F.broadcast(materialise(filled.join(visited, "leaf"), "deal"))
    deal_of = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    v = grouped.join(deal.select("leaf", "nq"), "leaf").withColumn("g", deal_of("nq")).select("leaf", "r", F.col("g").cast("long").alias("g"), "id", "x")
    q = visiting.select("query_id", "q", F.explode("leaves").alias("leaf")).join(deal, "leaf").withColumn("g", F.pmod(F.xxhash64("query_id"), F.col("nq").cast("long"))).withColumn("r", deal_of("nr")).select("leaf", F.col("r").cast("long").alias("r"), "g", "query_id", "q")

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score", "leaf", "r", "met"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())], names)
        own = Storey(left.column("id").to_numpy(), matrix(left.column("x").to_pylist()), leaf)
        q_id = right.column("query_id").to_numpy()
        a, b, s, met = own.search(q_id, matrix(right.column("q").to_pylist()), down, k)
        at, r = (x.as_py() for x in key[:2])
        return pa.table([q_id[a], own.id[b], s, np.full(len(a), at, np.int32), np.full(len(a), r), met], names)

    keys = ["leaf", "r", "g"]
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(meet, out)


def _needs(tree: Tree, queries: dict, rows: DataFrame, grouped: DataFrame, k: int, leaf: int) -> np.ndarray:
    """(upper rank, lower rank) of the leaves that hold the queries' true neighbours."""
    spark = rows.sparkSession
    true = brute_force(queries, rows, k).select("query_id", "vec_id")
    asked = F.broadcast(spark.createDataFrame(list(zip(queries["id"].tolist(), queries["x"])), "query_id long, q binary"))
    # At most CALIBRATION x k rows, so their groups are as few.
    right = materialise(true.join(grouped.withColumnRenamed("id", "vec_id"), "vec_id").join(asked, "query_id").select("leaf", "r", "query_id", "vec_id", "q"), "neighbours")
    left = grouped.join(F.broadcast(right.select("leaf", "r").distinct()), ["leaf", "r"], "left_semi")

    def rank(key, a: pa.Table, b: pa.Table) -> pa.Table:
        own = Storey(a.column("id").to_numpy(), matrix(a.column("x").to_pylist()), leaf)
        q = unit(matrix(b.column("q").to_pylist()))
        place = {i: int(x) for i, x in zip(own.id.tolist(), own.leaf)}
        lower = [_rank_in(own.tree, x, place[v]) for x, v in zip(q, b.column("vec_id").to_pylist())]
        return pa.table({"query_id": b.column("query_id"), "leaf": b.column("leaf"), "lower": pa.array(lower, pa.int32())})

    found = local(left.groupBy("leaf", "r").cogroup(right.groupBy("leaf", "r")).applyInArrow(rank, "query_id long, leaf int, lower int"))
    order = {i: {x: n for n, x in enumerate(tree.visits(v, tree.leaves), 1)} for i, v in zip(queries["id"].tolist(), unit(matrix(queries["x"])))}
    return np.array([(order[i][x], n) for i, x, n in zip(found["query_id"].tolist(), found["leaf"].tolist(), found["lower"].tolist())]).reshape(-1, 2)


def search(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, recall: float = RECALL, sample: int = SAMPLE, leaf: int = LOWER, upper: int = UPPER) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which is_query(id column) holds."""
    found = meetings(df, is_query, id_col, vec_col, k, recall, sample, leaf, upper)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
