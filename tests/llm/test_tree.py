"""The tree grows with the table: what a query meets doesn't; common vectors and repeated ids."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from graphloom.llm import ann
from pyspark.sql import functions as F
from test_operators import naive_neighbours


@pytest.fixture(scope="module")
def base():
    import pandas as pd

    return np.stack(pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet").embedding.to_list()).astype(float)


def perturbed(spark, base, n):
    rng = np.random.default_rng(5)
    x = base[rng.integers(0, len(base), n)] + rng.normal(scale=0.05, size=(n, base.shape[1]))
    path_rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(spark.sparkContext.parallelize(path_rows, 8), "vec_id long, embedding array<double>"), x


def measured(spark, base, n, queries=40):
    df, x = perturbed(spark, base, n)
    step = n // queries
    found = ann.meetings(df, lambda i: i % step == 0).cache()
    got = defaultdict(set)
    for r in ann._top(found, 5).collect():
        got[r["query_id"]].add(r["vec_id"])
    u = x / np.sqrt((x * x).sum(1))[:, None]
    hits = 0
    for q in got:
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    met = found.groupBy("query_id", "leaf", "r").agg(F.max("met").alias("met")).agg(F.sum("met")).first()[0]
    return hits / (5 * len(got)), met / len(got)


def test_rows_met_dont_grow_with_the_table(spark, base):
    small, large = measured(spark, base, 20_000), measured(spark, base, 200_000)
    assert small[0] >= 0.95 and large[0] >= 0.95, (small, large)
    assert large[1] <= 2 * small[1], (small, large)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 50 == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    want = naive_neighbours([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.95


def test_common_vectors_and_repeated_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(200)]
    rows += [(1000 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(2000)] + [(1000, [1.0, 0.0, 0.0, 0.0])] * 500
    rows += [(50, [0.0, 1.0, 0.0, 0.0]), (50, [0.0, 0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert ann.candidates(ann.vectors(df), 5).where("id >= 1000").count() == 6
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 50 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert len(got) == 4 + 40
    assert got[2000] == [1000, 1001, 1002, 1003, 1004] and got[1000] == [1001, 1002, 1003, 1004, 1005]
    assert all(len(x) == len(set(x)) == 5 for x in got.values())
    again = ann.search(df.repartition(2), lambda i: i % 50 == 0, recall=1.0).where("query_id = 50").orderBy("rank").collect()
    assert [r["vec_id"] for r in again] == got[50]
