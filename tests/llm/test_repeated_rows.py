"""Nearest neighbours among rows whose ids repeat."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from graphloom.llm import ann


def test_rows_that_repeat_leave_room_for_others():
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(40, 6)), 6, axis=0)
    v[::6] += rng.normal(scale=0.01, size=(40, 6))
    ids = np.repeat(np.arange(40), 6)
    mix = rng.permutation(len(ids))
    ids, v = ids[mix], v[mix]
    q_id, q = np.array([0, 7, 99]), rng.normal(size=(3, 6))
    got = defaultdict(list)
    for a, b, s in zip(*ann.best(q_id, q, ids, v, 5)):
        got[int(q_id[a])].append((int(ids[b]), round(float(s), 12)))
    for i, x in zip(q_id.tolist(), q):
        top = {}
        for j, s in zip(ids.tolist(), ann.cosines(np.broadcast_to(x, v.shape), v).tolist()):
            if j != i:
                top[j] = max(top.get(j, -2), round(s, 12))
        assert got[i] == sorted(top.items(), key=lambda t: (-t[1], t[0]))[:5]


def test_search_over_rows_six_times(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(60)] * 6
    got = Counter(r["query_id"] for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 10 == 0, recall=1.0).collect())
    assert got == {k: 5 for k in range(0, 60, 10)}
