"""Every query that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from graphloom.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name, tmp_path):
    QUERIES[name](spark, sf).write.parquet(f"{tmp_path}/out")
    got = f"read_parquet('{tmp_path}/out/*.parquet')"
    if name not in ORACLE_SQL:
        assert duck.execute(f"SELECT count(*) FROM {got}").fetchall()[0][0] > 0
        return
    duck.execute(f"CREATE OR REPLACE TABLE want AS {ORACLE_SQL[name]}")
    want = sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall())
    assert want == sorted(r[0] for r in duck.execute(f"DESCRIBE SELECT * FROM {got}").fetchall())
    cols = ", ".join(f'"{c}"' for c in want)
    a, b = f"SELECT {cols} FROM want", f"SELECT {cols} FROM {got}"
    assert duck.execute(f"({a} EXCEPT ALL {b}) UNION ALL ({b} EXCEPT ALL {a}) LIMIT 4").fetchall() == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["customer", "nation", "order", "part", "s", "c"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
