"""Streams over files, batch by batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from graphloom import schema
from graphloom.kb import KnowledgeBase
from graphloom.plans.pattern import Var, concept, inheritance
from graphloom.streaming import cycles


def test_windows_and_sessions(spark, tmp_path):
    rows = [(f"u{k % 2}", dt.datetime(2024, 1, 1, h), float(k)) for k, h in enumerate((0, 0, 1, 5, 6))]
    df = spark.createDataFrame(rows, "user string, ts timestamp, value double")
    df.write.parquet(f"{tmp_path}/in")
    s = cycles.read(spark, f"{tmp_path}/in", df)
    assert cycles.drain(cycles.windowed(s, ["user"])).agg(F.sum("n")).first()[0] == 5
    assert cycles.drain(cycles.sessions(s, ["user"], "90 minutes")).count() == 4
    kept = cycles.drain(s.where("value > 1"), "append")
    assert kept.count() == 3


def test_state_grows_over_batches(spark, tmp_path):
    one = lambda a, x: spark.createDataFrame([(a, x)], "atom_id string, amount double").coalesce(1)
    for k in range(3):
        one("a", 10.0).write.mode("append").parquet(f"{tmp_path}/in")
    like = one("a", 1.0)
    s = cycles.read(spark, f"{tmp_path}/in", like, files_a_batch=1)
    bank = spark.createDataFrame([("a", 100.0, 0.0, 0.0)], "atom_id string, sti double, lti double, vlti double")
    a = cycles.AttentionStream(bank, f"{tmp_path}/bank", 0.5)
    q = a.start(s, availableNow=True)
    q.awaitTermination()
    assert a.bank.first()["sti"] == ((100 * 0.5 + 10) * 0.5 + 10) * 0.5 + 10
    out = cycles.running_sti(cycles.read(spark, f"{tmp_path}/in", like, files_a_batch=1))
    q = out.writeStream.outputMode("update").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("running").agg(F.max("sti"), F.max("n")).first() == (30.0, 3)


def test_standing_pattern(spark, tmp_path):
    one = spark.range(1).coalesce(1)
    atoms = schema.inheritance(one, F.lit("ConceptNode|a"), F.lit("ConceptNode|b"))
    for other in ("b", "c"):
        schema.inheritance(one, F.lit("ConceptNode|a"), F.lit(f"ConceptNode|{other}")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    q = cycles.standing_pattern(cycles.read(spark, f"{tmp_path}/in", atoms, files_a_batch=1), KnowledgeBase.empty(spark), inheritance(Var("x"), concept("b")), lambda d, k: seen.append(d.count()), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [0, 1]
