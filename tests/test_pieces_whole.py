"""Word pieces of whole texts."""

from __future__ import annotations

from graphloom.functions import tokenizer
from graphloom.queries import QUERIES, _pieces
from pyspark.sql import functions as F


def test_word_pieces_are_counted_whole(spark, sf):
    piece = tokenizer.WordPiece(_pieces(spark, sf))
    want = {r["item_id"]: piece.encode(r["text"] or "", longest=None) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = QUERIES["x9_x10_word_piece"](spark, sf).collect()
    assert max(map(len, want.values())) > 64 and len(got) == len(want)
    for r in got:
        ids = want[r["item_id"]]
        assert r["n"] == len(ids)
        assert r["input_ids"][: len(ids)] == ids[:512] and sum(r["mask"]) == min(len(ids), 512)
        assert len(r["input_ids"]) == len(r["mask"]) == len(r["type_ids"]) == 512


def test_padding_cuts(spark):
    r = spark.range(1).select(tokenizer.padded(F.array(*(F.lit(k) for k in range(5))), 3).alias("p")).first()["p"]
    assert r["input_ids"] == [0, 1, 2] and r["mask"] == [1, 1, 1] and r["type_ids"] == [0, 0, 0]
