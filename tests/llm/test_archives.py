"""Archives of many members, of large pages, and with damage inside members."""

from __future__ import annotations

import gzip
import random
import time

from graphloom.llm import warc
from pyspark.sql import functions as F


def test_reading_takes_time_in_proportion():
    rng = random.Random(2)
    made = [gzip.compress(warc.record(k, f"http://x/{k}", rng.randbytes(1200), None, False), 1) for k in range(8000)]

    def seconds(n):
        data, t = b"".join(made[:n]), time.time()
        assert sum(f.gap is None for f in warc.salvage(data)) == n
        return time.time() - t

    seconds(500)
    assert min(seconds(8000) for _ in range(3)) < 2.6 * min(seconds(4000) for _ in range(3))


def test_damage_is_searched_once():
    """False starts all over: members that fail, without a version line after them."""
    data = (warc.MAGIC + b"\x00" * 7 + b"\xff" * 40) * 20_000
    t = time.time()
    found = list(warc.salvage(data))
    assert time.time() - t < 10
    assert len(found) == 1 and found[0].length == len(data)


def test_gaps_inside_a_member_have_their_bytes():
    a, b, c = (warc.record(k, None, b"x" * 50, None, False) for k in range(3))
    broken = b.replace(b"x" * 50, b"y" * 50)
    data = gzip.compress(a + broken + c)
    found = list(warc.salvage(data))
    assert [f.fields.get("warc-record-id", "")[:12] for f in found if f.gap is None] == ["<urn:page:0:", "<urn:page:2:"]
    gap = next(f for f in found if f.gap)
    assert (gap.inner, gap.length) == (len(a), len(broken))


def test_large_pages_among_small_ones(spark, tmp_path):
    big = 12_000_000
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 16 == 3, F.repeat(F.concat(F.lit("é"), "id"), big)).otherwise(F.concat(F.lit("p"), "id")).alias("html")).coalesce(1)
    got = {r["page_id"]: r["payload_bytes"] for r in warc.round_trip(df.withColumn("archive", F.lit("clash")).withColumn("first", F.lit(1))).collect()}
    assert got == {i: (2 + len(str(i))) * big if i % 16 == 3 else 1 + len(str(i)) for i in range(40)}
    rng = random.Random(1)
    rows = [(k, "u", rng.randbytes(60_000 if k % 10 == 0 else 100).hex()) for k in range(100)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w", archive_bytes=50_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("archive=*/part-*")]
    assert len(sizes) == 11 and max(sizes) < 50_000 + 130_000


def test_lost_pages_are_reported(spark, monkeypatch):
    import pytest

    real = warc.gzip.compress
    monkeypatch.setattr(warc, "write", lambda pages, path, **_: spark.createDataFrame([(real(warc.record(1, None, b"a", None, False))[:-9].decode("latin-1"),)], "r string").write.option("encoding", "ISO-8859-1").text(path))
    with pytest.raises(RuntimeError, match="damaged"):
        warc.round_trip(spark.createDataFrame([(1, None, "a")], "page_id long, url string, html string"))
