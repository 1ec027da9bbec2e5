"""The pipeline's stages against their operators' brute-force versions."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from graphloom.llm import packing, queries, secrets
from graphloom.llm.common import materialise
from test_copies import naive_kept
from test_operators import DOCS, ODD, naive_base, naive_quality, naive_spans, rows_of


def stages(spark, docs, sf):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf), name.replace(" ", "-")))
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    raw, good, single, cut, clean, packed = stages(spark, docs, sf)
    assert all(d.columns == docs.columns for d in (good, single, cut, clean))
    before, after = dict(rows_of(raw)), dict(rows_of(good))
    assert set(after) <= {i for i, t in before.items() if not naive_quality(t)[-1]}
    assert len(after) > 0.5 * sum(not naive_quality(t)[-1] for t in before.values())
    assert {i for i, _ in rows_of(single)} == naive_kept(list(after.items()))
    want = naive_spans(rows_of(single))
    assert dict(rows_of(cut)) == {i: t for (i, _), (t, n) in want.items() if not n or t.split()}
    masked = dict(rows_of(clean))
    assert masked == {i: secrets.redacted(t) for i, t in rows_of(cut)}
    assert not any(naive_base(t) for t in masked.values())
    assert any(naive_base(t) for t in before.values())
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect() if r["text"] != before[r["doc_id"]])
    assert {r["doc_id"] for r in packed.collect()} == set(masked)
    assert sorted(packed.columns) == sorted(packing.pack(clean, queries.tokenizer_path()).columns)
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_stages_on_odd_rows(spark, sf):
    """Rows of which quality keeps some: nulls, repeated and long texts, clashing columns."""
    prose = " ".join(f"word{k}" + "." * (k % 9 == 8) for k in range(120))
    rows = [(*r, "clash") for r in [*ODD, (20, prose, "en", "a", 7), (20, prose, "en", "a", 7), (None, prose, None, None, None), (21, prose + " token = aB3dE5gH7jK9mN2q", "en", "a", 1)]]
    odd = spark.createDataFrame(rows, DOCS + ", h string")
    raw, good, single, cut, clean, packed = stages(spark, odd, sf)
    assert all(d.columns == odd.columns for d in (good, single, cut, clean))
    before = rows_of(odd)
    assert Counter(rows_of(good)) <= Counter((i, t) for i, t in before if not naive_quality(t)[-1])
    assert [i for i, _ in rows_of(single)] == [20]
    assert rows_of(clean) == rows_of(cut) == [(20, prose)]
    assert {r["doc_id"] for r in packed.collect()} == {20}
    empty = stages(spark, odd.where("false"), sf)
    assert all(d.count() == 0 for d in empty) and all(d.columns == odd.columns for d in empty[:-1])
