"""Each operator against a brute-force version, on the smallest tables and on odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, components, lm, packing, quality, queries, secrets, simhash, spans, toxicity, warc
from graphloom.llm.common import lower_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Word, another one here. " * 4000
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (None, "password = hunter2hunter2 and more words to come here", "en", "a", 3),
    (4, LONG, None, "b", len(LONG)),
    (5, "Ünïcode  \x1c straße\tÉé ﬁ 日本 <|endoftext|> x", "de", "b", 1),
    (5, "Ünïcode  \x1c straße\tÉé ﬁ 日本 <|endoftext|> x", "de", "b", 1),
    (7, "same text of some words", "en", "b", 1),
    (6, "same text of some words", "en", "b", 1),
    (8, "  \n\n\t ", "en", "c", 1),
    (9, "x", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("h", F.lit(1)).withColumn("fp", F.lit("clash")).withColumn("host", F.lit("clash"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- 1: secrets


def naive_base(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate((("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [s for _, _, s in sorted(out)]


def check_secrets(df):
    got = Counter((r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secrets.scan(df).collect())
    want = Counter()
    for i, t in rows_of(df):
        s = naive_base(t or "")
        n = Counter(x.split(":")[0] for x in s)
        want[(i, hashlib.sha256(",".join(s).encode()).hexdigest(), n["assign"], n["access"], n["hex"])] += 1
    assert got == want


def test_secrets_base(docs, odd, none):
    check_secrets(docs)
    check_secrets(odd)
    check_secrets(none)


@pytest.mark.parametrize(
    "text, secret",
    [
        ('db_pwd = "Xk92$lmQw0zz"', "Xk92$lmQw0zz"),
        ('K = "q8Zr71LmX0pTvv"\nclient.auth_key = K', "q8Zr71LmX0pTvv"),
        ("DB_CREDENTIAL=aB3$kk91xZ@q7\nother=1", "aB3$kk91xZ@q7"),
        ('a = "Zx81kQpL"\nb = a + "77Rt#mmQ"\nprivate_key: b', "77Rt#mmQ"),
        ("export V=9xKq72LmZp01Rt\nbearerAuth: ${V}", "9xKq72LmZp01Rt"),
        ('{"signingSecretKey": "p0Lk!82nnQzX"}', "p0Lk!82nnQzX"),
    ],
)
def test_secrets_lexed(text, secret):
    found = [text[s:e] for s, k, e in secrets.all_spans(text)[1]]
    assert secret in found
    assert secret not in secrets.redacted(text)


@pytest.mark.parametrize("text", ["password: changeme", "The secret: nothing at all.", "key = value", "passphrase = <your-passphrase>", "note: see a token of love", "auth = true"])
def test_secrets_clean(text):
    assert secrets.all_spans(text)[1] == []
    assert secrets.redacted(text) == text


# --- 2: language model


def check_lm(df):
    got = lm.score(df).collect()
    rows = rows_of(df)
    crc = lambda i: 0 if i is None else zlib.crc32(str(i).encode())
    counts = Counter()
    for i, t in rows:
        if crc(i) % 7 != 2:
            counts.update(lower_words(t) + [b""])
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for i, t in rows:
        tokens = lower_words(t) + [b""]
        want[i].append((crc(i) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)))
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == n
        assert any((r["held_out"], r["n_tokens"], r["n_known"]) == w[:3] and abs(r["base_score"] - w[3]) < 1e-6 * (1 - w[3]) for w in want[r["doc_id"]])
        assert math.isfinite(r["score"]) and r["score"] <= 1e-9
    return got


def test_lm(docs, odd, none, monkeypatch):
    got = check_lm(docs)
    held = [r for r in got if r["held_out"]]
    # The model beats the unigram base on texts that it hasn't learned from.
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    check_lm(odd)
    assert lm.score(none).count() == 0


def test_lm_rare_words(docs, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 64)
    check_lm(docs)


def test_lm_is_a_distribution(spark, docs):
    """Over units after any context, and within a bucket over its known words and one unknown word."""
    table, counts, weights = lm.train(docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5 == 0).alias("held_out"), F.col("text").cast("binary").alias("text")))
    c, w = counts.value, weights.value.astype(np.float32)
    assert np.abs(w).max() > 0.1
    assert sorted(c.place.tolist()) == list(range(lm.UNITS))
    t = lm.tokens([r["text"] for r in docs.where("doc_id < 3").select(F.col("text").cast("binary").alias("text")).collect()], c.seed)
    f = lm.contexts(t)
    for k in (0, 1, 7, 30):
        p = np.exp(lm.log_units(w, c, np.repeat(f[:, k : k + 1], lm.UNITS, 1), np.arange(lm.UNITS)))
        assert abs(p.sum() - 1) < 1e-4 and p.min() > 0
    rows = table.where("c > 0").collect()
    alone = {int(h) for h, u in zip(c.head.keys[c.head.keys != 0].view(np.int64) ^ lm.FLIP.view(np.int64), c.head_unit[c.head.values[c.head.keys != 0]]) if u >= 0}
    inside = defaultdict(float)
    for r in rows:
        if r["h"] not in alone:
            inside[r["e"]] += (r["c"] + 1) / 10 ** c.within[lm.ALONE + r["e"]]
    assert inside and all(abs(x + 1 / 10 ** c.within[lm.ALONE + e] - 1) < 1e-9 for e, x in inside.items())


def test_lm_gain(spark):
    """On texts that it hasn't learned from, 0.28 in log10 a token over the base."""
    r = lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg(((F.sum("score") - F.sum("base_score")) / F.sum("n_tokens")).alias("gain")).first()
    assert r["gain"] >= 0.28


# --- 3: WARC


def test_warc(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    more = spark.createDataFrame([(100001, "u", "same"), (100000, "u", "same"), (100002, None, "same"), (100003, "u", None), (100004, "u\r\nX: 1", ""), (None, "u", "same"), (None, "u", "alone"), (100005, "é", "\x00é\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string")
    df = pages.select("page_id", "url", "html").union(more)
    got = {(r["page_id"], r["payload_digest"]): (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    least = {}
    for i, p in rows:
        if i is not None:
            least[p] = min(i, least.get(p, i))
    want = {}
    for i, p in rows:
        first = least.get(p)
        again = first is not None and i != first
        want[i, base64.b32encode(hashlib.sha1(p).digest()).decode()] = (len(p), "revisit" if again else "response", first if again else None)
    assert got == want
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k} é</p>" * k) for k in range(40)], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/w", archive_bytes=2000)
    back = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert {r["record_id"].split(":")[2]: bytes(r["payload"]).decode() for r in back} == {str(k): f"<p>{k} é</p>" * k for k in range(40)}
    files = list((tmp_path / "w").glob("archive=*/part-*"))
    assert len(files) > 4 and all(gzip.decompress(f.read_bytes()).count(b"WARC/1.1") >= 1 for f in files)


def test_warc_salvage():
    rng = random.Random(5)
    made = [warc.record(k, f"http://x/{k}", rng.randbytes(300), None, False) for k in range(30)]
    for packed in (made, [gzip.compress(r) for r in made]):
        for broken in (3, 7, 29):
            parts = list(packed)
            x = bytearray(parts[broken])
            x[len(x) // 2] ^= 0xFF
            parts[broken] = bytes(x)
            parts[12] = parts[12][: len(parts[12]) // 2]
            data = b"".join(parts)
            found = list(warc.salvage(data))
            whole = [f.fields["warc-record-id"].split(":")[2] for f in found if f.gap is None]
            assert whole == [str(k) for k in range(30) if k not in (broken, 12)]
            assert sum(f.length for f in found) == len(data)
    assert list(warc.salvage(b"")) == []
    assert [f.gap for f in warc.salvage(b"junk")] == ["no member or version line"]


# --- 4: toxicity


def test_toxicity(spark, odd, none):
    rng = random.Random(1)
    common = [f"w{k}" for k in range(300)]
    bad = ["grizzlefop", "snarkwit", "blatherskite"]
    docs, labels = [], []
    for i in range(1500):
        w = rng.choices(common, k=rng.randint(20, 200))
        if toxic := rng.random() < 0.25:
            w[rng.randrange(len(w))] = rng.choice(bad)
            w[rng.randrange(len(w))] = rng.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    lab = spark.createDataFrame([(1, 1), (4, 0), (5, 0), (5, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd, lab).count() == len(ODD)
    assert toxicity.score(odd, lab.where("false")).count() == len(ODD)
    assert toxicity.score(none, lab).count() == 0


def test_toxicity_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = toxicity.score(d, lab).join(lab, "doc_id").where("held_out").selectExpr("avg(int(predicted = toxic)) a", "sum(int(predicted = 1 and toxic = 1)) / sum(toxic) r", "sum(int(predicted = 1 and toxic = 1)) / sum(predicted) p").first()
    assert r["a"] > 0.97 and r["r"] > 0.85 and r["p"] > 0.85, r


# --- 5: near-duplicates


def naive_fingerprint(text):
    w = (text or "").translate({k: k + 32 for k in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fps):
    """{fingerprint: its component} by comparing all pairs."""
    left, out = set(fps), {}
    while left:
        front, own = [left.pop()], set()
        while front:
            x = front.pop()
            own.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            front += near
        for x in own:
            out[x] = frozenset(own)
    return out


def check_simhash(df):
    rows = [(i, naive_fingerprint(t)) for i, t in rows_of(df)]
    comp = naive_components({f for _, f in rows})
    least = {}
    for i, f in rows:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = Counter((i, f"{f:016x}", least.get(comp[f])) for i, f in rows)
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want


def test_simhash(docs, odd, none):
    check_simhash(docs)
    check_simhash(odd)
    check_simhash(none)


def planted(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        out.append(x)
        for _ in range(rng.choice([0, 0, 3, 40])):
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return list(set(out))


@pytest.mark.parametrize("key_classes, classes", [(simhash.KEY_CLASSES, 0), (4, 0), (simhash.KEY_CLASSES, 1 << 30), (simhash.KEY_CLASSES, 1 << 40)])
def test_simhash_links(spark, monkeypatch, key_classes, classes):
    """Dense clusters; keys with too many classes; the families that larger inputs take."""
    fps = planted()
    if classes:
        group = simhash.families(classes)
        assert len(group) > 3
        monkeypatch.setattr(simhash, "families", lambda *_: group)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = components.components(simhash.links(df, key_classes=key_classes))
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found.collect()}
    want = naive_components(fps)
    sets = defaultdict(set)
    for x in fps:
        sets[root.get(x, x)].add(x)
    assert {frozenset(s) for s in sets.values()} == set(want.values())


def test_simhash_large_run():
    fps = np.array(planted(600, 9), np.uint64)
    a, b = simhash.links_within(np.zeros(len(fps), int), fps)
    root = simhash.forest(len(fps), a, b)
    want = naive_components([int(x) for x in fps])
    sets = defaultdict(set)
    for x, r in zip(fps.tolist(), root.tolist()):
        sets[r].add(x)
    assert {frozenset(s) for s in sets.values()} == set(want.values())


def test_simhash_keeps_one_of_each(docs, odd):
    for df in (docs, odd):
        kept = simhash.deduplicated(df)
        assert kept.columns == df.columns
        all_rows = simhash.near_duplicates(df).collect()
        assert kept.count() == len({r["component_id"] for r in all_rows})
        assert {r["doc_id"] for r in kept.collect()} >= {r["component_id"] for r in all_rows} - {None}


# --- 6 and 10: tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def check_packing(df, library):
    pieces = defaultdict(list)
    got = packing.pack(df, queries.tokenizer_path(), with_ids=True)
    seqs = {r["sequence_id"]: r for r in packing.sequences(got).collect()}
    got = got.collect()
    for r in got:
        pieces[r["doc_id"]].append(r)
    want = defaultdict(Counter)
    n = 0
    for i, t in rows_of(df):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want[i][np.array(ids, "<u4").tobytes()] += 1
        n += len(ids)
    assert sum(r["length"] for r in got) == n
    at = 0
    for k, s in sorted(seqs.items()):
        assert k == at and s["n_tokens"] == min(2048, n - 2048 * k) and len(s["ids"]) == 4 * s["n_tokens"]
        at += 1
    flat = b"".join(bytes(seqs[k]["ids"]) for k in sorted(seqs))
    assert len(flat) == 4 * n
    for i, rs in pieces.items():
        found, now = Counter(), b""
        for r in sorted(rs, key=lambda r: (r["sequence_id"], r["offset"])):
            g = 4 * (r["sequence_id"] * 2048 + r["offset"])
            b = flat[g : g + 4 * r["length"]]
            assert zlib.crc32(b) == r["ids_crc32"] and r["start"] == len(now) // 4
            now += b
            if len(now) == 4 * r["doc_tokens"]:
                found[now] += 1
                now = b""
        assert not now and found == want[i]


def test_packing(docs, odd, none, library):
    check_packing(docs, library)
    check_packing(odd, library)
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def check_bpe(df, library):
    want = Counter()
    for i, t in rows_of(df):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digest(df, queries.tokenizer_path()).collect()) == want


def test_bpe(docs, odd, none, library):
    check_bpe(docs, library)
    check_bpe(odd, library)
    check_bpe(none, library)
    got = bpe.encode(odd, queries.tokenizer_path()).collect()
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in got)


def test_bpe_random_text(library):
    model = bpe.model(Path(queries.tokenizer_path()).read_text())
    rng = random.Random(2)
    alphabet = "abcdefgh AB'stre  \n\t.,!?1²½éÉÅßÀÁσςΣİıſK日😀\x1c\x1f\x85\xa0​ﬁ"
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) if rng.random() < 0.97 else rng.choice(["<|endoftext|>", "aaaaaaa", "'s"]) for _ in range(rng.randint(0, 60)))
        assert model.encode(s) == library.encode(s, add_special_tokens=False).ids, s
    for _ in range(500):
        s = "".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(20))
        assert model.encode(s) == library.encode(s, add_special_tokens=False).ids, ascii(s)


def test_bpe_one_merge_a_round(library):
    model = bpe.Bpe(Path(queries.tokenizer_path()).read_text())
    model.ordered = False
    for s in ("aaaaaaaaa hello tokenization", "thethethe inininin"):
        assert model.encode(s) == library.encode(s, add_special_tokens=False).ids


# --- 7: nearest neighbours


def naive_neighbours(rows, k=5):
    out = {}
    usable = {i: np.asarray(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(usable))
    m = np.stack([usable[i] for i in ids])
    u = m / np.sqrt((m * m).sum(1))[:, None]
    for q in ids[ids % 50 == 0]:
        s = u @ (usable[q] / np.sqrt((usable[q] ** 2).sum()))
        s[ids == q] = -9
        s = np.round(s, 12)
        out[q] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


@pytest.mark.parametrize("leaf", [ann.LOWER, 8])
def test_ann(spark, leaf):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 50 == 0, leaf=leaf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = naive_neighbours([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.9


def test_ann_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=4).tolist(), "x") for k in range(120)]
    rows += [(200 + k, [1.0, 0.0, 0.0, 0.0], "x") for k in range(300)]
    rows += [(600, None, "x"), (650, [0.0] * 4, "x"), (700, [1.0, None, 0.0, 0.0], "x"), (750, [float("nan"), 1.0, 1.0, 1.0], "x"), (800, [float("inf"), 1.0, 1.0, 1.0], "x"), (None, [1.0, 2.0, 3.0, 4.0], "x"), (850, [1.0, 2.0], "x"), (250, [1.0, 0.0, 0.0, 0.0], "x"), (900, [0.0, 0.0, 0.0, 2.0], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 50 == 0, leaf=10, recall=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100, 200, 250, 300, 350, 400, 450, 900}
    assert [(n, v) for n, v, _ in got[250]] == list(enumerate([200, 201, 202, 203, 204], 1))
    want = naive_neighbours([r[:2] for r in rows if r[0] != 850])
    assert {q: [v for _, v, _ in x] for q, x in got.items()} == want
    assert ann.search(df.where("vec_id in (650, 750)"), lambda i: i % 50 == 0).count() == 0


# --- 8: quality


def naive_quality(text):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    in_repeat = {i + o for i, g in enumerate(grams) if n[g] > 1 for o in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(in_repeat), len(w) < 50 or 100 * len(in_repeat) > 50 * len(w)


def test_quality(docs, odd, none):
    for df in (docs, odd, none):
        got = quality.verdicts(df).collect()
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        assert Counter(tuple(r[c] for c in names) for r in got) == Counter((i, *naive_quality(t)) for i, t in rows_of(df))
        assert not any(r["kept"] and r["base_failed"] for r in got)
        kept = quality.keep(df)
        assert kept.columns == df.columns
        assert kept.count() == sum(r["kept"] for r in got)


def test_quality_hosts(spark):
    good = "It was a fair day and nobody in the whole village had any reason to complain of it. " * 1
    fine = [" ".join(f"{x}{k}" for x in good.split() for k in (i, i + 1, i + 2, i + 3)) for i in range(60)]
    some = " ".join(f"word{k}" for k in range(60)) + " #" * 8
    rows = [(k, t, "good") for k, t in enumerate(fine)] + [(100, some, "good")]
    rows += [(200 + k, "bad", "poor") for k in range(60)] + [(300, some, "poor"), (301, fine[3], "poor")]
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(kept[k] for k in range(60)) and kept[100] and not kept[300] and kept[301]


def test_quality_plan_is_native(docs):
    plan = docs.select(*quality.measures(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 9: substring dedup


def naive_units(text, long=14, window=8):
    """Sentences; those of over `long` words cut at commas, and what is still long behind least hashes: on strings, word by word."""
    from graphloom.llm.pieces import batch

    words = [(m.start(), m.end(), m[0].lower() if m[0].isascii() else m[0].translate({k: k + 32 for k in range(65, 91)})) for m in re.finditer("[^\x20\x09-\x0d]+", text or "")]
    close = [w[:-1] if len(w) > 1 and w[-1] in "\"')]}" else w for _, _, w in words]
    gap = [text[a[1] : b[0]] for a, b in zip(words, words[1:])] + [""]

    def split(part, ends):
        out = [[]]
        for k in part:
            out[-1].append(k)
            if ends(k) and k != part[-1]:
                out.append([])
        return out

    def value(k):
        x = np.frombuffer(words[k][2].encode() + b" ", np.uint8)
        return int(batch(x, np.array([0]), np.array([len(x) - 1])).hashes[0])

    parts = []
    for s in split(list(range(len(words))), lambda k: close[k][-1] in ".!?" or "\n" in gap[k]) if words else []:
        for c in split(s, lambda k: close[k][-1] in ",;:") if len(s) > long else [s]:
            if len(c) > long:
                h = {k: value(k) for k in c}
                marks = {min(c[i : i + window], key=lambda k: (h[k], -k)) for i in range(len(c) - window + 1)}
                parts += split(c, lambda k: k in marks)
            else:
                parts.append(c)
    starts = [0] + [words[p[0]][0] for p in parts[1:]]
    return [(text[a:b], [words[k][2] for k in p]) for a, b, p in zip(starts, [*starts[1:], len(text or "")], parts)]


def naive_spans(rows, least=25):
    split = {(i, t): naive_units(t) for i, t in rows}
    where = defaultdict(list)
    for (i, t), ss in split.items():
        for a in range(len(ss)):
            n, b = 0, a
            while b < len(ss) and n < least:
                n += len(ss[b][1])
                b += 1
            if n >= least:
                where[" ".join(" ".join(w) for _, w in ss[a:b])].append((i is None, i or 0, xxh(t), a, b, i, t))
    cut = defaultdict(set)
    for found in where.values():
        for *_, a, b, i, t in sorted(found, key=lambda x: x[:4])[1:]:
            cut[i, t].update(range(a, b))
    return {k: (k[1] if not cut[k] else "".join(x for n, (x, _) in enumerate(ss) if n not in cut[k]), len(cut[k])) for k, ss in split.items()}


def test_sentences():
    cut = lambda t: [t.encode()[a:b].decode() for a, b in spans.sentences(t.encode())]
    assert cut("One two. Three?\nfour  \n\n five!six. ") == ["One two. ", "Three?\n", "four  \n\n ", "five!six. "]
    assert cut("") == [] and cut(" \n") == [] and cut("é") == ["é"]
    whole = 'The committee met on Tuesday, in the old town hall, to discuss the bridge. '
    assert cut(whole + 'She said "no." Then she left.') == [whole, 'She said "no." ', "Then she left."]
    clauses = ["The committee of the whole old town met on Tuesday, ", "in the old town hall behind the church, ", "to discuss the plans for a new bridge. "]
    assert cut("".join(clauses)) == clauses
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [" ".join([*rng.choices(words, k=a), passage, *rng.choices(words, k=20)]) for a in (3, 17, 40)]
    found = [set(h.tolist()) for h in spans.runs([t.encode() for t in texts])[0]]
    assert found[0] & found[1] & found[2]


def test_shared_passage_is_no_hot_key(spark, monkeypatch):
    """A third of all runs are one: the join that brings them back meets that key by broadcast."""
    from graphloom.llm import common

    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id) h")
    groups = rows.groupBy("h").count().withColumnRenamed("count", "n")
    joined = common.share_join(rows, groups.withColumn("g", F.col("n")), ["h"], 3000)
    assert joined.count() == 3000 and joined.where("g = 1001").count() == 1001
    monkeypatch.setattr(common, "HEAVY", 100)
    joined = common.share_join(rows.union(spark.createDataFrame([(1, None)], "id long, h long")), groups, ["h"], 3000, "left")
    assert joined.count() == 3001


def xxh(t):
    if t is None:
        return 42
    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_spans(spark, docs, odd, none):
    passage = "This passage is told by many documents. It has a good number of words in it, more than fifty by far. Each of them is told in the same order. Nothing in it differs from one document to the next! Does anyone ever read it to the very end? Nobody knows, but here it ends."
    more = [(100000 + k, f"Own beginning number {k} of a document. {passage} Own end {k}.", "en", "z", None) for k in range(5)]
    both = docs.union(spark.createDataFrame(more, DOCS))
    for df in (both, odd, none):
        got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in spans.digest(df).collect())
        want = naive_spans(rows_of(df))
        assert got == Counter((i, *want[i, t]) for i, t in rows_of(df))
    r = {r["doc_id"]: r for r in spans.digest(both).collect()}
    assert passage in r[100000]["text"] and all("told by many" not in r[100000 + k]["text"] and r[100000 + k]["first_doc_ids"] == [100000] for k in range(1, 5))
    kept = spans.deduplicated(odd)
    assert kept.columns == odd.columns


def test_pieces_are_the_tokenizers(library):
    """Cutting by bytes, hashes and a table that overflows give what the library gives."""
    from graphloom.llm.pieces import Pieces, bounds, numbered

    rng = random.Random(8)
    spaces = " \t\n\r\x0b\x0c\x85\xa0             　"
    letters = "abcÀéß¿«»日本語😀\x1c\x1d​﻿"
    texts = ["".join(rng.choice(spaces if rng.random() < 0.3 else letters) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["", " ", "y" * 5000, LONG]
    data = np.frombuffer(" ".join(texts).encode() + b" ", np.uint8)
    s, e = bounds(data)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == bpe.pieces(" ".join(texts))
    known: list[str] = []
    table = Pieces(64)

    def learn(new):
        begin = len(known)
        known.extend(new)
        return range(begin, len(known))

    for k in range(0, len(texts), 50):
        part = texts[k : k + 50]
        at, count = numbered([t.encode() for t in part], table, learn, known.clear)
        assert count.tolist() == [len(bpe.pieces(t)) for t in part]
        assert [known[a] for a in at.tolist()] == [p for t in part for p in bpe.pieces(t)]
    cache = packing._Cache(Path(queries.tokenizer_path()).read_text())
    ids, n = cache.encode([t.encode() for t in texts])
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
