"""Operator 8: quality rules with host-level verdicts, in DataFrame functions alone.

Every document gets counts and rule points; failures are summed by host (the
`source` column), each host's failure rate is shrunk by a beta prior fitted to
all hosts' rates, and the host's standing sets how many points its documents may
have.  Only narrow rows are aggregated; hosts come back by a join that is
broadcast if the counted hosts are few.

Defined cases: a null text has no words; a null host is a host of its own; null
and repeated ids need no rule, as rows are judged one by one; an empty table
gives an empty result.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE, WORD, discard, materialise, sides

#: Least words, and percentages over which a rule gives a point.
MIN_WORDS = 50
REPEAT_PCT = 50
SYMBOLS = "#*$%&|<>"
RULES = {"symbol_pct": (10, 50), "dup_line_pct": (30, 60), "short_word": 25, "long_word": 120}
#: A host below the first rate is trusted, from the second on it is held strictly.
TRUSTED, STRICT = 0.2, 0.5
#: The prior's weight in documents lies between these.
WEIGHT = (2.0, 1000.0)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the list.

    Windows are sorted with their places; equal neighbours are repeats.  The
    places, again in order, cover min(3, gap) words each.
    """
    n = F.size(w) - 2
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("k"), i.alias("p")))

    def places(s: Column) -> Column:
        twin = lambda x, j: ((j > 0) & (F.get(s, j - 1)["k"] == x["k"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["k"] == x["k"]))
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["p"]))

    covered = lambda ps: F.aggregate(ps, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])
    none = F.lit(0).cast("long")
    some = let(windows, lambda v: F.when(F.size(F.array_distinct(v["k"])) == F.size(v), none).otherwise(let(F.sort_array(v), lambda s: let(places(s), covered))))
    return F.when(n < 2, none).otherwise(some)


def measures(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """The counts of a text, as columns."""
    text = F.coalesce(docs[text_col], F.lit(""))
    blank = "\t\n\x0b\x0c\r "
    counted = let(F.array_remove(F.split(text, f"{SPACE}+"), ""), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    length = F.length(text)
    return [
        counted.alias("w"),
        lines.alias("l"),
        F.length(F.translate(text, blank, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ]


FLAT = ["w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines"]


def points(strict: Column | None = None) -> Column:
    """Rule points of a document; strictly held hosts get half the percentages."""
    half = F.when(strict, F.lit(1)).otherwise(F.lit(2)) if strict is not None else F.lit(2)
    over = lambda part, whole, pct: (200 * F.col(part) > pct * half * F.col(whole)).cast("int")
    (s1, s2), (d1, d2) = RULES["symbol_pct"], RULES["dup_line_pct"]
    length = (10 * F.col("word_chars") < RULES["short_word"] * F.col("n_words")) | (10 * F.col("word_chars") > RULES["long_word"] * F.col("n_words"))
    return over("n_symbols", "n_words", s1) + over("n_symbols", "n_words", s2) + over("n_dup_lines", "n_lines", d1) + over("n_dup_lines", "n_lines", d2) + length.cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PCT * F.col("n_words"))


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: documents, failing documents and the failure rate shrunk by the fitted beta prior."""
    failed = (base_failed() | (points() > 0)).cast("long")
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(failed).alias("f"))
    rates = hosts.agg(F.avg(F.col("f") / F.col("n")).alias("m"), F.coalesce(F.var_pop(F.col("f") / F.col("n")), F.lit(0.0)).alias("v"))
    spread = F.col("m") * (1 - F.col("m"))
    weight = F.when(F.col("v") > 0, F.greatest(F.lit(WEIGHT[0]), F.least(F.lit(WEIGHT[1]), spread / F.col("v") - 1))).otherwise(F.lit(WEIGHT[1]))
    prior = rates.select("m", weight.alias("s"))
    # One row meets every host.
    return hosts.join(F.broadcast(prior)).select("host", "n", "f", ((F.col("f") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))).alias("host_rate"))


def judged(measured: DataFrame) -> DataFrame:
    """Adds host_rate, base_failed and kept to rows with the measures and a host; `measured` is read twice."""
    hosts = materialise(host_rates(measured), "hosts")
    n = hosts.count()
    h = hosts.select(F.col("host").alias("_host"), "host_rate")
    both = sides(measured, h, measured["host"].eqNullSafe(h["_host"]), "left", n).drop("_host")
    rate = F.col("host_rate")
    allowed = F.when(rate < TRUSTED, 2).otherwise(1)
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (points(rate >= STRICT) < allowed))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: id, measures, host rate and the verdict."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[host_col].alias("host"), *measures(docs, text_col))
    measured = materialise(rows.select("doc_id", "host", *FLAT), "measures")
    return judged(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", F.round("host_rate", 6).alias("host_rate"))


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own = dict(zip(docs.columns, names))
    rows = plain.select(F.struct(*names).alias("_row"), F.col(own[host_col]).alias("host"), *measures(plain, own[text_col]))
    measured = materialise(rows.select("_row", "host", *FLAT), "measured")
    out = judged(measured).where("kept").select("_row.*")
    return out.toDF(*docs.columns)


ORACLE = rf"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, host,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM t),
r AS (SELECT row_number() OVER () AS rid, *, len(w) AS n_words, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM m),
g AS (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM (SELECT rid, w, unnest(range(1, n_words - 1)) AS p FROM r WHERE n_words > 2)),
d AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
q AS (SELECT rid, count(DISTINCT p + o) AS n_repeat_words FROM d, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
a AS (SELECT r.doc_id, r.host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM r LEFT JOIN q ON r.rid = q.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words AS base_failed,
  (10 * word_chars < {RULES["short_word"]} * n_words OR 10 * word_chars > {RULES["long_word"]} * n_words)::INT AS odd FROM a),
h AS (SELECT host, count(*) AS n, sum((base_failed OR odd > 0 OR 100 * n_symbols > {RULES["symbol_pct"][0]} * n_words OR 100 * n_dup_lines > {RULES["dup_line_pct"][0]} * n_lines)::INT) AS f FROM b GROUP BY host),
pr AS (SELECT avg(f / n) AS m, coalesce(var_pop(f / n), 0) AS v FROM h),
ps AS (SELECT m, CASE WHEN v > 0 THEN greatest({WEIGHT[0]}, least({WEIGHT[1]}, m * (1 - m) / v - 1)) ELSE {WEIGHT[1]} END AS s FROM pr),
hr AS (SELECT host, (f + m * s) / (n + s) AS rate FROM h, ps),
j AS (SELECT b.*, rate, CASE WHEN rate >= {STRICT} THEN 1 ELSE 2 END AS half FROM b JOIN hr ON b.host IS NOT DISTINCT FROM hr.host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND odd
    + (200 * n_symbols > {RULES["symbol_pct"][0]} * half * n_words)::INT + (200 * n_symbols > {RULES["symbol_pct"][1]} * half * n_words)::INT
    + (200 * n_dup_lines > {RULES["dup_line_pct"][0]} * half * n_lines)::INT + (200 * n_dup_lines > {RULES["dup_line_pct"][1]} * half * n_lines)::INT
    < CASE WHEN rate < {TRUSTED} THEN 2 ELSE 1 END AS kept,
  n_lines, round(rate, 6) AS host_rate
FROM j
"""
