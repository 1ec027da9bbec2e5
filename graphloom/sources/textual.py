"""The line format: nodes, then links, each with its truth value and, if not zero, its attention.

    NODE:<type>:<name>:TV:<s>,<c>[:ATT:<a>]
    LINK:<type>:OUT:[<ref>,<ref>...]:TV:<s>,<c>[:ATT:<a>]

A reference is an atom's id; `%`, `:`, `,`, brackets and line ends in names are
written as %XX, so that names of any content come back.  Lines that begin with
`#` and blank lines are skipped.  Embeddings are not written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.kb import KnowledgeBase

#: Characters of the grammar, and what stands for them; the escape first.
ESCAPES = [("%", "%25"), (":", "%3A"), (",", "%2C"), ("[", "%5B"), ("]", "%5D"), ("\n", "%0A"), ("\r", "%0D"), ("#", "%23")]


def escaped(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def unescaped(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), c)


def lines(atoms: DataFrame) -> DataFrame:
    """(line): an atom each."""
    values = F.concat(F.lit(":TV:"), F.col("tv_s").cast("string"), F.lit(","), F.col("tv_c").cast("string"))
    attention = F.when(F.col("attention") != 0, F.concat(F.lit(":ATT:"), F.col("attention").cast("string"))).otherwise("")
    refs = F.array_join(F.transform("outgoing", escaped), ",")
    body = F.when(F.col("is_node"), F.concat(F.lit("NODE:"), "type", F.lit(":"), escaped(F.col("name")))).otherwise(F.concat(F.lit("LINK:"), "type", F.lit(":OUT:["), refs, F.lit("]")))
    return atoms.select(F.concat(body, values, attention).alias("line"))


def write(kb: KnowledgeBase, path: str) -> None:
    lines(kb.atoms).write.mode("overwrite").text(path)


def parse(rows: DataFrame, column: str = "value") -> DataFrame:
    """Atoms of lines."""
    c = F.col(column)
    kept = rows.where(~c.rlike(r"^\s*(#|$)"))
    part = lambda p, k=1: F.regexp_extract(c, p, k)
    node = c.startswith("NODE:")
    type_, name = part("^(?:NODE|LINK):([^:]*):"), unescaped(part("^NODE:[^:]*:([^:]*)"))
    inner = part(r":OUT:\[([^\]]*)\]")
    out = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), unescaped))
    number = lambda x, default: F.coalesce(x.try_cast("double"), F.lit(default))
    rows = kept.select(
        node.alias("is_node"),
        type_.alias("type"),
        F.when(node, name).alias("name"),
        F.when(~node, out).alias("outgoing"),
        number(part(":TV:([^,:]*),"), 1.0).alias("tv_s"),
        number(part(":TV:[^,:]*,([^:]*)"), 1.0).alias("tv_c"),
        number(part(":ATT:(.*)$"), 0.0).alias("attention"),
    )
    link = F.concat("type", F.lit("|"), F.substring(F.sha2(F.array_join("outgoing", ","), 256), 1, 32))
    return rows.select(
        F.when(F.col("is_node"), F.concat("type", F.lit("|"), "name")).otherwise(link).alias("atom_id"),
        "type", "is_node", "name", "outgoing", F.coalesce(F.size("outgoing"), F.lit(0)).alias("arity"),
        F.lit(None).cast("array<float>").alias("embedding"), "tv_s", "tv_c", "attention",
    ).withColumn("arity", F.greatest("arity", F.lit(0)))


def read(spark: SparkSession, path: str) -> KnowledgeBase:
    return KnowledgeBase(parse(spark.read.text(path)).select(schema.COLUMNS))


def pretty(kb: KnowledgeBase) -> DataFrame:
    """(atom_id, text): nested expressions, a child a line, two spaces in."""
    from graphloom.store import cut

    done = cut(kb.atoms.where("is_node").select("atom_id", F.concat(F.lit("("), "type", F.lit(' "'), "name", F.lit('")')).alias("text")))
    inc = kb.incidence()
    for _ in range(16):
        ready = inc.join(done.withColumnRenamed("atom_id", "target_id"), "target_id").join(done.select(F.col("atom_id").alias("link_id")), "link_id", "left_anti")
        parts = ready.groupBy("link_id", "link_type", "arity").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("cs")).where(F.size("cs") == F.col("arity"))
        text = F.concat(F.lit("("), "link_type", F.array_join(F.transform("cs", lambda x: F.concat(F.lit("\n  "), x["text"])), ""), F.lit(")"))
        new = cut(parts.select(F.col("link_id").alias("atom_id"), text.alias("text")))
        if new.isEmpty():
            break
        done = cut(done.unionByName(new))
    return done
