"""Text in column expressions: ASCII rules that Spark, RE2 and byte-wise regexes read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
SENTENCE = r"[^.!?]+[.!?]+"
#: Word bounds that know ASCII letters alone.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
ENTITY = LEFT + r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*" + RIGHT
VERB = LEFT + r"[A-Za-z0-9_]*(?:ed|ing)" + RIGHT


def tokens(text: str | Column) -> Column:
    """Words and single marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def lemma(token: Column) -> Column:
    return F.translate(token, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def part_of_speech(token: Column) -> Column:
    """By shape: a single mark, then endings, else a noun."""
    n = F.length(token)
    return (
        F.when((n == 1) & ~token.rlike("[A-Za-z0-9]"), "PUNCT")
        .when((token.endswith("ed") & (n > 2)) | (token.endswith("ing") & (n > 3)), "VERB")
        .when(token.endswith("ly") & (n > 2), "ADV")
        .otherwise("NOUN")
    )


def normalise(text: str | Column) -> Column:
    """Lower-case letters, digits, white space, `-` and `_`; the rest goes."""
    return lemma(F.regexp_replace(text, r"[^A-Za-z0-9\s_-]", ""))


def sentences(text: str | Column) -> Column:
    """Sentences with their marks, trimmed; the whole text if none ends; what doesn't end is dropped."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(F.size(found) > 0, found).otherwise(F.array(c))


def entities(text: str | Column) -> Column:
    """Runs of capitalised words."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def entity_type(entity: Column) -> Column:
    return F.when(F.contains(entity, F.lit(" ")), "PERSON").otherwise("ENTITY")


def entity_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, text, type, start, end, confidence): entities with their places, in characters."""

    def step(a: Column, e: Column) -> Column:
        at = F.call_function("locate", e, F.col(text_col), a["at"])
        return F.struct((at + F.length(e)).alias("at"), F.concat(a["found"], F.array(F.struct(e.alias("text"), (at - 1).alias("start")))).alias("found"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,start:int>>").alias("found"))
    found = F.aggregate(entities(text_col), start, step, lambda a: a["found"])
    rows = docs.select(id_col, F.posexplode(found).alias("ord", "e"))
    return rows.select(id_col, "ord", F.col("e.text").alias("text"), entity_type(F.col("e.text")).alias("type"), F.col("e.start").alias("start"), (F.col("e.start") + F.length("e.text")).alias("end"), F.lit(0.8).alias("confidence"))


def verb(gap: Column) -> Column:
    """The first word of a gap that ends like a verb and has more than three letters, normalised; empty if none."""
    found = F.filter(F.regexp_extract_all(gap, F.lit(VERB), F.lit(0)), lambda w: F.length(w) > 3)
    return F.coalesce(normalise(F.get(found, F.lit(0))), F.lit(""))


def relation_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, subject, predicate, object, confidence): entity pairs of a text with a verb between them."""
    e = entity_table(docs, id_col, text_col)
    a = e.select(id_col, F.col("ord").alias("i"), F.col("text").alias("subject"), F.col("end").alias("lo"))
    b = e.select(id_col, F.col("ord").alias("j"), F.col("text").alias("object"), F.col("start").alias("hi"))
    pairs = a.join(b, id_col).where("i < j AND lo < hi").join(docs.select(id_col, F.col(text_col).alias("_t")), id_col)
    gap = F.substr("_t", F.col("lo") + 1, F.col("hi") - F.col("lo"))
    return pairs.select(id_col, "i", "j", "subject", verb(gap).alias("predicate"), "object", F.lit(0.7).alias("confidence")).where("predicate != ''")


def graph_of(relations: DataFrame, entities_: DataFrame) -> DataFrame:
    """Atoms of a text: entities at (0.8, 0.9); evaluations of relations at (0.7, 0.8)."""
    from graphloom import schema

    nodes = schema.nodes(entities_, "ConceptNode", F.col("text"), 0.8, 0.9)
    s, o = schema.node_id("ConceptNode", F.col("subject")), schema.node_id("ConceptNode", F.col("object"))
    args = schema.link_id("ListLink", [s, o])
    parts = [
        nodes,
        schema.nodes(relations, "PredicateNode", F.col("predicate")),
        schema.links(relations, "ListLink", [s, o]),
        schema.links(relations, "EvaluationLink", [schema.node_id("PredicateNode", F.col("predicate")), args], 0.7, 0.8),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["atom_id"])


def sentence_of(kb) -> DataFrame:
    """(atom_id, text): atoms in words, children first - inheritance, evaluations, and, or, others by type."""
    from graphloom.store import cut

    atoms = kb.atoms
    done = cut(atoms.where("is_node").select("atom_id", F.col("name").alias("text")))
    inc = kb.incidence().join(atoms.select(F.col("atom_id").alias("target_id"), F.col("type").alias("child_type")), "target_id", "left")
    for _ in range(16):
        ready = inc.join(done.withColumnRenamed("atom_id", "target_id"), "target_id").join(done.withColumnRenamed("atom_id", "link_id").select("link_id"), "link_id", "left_anti")
        parts = ready.groupBy("link_id", "link_type", "arity").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "child_type"))).alias("cs")).where(F.size("cs") == F.col("arity"))
        words = F.transform("cs", lambda c: c["text"])
        n = F.size("cs")

        def listed(word: str) -> Column:
            return F.when(n == 1, words[0]).otherwise(F.concat(F.array_join(F.slice(words, 1, n - 1), ", "), F.lit(f" {word} "), F.element_at(words, -1)))

        text = (
            F.when((F.col("link_type") == "InheritanceLink") & (n == 2), F.concat(words[0], F.lit(" is a "), F.get(words, F.lit(1))))
            .when((F.col("link_type") == "EvaluationLink") & (n == 2), F.regexp_replace(F.get(words, F.lit(1)), "\u0001", F.concat(F.lit(" "), words[0], F.lit(" "))))
            .when((F.col("link_type") == "ListLink") & (n == 2), F.concat(words[0], F.lit("\u0001"), F.get(words, F.lit(1))))
            .when(F.col("link_type") == "AndLink", listed("and"))
            .when(F.col("link_type") == "OrLink", listed("or"))
            .otherwise(F.concat("link_type", F.lit("("), F.array_join(words, ", "), F.lit(")")))
        )
        new = cut(parts.select(F.col("link_id").alias("atom_id"), text.alias("text")))
        if new.isEmpty():
            break
        done = cut(done.unionByName(new))
    return done.withColumn("text", F.regexp_replace("text", "\u0001", ", "))


def summary(kb, most: int = 5) -> DataFrame:
    """The first evaluations by id as one text."""
    said = sentence_of(kb).join(kb.by_type("EvaluationLink").select("atom_id"), "atom_id", "left_semi").orderBy("atom_id").limit(most)
    return said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("atom_id", "text"))), lambda x: F.concat(x["text"], F.lit("."))), " ").alias("summary"))
