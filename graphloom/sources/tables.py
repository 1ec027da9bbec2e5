"""Parquet as the native store: a folder of tables, atoms partitioned by type."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import schema
from graphloom.kb import KnowledgeBase

TABLES = ("attention", "temporal", "atom_events")


def write(kb: KnowledgeBase, path: str, mode: str = "overwrite", clustered: bool = True) -> None:
    """Scans by type read that type's files alone; clustered, a point lookup reads the pages whose range of ids holds it."""
    atoms = kb.atoms.repartition("atom_id").sortWithinPartitions("type", "atom_id") if clustered else kb.atoms
    atoms.write.mode(mode).partitionBy("type").parquet(f"{path}/atoms")
    for name in TABLES:
        if (df := getattr(kb, name)) is not None:
            df.write.mode(mode).parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, tables: tuple[str, ...] = ()) -> KnowledgeBase:
    return KnowledgeBase(spark.read.schema(schema.ATOMS).parquet(f"{path}/atoms").select(schema.COLUMNS), **{t: spark.read.parquet(f"{path}/{t}") for t in tables})


# Vocabularies, merges, configurations


def vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Token to id: by line number, or from a flat JSON object; bounded, so it is held by the driver."""
    rows = spark.read.text(path, wholetext=True).first()
    text = rows[0] if rows else ""
    if path.endswith(".json"):
        return {str(k): int(v) for k, v in json.loads(text).items()}
    return {line.rstrip("\r"): k for k, line in enumerate(text.split("\n")) if line.rstrip("\r") or k < text.count("\n")}


def merges(spark: SparkSession, path: str) -> list[str]:
    """Merge rules in order; blank lines and comments are skipped."""
    rows = spark.read.text(path, wholetext=True).first()
    return [line.strip("\r") for line in (rows[0] if rows else "").split("\n") if line.strip() and not line.startswith("#")]


CONFIG = T.StructType([T.StructField("model_name", T.StringType())] + [T.StructField(c, T.IntegerType()) for c in ("hidden_size", "num_hidden_layers", "num_attention_heads", "vocab_size", "max_position_embeddings", "intermediate_size", "image_size", "patch_size")])


def model_configs(spark: SparkSession, path: str) -> DataFrame:
    """Model configurations, a row a file; absent optional fields are null."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", CONFIG).alias("c")).select("c.*")


def tensor_files(spark: SparkSession, path: str, kind: str = "<f4") -> DataFrame:
    """(path, values): raw little-endian numbers of each file."""
    @F.pandas_udf("array<double>")
    def values(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.frombuffer(b, kind).astype(float).tolist())

    return spark.read.format("binaryFile").load(path).select("path", values("content").alias("values"))
