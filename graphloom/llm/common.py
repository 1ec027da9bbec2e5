"""What the training-data operators share: words, shared storage, Arrow plumbing.

Words are runs of anything but space and U+0009..U+000D.  `bytes.split()` splits
on exactly those six characters and `bytes.lower()` touches A-Z only, so both
work on UTF-8 without decoding.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.store import checkpoint_dir, ship

#: Java and RE2 class of the characters that part words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 (null: none)."""
    return utf8(text).split()


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return utf8(text).lower().split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class Ids(dict):
    """Numbers keys in the order of their first lookup; hits stay inside C."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as 0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0)) % modulus


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; one is made only if the master is local."""
    return f"{checkpoint_dir(spark)}/graphloom"


def file_text(spark: SparkSession, path: str) -> Broadcast:
    """The text of a file on the driver, such as a tokenizer's, for executors that don't have the file."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    if _open:
        _open[-1][path] = out
    return out


#: Tables made since each open `scratch` began.
_open: list[dict[str, DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], None]]:
    """Deletes the tables that are materialised inside, but for those that it is told to keep."""
    _open.append({})
    try:
        yield lambda kept: _open[-1].pop(kept._graphloom_path)
    finally:
        discard(*_open.pop().values())


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_graphloom_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Returns freed memory to the system: workers live on for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Rows are texts: Arrow batches of a thousand, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterable[tuple]], batch: int = 1024) -> DataFrame:
    """mapInArrow for functions from a partition's column lists to output tuples.

    `rows` gets an iterator of dicts of lists (one a record batch, at most `batch`
    rows) and yields lists of output columns.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    small_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema if not isinstance(schema, StructType) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists():
            for b in batches:
                for k in range(0, b.num_rows, batch):
                    part = b.slice(k, batch)
                    yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}

        try:
            for columns in rows(lists()):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        finally:
            give_back()

    return df.mapInArrow(run, out)


def local(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a bounded table on the driver: numbers as arrays, others as arrays of objects."""
    t = df.toArrow()
    return {n: t.column(n).to_numpy() for n in t.column_names}


def sides(left: DataFrame, small: DataFrame, on, how: str, rows: int, bound: int = 50_000) -> DataFrame:
    """Join; the small side is broadcast only if its counted rows are within the bound."""
    return left.join(F.broadcast(small) if rows <= bound else small, on, how)


#: A key with more than one of so many rows is heavy; there are at most this many such keys.
HEAVY = 10_000


def share_join(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """Join of rows with one row a key, whose column `n` counts the key's rows among all `total`.

    Heavy keys are broadcast: by their counts they are at most HEAVY.  The other
    keys go through a shuffle in which none has more than 1 / HEAVY of the rows.
    A left join keeps rows without a group, null keys among them.
    """
    bound = total // HEAVY
    heavy, light = F.broadcast(groups.where(F.col("n") > bound).drop("n")), groups.where(F.col("n") <= bound).drop("n")
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(keys), keys, "left_anti").join(light, keys, how))
