"""Streams: micro-batches of the cycles that a single process would loop over."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom import schema
from graphloom.kb import KnowledgeBase
from graphloom.operators import attention
from graphloom.plans.compiler import compile_pattern
from graphloom.plans.pattern import Pattern
from graphloom.store import checkpoint_dir


def read(spark: SparkSession, folder: str, like: DataFrame, glob: str | None = None, files_a_batch: int = 8) -> DataFrame:
    """Files of a folder as they come, with the columns of a sample."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def windowed(events: DataFrame, by: list[str], width: str = "1 hour", late: str = "10 minutes", value: str = "value", ts: str = "ts") -> DataFrame:
    """Counts and sums in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, by: list[str], gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Sessions that end after a gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), *by, "n")


def drain(stream: DataFrame, mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all that is there and gives its result, a Parquet table in the shared folder.

    Appended rows are kept batch by batch; in the complete mode every batch writes
    the whole result and the last one counts; in the update mode, of the rows of a
    key those of its last batch.  A batch that runs again writes its folder again.
    """
    spark = stream.sparkSession
    out = f"{checkpoint_dir(spark)}/drain-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{out}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")
    seen: list[int] = []

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch-{number}")
        seen.append(number)

    writer.foreachBatch(write).start().awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/rows/batch-{max(seen)}")
    every = reduce(DataFrame.unionByName, [spark.read.schema(stream.schema).parquet(f"{out}/rows/batch-{n}").withColumn("_n", F.lit(n)) for n in sorted(set(seen))])
    last = every.groupBy(*keys).agg(F.max("_n").alias("_n"))
    return every.join(last, [*keys, "_n"]).drop("_n")


def standing_pattern(atoms: DataFrame, space: KnowledgeBase, p: Pattern, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls back with the matches that each batch of new atoms brings, among the space and all atoms that came before; stop() ends it.

    Batches are kept below `<checkpoint>/atoms`; one that runs again writes the same folder again.
    """
    spark = space.spark

    def batch(new: DataFrame, number: int) -> None:
        new.select(schema.COLUMNS).write.mode("overwrite").parquet(f"{checkpoint}/atoms/batch={number}")
        came = spark.read.schema(f"{schema.ATOMS}, batch long").parquet(f"{checkpoint}/atoms").where(F.col("batch") <= number)
        own = came.where(F.col("batch") == number).select(schema.COLUMNS)
        callback(compile_pattern(space.atoms.unionByName(came.select(schema.COLUMNS)), p, candidates=own), number)

    return atoms.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/state").start()


class AttentionStream:
    """The bank as a stream of stimuli grows it: each batch is one decay and one stimulation, kept as a table."""

    def __init__(self, bank: DataFrame, folder: str, factor: float = attention.DECAY):
        self.folder, self.factor, self.version = folder, factor, 0
        bank.select("atom_id", *attention.PARTS).write.mode("overwrite").parquet(f"{folder}/0")
        self.spark = bank.sparkSession

    @property
    def bank(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.version}")

    def apply(self, stimuli: DataFrame, number: int) -> None:
        """A batch that is run again writes the same version again."""
        before = self.spark.read.parquet(f"{self.folder}/{number}")
        after = attention.stimulate(attention.decay(before, self.factor), stimuli)
        after.write.mode("overwrite").parquet(f"{self.folder}/{number + 1}")
        self.version = number + 1

    def start(self, stimuli: DataFrame, **trigger) -> StreamingQuery:
        return stimuli.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/_state").trigger(**trigger).start()


def running_sti(stimuli: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Per atom, sti kept in state from batch to batch: (atom_id, sti, n)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key, frames, state: GroupState):
        sti, n = state.get if state.exists else (0.0, 0)
        for f in frames:
            sti, n = sti + float(f["amount"].sum()), n + len(f)
        state.update((sti, n))
        yield pd.DataFrame({"atom_id": [key[0]], "sti": [sti], "n": [n]})

    return stimuli.groupBy("atom_id").applyInPandasWithState(update, "atom_id string, sti double, n long", "sti double, n long", "update", GroupStateTimeout.NoTimeout)


def frames(detections: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every batch of frames' detections to a function."""
    return detections.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
