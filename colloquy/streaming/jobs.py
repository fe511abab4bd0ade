"""Structured Streaming jobs: arriving recogniser files become turns, and live progress is throttled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from colloquy.functions.text import media_stem
from colloquy.operators.turns import collect_words, make_turns, normalize_asr, split_turns
from colloquy.sources.files import ASR, asr_segments
from colloquy.sources.names import metadata_name
from colloquy.sources.store import VersionedTable


def ingest_batch(batch: DataFrame, table: VersionedTable, transaction: tuple[str, int]) -> int:
    """The table's version after the turns of a batch of recogniser documents (rec_id, the columns
    of the file, ``_modified``). A recording that is there already is replaced; of two files of
    one recording the later one counts. A batch that the table has is not written again."""
    last = F.row_number().over(Window.partitionBy("rec_id").orderBy(F.desc("_modified"), F.desc("_file")))
    docs = asr_segments(batch.withColumn("_nth", last).where("_nth = 1").drop("_nth"))
    words = collect_words(normalize_asr(docs)).withColumn("speaker", F.lit(None).cast("string"))
    return table.upsert(split_turns(make_turns(words).withColumn("text_zh", F.lit(""))), transaction)


def stream_ingest(spark: SparkSession, in_dir: str, out: str, checkpoint: str, buckets: int = 16, available_now: bool = False):
    """Starts a query that turns each new file, one whole recording, into turns of the versioned
    table ``out`` (read it with :func:`ingested`); with ``available_now`` it ends when the files
    that are there are through.

    Exactly once: the files of a batch count from the moment when the table's log has an entry
    with the batch's number. A batch that stopped before it leaves files that nothing names and
    runs again; one that stopped behind it finds its number and does nothing."""
    files = spark.readStream.schema(ASR).option("multiLine", True).json(in_dir)
    name = metadata_name()
    docs = files.select("*", F.regexp_replace(media_stem(name), r"\.whisper$", "").alias("rec_id"), F.col("_metadata.file_modification_time").alias("_modified"), name.alias("_file")).where("_corrupt_record is null")
    table = VersionedTable(spark, out, "rec_id", buckets)
    writer = docs.writeStream.trigger(availableNow=True) if available_now else docs.writeStream
    return writer.foreachBatch(lambda batch, n: ingest_batch(batch, table, (f"ingest {checkpoint}", n))).option("checkpointLocation", checkpoint).start()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """The turns of all recordings that arrived."""
    return VersionedTable(spark, out).read()


class Throttle(StatefulProcessor):
    """Lets the ticks of a job pass that the throttle emits. The state is the job's greatest percent
    and last place; it ends with a tick without a percent, or when the job was silent for ``silence``
    milliseconds. Either gives 100 if that was not reached."""

    def __init__(self, step: int, silence: int):
        self.step, self.silence = step, silence

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "most int, last long")

    def _end(self) -> None:
        self.state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows)).sort_values("seq", kind="stable")
        most, last = self.state.get() if self.state.exists() else (-1, 0)
        out, ended = [], False
        for seq, pct in zip(ticks["seq"], ticks["pct"]):
            ended = bool(pd.isna(pct))
            pct = 100 if ended else int(pct)
            if most < 0 or pct // self.step > most // self.step or (pct >= 100 and most < 100):
                out.append((key[0], int(seq), pct))
            most, last = (-1, 0) if ended else (max(most, pct), int(seq))
        self._end()
        if not ended:
            self.state.update((most, last))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        yield pd.DataFrame(out, columns=["job_id", "seq", "pct"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        most, last = self.state.get() if self.state.exists() else (100, 0)
        self.state.clear()
        yield pd.DataFrame([(key[0], last + 1, 100)] if most < 100 else [], columns=["job_id", "seq", "pct"])

    def close(self) -> None:
        pass


def stream_throttle(progress: DataFrame, step: int = 5, silence_seconds: float = 600) -> DataFrame:
    """Ticks of (job_id, seq, pct) that pass the throttle, and a tick of 100 for each job that ends
    below it: by a tick without a percent, or by ``silence_seconds`` without a tick. A job that has
    ended leaves no state; further ticks begin it anew. The session needs the RocksDB state store."""
    spark = progress.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise RuntimeError("set spark.sql.streaming.stateStore.providerClass to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return progress.groupBy("job_id").transformWithStateInPandas(Throttle(step, int(silence_seconds * 1000)), "job_id long, seq long, pct int", "Append", "ProcessingTime")
