"""Watching folders for new files, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.store import TableStore


def new_files(spark: SparkSession, folder: str, pattern: str = "*", most: int = 1000) -> DataFrame:
    """A stream of (watch_dir, path, length, modified, file_hash, content) of the files of a folder; empty files are left out."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most).load(folder)
    return raw.where("length > 0").select(F.lit(folder).alias("watch_dir"), "path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"), "content")


def distinct_files(files: DataFrame) -> DataFrame:
    """Each (watch_dir, file_hash) once, whatever the file's name; the state lasts as long as the stream, as the log of a watcher does."""
    return files.dropDuplicates(["watch_dir", "file_hash"])


def ingest(files: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None = None):  # noqa: ANN201
    """Start `handle` on each batch of new files, at an interval such as "30 seconds", or without one until all that lies there is done; a restart with the same checkpoint repeats nothing."""
    writer = distinct_files(files).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch(spark: SparkSession, folders: dict[str, str], checkpoint: str, handle: Callable[[DataFrame, int], None], pattern: str = "*") -> list:
    """A stream for each folder, polled at its own interval."""
    return [ingest(new_files(spark, folder, pattern), f"{checkpoint}/{i}", handle, every) for i, (folder, every) in enumerate(sorted(folders.items()))]


class Periodic:
    """Runs a job if its interval has passed since it last ran, and never twice at once, whoever asks; times are kept in a store."""

    LOG = "job string, ran timestamp"

    def __init__(self, store: TableStore, held: set[str] | None = None):
        self.store, self.held = store, set() if held is None else held

    def run(self, job: str, seconds: float, work: Callable[[], None], now: datetime | None = None) -> bool:
        """Whether the job was due and has run."""
        now = now or datetime.now()
        log = self.store.read("periodic_jobs", self.LOG)
        last = log.where(F.col("job") == job).agg(F.max("ran").alias("t")).first().t
        if job in self.held or (last is not None and (now - last).total_seconds() < seconds):
            return False
        self.held.add(job)
        try:
            work()
            self.store.write("periodic_jobs", log.where(F.col("job") != job).unionByName(self.store.spark.createDataFrame([(job, now)], self.LOG)))
        finally:
            self.held.discard(job)
        return True


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value), batch or stream, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
