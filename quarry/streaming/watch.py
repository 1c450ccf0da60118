"""Change events as a stream: filter, deduplicate, debounce, and re-index per micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import EVENTS
from ..session import scratch, staged
from ..sources.walk import LANGUAGES, listing

# Directories that are never watched.
UNWATCHED = ["node_modules", ".git", "dist", "build", "vendor", "__pycache__", "bin", ".next", ".nuxt", "coverage", "target", ".idea", ".vscode"]
OPERATIONS = ["create", "write", "remove"]


def relevant(path: Column, operation: Column) -> Column:
    """Creations, writes and removals of files with a known extension, in any case; renames and modes do not count."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    watched = ~path.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in UNWATCHED) + ")/")
    return operation.isin(OPERATIONS) & suffix.isin(list(LANGUAGES)) & watched


def _moment(events: DataFrame) -> DataFrame:
    """Watermarks need an instant: a time without zone is taken as UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def debounce(events: DataFrame, gap: str = "500 milliseconds", lateness: str = "10 minutes", key: str | None = None) -> DataFrame:
    """(key, first_event, flush_at, events, paths): bursts of events(path, ts), closed by a quiet time of `gap`.

    Works on a stream, where a burst comes out when the watermark passes it, and on a table. key: a column, such as the
    repository, whose values burst apart and are worked on apart. Without one all events are one sequence, which is
    what a watcher of one tree has; a table of many trees' events should have a key.
    """
    rows = _moment(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    # a stream needs a key beside the session, and no constant: the remainder by one is 0 for every path
    groups = [F.session_window("ts", gap).alias("w"), F.col(key) if key else F.pmod(F.xxhash64("path"), F.lit(1)).alias("all")]
    paths = F.approx_count_distinct("path", 0.01) if rows.isStreaming else F.count_distinct("path")
    bursts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("events"), paths.alias("paths"))
    return bursts.select(*([key] if key else []), F.col("w.start").alias("first_event"), F.col("w.end").alias("flush_at"), "events", "paths")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, op): `create`, `write` or `remove` for each path on which two listings (path, size_bytes, modified) differ."""
    a = before.select("path", F.struct("size_bytes", "modified").alias("was"))
    b = after.select("path", F.struct("size_bytes", "modified").alias("now"))
    op = F.when(F.col("was").isNull(), "create").when(F.col("now").isNull(), "remove").when(F.col("was") != F.col("now"), "write")
    return a.join(b, "path", "full_outer").select("path", op.alias("op")).where("op is not null")


class TreeWatcher:
    """Watches a tree by comparing listings: each poll writes what changed since the last as a file of events.

    The events' folder is the source of a stream (read_events), so a flush that fails is tried again from the stream's
    checkpoint. No content is read here.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str | None = None):
        self.spark, self.root = spark, root
        self.folder = folder or scratch(spark, "events")
        self.seen = staged(listing(spark, root), "listing")
        spark.createDataFrame([], EVENTS).write.mode("append").parquet(self.folder)

    def poll(self) -> int:
        """How many paths changed since the last poll."""
        now = staged(listing(self.spark, self.root), "listing")
        events = staged(changes(self.seen, now).select("path", F.current_timestamp().alias("ts"), "op"), "changes")
        found = events.count()
        if found:
            events.write.mode("append").parquet(self.folder)
        self.seen = now
        return found

    def run(self, reindex: Callable[[DataFrame, int], None], polls: int | None = None, every_s: float = 0.5) -> int:
        """Polls, and hands the paths of each quiet moment to reindex; `polls` None goes on for ever. How many flushes.

        A flush waits for a poll without changes, so a burst of writes is one flush.
        """
        flushes, dirty, done = 0, False, 0
        mark = scratch(self.spark, "watch")
        while polls is None or done < polls:
            if self.poll():
                dirty = True
            elif dirty:
                events = read_events(self.spark, self.folder, EVENTS)
                on_flush(events.where(relevant(F.col("path"), F.col("op"))), reindex, mark, once=True).awaitTermination()
                flushes, dirty = flushes + 1, False
            done += 1
            time.sleep(every_s)
        return flushes


def pending(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, path): each path once for each window of time, however often it changed."""
    rows = _moment(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    keyed = rows.select(F.window("ts", window).start.alias("window_start"), "path", "ts")
    if rows.isStreaming:
        return keyed.dropDuplicatesWithinWatermark(["window_start", "path"]).drop("ts")
    return keyed.select("window_start", "path").distinct()


def on_flush(events: DataFrame, reindex: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "500 milliseconds") -> StreamingQuery:
    """Starts a query that hands the distinct paths of each micro-batch to reindex(paths, batch_id); empty ones are skipped.

    The trigger's interval is the quiet time; once: take what is there and stop. Paths are cached while a batch lasts.
    """

    def flush(batch: DataFrame, number: int) -> None:
        paths = batch.select("path").distinct().persist()
        try:
            if not paths.isEmpty():
                reindex(paths, number)
        finally:
            paths.unpersist()

    writer = events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files of events: those that arrive in the folder path, or the one file path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
