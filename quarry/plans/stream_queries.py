"""Stream operators and the parsing pipeline as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch, spread, table
from ..sources import walk
from ..streaming import watch
from .views import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, **more: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, **more)
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), "ts", "event_id")


@query(
    "SELECT min(ts)::VARCHAR AS first_event, path, count(*)::BIGINT AS events FROM numbered GROUP BY path, burst",
    gaps="SELECT user_id::VARCHAR AS path, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events",
    numbered="SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM gaps",
)
def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of events of each user with 30 minutes of quiet between them."""
    found = watch.debounce(_events(spark, sf), "30 minutes", key="path")
    stamp = F.date_format("first_event", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return found.select(F.regexp_replace(stamp, r"(\.\d*?[1-9])0+$|\.0+$", "$1").alias("first_event"), "path", "events")


@query("SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, user_id::VARCHAR AS path FROM events")
def dedup_pending(spark: SparkSession, sf: str) -> DataFrame:
    return watch.pending(_events(spark, sf)).select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "path")


@query("SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, user_id::VARCHAR AS path FROM events")
def dedup_pending_stream(spark: SparkSession, sf: str) -> DataFrame:
    """dedup_pending through a stream, which keeps the paths of the open hours as its state."""
    out = scratch(spark, "stream")
    events = watch.read_events(spark, f"{sf.rstrip('/')}/events.parquet", table(spark, sf, "events").schema)
    paths = watch.pending(events.select(F.col("user_id").cast("string").alias("path"), "ts"), lateness="400 days")
    run = paths.writeStream.format("parquet").option("path", f"{out}/found").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("window_start timestamp, path string").parquet(f"{out}/found").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "path")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by type, taken through a stream of the event files and one micro-batch after another."""
    out = scratch(spark, "stream")
    source = f"{sf.rstrip('/')}/events.parquet"
    events = watch.read_events(spark, source, table(spark, sf, "events").schema)

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    run = events.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/counts").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT DISTINCT 0 AS flush, 'src/user_' || user_id || '.go' AS path FROM events WHERE event_type <> 'error'")
def stream_incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    """The paths handed to the index, flush by flush, of a stream of change events."""
    out = scratch(spark, "stream")
    raw = watch.read_events(spark, f"{sf.rstrip('/')}/events.parquet", table(spark, sf, "events").schema)
    path = F.concat(F.lit("src/user_"), F.col("user_id").cast("string"), F.lit(".go"))
    operation = F.when(F.col("event_type") == "click", "write").when(F.col("event_type") == "error", "chmod").otherwise("create")
    events = raw.select(path.alias("path"), "ts", operation.alias("op")).where(watch.relevant(F.col("path"), F.col("op")))
    run = watch.on_flush(events, lambda paths, n: paths.withColumn("flush", F.lit(n)).write.mode("overwrite").parquet(f"{out}/flushed/batch={n}"), f"{out}/checkpoint", once=True)
    run.awaitTermination()
    return spark.read.parquet(f"{out}/flushed").select("flush", "path")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """The source files among the documents."""
    rows = table(spark, sf, "documents").where("doc_kind = 'source' and text is not null and path is not null")
    language = walk.language(F.col("path"))
    return rows.select(F.col("source").alias("repo_name"), "path", language.alias("language"), F.col("text").alias("content")).where("language is not null")


@query()
def parse_symbols(spark: SparkSession, sf: str) -> DataFrame:
    from ..parse.extract import extract_symbols

    return extract_symbols(spread(_code(spark, sf))).drop("code_block")


@query()
def extract_deps(spark: SparkSession, sf: str) -> DataFrame:
    from ..parse.extract import extract_edges

    return extract_edges(spread(_code(spark, sf)))


def _code(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols' code blocks as if each were a file of its language, and the source documents."""
    blocks = table(spark, sf, "symbols").where("language is not null").dropDuplicates(["id"])
    own = blocks.select("repo_name", F.concat("file_path", F.lit("#"), F.col("id").cast("string")).alias("path"), "language", F.col("code_block").alias("content"))
    return own.unionByName(_sources(spark, sf))
