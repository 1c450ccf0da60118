"""Session settings, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that never hurt: adaptive plans, skew handling, Arrow transfer, UTC.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = 8, memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A session for tests and for the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quarry")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle)).config("spark.driver.memory", memory)
    session = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: what the cluster names in spark.checkpoint.dir.

    Only a local run, where one machine is all there is, gets a temporary folder if none is set; any other master must
    name one, as a machine's own folder would not be seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The folder as a plain path if it lies in a mounted file system, else None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = p.toUri().getScheme() or p.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return p.toUri().getPath() if scheme == "file" else None


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what lies there goes when the driver ends."""
    path = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Cuts the lineage in a way that survives lost executors, and costs less disk than
    checkpoint() because the columns are compressed. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Removes the table that staged() gave as df, before the driver ends."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; sf_dir holds NAME.parquet as a file or a folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: where its scan gives fewer parts than the cluster has cores, its rows are dealt out evenly.

    For stages that compute long over each row. A large input has parts enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slots(spark: SparkSession, rows_hint: int | None = None, per_task: int = 50_000) -> int:
    """Shuffle partitions: the session's setting, or more when rows_hint asks for it."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(base, -(-rows_hint // per_task)) if rows_hint else base
