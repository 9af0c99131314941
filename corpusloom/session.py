"""Session settings the operators rely on, and lineage cutting that survives lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Repeated front-matter keys: the last line wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of long texts stays small beside a worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # A union must not claim its inputs' partitioning: adaptive execution may coalesce
    # each input differently, and a grouping above would then see a key twice.
    "spark.sql.unionOutputPartitioning": "false",
    # Folders are listed in so many tasks; by default each of up to 10,000 folders is a task of its own.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # Sessions of a busy key are merged in each task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the session options that change results or plan quality, and send the package to the workers."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Spark's own file server deals out the archive, so workers need neither an
    installation nor the driver's path.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corpusloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def local_session(app: str = "corpusloom", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return shared_dir(spark)


_RECORDERS: list[list[str]] = []


@contextmanager
def recorded_tables() -> Iterator[list[str]]:
    """Paths of the tables that ``written`` stores inside the block, for ``drop_tables``."""
    paths: list[str] = []
    _RECORDERS.append(paths)
    try:
        yield paths
    finally:
        _RECORDERS.pop()


def exists(spark: SparkSession, name: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def folders(spark: SparkSession, name: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(path) if f.isDirectory()) if system.exists(path) else []


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def written(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Store a table in the shared folder and read it back.

    Survives executor loss like a checkpoint, and later readers still get
    column pruning, filters pushed to the scan and known sizes. A writer and a reader hold
    a row group in memory; of rows that are large each, a group takes ``group_rows``.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    writer = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    for paths in _RECORDERS:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(
    df: DataFrame, *keys: str, partition: str | None = None, sort: tuple[str, ...] = (), placed: bool = False
) -> DataFrame:
    """Store a table in the shared folder in buckets of ``keys``; reading it keeps that placement.

    As many buckets as the session has shuffle partitions. ``partition`` deals the rows to folders that
    a filter on it can skip; each bucket's rows are sorted by ``sort``. ``placed`` rows have been
    repartitioned so before and are written where they are.
    """
    spark = df.sparkSession
    name = f"corpusloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if placed else df.repartition(buckets, *keys)
    writer = rows.write.option("path", path).bucketBy(buckets, *keys)
    if sort:
        writer = writer.sortBy(*sort)
    if partition:
        writer = writer.partitionBy(partition)
    writer.saveAsTable(name)
    return spark.table(name)
