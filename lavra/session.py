"""Sessions, shared storage and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "lavra") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("LAVRA_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LAVRA_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine a temporary one.

    On a cluster that names no such folder this raises, since a folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not at:
        have = context.getCheckpointDir()
        if have:
            return have
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lavra-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = f"file://{folder}"
        context.setCheckpointDir(at)
    return at


_written: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside give their shuffle files back at once, since their results are kept elsewhere."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and return a scan of it, which cuts the lineage and keeps column pruning.

    The files last until drop_materialized, or till the program ends; a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lavra/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if not _written:
        atexit.unregister(_drop_quietly)
        atexit.register(_drop_quietly, spark)
    _written.append(path)
    with tidy(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables materialize has written so far; frames that read them are of no use then."""
    conf, paths = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    while _written:
        at = paths(_written.pop())
        at.getFileSystem(conf).delete(at, True)


def _drop_quietly(spark: SparkSession) -> None:
    """At the end of the program: what is left of its tables, if there still is a session to ask."""
    with suppress(Exception):
        drop_materialized(spark)


def spread(df: DataFrame) -> DataFrame:
    """A scan of few splits over all cores, for work that costs far more than moving its input; else df as it is.

    Large inputs have splits enough and are not moved. Plans that shuffle anyway are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString() or df.isStreaming:
        return df
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def send_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to all workers, once per session; returns the name SparkFiles finds it by."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_lavra_files", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    return os.path.basename(path)
