"""Spark session builder and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import time
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # duplicate JSON keys: the last one wins, as in most readers
    "spark.sql.variant.allowDuplicateKeys": "true",
    # noting where each column expression was written takes longer than making it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "8g", app: str = "sessionloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = DEFAULTS | {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_session(master: str | None = None, app: str = "sessionloom") -> SparkSession:
    """The session of the environment (as ``spark-submit`` sets it up), or a local one."""
    builder = SparkSession.builder.appName(app)
    submitted = os.environ.get("PYSPARK_GATEWAY_PORT") or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if master or not (submitted or SparkSession.getActiveSession()):
        builder = builder.master(master or "local[*]")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (a local run, as in tests) is a temporary folder set.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints", str(os.getpid()))
    context.setCheckpointDir(named)
    return named


def store_by(df: DataFrame, key: str) -> DataFrame:
    """A frame as a stored table in the shared folder, in sorted buckets of a key, as many as a shuffle has
    partitions: what groups, joins or orders by that key moves no row."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"stored_{uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    df.repartition(n, key).write.option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def present(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names any file, in whatever store Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def drop_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are checkpointed.

    Spark deletes them once the driver has collected the plans that made them, which may be long after.
    It holds on to the last plan with a shuffle until there is another, hence the small ones, and to the
    events that tell of it until all listeners have had them; hence more than one round.
    """
    for _ in range(3):
        spark.range(0, 2, 1, 2).repartition(2).count()
        gc.collect()
        try:
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        except Py4JJavaError:
            pass  # a busy listener only delays the deletion
        spark._jvm.System.gc()
        time.sleep(0.2)
