"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on or profit from.  All are run-time SQL settings,
# so they can be applied to a session somebody else built.
RUNTIME_CONF = {
    # JSON objects with a repeated key: the last value wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


#: Removes a query's shuffle files when the query has ended, and not when the driver's collector comes to it.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "requestloom", master: str | None = None) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and unchunked base64."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.chunkBase64String.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return configure(builder.getOrCreate())


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; without that setting its
    warehouse is taken, and a session whose tasks run in the driver gets a
    temporary folder.  A plain path may be a mount that all machines share or a
    folder of one machine, where rows would be lost without an error, so tasks
    try it once before it is used.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    local = context.master == "local" or context.master.startswith("local[")
    if not root and not local:
        root = spark.conf.get("spark.sql.warehouse.dir")
    elif not root:
        app = context.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="requestloom-")
        root = _LOCAL_ROOTS[app]
    root = root.rstrip("/")
    check_shared(root, local, lambda: reached_by_tasks(spark, root))
    return root


_LOCAL_ROOTS: dict[str, str] = {}
_REACHED: set[tuple[str, str]] = set()


def check_shared(root: str, local: bool, reached: Callable[[], bool] = lambda: False) -> None:
    """Refuse a folder of one machine where tasks run on several, unless they are seen to share it."""
    if not local and urlsplit(root).scheme in ("", "file") and not reached():
        raise ValueError(
            f"{root} is a folder of one machine: set spark.checkpoint.dir to a folder shared by all executors"
        )


def reached_by_tasks(spark: SparkSession, root: str) -> bool:
    """Whether the driver and other tasks find what tasks write below ``root``: a row per core, tried once."""
    tried = (spark.sparkContext.applicationId, root)
    if tried not in _REACHED:
        tasks = spark.sparkContext.defaultParallelism
        where = f"{root}/requestloom/probe-{uuid.uuid4().hex}"
        spark.range(0, tasks, 1, tasks).write.parquet(where)
        if spark.read.schema("id bigint").parquet(where).count() != tasks:
            return False
        _REACHED.add(tried)
    return True


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/requestloom/{label}-{uuid.uuid4().hex}"


def stage_table(rows: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write rows to the shared folder and return the written table.

    Cuts the lineage: later steps read the table, also after losing executors.  So the shuffle files that led to it go
    when it is written.
    """
    spark = rows.sparkSession
    where, before = shared_path(spark, label), spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        rows.write.parquet(where, compression=compression)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(where)


def drop_tables(*tables: DataFrame) -> None:
    """Remove written tables of ``stage_table`` that nothing reads any more."""
    for table in tables:
        jvm, state = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState()
        for where in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if where.split("/")[-2] != "requestloom":
                raise ValueError(f"{where} is no staged table")
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(where))
            folder.getFileSystem(state.newHadoopConf()).delete(folder, True)


def small_table(spark: SparkSession, schema: str, *columns: list) -> DataFrame:
    """A table of driver-side values, given column by column; becomes a local relation."""
    names = [field.split()[0] for field in schema.split(", ")]
    table = pa.table(dict(zip(names, columns)))
    return spark.createDataFrame(table, schema)
