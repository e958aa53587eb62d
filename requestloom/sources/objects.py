"""Object sources: directories of whole files, or an inventory table.

A direct directory scan lists on the driver and, as Spark does, leaves out names
starting with ``_`` or ``.``.  For very many objects, or where those names
matter, give the listing as a table (an object-store inventory) instead.  Texts
are listed and opened by the tasks where they can reach the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .fetch import fetch_content, task_count
from .listing import list_tree
from .stores import ArrowStore


def _binary_files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.withColumnsRenamed(
        {"path": "file_path", "length": "size", "modificationTime": "last_modified"}
    )


def scan_objects(spark: SparkSession, root: str) -> DataFrame:
    """Listing of a directory tree; file content is never opened."""
    return _binary_files(spark, root).select(
        "file_path", C.basename("file_path").alias("file_name"), "size", "last_modified"
    )


def inventory_objects(
    inventory: DataFrame, path: str = "key", size: str = "size", modified: str = "last_modified"
) -> DataFrame:
    """The same listing from an inventory table; keys starting ``_`` or ``.`` are kept."""
    return inventory.select(
        F.col(path).alias("file_path"),
        C.basename(path).alias("file_name"),
        F.col(size).cast("bigint").alias("size"),
        F.col(modified).cast("timestamp").alias("last_modified"),
    )


def read_binary_objects(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """One row per file with its bytes; larger files are skipped before they are read."""
    files = _binary_files(spark, root)
    return files if max_bytes is None else files.filter(F.col("size") <= max_bytes)


def read_text_objects(spark: SparkSession, root: str, on_error: str = "reject") -> DataFrame:
    """One row per file, decoded as strict UTF-8.

    With ``reject``, ``content`` is null for a file that is not valid UTF-8;
    with ``fail``, such a file stops the job.
    """
    if on_error not in ("reject", "fail"):
        raise ValueError("on_error is 'reject' or 'fail'")
    check = F.try_validate_utf8 if on_error == "reject" else F.validate_utf8
    files = _opened_by_tasks(spark, root)
    files = read_binary_objects(spark, root) if files is None else files
    return files.withColumn("content", check(F.col("content").cast("string")))


def _opened_by_tasks(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of ``read_binary_objects`` for a folder that tasks can list and read; none for a single file, a pattern or
    another store.

    Spark's source lists on the driver, holds every file there and plans a task for each few dozens of small ones.
    """
    if set(root) & set("*?[]{}\\"):
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    where = system.makeQualified(where)
    folder = where.toString()
    if not ArrowStore.knows(folder) or not system.exists(where) or not system.getFileStatus(where).isDirectory():
        return None
    folder = folder if folder.endswith("/") else f"{folder}/"
    name = F.col("name")  # what Spark's file sources leave out
    left_out = (name.startswith("_") & ~name.contains("=")) | name.startswith(".") | name.endswith("._COPYING_")
    looked_into = F.col("size").isNull() & (name.startswith("_metadata") | name.startswith("_common_metadata"))
    listing = list_tree(spark, folder, hidden=left_out & ~looked_into).select(
        F.concat(F.lit(folder), F.col("file_path")).alias("file_path"),
        F.date_trunc("millisecond", "last_modified").alias("last_modified"),
        "size",
    )
    tasks = task_count(*listing.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first())
    read = fetch_content(listing, "file_path", tasks)
    stop = F.raise_error(F.concat(F.lit("cannot read "), F.col("file_path"), F.lit(": "), F.col("problem")))
    content = F.when(F.col("problem").isNotNull(), stop.cast("binary")).otherwise(F.col("content"))
    return read.select("file_path", "last_modified", "size", content.alias("content"))
