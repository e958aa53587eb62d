"""Listing of a folder tree by the tasks, one level of folders after the other.

Listing a prefix starts at the deepest folder that the prefix names, so nothing beside it is looked at.  The folders of a
level are spread over the tasks, each task lists its own, and the folders found are the next level.  The driver lists
nothing; it starts a job per level, which depends on the depth of the tree and not on its size.  Levels are written to the
shared folder, so a folder is listed once.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stage_table
from .stores import ArrowStore, store_errors

FOUND = "folder string, name string, size bigint, modified double, problem string"
#: Folders that a task lists, and how many more of them while there are enough tasks.
TASK_FOLDERS, MOST_FOLDERS = 64, 4096
#: Entries of a folder that a task holds at a time.
ENTRIES_AT_ONCE = 8192


def _level(folders: DataFrame, root: str, store, tasks: int) -> DataFrame:
    """Entries of the folders of one level."""

    def run(batches):
        import pyarrow as pa

        bad = store_errors()

        def found(folder, rows, problem=None):
            names, sizes, times = zip(*rows) if rows else ((), (), ())
            columns = [
                pa.array([folder] * len(rows), pa.string()),
                pa.array(names, pa.string()),
                pa.array(sizes, pa.int64()),
                pa.array(times, pa.float64()),
                pa.array([problem] * len(rows), pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["folder", "name", "size", "modified", "problem"])

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    entries = iter(store.entries(root + folder))
                    while rows := list(islice(entries, ENTRIES_AT_ONCE)):
                        yield found(folder, rows)
                except bad as error:
                    yield found(folder, [(None, None, None)], str(error))

    return folders.repartition(tasks, "folder").mapInArrow(run, FOUND)


def list_tree(
    spark: SparkSession,
    root: str,
    prefix: str = "",
    store=None,
    hidden: bool | Column = True,
    task_folders: int = TASK_FOLDERS,
) -> DataFrame:
    """Objects whose key, the path below ``root``, starts with ``prefix``: file_path (the key), file_name, size,
    last_modified.

    Names that start with ``_`` or ``.`` are left out, as files and as folders, if ``hidden`` is false; so are those that
    meet it if it is a condition on ``name`` and ``size`` (null: a folder).  A folder that cannot be listed stops the job.
    """
    store = ArrowStore() if store is None else store
    root = root if root.endswith("/") else root + "/"
    start, _, rest = prefix.rpartition("/")
    folders = spark.createDataFrame([(start + "/" if start else "",)], "folder string")
    left_out = F.col("name").startswith("_") | F.col("name").startswith(".") if isinstance(hidden, bool) else hidden
    levels, count, wanted = [], 1, F.col("name").startswith(rest) if rest else F.lit(True)
    while count:
        few = max(4 * spark.sparkContext.defaultParallelism, -(-count // MOST_FOLDERS))
        found = _level(folders, root, store, max(1, min(few, -(-count // task_folders))))
        stop = F.raise_error(F.concat(F.lit("cannot list "), F.col("folder"), F.lit(": "), F.col("problem")))
        found = found.withColumn("name", F.when(F.col("problem").isNotNull(), stop.cast("string")).otherwise(F.col("name")))
        if hidden is not True:
            found = found.filter(~left_out)
        level = stage_table(found.filter(wanted).drop("problem"), "level")
        levels.append(level.filter("size is not null"))
        folders = level.filter("size is null").select(F.concat("folder", "name", F.lit("/")).alias("folder"))
        count, wanted = folders.count(), F.lit(True)
    path = F.concat("folder", "name")
    return reduce(DataFrame.unionAll, levels).select(
        path.alias("file_path"),
        C.basename("name").alias("file_name"),
        "size",
        F.timestamp_seconds("modified").alias("last_modified"),
    )
