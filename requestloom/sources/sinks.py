"""Sinks: request JSONL, staged request tables, objects of their own."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import ArrowStore


def write_requests(requests: DataFrame, uri: str, col: str = "value", mode: str = "errorifexists") -> str:
    """Write one request per line straight to the target folder.

    Every task streams its own part file, so memory does not grow with the batch;
    there is no single-file mode, since that would send the batch through one
    task.
    """
    requests.select(col).write.mode(mode).option("lineSep", "\n").text(uri)
    return uri


def stage_requests(requests: DataFrame, table_uri: str, mode: str = "errorifexists") -> DataFrame:
    """Materialize prepared requests (with their paths) and return the staged table.

    The staged table is what the combine step reads, so a failed write never
    repeats the object reads, and ids stay traceable to files.
    """
    requests.write.mode(mode).parquet(table_uri)
    return requests.sparkSession.read.schema(requests.schema).parquet(table_uri)


def write_objects(objects: DataFrame, root: str, store=None) -> str:
    """Write each row (``name``, ``content`` as bytes) as an object of its own below ``root``.

    Rows of one name that follow each other in a partition make up one object.  Tasks write the objects themselves, each
    under its own name at once, so nothing is moved by the driver afterwards.  A task that is tried again replaces what
    it wrote; so each partition must hold the same rows in the same order every time, as that of a scan does, and names of
    two partitions must differ.
    """
    store = ArrowStore() if store is None else store

    def write(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        made, written = None, 0
        for name, parts in groupby(rows(), lambda row: row[0]):
            if (folder := f"{root}/{name}".rpartition("/")[0]) != made:
                store.make_folder(made := folder)
            with store.create(f"{root}/{name}") as stream:
                for _, content in parts:
                    stream.write(content)
            written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    store.make_folder(root)
    objects.select("name", "content").mapInArrow(write, "written bigint").agg(F.sum("written")).collect()
    return root
