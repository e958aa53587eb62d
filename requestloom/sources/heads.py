"""The beginning of files: their first bytes, or their first lines that hold anything.

Tasks open the files themselves and stop reading as soon as they have enough, so what is read does not grow with a file,
and lines are never moved to find the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import fixed
from ..session import stage_table
from .fetch import TASK_OBJECTS
from .stores import ArrowStore, store_errors

BLOCK_BYTES = 64 * 1024


def first_lines_of(stream, n: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, str]]:
    """(place in the file, line) of the first ``n`` lines that are text and not blank; lines end with ``\\n``."""
    held, place, given = [], 0, 0

    def line(raw: bytes) -> str | None:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
        return text if text.strip(fixed.WHITESPACE) else None

    while given < n:
        block = stream.read(block_bytes)
        if not block:
            break
        *ended, rest = block.split(b"\n")
        for raw in ended:
            text = line(b"".join([*held, raw]))
            held, place = [], place + 1
            if text is not None:
                yield place, text
                given += 1
                if given == n:
                    return
        held.append(rest)
    if given < n and held:
        text = line(b"".join(held))
        if text is not None:
            yield place + 1, text


def head_lines(
    files: DataFrame, n: int, uri: str = "uri", store=None, tasks: int | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The files' columns with ``place`` and ``line`` of their first ``n`` lines; a file that cannot be read gives one row
    with the ``problem`` and no line."""
    store = ArrowStore() if store is None else store
    added = [StructField("place", IntegerType()), StructField("line", StringType()), StructField("problem", StringType())]
    schema = StructType([*files.schema.fields, *added])

    def run(batches):
        import pyarrow as pa

        bad = store_errors()
        for batch in batches:
            where = batch.column(batch.schema.names.index(uri)).to_pylist()
            for i, one in enumerate(where):
                found, problem = [], None
                try:
                    with store.open(one) as stream:
                        found = list(first_lines_of(stream, n, block_bytes))
                except bad as error:
                    found, problem = [(None, None)], str(error)
                columns = [batch.column(c).take(pa.array([i] * len(found), pa.int32())) for c in range(batch.num_columns)]
                places, lines = zip(*found) if found else ((), ())
                columns += [pa.array(places, pa.int32()), pa.array(lines, pa.string())]
                columns.append(pa.array([problem] * len(found), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "place", "line", "problem"])

    spread = files.repartition(tasks, F.col(uri)) if tasks else files
    return spread.mapInArrow(run, schema)


def head_lines_of_parts(
    parts: DataFrame,
    n: int,
    by: list[str],
    part: str = "part",
    uri: str = "uri",
    store=None,
    on_error: str = "fail",
) -> DataFrame:
    """``by``, ``line_no``, ``line``: the first ``n`` lines of files that are folders of parts, in the order of the parts.

    Of each file the first part is read, then the next two, the next four and so on while it lacks lines.  Only the list of
    parts is ranked.  A part that cannot be read stops the job, or with ``skip`` counts as empty.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(part))
    left, done, first, last = parts.select(*by, part, uri), None, 1, 1
    while True:
        now = left.withColumn("nth", rank).filter(F.col("nth") <= last).filter(F.col("nth") >= first)
        now = stage_table(now, "parts")
        count = now.count()
        if not count:
            break
        found = head_lines(now, n, uri, store, tasks=max(1, -(-count // TASK_OBJECTS)))
        if on_error == "fail":
            stop = F.raise_error(F.concat(F.col(uri), F.lit(": "), F.col("problem"))).cast("string")
            found = found.withColumn("line", F.when(F.col("problem").isNotNull(), stop).otherwise(F.col("line")))
        rows = stage_table(found.filter("line is not null").select(*by, "nth", "place", "line"), "head_lines")
        done = rows if done is None else done.unionAll(rows)
        complete = done.groupBy(*by).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= n)
        left = left.join(complete.select(*by), by, "left_anti")
        first, last = last + 1, 3 * last
    if done is None:
        return parts.select(*by, F.lit(0).alias("line_no"), F.lit("").alias("line")).limit(0)
    order = Window.partitionBy(*by).orderBy("nth", "place")
    return done.withColumn("line_no", F.row_number().over(order)).filter(F.col("line_no") <= n).select(*by, "line_no", "line")
