"""Content of listed objects, read by the tasks that need it.

A directory scan lists on the driver and hands out content in whatever order it
is packed; bringing it together with numbers or other columns of a large listing
then means moving the content.  Here the listing, which is small, is spread over
the tasks first, and each task opens its own objects.  Content is never shuffled
and nothing is listed on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .stores import ArrowStore, store_errors

CHUNK_BYTES = 32 * 1024 * 1024
TASK_BYTES = 1024 * 1024 * 1024
TASK_OBJECTS = 2000
READERS = 8


def task_count(objects: int, total_bytes: int) -> int:
    """Tasks for about ``TASK_BYTES`` or ``TASK_OBJECTS`` each, whichever asks for more of them."""
    return max(1, -(-total_bytes // TASK_BYTES), -(-objects // TASK_OBJECTS))


def fetch_content(
    listing: DataFrame,
    uri: str = "uri",
    tasks: int | None = None,
    keep_content: bool = True,
    chunk_bytes: int = CHUNK_BYTES,
    store=None,
    head_bytes: str | int | None = None,
    as_text: bool = False,
    count_good: bool = False,
) -> DataFrame:
    """Add ``content`` and ``problem`` (why it could not be read, else null) to a listing.

    ``tasks`` spreads the listing by hash first.  A task opens ``READERS`` objects
    at a time, and output batches are cut by the bytes they hold, so it needs
    memory for about one chunk and not for its whole share.
    ``keep_content=False`` reads but returns only the problem.  ``head_bytes``
    (a number, or a column with one per object) reads no more than the first
    bytes of each object.  ``store`` opens the objects, see ``stores``.
    ``as_text`` makes content that is not UTF-8 a problem.  ``count_good`` adds
    ``position``: how many objects before this one, in its task, had no problem.
    """
    store = ArrowStore() if store is None else store
    added = [StructField("problem", StringType())]
    if keep_content:
        added.insert(0, StructField("content", BinaryType()))
    if count_good:
        added.append(StructField("position", LongType()))
    schema = StructType([*listing.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = store_errors()

        def attempt(where: str, most: int | None) -> tuple[bytes | None, str | None]:
            try:
                with store.open(where) as stream:
                    data = stream.read() if most is None else stream.read(most)
                if as_text:
                    data.decode("utf-8")
                return data, None
            except bad as error:
                return None, str(error)

        def in_order(batch: pa.RecordBatch) -> Iterator[tuple[bytes | None, str | None]]:
            names = batch.schema.names
            places = batch.column(names.index(uri)).to_pylist()
            if isinstance(head_bytes, str):
                most = batch.column(names.index(head_bytes)).to_pylist()
            else:
                most = [head_bytes] * len(places)
            for i in range(0, len(places), READERS):
                yield from pool.map(attempt, places[i : i + READERS], most[i : i + READERS])

        good = 0
        with ThreadPoolExecutor(READERS) as pool:
            for batch in batches:
                start, content, problems, held = 0, [], [], 0
                names = [*batch.schema.names]

                def chunk(end: int) -> pa.RecordBatch:
                    nonlocal good
                    rows = batch.slice(start, end - start)
                    arrays, labels = [*rows.columns], [*names]
                    if keep_content:
                        arrays.append(pa.array(content, pa.binary()))
                        labels.append("content")
                    arrays.append(pa.array(problems, pa.string()))
                    labels.append("problem")
                    if count_good:
                        places = list(accumulate((p is None for p in problems), initial=good))
                        good = places.pop()
                        arrays.append(pa.array(places, pa.int64()))
                        labels.append("position")
                    return pa.RecordBatch.from_arrays(arrays, labels)

                for i, (data, problem) in enumerate(in_order(batch)):
                    problems.append(problem)
                    if keep_content:
                        content.append(data)
                        held += len(data or b"")
                    if held >= chunk_bytes:
                        yield chunk(i + 1)
                        start, content, problems, held = i + 1, [], [], 0
                if problems:
                    yield chunk(batch.num_rows)

    spread = listing.repartition(tasks, F.col(uri)) if tasks else listing
    return spread.mapInArrow(run, schema)
