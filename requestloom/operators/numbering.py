"""Contiguous record numbers over the accepted objects, in listing order.

Only the paths are sorted.  They are range-partitioned (paths are unique, so the
ranges are even), written once to the shared folder together with their position
inside the range, and counted per range; number = rows in earlier ranges +
position.  No window over the whole table and no pass through one task.  Writing
the sorted paths also pins the range bounds, so a lost executor or a second scan
cannot change any number.

Payload rows are attached afterwards by path: with a broadcast of the numbers
when their measured size is within ``BROADCAST_BYTES`` (the payload then stays
where it was read), and with a shuffled hash join beyond that.  Objects that are
read by path need no join at all, see ``requests.prepare_listed_batch``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_table, stage_table

BROADCAST_BYTES = 256 * 1024 * 1024
_ROW_OVERHEAD = 96  # per-row cost of a hashed relation besides the path text, which key and value both hold


class DuplicateKeyError(ValueError):
    """Two objects have the same key, so numbers could not be joined back to them."""


@dataclass(frozen=True)
class Numbering:
    """Numbered keys, with the totals measured while numbering them."""

    frame: DataFrame
    key: str
    rows: int
    bytes: int


def number_records(objects: DataFrame, key: str = "file_path", stage_keys: bool = False) -> Numbering:
    """Give each object ``record_index`` 0..n-1 in byte order of its unique ``key``.

    Range partitioning reads its input twice (once to find the ranges).  Where
    telling the accepted objects is costly, ``stage_keys`` writes their keys
    first, so that work is done once.
    """
    spark = objects.sparkSession
    keys = objects.select(key)
    if stage_keys:
        keys = stage_table(keys, "accepted")
    # the ranges already bring equal keys together, so counting copies needs the sort but no shuffle
    copy = F.row_number().over(Window.partitionBy(key).orderBy(key))
    ranged = keys.repartitionByRange(key).select(key, copy.alias("copy")).sortWithinPartitions(key)
    # slot = range number in the upper bits, position in the lower 33 bits
    placed = stage_table(ranged.select(key, "copy", F.monotonically_increasing_id().alias("slot")), "numbering")
    placed = placed.select(
        key,
        "copy",
        F.shiftright("slot", 33).cast("int").alias("bucket"),
        F.col("slot").bitwiseAND(F.lit((1 << 33) - 1)).alias("position"),
    )
    # one row per range
    ranges = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(key)).alias("b"), F.max("copy").alias("copies")
    )
    sizes = sorted(ranges.collect())
    if any(r["copies"] > 1 for r in sizes):
        repeated = placed.filter("copy > 1").first()[key]
        raise DuplicateKeyError(f"{key} is not unique: {repeated!r} occurs more than once")
    starts = [0, *accumulate(r["n"] for r in sizes)]
    offsets = small_table(
        spark, "bucket int, first_index bigint", [r["bucket"] for r in sizes], starts[: len(sizes)]
    )
    frame = placed.join(F.broadcast(offsets), "bucket").select(
        key, (F.col("first_index") + F.col("position")).alias("record_index")
    )
    rows = starts[-1]
    return Numbering(frame, key, rows, 2 * sum(r["b"] for r in sizes) + rows * _ROW_OVERHEAD)


def attach_numbers(rows: DataFrame, numbering: Numbering, broadcast_bytes: int | None = None) -> DataFrame:
    """Join ``record_index`` to the rows whose key was numbered."""
    bound = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if numbering.bytes <= bound:
        numbers = F.broadcast(numbering.frame)
    else:
        numbers = numbering.frame.hint("shuffle_hash")
    return rows.join(numbers, numbering.key)
