"""Shards by fixed virtual slots.

Records are hashed into thousands of slots.  Bytes are added up per slot, slots are dealt to shards with the largest slot
first and always to the lightest shard, and the slot-to-shard map is a table with a version.  Rebalancing edits the map: a
new shard takes whole slots of the others, nothing else moves.

The law is ``bytes``: shards are as equal in bytes as whole slots allow.  ``slot`` is a row's place in its shard, without
gaps from 0.  Null texts have no bytes.  Null ids hash by their text; repeated rows share a slot and get places of their
own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

SLOTS = 4096


def sized(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (bytes + 1), crc (of the bytes), virtual (its slot)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("crc"),
    ).withColumn("virtual", F.pmod(F.xxhash64("id", "crc"), F.lit(slots)).cast("int"))


def slot_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(sums: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: version, virtual, shard, bytes, rows.  One row per slot, so it is small by construction."""
    largest_first = F.array_sort(
        F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual", "bytes", "rows"))
    )

    def deal(dealt: Column, slot: Column) -> Column:
        lightest = F.array_position(dealt["loads"], F.array_min(dealt["loads"])) - 1
        return F.struct(
            F.transform(
                dealt["loads"], lambda load, i: F.when(i == lightest, load + slot["bytes"]).otherwise(load)
            ).alias("loads"),
            F.concat(
                dealt["slots"],
                F.array(
                    F.struct(
                        slot["virtual"].alias("virtual"),
                        lightest.cast("int").alias("shard"),
                        slot["bytes"].alias("bytes"),
                        slot["rows"].alias("rows"),
                    )
                ),
            ).alias("slots"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.expr("cast(array() as array<struct<virtual: int, shard: int, bytes: bigint, rows: bigint>>)").alias("slots"),
    )
    return (
        sums.agg(largest_first.alias("all"))
        .select(F.inline(F.aggregate("all", start, deal)["slots"]))
        .select(F.lit(1).alias("version"), "virtual", "shard", "bytes", "rows")
    )


def add_shard(slot_map: DataFrame) -> DataFrame:
    """The next version of a map, with one more shard: each shard gives small slots up to what it has over the new mean."""
    totals = slot_map.agg(
        (F.sum("bytes") / (F.max("shard") + 2)).alias("mean"), (F.max("shard") + 1).cast("int").alias("new")
    )
    by_size = Window.partitionBy("shard").orderBy("bytes", "virtual").rowsBetween(Window.unboundedPreceding, 0)
    with_sums = (
        slot_map.withColumn("given", F.sum("bytes").over(by_size))
        .withColumn("load", F.sum("bytes").over(Window.partitionBy("shard")))
        .join(F.broadcast(totals))  # one row
    )
    moved = F.col("given") <= F.col("load") - F.col("mean")
    return with_sums.select(
        (F.col("version") + 1).alias("version"),
        "virtual",
        F.when(moved, F.col("new")).otherwise(F.col("shard")).alias("shard"),
        "bytes",
        "rows",
    )


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with shard and slot, their place in the shard: slots follow each other, rows are ordered inside each."""
    before = Window.partitionBy("shard").orderBy("virtual").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select(
        "virtual", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("virtual").orderBy("id", "crc"))
    return (
        rows.withColumn("inside", inside)
        .join(F.broadcast(starts), "virtual")  # a row per slot
        .withColumn("slot", F.col("before") + F.col("inside") - 1)
        .drop("before", "inside")
    )


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, **columns: str) -> DataFrame:
    """Per document: id, size, crc, virtual, shard, slot."""
    rows = stage_table(sized(docs, slots, **columns), "sized")
    slot_map = stage_table(first_map(slot_sums(rows), shards), "slot_map")
    return place(rows, slot_map)
