"""Near-duplicate documents by 64-bit SimHash, found by multi-index hashing.

A document's fingerprint is the bitwise majority of the XXH64 values of its 3-word shingles, repeats included.  Documents
of one fingerprint are one class.  Two fingerprints link at ``RADIUS`` = 2 differing bits or fewer.

A fingerprint is cut into two segments of 32 bits, each the key of a table.  If two fingerprints differ in two bits at
most, their first segments differ in one bit at most, or their second segments are equal.  So each fingerprint looks up
the ball of radius one around its first segment and the ball of radius zero around its second, and complete distances
of what the tables hold there are verified.  Of two first segments that differ in one bit only the one that has the bit
set looks for the other.

A table entry that holds more than ``CROWD`` fingerprints is not fetched.  All fingerprints that look it up enumerate
their ball of radius one over both segments instead and meet in its members: two fingerprints have such a member in
common exactly if they differ in two bits or fewer, and no member has more than 65 fingerprints around it.  So crowds cost
65 rows a fingerprint, and no link is lost.

Null and empty texts and texts without words have fingerprint zero and link like any other.  Texts of fewer than three
words are one shingle.  Texts of any length are hashed in blocks.  Rows with a null id get their fingerprint and a null
component, and link nothing.  Rows that repeat an id get the component of their own fingerprint.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RADIUS = 2
SHINGLE, SEED = 3, 42
#: Fingerprints of a table entry that are fetched by a lookup.
CROWD = 64
#: Shingles that are held at a time in a task.
BLOCK = 1 << 17


def shingle_values(words: list[bytes]) -> list[np.ndarray]:
    """XXH64 of all runs of ``SHINGLE`` words joined by blanks (fewer words: one run), in blocks of ``BLOCK``."""
    import xxhash

    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    found = []
    for at in range(0, len(starts), BLOCK):
        digests = [xxhash.xxh64_digest(joined[i:j], SEED) for i, j in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        found.append(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64))
    return found


def fingerprints_of(texts: list[bytes | None]) -> np.ndarray:
    """The fingerprints of UTF-8 texts as signed 64-bit numbers."""
    found = np.zeros(len(texts), np.int64)
    held, places, size = [], [], 0

    def settle():
        nonlocal held, places, size
        if held:
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            found[places] = C.majorities(np.concatenate(held), lengths)
        held, places, size = [], [], 0

    for place, text in enumerate(texts):
        words = C.words_of(text)
        if not words:
            continue
        blocks = shingle_values(words)
        if len(blocks) == 1:
            held.append(blocks[0])
            places.append(place)
            size += len(blocks[0])
            if size >= BLOCK:
                settle()
        else:
            ones = sum(C.ones_per_bit(block, np.array([len(block)])).astype(np.int64) for block in blocks)
            majority = 2 * ones > sum(map(len, blocks))
            found[place] = np.packbits(majority, axis=1, bitorder="little").view(np.int64)[0, 0]
    settle()
    return found


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fp) of rows (id, text)."""

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            found = fingerprints_of(C.binary_column(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    return docs.mapInArrow(sign, "id bigint, fp bigint")


FIRST, SECOND = "shiftrightunsigned(fp, 32)", "(fp & 4294967295) + 4294967296"
TABLE = f"array({FIRST}, {SECOND})"
BALLS = (
    f"concat({TABLE}, transform(filter(sequence(0, 31), i -> getbit({FIRST}, i) = 1), i -> {FIRST} - shiftleft(1L, i)))"
)
WHOLE_BALL = "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"


def links(kinds: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``; those of a crowd are as many as its connection takes."""
    entries = C.staged(kinds.select("fp", F.explode(F.expr(TABLE)).alias("key")), "entries")
    crowded = C.staged(
        entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key"), "crowded"
    )
    lookups = kinds.select("fp", F.explode(F.expr(BALLS)).alias("key"))
    near = f"l.fp <> r.fp and bit_count(l.fp ^ r.fp) <= {RADIUS}"
    pair = [F.expr("least(l.fp, r.fp)").alias("a"), F.expr("greatest(l.fp, r.fp)").alias("b")]
    fetched = (
        lookups.alias("l")
        .join(entries.join(crowded, "key", "left_anti").alias("r"), F.expr(f"l.key = r.key and {near}"))
        .select(*pair)
    )
    around = (
        lookups.join(crowded, "key", "left_semi")
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.expr(WHOLE_BALL)).alias("member"))
        .groupBy("member")
        .agg(F.collect_set("fp").alias("held"))  # 65 at most
        .where(F.size("held") > 1)
        .select(F.array_min("held").alias("a"), F.explode("held").alias("b"))
        .where(f"a <> b and bit_count(a ^ b) <= {RADIUS}")
    )
    return C.staged(fetched.unionAll(around).distinct(), "links")


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hexadecimal digits), component_id (smallest id reachable)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = C.staged(fingerprints(narrow), "fingerprints")
    kinds = C.staged(
        signed.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")), "kinds"
    )
    found = C.components(links(kinds.where("first is not null").select("fp")), "simhash").withColumnRenamed("node", "fp")
    grouped = C.staged(
        kinds.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "grouped"
    )
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = C.staged(grouped.join(smallest, "component").select("fp", "times", "component_id"), "named")
    return C.join_hot(signed, named, "fp", "times").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
