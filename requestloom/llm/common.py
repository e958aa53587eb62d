"""What several operators share: tables, per-process caches, membership bits, word hashes, connected components."""

from __future__ import annotations

import gc
import sys
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table

#: Bits of a membership filter at most: 16 MB, whatever the number of ids.
MEMBER_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(key, make: Callable[[], object]):
    """A value made once per Python process and kept for its later tasks, until another one is asked for.

    Functions reach the tasks by value, with globals of their own, so the place is an attribute of ``sys``.  Processes
    outlive the steps that they work for, and each step's store may hold hundreds of megabytes, so there is one at a time.
    """
    kept = sys.__dict__.setdefault("_requestloom_kept", {})
    if key not in kept:
        if kept:
            kept.clear()
            gc.collect()  # stores that compute by a method of what holds them
        kept[key] = make()
    return kept[key]


#: Keys of more characters or bytes are not remembered, so that stores bounded by a number are bounded in bytes too.
LONGEST_KEPT = 128


class Bounded(dict):
    """A dict that computes missing values and starts afresh when it holds ``most`` of them."""

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) > LONGEST_KEPT:
            return value
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


def free_name(columns: list[str], base: str) -> str:
    """``base``, with as many underscores after it as no column has."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words.  Hashing each anew is quicker than any memory of them."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case."""
    return text.lower().split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def shingle_hashes(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; fewer words count as one run."""
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    k = min(size, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(k))
        for i in range(k):
            total = mixed(total ^ h[i : i + n]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(total)


def _spread_bytes() -> np.ndarray:
    """For each byte a 64-bit word whose eight bytes are the byte's bits, lowest first."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def ones_per_bit(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run of hashes (none of them empty) and each of 64 bits, how many hashes have the bit set.

    Bits are counted in bytes, so hashes are summed in runs of at most 255 and the runs are added up.
    """
    runs = (lengths + 254) // 255
    first_run = np.cumsum(runs) - runs
    within = np.arange(int(runs.sum())) - np.repeat(first_run, runs)
    starts = np.repeat(np.cumsum(lengths) - lengths, runs) + 255 * within
    spread, octets = per_process("spread bytes", _spread_bytes), values.view(np.uint8).reshape(-1, 8)
    in_runs = np.stack([np.add.reduceat(spread[octets[:, i]], starts) for i in range(8)], axis=1)
    in_runs = in_runs.view(np.uint8).reshape(-1, 64)
    ones = in_runs if len(in_runs) == len(lengths) else np.add.reduceat(in_runs, first_run, axis=0, dtype=np.int32)
    return ones.astype(np.int32)


def majorities(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashed features (none of them empty): bit i is the majority of the hashes' bits i."""
    majority = 2 * ones_per_bit(values, lengths) > lengths[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view(np.int64).ravel()


def binary_column(column) -> list:
    """The UTF-8 bytes of a string column of an Arrow batch; None where it is null."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def cut_batches(batches, rows: int):
    """Arrow batches of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def crc_of_id(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def staged(rows: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``stage_table``, after which the shuffle files that led to the table are given up.

    Spark removes them when the driver's collector finds nobody holding them, which a driver with a small heap and long
    jobs may leave undone for hours; so it is asked to look.
    """
    table = stage_table(rows, label, compression)
    gc.collect()
    rows.sparkSession.sparkContext._jvm.System.gc()
    return table


# ---------------------------------------------------------------- membership


def member_bits(ids: DataFrame, column: str, hashed: bool = False) -> np.ndarray:
    """A bit per hash of the ids (which are ``xxhash64`` of them, or they themselves if they are hashes), at most ``MEMBER_BITS``: tells surely which ids are *not* among them.

    Only a filter in front of an exact join.  When it fills up it lets everything pass.  What reaches the driver are
    bitmaps of a fixed total size, never ids.
    """
    count = ids.count()
    bits = 1 << 16
    while bits < 16 * count and bits < MEMBER_BITS:
        bits *= 2
    hashes = F.col(column) if hashed else F.xxhash64(F.col(column).cast("long"))
    at = F.pmod(hashes, F.lit(bits))
    rows = (
        ids.select(at.alias("at"))
        .groupBy(F.expr("at div 32768").alias("part"))
        .agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bitmap"))
        .collect()
    )
    found = np.zeros(bits // 8, np.uint8)
    for part, bitmap in rows:
        found[part * 4096 : (part + 1) * 4096] = np.frombuffer(bytes(bitmap), np.uint8)
    return found


def may_be_member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For hashes as in ``member_bits``: False means the id is not among them."""
    at = hashes.astype(np.int64) % np.int64(len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------- components


def components(links: DataFrame, label: str) -> DataFrame:
    """Connected components of links (a, b): rows (node, component), component being its smallest node.

    Every round lets each node join its smallest neighbour and contracts the links, which at least halves the nodes
    left.  Rounds are written to the shared folder, so a lost executor costs one round at most.
    """
    spark = links.sparkSession
    edges = staged(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    rounds = []
    while edges.limit(1).count():
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = staged(
            ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")),
            "joined",
        )
        rounds.append(joined)
        left = joined.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = joined.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = staged(
            edges.join(left, "a")
            .join(right, "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct(),
            "edges",
        )
    if not rounds:
        return spark.createDataFrame([], "node bigint, component bigint")
    found = rounds[0].select("node", F.col("to").alias("component"))
    for joined in rounds[1:]:
        step = joined.select(F.col("node").alias("component"), "to")
        found = found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return found


# ---------------------------------------------------------------- candidate pairs from tiles

#: Rows of a tile that are compared with each other in one piece; larger tiles are cut into pieces.
PIECE = 4096


def shared_tiles(rows: DataFrame) -> DataFrame:
    """Rows (key, id, ...) whose key occurs more than once, with the piece of their tile."""
    from pyspark.sql import Window

    return (
        rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key")))
        .where("m > 1")
        .withColumn("pieces", F.expr(f"cast(ceil(m / {PIECE}) as int)"))
        .withColumn("piece", F.expr("cast(pmod(xxhash64(id), pieces) as int)"))
        .drop("m")
    )


def cut_tiles(rows: DataFrame, label: str) -> DataFrame:
    """``shared_tiles``, written to the shared folder."""
    return staged(shared_tiles(rows), label)


def star_pairs(tiles: DataFrame, order: list[str], carried: list[str], may_link: str, groups: list[str]) -> DataFrame:
    """Pairs of each tile's first row with its others, and of first rows of the same key with each other.

    ``may_link`` is SQL over two rows ``l`` and ``r``.  The first rows are minima, so they are found before the shuffle.
    """
    head = F.min(F.struct(*order, "id", *[c for c in carried if c not in order])).alias("head")
    heads = tiles.groupBy("key", *groups).agg(head)
    tops = heads.groupBy("key").agg(F.min("head").alias("top"))
    columns = ["id", *carried]
    members = tiles.alias("r").join(
        heads.select("key", *groups, *[F.col(f"head.{c}").alias(c) for c in columns]).alias("l"),
        (F.expr(" and ".join(f"l.{c} = r.{c}" for c in ["key", *groups]))) & F.expr("l.id <> r.id") & F.expr(may_link),
    )
    leaders = (
        heads.select("key", *[F.col(f"head.{c}").alias(c) for c in columns])
        .alias("r")
        .join(
            tops.select("key", *[F.col(f"top.{c}").alias(c) for c in columns]).alias("l"),
            F.expr("l.key = r.key and l.id <> r.id") & F.expr(may_link),
        )
    )
    pair = [F.expr("least(l.id, r.id)").alias("a"), F.expr("greatest(l.id, r.id)").alias("b")]
    return members.select(*pair).unionAll(leaders.select(*pair)).distinct()


def open_tiles(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of tiles that still hold more than one component, with their component."""
    with_component = tiles.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    mixed_keys = (
        with_component.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("key")
    )
    return with_component.join(mixed_keys, "key", "left_semi")


def cross_pairs(rows: DataFrame, may_link: str, part: Column | None = None) -> DataFrame:
    """All pairs of rows of a tile that are in different components, piece by piece.

    With ``part``, a condition on a row, only the pairs whose first row is of that part: the parts' pairs together are all,
    and one that two tiles hold comes in one part unless a tile of several pieces turns it round.
    """
    first = rows if part is None else rows.where(part)
    first = first.withColumn("i", F.col("piece")).withColumn("j", F.expr("explode(sequence(piece, pieces - 1))"))
    second = rows.withColumn("j", F.col("piece")).withColumn("i", F.expr("explode(sequence(0, piece))"))
    met = first.alias("l").join(
        second.alias("r"),
        F.expr("l.key = r.key and l.i = r.i and l.j = r.j and l.component <> r.component and (l.i < l.j or l.id < r.id)")
        & F.expr(may_link),
    )
    return met.select(
        F.expr("least(l.id, r.id)").alias("a"), F.expr("greatest(l.id, r.id)").alias("b")
    ).distinct()


# ---------------------------------------------------------------- hot keys

#: A key is hot if it holds one of ``HOT`` rows or more.  There are ``HOT`` such keys at most, so they can be broadcast.
HOT = 1000


def join_hot(rows: DataFrame, found: DataFrame, key: str, times: str) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row per key (a null one counts) and, in ``times``, the number
    of rows of the key.

    Rows of hot keys meet a broadcast of at most ``HOT`` rows of ``found`` where they are; only the others are shuffled.
    Both should be written tables, since they are read twice.
    """
    total = found.agg(F.sum(times)).first()[0] or 0
    hot = F.broadcast(found.where(F.col(times) * HOT >= total))
    cold = found.where(F.col(times) * HOT < total)
    same = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    columns = [F.col(f"l.`{c}`") for c in rows.columns] + [F.col(f"r.`{c}`") for c in found.columns if c not in (key, times)]
    left = rows.alias("l")
    at_home = left.join(hot.alias("r"), same).select(*columns)
    moved = left.join(hot.alias("r"), same, "left_anti").alias("l").join(cold.alias("r"), same).select(*columns)
    return at_home.unionAll(moved)
