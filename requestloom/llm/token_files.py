"""Token ids in binary shard files with a minimal perfect hash index.

A shard file holds, one after the other: a header, the raw ids of its documents (little-endian, two or four bytes each), the
first id of every document, the document keys, and the index.  The index is a minimal perfect hash of the keys: on level
after level, keys that are alone in their bit are settled and the others go on; a key's number is the count of set bits
before its own.  Per number the file keeps a 32-bit fingerprint of the key, the first of its documents and how many there
are, so a lookup takes constant time and foreign keys are refused.

Documents are range-partitioned and sorted by id; each task cuts its stretch into files of a bounded number of ids.
Names carry the task attempt, and a file counts only if the manifest, a table that Spark writes, lists it.  So lost
executors and repeated attempts leave nothing behind but unlisted files.

Null texts have no ids but the end id.  Rows with a null id come first and are read by their position.  Rows that repeat
an id share a key, in the order of their texts.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path, stage_table
from . import common as C
from . import word_tokens as W

#: Ids of a file, beyond which it takes no further document.
SHARD_IDS = 1 << 21
MAGIC = b"IDSHARD1"
HEADER = "<8sIIQQQQ"  # magic, bytes per id, levels, documents, documents with a null key, keys, ids
MANIFEST = "part int, seq int, path string, n_docs bigint, n_ids bigint, first_key bigint, last_key bigint"


def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salted = keys.view(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
    return (C.mixed(salted) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (C.mixed(keys.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct 64-bit keys, from bit arrays alone."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        total = 0
        for bits in levels:
            self.before.append(total + np.cumsum(bits) - bits)
            total += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(64, 2 * len(left))
            at = _at(left, len(levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.int64)
            bits[at[alone]] = 1
            levels.append(bits)
            left = left[~alone]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 where no level settles a key."""
        found = np.full(len(keys), -1, np.int64)
        for level, bits in enumerate(self.levels):
            at = _at(keys, level, len(bits))
            hit = (found < 0) & (bits[at] == 1)
            found[hit] = self.before[level][at[hit]]
        return found


def pack(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A shard file.  ``keys`` are sorted with nulls first; ``ids`` are the documents' ids as bytes."""
    nulls = sum(key is None for key in keys)
    known = np.array(keys[nulls:], "<i8")
    distinct, first, times = np.unique(known, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    numbers = index.numbers(distinct)
    columns = np.zeros((3, len(distinct)), "<u4")
    columns[0, numbers], columns[1, numbers], columns[2, numbers] = fingerprints(distinct), first + nulls, times
    starts = np.concatenate([[0], np.cumsum([len(i) // width for i in ids])]).astype("<u8")
    levels = [struct.pack("<Q", len(bits)) + np.packbits(bits.astype(np.uint8)).tobytes() for bits in index.levels]
    header = struct.pack(HEADER, MAGIC, width, len(levels), len(keys), nulls, len(distinct), int(starts[-1]))
    return b"".join([header, *ids, starts.tobytes(), distinct.tobytes(), columns.tobytes(), *levels])


class ShardFile:
    """Keyed access to a shard file's bytes."""

    def __init__(self, data: bytes):
        magic, width, levels, self.n_docs, self.n_null, n_keys, n_ids = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = struct.calcsize(HEADER)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.ids = take(f"<u{width}", n_ids)
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        self.keys = take("<i8", n_keys)
        self.prints, self.first, self.times = (take("<u4", n_keys) for _ in range(3))
        bits = []
        for _ in range(levels):
            size = int(take("<u8", 1)[0])
            bits.append(np.unpackbits(take("u1", (size + 7) // 8), count=size).astype(np.int64))
        self.index = PerfectHash(bits)

    def document(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]

    def places(self, keys: np.ndarray) -> list[range]:
        """For each key the numbers of its documents; an empty range for keys that are not in the file."""
        numbers = self.index.numbers(keys)
        prints = fingerprints(keys)
        return [
            range(int(self.first[n]), int(self.first[n] + self.times[n])) if n >= 0 and self.prints[n] == p else range(0)
            for n, p in zip(numbers, prints)
        ]

    def get(self, key: int) -> list[np.ndarray]:
        return [self.document(number) for number in self.places(np.array([key], np.int64))[0]]


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def write_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    root: str | None = None,
    shard_ids: int = SHARD_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the documents' ids in ascending order of their ids; returns the manifest, one row per file.

    ``root`` is a folder that all executors reach; by default one in the shared folder.
    """
    spark = docs.sparkSession
    root = root or shared_path(spark, "token_files")
    shared = W.share(spark, tokenizer_path)

    def write(batches):
        import pyarrow as pa

        coder = W.coder(shared)
        width = coder.kind.itemsize
        end = np.array([end_id], coder.kind).tobytes()
        files, folder = _files(root)
        files.create_dir(folder, recursive=True)
        task = TaskContext.get()
        part, attempt, seq = task.partitionId(), f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0
        keys, ids, held = [], [], 0

        def flush():
            nonlocal keys, ids, held, seq
            name = f"part-{part:06d}-{seq:05d}-{attempt}.ids"
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(pack(keys, ids, width))
            known = [key for key in keys if key is not None]
            row = (part, seq, name, len(keys), held, known[0] if known else None, known[-1] if known else None)
            kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
            names = ["part", "seq", "path", "n_docs", "n_ids", "first_key", "last_key"]
            keys, ids, held, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for start, stop in W.slices(batch.num_rows):
                piece = batch.slice(start, stop - start)
                for key, found in zip(piece.column(0).to_pylist(), coder.encode(C.binary_column(piece.column(1)))):
                    if held >= shard_ids:
                        yield flush()
                    keys.append(key)
                    ids.append(found + end)
                    held += len(found) // width + 1
        if keys:
            yield flush()

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions, "id").sortWithinPartitions("id", "text")
    manifest = stage_table(ordered.mapInArrow(write, MANIFEST), "manifest")
    return _with_starts(manifest.withColumn("path", F.concat(F.lit(root + "/"), "path")))


def _with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids of all files before: sums per range on the driver, running sums inside."""
    spark: SparkSession = manifest.sparkSession
    sums = sorted(manifest.groupBy("part").agg(F.sum("n_ids")).collect())  # a row per range partition
    totals = np.cumsum([0, *[n for _, n in sums]])
    before = spark.createDataFrame(
        [(part, int(total)) for (part, _), total in zip(sums, totals)], "part int, before bigint"
    )
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        manifest.join(before, "part")
        .withColumn("base", F.col("before") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
        .drop("before")
    )


def read_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: ``id_col``, start, n_tokens, ids_crc32 (of the ids as 32-bit numbers)."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, name = _files(path)
                with files.open_input_file(name) as source:
                    shard = ShardFile(source.read())
                numbers, keys = list(range(shard.n_null)), [None] * shard.n_null
                for key, places in zip(shard.keys.tolist(), shard.places(shard.keys)):
                    numbers += places
                    keys += [key] * len(places)
                found = [shard.document(number) for number in numbers]
                columns = [
                    pa.array(keys, pa.int64()),
                    pa.array(shard.starts[np.array(numbers, np.int64)] + base),
                    pa.array([len(ids) for ids in found], pa.int64()),
                    pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32"])

    partitions = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        manifest.select("path", "base")
        .repartition(partitions, "path")
        .mapInArrow(read, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )
