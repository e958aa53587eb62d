"""Exact Jaccard join of documents on word 5-grams.

Every document is a set of shingle hashes.  Equal sets are one class.  Two sets of similarity t or more share one of the
``n - ceil(t n) + 1`` first shingles of either, in any order common to all sets; the order puts shingles that many
documents hold last.  Sets that share such a shingle meet in a tile, cut by bands of set size.  A pair of a tile has to
pass the size bound, the bound from the shingle's positions, and the bound from hashed bitmaps (bits of one set that the
other lacks are elements it lacks).  A bitmap of fixed size says little about a set of more elements than it has bits; so
pairs of large sets then meet by wide bitmaps, of one to two bits an element, the larger of two folded to the size of the
smaller.  What is left is compared exactly, as sorted arrays.

Tiles of thousands of near copies are not expanded: each band's members meet its smallest set first, then, where that
leaves several components, a row that differs from tile to tile; afterwards only rows of a tile that are still in
different components meet.

Nulls, empty texts and texts without words: the empty set, linked with nothing, a component of its own.  Rows with a null
id take no part and get a null component.  Rows that repeat an id are one document in the links: the links of each text are those of the id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Similarity as a ratio of whole numbers, so that the comparison is exact.
NUMERATOR, DENOMINATOR = 75, 100
WORDS = 64 // 4  # 64-bit words of a bitmap: 1,024 bits
#: A shingle is put last in the order if it is in 8 or more documents of some block of ``BLOCK`` documents and, counted
#: over all blocks, in one of ``BLOCK`` documents.  There are at most ``BLOCK`` times the mean set size of such
#: shingles, however many documents there are, so they can be broadcast.  They only shape the order.
BLOCK = 4096
IN_BLOCK = 8
#: Shingles of sets that a task hands on at a time.
AT_ONCE = 1 << 19


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the shingles that come last in the order."""

    def count(batches):
        import pyarrow as pa

        held = []

        def full():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= IN_BLOCK
            columns = [pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["key", "n"])

        for batch in batches:
            for text in C.binary_column(batch.column(0)):
                one = C.shingle_hashes(C.words_of(text), size)
                if len(one):
                    held.append(one)
                if len(held) == BLOCK:
                    yield full()
                    held = []
        if held:
            yield full()

    least = max(IN_BLOCK, docs.count() // BLOCK)
    counted = docs.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= least).select("key").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _positions(common: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(values), bool)
    at = np.searchsorted(common, values)
    at[at == len(common)] = 0
    return common[at] == values


def signatures(docs: DataFrame, size: int, common: np.ndarray) -> DataFrame:
    """Per document: id, set size n, digest of the set, bitmap words, wide bitmap (of large sets), and the prefix (once per
    set and batch, never in a row without an id)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    schema = "id bigint, n int, digest binary, bitmap array<bigint>, wide binary, prefix array<bigint>"

    def sign(batches):
        import hashlib

        import pyarrow as pa

        late = shared.value
        for batch in batches:
            seen, out = set(), ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), C.binary_column(batch.column(1))):
                values = C.shingle_hashes(C.words_of(text), size)
                n = len(values)
                digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                bitmap = wide = prefix = None
                if doc is not None and n and digest not in seen:
                    seen.add(digest)
                    bits = np.zeros(64 * WORDS, np.uint8)
                    bits[values & np.uint64(64 * WORDS - 1)] = 1
                    bitmap = np.packbits(bits).view(np.int64)
                    if n > 64 * WORDS:
                        bits = np.zeros(1 << (n - 1).bit_length(), np.uint8)
                        bits[values & np.uint64(len(bits) - 1)] = 1
                        wide = np.packbits(bits).tobytes()
                    keep = n - math.ceil(NUMERATOR * n / DENOMINATOR) + 1
                    last = _positions(late, values)
                    prefix = np.concatenate([values[~last], values[last]])[:keep].view(np.int64).copy()
                for column, value in zip(out, (doc, n, digest, bitmap, wide, prefix)):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            names = ["id", "n", "digest", "bitmap", "wide", "prefix"]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(out, kinds)], names)

    return docs.mapInArrow(sign, schema)


def _sets(docs: DataFrame, size: int, bits: np.ndarray) -> DataFrame:
    """id and sorted shingle hashes of the documents that may be among the members."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches):
        import pyarrow as pa

        def full():
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"]
            )

        for batch in batches:
            chosen = np.flatnonzero(C.may_be_member(shared.value, batch.column(2).to_numpy()))
            ids, sets, held = [], [], 0
            for row in chosen.tolist():
                text = batch.column(1)[row].as_py()
                ids.append(batch.column(0)[row].as_py())
                sets.append(C.shingle_hashes(C.words_of(text.encode() if text else None), size).view(np.int64))
                held += len(sets[-1])
                if held >= AT_ONCE:
                    yield full()
                    ids, sets, held = [], [], 0
            if ids:
                yield full()

    return docs.withColumn("at", F.xxhash64("id")).mapInArrow(read, "id bigint, shingles array<bigint>")


def _common_words(columns: str) -> str:
    return f"(1L * {NUMERATOR} * (l.n + r.n) + {NUMERATOR + DENOMINATOR - 1}) div {NUMERATOR + DENOMINATOR} <= {columns}"


#: Size bound, and at most what follows the shared shingle in either set.
SIZES = (
    f"1L * l.n * {DENOMINATOR} >= 1L * r.n * {NUMERATOR} and 1L * r.n * {DENOMINATOR} >= 1L * l.n * {NUMERATOR} and "
    + _common_words("least(l.n - l.pos, r.n - r.pos)")
)


def _lacks(one: str, other: str) -> str:
    return " + ".join(f"bit_count({one}.b{i} & ~{other}.b{i})" for i in range(WORDS))


#: Each bit of one set that the other lacks stands for an element or more that the other lacks.
BITMAPS = _common_words(f"least(l.n - ({_lacks('l', 'r')}), r.n - ({_lacks('r', 'l')}))")


def least_common(n: int, m: int) -> int:
    """How many elements two sets of these sizes have in common at least if they link."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def wide_bitmaps_allow(one: bytes, other: bytes, n: int, m: int) -> bool:
    """Whether sets of n and m elements with these wide bitmaps may link."""
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    lacks_x, lacks_y = int(np.bitwise_count(y & ~x).sum()), int(np.bitwise_count(x & ~y).sum())
    return least_common(n, m) <= min(n - lacks_y, m - lacks_x)


def _allowed_wide(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs that wide bitmaps allow; those without a wide bitmap on both sides pass."""
    wide = words.where("wide is not null").select("id", "n", "wide")
    met = pairs.join(wide.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("x")), "a", "left")
    met = met.join(wide.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("y")), "b", "left")

    def allow(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(2, 6)]
            keep = [
                x is None or y is None or wide_bitmaps_allow(x, y, n, m) for n, m, x, y in zip(*columns)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "na", "nb", "x", "y").mapInArrow(allow, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs that link, by exact intersection of sorted arrays."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _sets(docs, size, C.member_bits(ids, "id"))
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x = batch.column(2)[i].values.to_numpy()
                y = batch.column(3)[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """One row per document: ``id_col``, n_shingles (long), component_id (smallest id reachable by links)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = C.staged(signatures(docs, size, common_shingles(docs.select("text"), size)), "signed")
    classes = C.staged(
        signed.where("n > 0 and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("class_id"), F.min(F.when(F.col("prefix").isNotNull(), F.col("id"))).alias("holder")),
        "classes",
    )
    # One row per set; its node is the smallest id of the class, whose text gives the same set.
    held = signed.where("prefix is not null").join(
        classes.select("digest", "class_id", F.col("holder").alias("id")), ["digest", "id"]
    )
    rows = held.select(F.col("class_id").alias("id"), "n", F.posexplode("prefix").alias("pos", "key"))
    tiles = C.cut_tiles(rows.select("key", "id", "n", "pos"), "tiles").withColumn(
        "band", F.expr(f"cast(floor(ln(n) / ln({DENOMINATOR} / {NUMERATOR})) as int)")
    )
    words = C.staged(
        held.select(
            F.col("class_id").alias("id"), *[F.col("bitmap")[i].alias(f"b{i}") for i in range(WORDS)], "n", "wide"
        ),
        "bitmaps",
    )
    narrow = words.drop("wide")

    def with_bitmaps(pairs: DataFrame) -> DataFrame:
        met = (
            pairs.join(narrow.alias("l"), F.expr("a = l.id"))
            .join(narrow.alias("r"), F.expr("b = r.id"))
            .where(BITMAPS)
        )
        return with_wide(met.select("a", "b").distinct())

    def with_wide(pairs: DataFrame) -> DataFrame:
        return C.staged(_allowed_wide(C.staged(pairs, "pairs"), words), "wide_pairs")

    first = with_bitmaps(C.star_pairs(tiles, ["n"], ["n", "pos"], SIZES, ["band", "piece"]))
    links = C.staged(_verified(first, docs, size), "links")
    # Where a tile's smallest set left several components, another row leads, in each tile a different one: a crowd whose
    # members are similar to some of the others grows together before pairs are tried.
    opened = C.open_tiles(tiles, C.components(links, "star")).withColumn("turn", F.xxhash64("id", "key"))
    other = f"{SIZES} and l.component <> r.component"
    middle = with_bitmaps(C.star_pairs(opened, ["turn"], ["turn", "n", "pos", "component"], other, ["piece"]))
    links = links.unionAll(C.staged(_verified(middle, docs, size), "links"))
    opened = C.open_tiles(tiles, C.components(links, "star")).join(narrow.drop("n"), "id")
    second = with_wide(C.cross_pairs(opened, f"{SIZES} and {BITMAPS}"))
    links = links.unionAll(C.staged(_verified(second, docs, size), "links"))
    found = C.components(links, "all").withColumnRenamed("node", "class_id")
    named = classes.select("digest", "class_id").join(found, "class_id", "left")
    return (
        signed.select("id", "n", "digest")
        .join(named, "digest", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("id").isNull(), None)
            .otherwise(F.coalesce("component", "class_id", "id"))
            .alias("component_id"),
        )
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that link, directly or by others, with one of a smaller id.

    Rows with a null id stay.  Of rows that repeat an id all stay that have a text of the kept kind.
    """
    found = similar_documents(docs, id_col, text_col)
    gone = C.staged(found.where(f"component_id <> {id_col}").select(id_col).distinct(), "copies")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
