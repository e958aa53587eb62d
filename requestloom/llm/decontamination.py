"""Benchmark decontamination: short test items inside long documents.

Documents and items are sets of word 5-grams.  Documents are parted by set size in powers of two.  A document's MinHash
signature has eight to sixteen bins per shingle of its size class: a hash belongs to the bin of its leading bits, and each
bin keeps its smallest and its largest hash.  The number of bins follows the size, so the signature keeps nearly all hashes
and an item's shingle is hidden behind others of its bin with a chance of one to three in a thousand, in long documents as
in short ones; a contained item is missed only if all its shingles are.  Documents that share a signature hash with an item are candidates; they are
verified by exact containment of shingle texts, with a share of ``THRESHOLD`` of the item's shingles or more.

Words are split at ASCII white space, in lower case.  A text of fewer than five words is one shingle, so short items are
found only in equal texts.  Null and empty texts hold nothing.  Documents with a null id are not searched; rows that
repeat an id are one document, and the largest share counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

THRESHOLD = 0.75
#: Shingles of items that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def words(text: str) -> Column:
    return F.expr(rf"filter(split(lower({text}), '[ \\t-\\r]+'), w -> w <> '')")


def shingle_hashes(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Rows with ``out``: the distinct 64-bit hashes of the text's shingles, sorted."""
    return (
        rows.withColumn("_words", F.transform(words(text), lambda w: F.xxhash64(w)))
        .withColumn(
            out,
            F.expr(
                "sort_array(array_distinct(case when size(_words) >= 5 then transform(sequence(0, size(_words) - 5), i ->"
                " xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4]))"
                " when size(_words) > 0 then array(xxhash64(_words)) else cast(array() as array<bigint>) end))"
            ),
        )
        .drop("_words")
    )


def shingle_texts(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Rows with ``out``: the distinct shingles of the text."""
    return (
        rows.withColumn("_words", words(text))
        .withColumn(
            out,
            F.expr(
                "array_distinct(case when size(_words) >= 5 then"
                " transform(sequence(0, size(_words) - 5), i -> array_join(slice(_words, i + 1, 5), ' '))"
                " when size(_words) > 0 then array(array_join(_words, ' ')) else cast(array() as array<string>) end)"
            ),
        )
        .drop("_words")
    )


def signature(hashes: str) -> Column:
    """The smallest and the largest hash of each bin of a sorted array of hashes."""
    shift = f"(61 - cast(ceil(log2(size({hashes}))) as int))"
    bin_of = f"shiftrightunsigned({hashes}[{{}}], {shift})"
    return F.expr(
        f"filter({hashes}, (x, i) -> i = 0 or i = size({hashes}) - 1"
        f" or shiftrightunsigned(x, {shift}) <> {bin_of.format('i - 1')}"
        f" or shiftrightunsigned(x, {shift}) <> {bin_of.format('i + 1')})"
    )


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) that share a hash of the document's signature."""
    wanted = stage_table(
        shingle_hashes(items, "text", "hashes")
        .select("item_id", F.explode_outer("hashes").alias("hash"))
        .where("hash is not null"),
        "items",
    )
    if wanted.count() <= BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)
    # The outer form: for the plain one the optimizer adds a filter on the generated array and moves it below the
    # hashes, where each of its steps would compute all hashes anew.
    signed = shingle_hashes(docs, "text", "hashes").select(
        "doc_id", F.explode_outer(signature("hashes")).alias("hash")
    )
    return stage_table(signed.join(wanted, "hash").select("doc_id", "item_id").distinct(), "candidates")


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document and item that it contains: doc_id, item_id, n_item, n_shared (shingles), containment."""
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    found = candidates(docs, items)
    wanted = shingle_texts(items, "text", "item").select("item_id", "item")
    # The candidates are a written table: Spark broadcasts it if it is small, and else shuffles both sides.
    texts = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    held = shingle_texts(texts, "text", "held").select("doc_id", "held")
    return (
        found.join(wanted, "item_id")
        .join(held, "doc_id")
        .select(
            "doc_id",
            "item_id",
            F.size("item").cast("long").alias("n_item"),
            F.size(F.array_intersect("item", "held")).cast("long").alias("n_shared"),
        )
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .groupBy("doc_id", "item_id")  # texts that repeat an id of either table: the pair that contains most
        .agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("best"))
        .select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")
        .where(F.col("containment") >= threshold)
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no item."""
    found = stage_table(contained_items(docs, benchmark, id_col, text_col).select("doc_id").distinct(), "contaminated")
    return docs.alias("l").join(found.alias("r"), F.col(f"l.{id_col}") == F.col("r.doc_id"), "left_anti")
