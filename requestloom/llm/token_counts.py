"""Token counts with a digest cache.

The cache is a table (content digest, tokenizer digest, n_tokens) in the shared folder.  Where the tokenizer drops white
space, content is normalised (runs of ASCII white space become one blank, which leaves its tokens as they are) before its
digest is taken; the tokenizer's digest is that of its file.  Documents are joined to the stored counts; each distinct content that is missing is encoded
once, and the new counts are appended.

Copies are dropped inside the tasks before texts are shuffled, so a hot content costs a row per task.  Null texts count
as empty.  Rows are counted one by one; repeated rows and ids give repeated rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from . import common as C
from . import word_tokens as W

CACHE = "content binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def normal_content(text: bytes | None, drops_white: bool) -> bytes:
    return (b" ".join(text.split()) if drops_white else text) if text else b""


def content_digest(normal: bytes) -> bytes:
    return hashlib.blake2b(normal, digest_size=16).digest()


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The stored counts; of repeated entries (two runs at a time may append the same) one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache_dir).dropDuplicates(["content", "tokenizer"])


def _digests(docs: DataFrame, drops_white: bool) -> DataFrame:
    """id, n_bytes and content digest of each document."""
    kind = docs.schema["id"].dataType.simpleString()

    def digest(batches):
        import pyarrow as pa

        for batch in batches:
            texts = C.binary_column(batch.column(1))
            sizes = pa.array([len(t) if t else 0 for t in texts], pa.int64())
            found = pa.array([content_digest(normal_content(t, drops_white)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, found], ["id", "n_bytes", "content"])

    return docs.mapInArrow(digest, f"id {kind}, n_bytes bigint, content binary")


def _distinct_contents(docs: DataFrame, drops_white: bool) -> DataFrame:
    """(content, text): every distinct content once per task."""

    def read(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            contents, texts = [], []
            for text in C.binary_column(batch.column(1)):
                normal = normal_content(text, drops_white)
                content = content_digest(normal)
                if content not in seen:
                    seen.add(content)
                    contents.append(content)
                    texts.append(normal)
            columns = [pa.array(contents, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["content", "text"])

    return docs.mapInArrow(read, "content binary, text string")


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_dir: str | None = None,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: ``id_col``, n_bytes (long, UTF-8), n_tokens (long), over_limit (n_tokens > limit).

    Counts are those of the tokenizers library without added special tokens.  ``cache_dir`` is a folder all executors
    reach, and in which later runs find the counts again; without one the run has a cache of its own in the shared folder.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_dir = cache_dir or shared_path(spark, "token_counts")
    with open(tokenizer_path, encoding="utf-8") as lines:
        drops_white = W.chunked(lines.read())
    shared = W.share(spark, tokenizer_path)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stored = read_cache(spark, cache_dir).where(F.col("tokenizer") == version)

    def encode(batches):
        import pyarrow as pa

        coder, seen = W.coder(shared), set()
        for batch in batches:
            contents, texts = batch.column(0).to_pylist(), C.binary_column(batch.column(1))
            fresh = [i for i, c in enumerate(contents) if not (c in seen or seen.add(c))]
            counts = []
            for start, end in W.slices(len(fresh)):
                found = coder.encode([texts[i] for i in fresh[start:end]])
                counts += [len(ids) // coder.kind.itemsize for ids in found]
            columns = [
                pa.array([contents[i] for i in fresh], pa.binary()),
                pa.array([version] * len(fresh), pa.string()),
                pa.array(counts, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["content", "tokenizer", "n_tokens"])

    missing = _distinct_contents(docs, drops_white).join(stored, "content", "left_anti").select("content", "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    missing.repartition(partitions, "content").mapInArrow(encode, CACHE).write.mode("append").parquet(cache_dir)
    counts = read_cache(spark, cache_dir).where(F.col("tokenizer") == version).select("content", "n_tokens")
    return (
        _digests(docs, drops_white)
        .join(counts, "content")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
