"""Line sources: request files, result files, run manifests.

``read_lines`` keeps where a line came from.  (file, block start, row id) sorts
the lines of one scan into file order without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import columns as C
from ..functions import jsonl as J
from ..functions.topn import top_n

LINE_ORDER = ["file_path", "block_start", "row_id"]


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines ended by ``\\n`` only, with their place in file order."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("line"),
    )


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All lines of result files; limit them with ``preview_results`` if only a few are wanted."""
    return read_lines(spark, paths)


def request_rows(lines: DataFrame, col: str = "line") -> DataFrame:
    """Record id and ``modelInput`` JSON of ready request lines.

    ``model_input`` is null for a line that is not one valid JSON object in UTF-8.
    """
    text = C.strip_line(col)
    good = (F.col("_h.h") == F.xxhash64(text)) & F.is_valid_utf8(col)
    opened = lines.filter(~C.is_blank(col)).withColumn("_h", J.request_head(text))
    rid = F.coalesce(F.try_variant_get("_h.r.recordId", "$", "string"), F.lit("unknown"))
    others = [c for c in lines.columns if c != col]
    return opened.select(
        *others,
        F.when(good, rid).alias("record_id"),
        F.when(good, J.request_body(text)).alias("model_input"),
        F.col(col).alias("value"),
    )


def read_requests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Ready JSONL request files as request rows."""
    return request_rows(read_lines(spark, paths))


def request_rejects(rows: DataFrame, col: str = "value") -> DataFrame:
    """Request rows that cannot be used, with the reason; every other row has a ``model_input``."""
    reason = F.when(F.is_valid_utf8(col), "malformed_json").otherwise("malformed_text")
    return rows.filter(F.col("model_input").isNull()).withColumn("reason", reason)


def rejected_as_results(rejects: DataFrame) -> DataFrame:
    """An error line for each rejected request line, so that run totals count it."""
    error = F.struct(
        F.lit(400).alias("errorCode"), F.col("reason").alias("errorMessage"), F.lit(False).alias("retryable")
    )
    return rejects.select(F.to_json(F.struct(F.lit("unknown").alias("recordId"), error.alias("error"))).alias("value"))


def first_request(lines: DataFrame, order: list[str] = LINE_ORDER, col: str = "line") -> DataFrame:
    """The first request of a file: a top-1, not a full read into memory."""
    return request_rows(top_n(lines.filter(~C.is_blank(col)), 1, *order), col)


def read_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Run totals, one row per manifest file; an unreadable document gives null totals."""
    return (
        spark.read.schema(schemas.MANIFEST)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(paths)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )
