"""Registry source: JSON documents that map a job id to its entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from .. import schemas
from ..session import stage_table
from . import json_ranges as J
from .stores import ArrowStore


def registry_rows(documents: DataFrame, col: str = "value", seq: str | None = None) -> DataFrame:
    """One row per entry of each document, with its position in the document.

    A document that cannot be read gives no rows.
    """
    entries = F.map_entries(F.from_json(F.col(col), f"map<string,struct<{_struct()}>>"))
    extra = [seq] if seq else []
    return documents.select(*extra, F.posexplode(entries).alias("seq_in_doc", "entry")).select(
        *extra, "seq_in_doc", F.col("entry.key").alias("job_key"), "entry.value.*"
    )


def _struct() -> str:
    return schemas.REGISTRY_ENTRY.replace(" string", ":string")


def read_registry(spark: SparkSession, path: str, store=None, range_bytes: int = J.RANGE_BYTES) -> DataFrame:
    """Entries of a registry, a JSON object in one file or in a folder of parts, with their position.

    A missing or unreadable document is an empty registry.  Byte ranges are cut into entries by many tasks, see
    ``json_ranges``.  A job id that is repeated has a row for each time; ``registry_upsert`` keeps the last.  Where neither
    ``store`` is given nor pyarrow knows the scheme, the document is read whole by one task.
    """
    if store is None and not ArrowStore.knows(path):
        return _read_whole(spark, path)
    empty = spark.createDataFrame([], "value string")
    parts = J.document_parts(spark, path, store)
    entries = J.object_entries(J.document_ranges(parts, range_bytes), store)
    if entries is None:
        return registry_rows(empty)
    text = F.concat(F.lit("{"), F.col("entry"), F.lit("}"))
    kind = F.from_json(text, f"map<string,struct<{_struct()}>>", {"allowSingleQuotes": "false"})
    rows = stage_table(entries.select("seq_in_doc", "entry", F.map_entries(kind).alias("found")), "registry")
    blank = rows.filter(F.btrim("entry", F.lit(" \t\r\n")) == "").limit(2).count()
    if rows.filter(F.coalesce(F.size("found"), F.lit(0)) != 1).limit(1).count():
        if not blank or rows.limit(2).count() > 1:  # an object without entries has one blank piece
            return registry_rows(empty)
        rows = rows.limit(0)
    one = F.col("found")[0]
    return rows.select(F.col("seq_in_doc").cast("int").alias("seq_in_doc"), one["key"].alias("job_key"), one["value"].alias("v")).select(
        "seq_in_doc", "job_key", "v.*"
    )


def _read_whole(spark: SparkSession, path: str) -> DataFrame:
    try:
        documents = spark.read.text(path, wholetext=True)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in (problem.getCondition() or ""):
            raise
        documents = spark.createDataFrame([], "value string")
    return registry_rows(documents)
