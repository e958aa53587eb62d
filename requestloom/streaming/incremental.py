"""Incremental forms of the request sink and of the result reader.

The batch operators are narrow, so they take a streaming table as it is.  The
file source keeps its own log of handled files and the file sinks commit per
micro-batch, so a restarted query neither repeats nor loses a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.results import parse_results


def stream_result_lines(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Result lines of files appearing in a folder, a bounded number of files per step."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files).option("lineSep", "\n")
    return reader.text(folder).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))


def append_results(lines: DataFrame, table_uri: str, log_uri: str) -> StreamingQuery:
    """Parse arriving lines into a growing table; handles what is there, then stops."""
    return (
        parse_results(lines)
        .writeStream.format("parquet")
        .option("checkpointLocation", log_uri)
        .option("path", table_uri)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def append_requests(requests: DataFrame, uri: str, log_uri: str) -> StreamingQuery:
    """Append request lines (column ``value``) to a folder as their objects arrive."""
    return (
        requests.select("value")
        .writeStream.format("text")
        .option("checkpointLocation", log_uri)
        .option("path", uri)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
