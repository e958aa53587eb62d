"""Job registry: append log, latest view, recent jobs, status flags, locations.

The registry is an append log with an increasing ``seq``; the current state of a
job is its newest entry, in the position of its first one.  All views are
aggregates with map-side combine per job, or a top-n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..functions.columns import ColumnOrName, as_col
from ..functions.topn import top_n


def registry_append(
    job_arns: DataFrame, stamp: str | Column, seq: str | Column = "seq", job_type: str | None = None
) -> DataFrame:
    """New log entries: the job columns, the time they were saved, and the job type."""
    stamp = F.lit(stamp) if isinstance(stamp, str) else stamp
    wanted = ("job_arn", "output_bucket", "output_prefix", "aws_region", "input_bucket", "input_prefix")
    have = [F.col(c) if c in job_arns.columns else F.lit(None).cast("string").alias(c) for c in wanted]
    return job_arns.select(
        *have, stamp.alias("timestamp"), F.lit(job_type).cast("string").alias("job_type"), as_col(seq).alias("seq")
    )


def registry_upsert(log: DataFrame, key: str = "job_arn", seq: str = "seq") -> DataFrame:
    """Latest entry per job, with ``position``: the order in which jobs first appeared."""
    entry = F.struct(*[c for c in log.columns if c not in (key, seq)])
    latest = log.groupBy(key).agg(
        F.max_by(entry, F.col(seq)).alias("e"), F.min(seq).alias("position"), F.max(seq).alias(seq)
    )
    return latest.select(key, "e.*", "position", seq)


def registry_recent(states: DataFrame, ts: str = "timestamp", n: int = fixed.RECENT_JOBS) -> DataFrame:
    """The ``n`` newest jobs; equal times keep insertion order."""
    return top_n(states, n, F.coalesce(F.col(ts), F.lit("")).desc(), F.col("position").asc())


def registry_latest(states: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The newest job: at most one row."""
    return registry_recent(states, ts, 1)


def registry_get(states: DataFrame, job_arn: str) -> DataFrame:
    return states.filter(F.col("job_arn") == job_arn)


def job_status(
    status_log: DataFrame, seq: str = "seq", output_uri: str | None = None
) -> DataFrame:
    """Newest status per job with flags; the output location only when completed.

    A log with ``message`` gives the newest one (null or empty: none), one with ``ts`` the times of the first and the
    newest entry.
    """
    state = F.struct(*[c for c in status_log.columns if c not in ("job_arn", seq)])
    times = [F.min_by("ts", F.col(seq)).alias("submit_time")] if "ts" in status_log.columns else []
    now = status_log.groupBy("job_arn").agg(F.max_by(state, F.col(seq)).alias("s"), *times)
    status = F.col("s.status")
    done = status == "Completed"
    hint = (
        F.when(done, "results_ready")
        .when(status == "Failed", "check_configuration")
        .when(status.isin(*fixed.RUNNING_STATUSES), "refresh_later")
        .otherwise("")
    )
    uri = [F.when(done, F.col(f"s.{output_uri}")).alias("output_s3_uri")] if output_uri else []
    return now.select(
        "job_arn",
        status.alias("status"),
        status.isin(*fixed.TERMINAL_STATUSES).alias("is_terminal"),
        (status == "Error").alias("is_error"),
        done.alias("results_ready"),
        hint.alias("hint"),
        *uri,
        *([F.col("s.message").alias("message")] if "message" in status_log.columns else []),
        *([F.col("submit_time"), F.col("s.ts").alias("last_modified")] if times else []),
    )


# ---------------------------------------------------------------- names and locations


def result_locations(jobs: DataFrame, uri: str = "output_s3_uri", arn: str = "job_arn") -> DataFrame:
    """Bucket, prefix and result folder of each job from its output URI."""
    path = F.replace(F.col(uri), F.lit("s3://"), F.lit(""))
    slash = F.instr(path, "/")
    rest = F.when(slash > 0, F.substring(path, slash + 1, F.char_length(path))).otherwise("")
    prefix = F.when((rest == "") | rest.endswith("/"), rest).otherwise(F.concat(rest, F.lit("/")))
    job_id = F.substring_index(F.col(arn), "/", -1)
    return jobs.withColumns(
        {
            "result_bucket": F.substring_index(path, "/", 1),
            "result_root": prefix,
            "job_id": job_id,
            "result_prefix": F.concat(prefix, job_id, F.lit("/")),
        }
    )


def normalize_prefixes(table: DataFrame, *columns: str) -> DataFrame:
    return table.withColumns({c: C.normalize_prefix(c) for c in columns})


def output_uri(bucket: ColumnOrName, prefix: ColumnOrName) -> Column:
    return F.concat(F.lit("s3://"), as_col(bucket), F.lit("/"), F.coalesce(as_col(prefix), F.lit("")))


def request_file_name(modality: ColumnOrName, ts: ColumnOrName) -> Column:
    """``batch-{ts}.jsonl`` for text, ``batch-image-…`` and ``batch-video-…`` for media."""
    m = as_col(modality)
    kind = F.when(m == "text", "batch-").otherwise(F.concat(F.lit("batch-"), m, F.lit("-")))
    return F.concat(kind, as_col(ts).cast("string"), F.lit(".jsonl"))


def job_name(name: ColumnOrName, ts: ColumnOrName) -> Column:
    given = F.nullif(as_col(name), F.lit(""))
    return F.coalesce(given, F.concat(F.lit("batch-job-"), as_col(ts).cast("string")))


def job_names(jobs: DataFrame, name: str = "job_name", modality: str = "modality", ts: str = "ts") -> DataFrame:
    return jobs.withColumns(
        {"job_name": job_name(name, ts), "request_file": request_file_name(modality, ts)}
    )


def output_uris(
    jobs: DataFrame,
    output_bucket: str = "output_bucket",
    output_prefix: str = "output_prefix",
    input_bucket: str = "input_bucket",
    input_prefix: str = "input_prefix",
    request_file: str = "request_file",
) -> DataFrame:
    """Output location, and location of the request file beside its inputs."""
    return jobs.withColumns(
        {
            "output_s3_uri": output_uri(output_bucket, output_prefix),
            "request_s3_uri": F.concat(output_uri(input_bucket, input_prefix), F.col(request_file)),
        }
    )
