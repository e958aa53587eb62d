"""The whole flow behind one object: prepare, run, remember, look at results.

Buckets are folders below a root that every executor can read and write; keys
are paths inside a bucket.  Each method plans Spark jobs over the operators of
this package; the driver only ever holds a handful of job-level values.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas
from .functions import columns as C
from .functions import fixed
from .functions.topn import top_n
from .operators import infer as I
from .operators import models as M
from .operators import objects as O
from .operators import progress as G
from .operators import registry as R
from .operators import requests as Q
from .operators import results as P
from .operators import rules as V
from .session import configure
from .sources import heads as H
from .sources import lines as L
from .sources import listing as T
from .sources import objects as S
from .sources import sinks as K
from .sources.commits import CommitLog
from .sources.stores import ArrowStore

JOB_LOG = (
    "job_arn string, output_bucket string, output_prefix string, aws_region string, input_bucket string, "
    "input_prefix string, timestamp string, job_type string, job_name string, model_id string, seq bigint"
)
PROGRESS_LOG = "entry string, job_arn string, step string, metric string, value bigint, seq bigint"
STATUS_LOG = "job_arn string, status string, output_s3_uri string, message string, ts string, seq bigint"

#: Parts of the request files that this engine writes, and the end that parts of result files add to the file's name.
REQUEST_PART = r"\.jsonl/part-[^/]*\z"
RESULT_PART = r"(?<=\.out)/part-[^/]*\z"


class BatchEngine:
    def __init__(self, spark: SparkSession, root: str, region: str = "us-east-1", store=None):
        """``store`` lets tasks list and open objects below ``root`` (see ``sources.stores``); where none is given and
        pyarrow does not know the root's scheme either, Spark's own sources do it."""
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self.region = region
        self.store = store or (ArrowStore() if ArrowStore.knows(self.root) else None)
        self._jobs = CommitLog(spark, f"{self.root}/_registry/jobs", JOB_LOG, "job_arn")
        self._statuses = CommitLog(spark, f"{self.root}/_registry/status", STATUS_LOG, "job_arn")
        self._progress = CommitLog(spark, f"{self.root}/_registry/progress", PROGRESS_LOG, "entry")

    # ------------------------------------------------------------ places

    def place(self, bucket: str, key: str = "") -> str:
        return f"{self.root}/{bucket}/{key}"

    def place_of_uri(self, uri: str) -> str:
        return f"{self.root}/" + uri.replace("s3://", "")

    @staticmethod
    def normalize_prefix(prefix: str | None) -> str:
        bare = (prefix or "").lstrip("/")
        return bare + "/" if bare and not bare.endswith("/") else bare

    def _as_keys(self, files: DataFrame, bucket: str) -> DataFrame:
        """File URIs of a scan as keys inside the bucket."""
        marker = self.place(bucket).split("://", 1)[-1].lstrip("/")
        at = F.instr("file_path", marker)
        outside = F.raise_error(F.concat(F.lit(f"not below {marker}: "), F.col("file_path")))
        start = F.when(at > 0, at).otherwise(outside.cast("int")) + len(marker)
        return files.withColumn("file_path", F.substring("file_path", start, F.char_length("file_path")))

    # ------------------------------------------------------------ input

    def _listed(self, bucket: str, prefix: str) -> DataFrame:
        """Keys below a prefix, taken as plain text: listed by the tasks, from the deepest folder of the prefix on."""
        if self.store is None:
            return self._as_keys(S.scan_objects(self.spark, self.place(bucket)), bucket)
        return T.list_tree(self.spark, self.place(bucket), prefix, self.store, hidden=False)

    def list_input_files(self, bucket: str, prefix: str = "") -> DataFrame:
        """Valid objects whose key starts with the prefix, as typed.

        The parts of request files that this engine wrote beside its input are no objects.
        """
        files = self._listed(bucket, prefix).filter(~F.col("file_path").rlike(REQUEST_PART))
        return O.list_objects(files, prefix)

    def preview_files(self, bucket: str, prefix: str = "") -> DataFrame:
        return O.describe(self.list_input_files(bucket, prefix))

    def read_file_content(self, bucket: str, key: str) -> DataFrame:
        return S.read_text_objects(self.spark, self.place(bucket, key), on_error="fail").select("content")

    def download_and_encode_image(self, bucket: str, key: str) -> DataFrame:
        files = S.read_binary_objects(self.spark, self.place(bucket, key))
        return files.select(C.base64_text("content").alias("data"))

    def _prepare(self, modality: str, bucket: str, prefix: str, model_id: str, batch_ts: int | None, **choices) -> Q.Batch:
        """A batch of the objects below a prefix; what cannot be read or is too large is rejected."""
        listed = self.list_input_files(bucket, prefix)
        O.require_nonempty(listed, modality, bucket, prefix)
        choices["batch_ts"] = int(time.time()) if batch_ts is None else batch_ts
        if self.store is not None:
            return Q.prepare_listed_batch(listed, self.place(bucket), modality, model_id, store=self.store, **choices)
        limit = C.max_raw_bytes(fixed.MAX_BASE64[modality]) if modality in fixed.MAX_BASE64 else None
        files = self._as_keys(S.read_binary_objects(self.spark, self.place(bucket), limit), bucket)
        files = files.filter(~F.col("file_path").rlike(REQUEST_PART))
        files = O.route(O.valid_objects(O.under_prefix(files, prefix), prefix), modality)
        batch = Q.prepare_batch(files, modality, model_id, **choices)
        if limit is None:
            return batch
        # the oversized files were left out of the content scan: report them from the listing
        oversized = Q.split_by_payload(O.route(listed, modality), modality)[1]
        return Q.Batch(batch.requests, batch.rejects.unionByName(oversized), batch.rows)

    # ------------------------------------------------------------ request preparation

    def prepare_batch_data(
        self,
        bucket: str,
        prefix: str,
        prompt: str,
        model_id: str,
        max_tokens: int = fixed.TEXT_MAX_TOKENS,
        temperature: float = fixed.TEXT_TEMPERATURE,
        batch_ts: int | None = None,
        on_error: str = "reject",
    ) -> Q.Batch:
        choices = {"prompt": prompt, "max_tokens": max_tokens, "temperature": temperature, "on_error": on_error}
        return self._prepare("text", bucket, prefix, model_id, batch_ts, **choices)

    def prepare_image_batch_data(
        self, bucket: str, prefix: str, system_prompt: str, user_prompt: str, model_id: str, batch_ts: int | None = None
    ) -> Q.Batch:
        return self._prepare("image", bucket, prefix, model_id, batch_ts, prompt=user_prompt, system_prompt=system_prompt)

    def prepare_video_batch_data(
        self, bucket: str, prefix: str, system_prompt: str, user_prompt: str, model_id: str, batch_ts: int | None = None
    ) -> Q.Batch:
        return self._prepare("video", bucket, prefix, model_id, batch_ts, prompt=user_prompt, system_prompt=system_prompt)

    def prepare_inventory_batch_data(
        self, inventory: DataFrame, bucket: str, prefix: str, modality: str, model_id: str, batch_ts: int | None = None, **choices
    ) -> Q.Batch:
        """A batch of the objects that an inventory table of the bucket lists; nothing is listed."""
        listed = O.list_objects(S.inventory_objects(inventory), prefix)
        O.require_nonempty(listed, modality, bucket, prefix)
        choices["batch_ts"] = int(time.time()) if batch_ts is None else batch_ts
        return Q.prepare_listed_batch(listed, self.place(bucket), modality, model_id, store=self.store, **choices)

    # ------------------------------------------------------------ jobs

    def _set_status(self, arn: str, status: str, uri: str = "", message: str = "") -> None:
        stamp = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())
        self._statuses.append({"job_arn": arn, "status": status, "output_s3_uri": uri, "message": message, "ts": stamp})

    def _note(self, arn: str, step: str, counts: dict[str, int]) -> None:
        for metric, value in counts.items():
            entry = {"entry": f"{arn}/{step}/{metric}", "job_arn": arn, "step": step, "metric": metric, "value": int(value)}
            self._progress.append(entry)

    def get_job_progress(self, job_arn: str) -> DataFrame:
        """What the steps of a job counted: step, metric, value."""
        mine = self._progress.read().filter(F.col("job_arn") == job_arn)
        newest = mine.groupBy("step", "metric").agg(F.max_by("value", "seq").alias("value"))
        return newest.select("step", "metric", "value")

    def create_batch_job_from_jsonl(
        self,
        jsonl_s3_uri: str,
        output_bucket: str,
        output_prefix: str,
        model_id: str,
        make_scorer: Callable[[], I.Scorer],
        *,
        input_bucket: str = "",
        input_prefix: str = "",
        job_type: str = "text",
        job_name: str | None = None,
        prepared: dict[str, int] | None = None,
    ) -> str:
        """Score a ready request file and write result lines and run totals; returns the job id.

        A job without a name is named after the time.  ``prepared`` are counts of the steps before, kept with the job's own.
        """
        name = job_name or f"batch-job-{int(time.time())}"
        arn = f"arn:local:model-invocation-job/{uuid.uuid4().hex[:12]}"
        prefix = self.normalize_prefix(output_prefix)
        stamp = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())
        job = {"job_arn": arn, "output_bucket": output_bucket, "output_prefix": prefix, "aws_region": self.region}
        job |= {"input_bucket": input_bucket, "input_prefix": input_prefix, "timestamp": stamp, "job_type": job_type}
        self._jobs.append(job | {"job_name": name, "model_id": model_id})
        uri = f"s3://{output_bucket}/{prefix}"
        self._set_status(arn, "InProgress", uri)
        folder = self.place(output_bucket, f"{prefix}{arn.split('/')[-1]}")
        result = f"{folder}/{jsonl_s3_uri.rstrip('/').split('/')[-1]}.out"
        try:
            requests = L.read_requests(self.spark, self.place_of_uri(jsonl_s3_uri))
            ready = requests.filter(F.col("model_input").isNotNull())
            answers = I.infer_batch(ready, make_scorer).select("value")
            unusable = L.request_rejects(requests)
            K.write_requests(answers.unionByName(L.rejected_as_results(unusable)), result)
            unusable.select("value", "reason").write.parquet(f"{folder}/rejects")
            totals = P.run_manifest(L.read_results(self.spark, result))
            totals.write.json(f"{folder}/manifest.json.out")
            self._note(arn, "prepare", prepared or {})
            written = L.read_manifest(self.spark, f"{folder}/manifest.json.out").drop("file_path").first()
            self._note(arn, "results", {k: v for k, v in written.asDict().items() if v is not None})
        except Exception as problem:
            self._set_status(arn, "Failed", uri, str(problem))
            raise
        self._set_status(arn, "Completed", uri)
        return arn

    def _run(
        self, batch: Q.Batch, bucket, prefix, output_bucket, output_prefix, model_id, make_scorer, modality, job_name
    ) -> str:
        kind = "" if modality == "text" else f"{modality}-"
        key = f"{prefix}batch-{kind}{int(time.time())}-{uuid.uuid4().hex[:6]}.jsonl"
        watched, seen = G.observe_requests(batch.requests)
        K.write_requests(watched, self.place(bucket, key))
        prepared = {**seen.get, "rejected": batch.rejects.count()}
        return self.create_batch_job_from_jsonl(
            f"s3://{bucket}/{key}",
            output_bucket,
            output_prefix,
            model_id,
            make_scorer,
            input_bucket=bucket,
            input_prefix=prefix,
            job_type=modality,
            job_name=job_name,
            prepared=prepared,
        )

    def create_batch_job(
        self, input_bucket, input_prefix, output_bucket, output_prefix, model_id, prompt, make_scorer, job_name=None
    ) -> str:
        prefix = self.normalize_prefix(input_prefix)
        batch = self.prepare_batch_data(input_bucket, prefix, prompt, model_id)
        return self._run(batch, input_bucket, prefix, output_bucket, output_prefix, model_id, make_scorer, "text", job_name)

    def create_image_batch_job(
        self, input_bucket, input_prefix, output_bucket, output_prefix, model_id, system_prompt, user_prompt, make_scorer,
        job_name=None,
    ) -> str:
        prefix = self.normalize_prefix(input_prefix)
        batch = self.prepare_image_batch_data(input_bucket, prefix, system_prompt, user_prompt, model_id)
        return self._run(batch, input_bucket, prefix, output_bucket, output_prefix, model_id, make_scorer, "image", job_name)

    def create_video_batch_job(
        self, input_bucket, input_prefix, output_bucket, output_prefix, model_id, system_prompt, user_prompt, make_scorer,
        job_name=None,
    ) -> str:
        prefix = self.normalize_prefix(input_prefix)
        batch = self.prepare_video_batch_data(input_bucket, prefix, system_prompt, user_prompt, model_id)
        return self._run(batch, input_bucket, prefix, output_bucket, output_prefix, model_id, make_scorer, "video", job_name)

    def job_states(self) -> DataFrame:
        return R.registry_upsert(self._jobs.read())

    def get_all_job_states(self) -> DataFrame:
        """The newest jobs, in the order in which they were committed and not by the clocks of their drivers."""
        return top_n(self.job_states(), fixed.RECENT_JOBS, F.col("seq").desc())

    def load_job_state(self, job_arn: str | None = None) -> DataFrame:
        return R.registry_get(self.job_states(), job_arn) if job_arn else top_n(self.job_states(), 1, F.col("seq").desc())

    def get_job_status(self, job_arn: str) -> DataFrame:
        log = self._statuses.read().filter(F.col("job_arn") == job_arn)
        return R.job_status(log, output_uri="output_s3_uri")

    def monitor_job(self, job_arn: str, check_interval: float = 30) -> DataFrame:
        """Wait until the job has a status it will not leave."""
        while True:
            status = self.get_job_status(job_arn)
            row = status.first()
            if row and (row["is_terminal"] or row["is_error"]):
                return status
            time.sleep(check_interval)

    # ------------------------------------------------------------ results

    def _result_files(self, job_arn: str) -> tuple[str, DataFrame]:
        """Bucket, and the job's result folder with part files under the name of their file."""
        status = self.get_job_status(job_arn)
        row = R.result_locations(status.filter("results_ready")).first()
        if row is None:
            raise RuntimeError(f"job {job_arn} has no results yet")
        bucket = row["result_bucket"]
        if self.store is None:
            files = self._as_keys(S.scan_objects(self.spark, self.place(bucket, row["result_prefix"])), bucket)
        else:
            files = T.list_tree(self.spark, self.place(bucket), row["result_prefix"], self.store, hidden=False)
        # The job's own rejects are kept beside its results.
        files = files.filter(~F.col("file_path").startswith(row["result_prefix"] + "rejects/"))
        return bucket, files.select(
            F.lit(row["job_id"]).alias("job_id"),
            F.regexp_replace("file_path", RESULT_PART, "").alias("file_path"),
            F.col("file_path").alias("part"),
            F.concat(F.lit(self.place(bucket)), F.col("file_path")).alias("uri"),
            "size",
        )

    def _line_table(self, bucket: str, keys: list[str]) -> DataFrame:
        return L.read_results(self.spark, [self.place(bucket, k) for k in keys])

    def get_job_results(self, job_arn: str) -> DataFrame:
        """Every parsed row of every result file of a job."""
        bucket, files = self._result_files(job_arn)
        results = files.filter(P.file_kind() == "result").select("file_path").distinct()
        keys = [r["file_path"] for r in results.collect()]  # result files of one job
        if not keys:
            raise FileNotFoundError(fixed.NO_RESULT_FILE)
        return P.parse_results(self._line_table(bucket, keys)).drop(*L.LINE_ORDER)

    def get_results_preview(self, job_arn: str, max_preview_lines: int | None = None) -> DataFrame:
        """First rows, location and run totals of a job's first result file: one row.

        Only the first part of the file is read, unless it has too few lines.  If the file gives no row, or there is no
        result file, the starts of the job's other files are looked into.  The number of rows follows the job's type
        unless it is given.
        """
        bucket, files = self._result_files(job_arn)
        if max_preview_lines is None:
            state = self.load_job_state(job_arn).first()
            modality = state["job_type"] if state and state["job_type"] in fixed.PREVIEW_LINES else "text"
            max_preview_lines = fixed.PREVIEW_LINES[modality]
        listing = files.select("job_id", "file_path").distinct()
        row = P.discover_result_files(listing).first()
        if row is None:
            raise FileNotFoundError(fixed.NO_RESULT_FILE)
        if self.store is None:
            rows = self._first_rows(bucket, files, row, max_preview_lines) if row["result_key"] else None
            if rows is None or not rows.take(1):
                rows = self._fallback_rows(bucket, files)
        else:
            rows = P.previews_from_files(files, max_preview_lines, part="part", store=self.store)
        if row["result_key"] is None and not rows.take(1):
            raise FileNotFoundError(fixed.NO_RESULT_FILE)
        if row["manifest_key"]:
            totals = L.read_manifest(self.spark, self.place(bucket, row["manifest_key"]))
            totals = totals.withColumn("file_path", F.lit(row["manifest_key"])).limit(1)
        else:
            totals = self.spark.createDataFrame([], schemas.MANIFEST + ", file_path string")
        return P.result_bundle(listing, rows, totals, bucket)

    def _fallback_rows(self, bucket: str, files: DataFrame) -> DataFrame:
        """Rows from the start of the job's first file that gives any."""
        # The line files of one job; its manifests are documents of another kind.
        usable = files.filter(P.file_kind().isin("result", "other") & ~F.lower("file_path").contains("manifest"))
        parts = [r["part"] for r in usable.select("part").distinct().collect()]
        if not parts:
            return self.spark.createDataFrame([], "job_id string, file_path string, line_no int, " + P.RESULT_SCHEMA)
        read = self._line_table(bucket, parts).withColumnRenamed("file_path", "part_path")
        lines = self._as_keys(read.withColumn("file_path", F.col("part_path")), bucket)
        lines = lines.withColumn("file_path", F.regexp_replace("file_path", RESULT_PART, ""))
        job = files.select("job_id").first()["job_id"]
        return P.read_results_fallback(
            lines.withColumn("job_id", F.lit(job)), ["part_path", "block_start", "row_id"]
        )

    def _first_rows(self, bucket: str, files: DataFrame, row, max_preview_lines: int) -> DataFrame:
        first_part = files.filter(F.col("file_path") == row["result_key"]).agg(F.min("part")).first()[0]
        lines = self._line_table(bucket, [first_part])
        if len(P.first_lines(lines, max_preview_lines, L.LINE_ORDER).take(max_preview_lines)) < max_preview_lines:
            lines = self._line_table(bucket, [row["result_key"]])
        heads = P.first_lines(lines, max_preview_lines, L.LINE_ORDER)
        ordered = F.row_number().over(Window.orderBy(*L.LINE_ORDER)).alias("line_no")  # a few lines only
        return P.parse_results(heads.select("*", ordered)).select(
            F.lit(row["job_id"]).alias("job_id"),
            F.lit(row["result_key"]).alias("file_path"),
            "line_no",
            *P.RESULT_FIELDS,
        )

    def _first_request(self, jsonl_s3_uri: str) -> DataFrame:
        """The first request of a request file, which is not read further than that."""
        where = self.place_of_uri(jsonl_s3_uri).rstrip("/")
        if self.store is None:
            return L.first_request(L.read_lines(self.spark, where))
        folder, name = where.rsplit("/", 1)
        parts = T.list_tree(self.spark, folder, name, self.store, hidden=False)
        mine = (F.col("file_path") == name) | F.col("file_path").startswith(name + "/")
        uri = F.concat(F.lit(folder + "/"), F.col("file_path"))
        parts = parts.filter(mine).select(F.lit(name).alias("file"), F.col("file_path").alias("part"), uri.alias("uri"))
        return L.request_rows(H.head_lines_of_parts(parts, 1, ["file"], store=self.store))

    # ------------------------------------------------------------ checks

    def validate_permissions(
        self, role_arn: str, input_bucket: str, output_bucket: str, model_id: str | None = None
    ) -> DataFrame:
        row = [(role_arn, input_bucket, output_bucket, model_id)]
        schema = "role_arn string, input_bucket string, output_bucket string, model_id string"
        return V.validate_configs(self.spark.createDataFrame(row, schema))

    def resolve_model(self, modality: str, model_name: str) -> str | None:
        row = self.spark.createDataFrame([(modality, model_name)], "modality string, model_name string")
        return M.resolve_models(row).first()["model_id"]

    def validate_inference(
        self,
        modality: str,
        model_id: str,
        make_scorer: Callable[[], I.Scorer],
        *,
        bucket: str = "",
        prefix: str = "",
        jsonl_s3_uri: str | None = None,
        prompt: str = "",
        system_prompt: str | None = None,
        seed: int = 0,
    ) -> DataFrame:
        """Dry run of one record: the first of a ready file, or one drawn object."""
        if jsonl_s3_uri:
            first = self._first_request(jsonl_s3_uri).select("record_id", "value")
            info = F.concat(F.lit("JSONL Record ID: "), F.col("record_id"))
            if modality != "video":
                clash = V.check_format(first.select(F.col("value").alias("line")), model_id).first()
                if clash is not None and not clash["matches"]:
                    return self.spark.createDataFrame([(False, clash["message"])], "success boolean, error string")
            sample = first
        else:
            listed = O.route(self.list_input_files(bucket, prefix), modality)
            drawn = O.sample_objects(listed, 1, seed).first()
            if drawn is None:
                raise O.EmptyInputError(f"no {modality} object below {bucket}/{prefix}")
            # named in full, so only this object is looked at
            one = S.read_binary_objects(self.spark, self.place(bucket, drawn["file_path"]))
            one = one.withColumn("file_path", F.lit(drawn["file_path"]))
            batch = Q.prepare_batch(
                one, modality, model_id, batch_ts=0, prompt=prompt, system_prompt=system_prompt, on_error="fail"
            )
            info = F.lit(f"文件: {drawn['file_name']} ({drawn['size']} bytes)")
            sample = batch.requests
        return I.infer_sample(sample.withColumn("info", info), make_scorer, info="info")

