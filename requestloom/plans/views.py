"""Views over the given tables that reproduce the engine's inputs.

Each view is stated once per dialect: as a DataFrame for the engine, and as SQL
text for the checks (which run elsewhere, on the same parquet tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_TS = 1700000000
BUCKET = "results-bucket"

# ---------------------------------------------------------------- expressions both dialects share

_OBJECT_PATH = """concat('input/', source, '/', lpad(cast(doc_id as string), 8, '0'),
  case doc_id % 12 when 0 then '.TXT' when 6 then '.jpg' when 7 then '.PNG' when 8 then '.mp4'
                   when 9 then '.csv' when 10 then '/' else '.txt' end)"""
_OBJECT_SIZE = """case when doc_id % 12 = 11 then 0
  else n_chars * (case doc_id % 5 when 0 then 1 when 1 then 97 when 2 then 997 else 9970 end) end"""
_LINE_CHOICE = """case doc_id % 9 when 0 then '' when 1 then substr(ok_a, 1, length(ok_a) - 5) when 2 then er
  when 3 then '{"recordId":"n","other":1}' when 4 then ok_b when 5 then ok_b
  when 6 then concat(ok_a, ' x') else ok_a end"""
_JOB_OF_DOC = "case when doc_id % 3 = 0 then 'j0' else concat('j', cast(doc_id % 40 as string)) end"
_FILE_OF_DOC = """concat('out/', job_id, '/', case when job_id in ('j7', 'j11') then 'raw.out'
  when doc_id % 2 = 0 then 'a.jsonl.out' else 'b.jsonl.out' end)"""
_ROLE = """case c_custkey % 5 when 0 then '' when 1 then 'arn:aws:s3:::x'
  else concat('arn:aws:iam::123456789012:role/r', cast(c_custkey as string)) end"""
_INPUT_BUCKET = """case c_custkey % 7 when 0 then c_name when 1 then 'ab' when 2 then '-bad'
  when 3 then repeat('a', 64) else replace(lower(c_name), '#', '-') end"""
_OUTPUT_BUCKET = "case c_custkey % 6 when 0 then 'x.y-z' when 1 then 'Upper' else 'out-bucket' end"
_MODEL_ID = """case c_custkey % 4 when 0 then '   ' when 1 then 'us.amazon.nova-pro-v1:0'
  else 'us.anthropic.claude-3-haiku-20240307-v1:0' end"""
_MODALITY = "case c_custkey % 3 when 0 then 'text' when 1 then 'image' else 'video' end"
_MODEL_NAME = """case c_custkey % 8 when 0 then 'Claude 3 Haiku' when 1 then 'Nova Pro'
  when 2 then 'Nova Pro (Image)' when 3 then 'Nova Pro (Video)' when 4 then 'Claude Sonnet 4.5'
  when 5 then 'No Such Model' when 6 then '' else 'Nova Lite (Image)' end"""
_PREFIX = """case o_orderkey % 7 when 0 then null when 1 then '' when 2 then '/' when 3 then '//a'
  when 4 then 'a' when 5 then 'a/' else concat('/a/', cast(o_custkey as string)) end"""
_STATUS = "case o_orderstatus when 'F' then 'Completed' when 'O' then 'InProgress' else 'Failed' end"
_REGISTRY_FIELDS = [
    "concat('job/', cast(o_orderkey as string)) as job_arn",
    "concat('out-', cast(o_custkey % 5 as string)) as output_bucket",
    "case o_orderkey % 4 when 0 then null when 1 then 'a\"b/' when 2 then 'c,{[/' else concat('d', chr(92), '}/') end"
    " as output_prefix",
    "case when o_custkey % 2 = 0 then 'us-west-2' else 'us-east-1' end as aws_region",
    "case when o_orderkey % 3 = 0 then null else 'in' end as input_bucket",
    "concat(o_orderpriority, chr(10), chr(92), chr(34)) as input_prefix",
]
_KEY_KIND = """case o_orderkey % 6 when 0 then '/' when 1 then '.jsonl.out' when 2 then '/Manifest.json.out'
  when 3 then '.jsonl.out.tmp' when 4 then '.jsonl.out' else '.log' end"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object table: text, image and video names, folder keys, empty objects, other endings."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        f"{_OBJECT_PATH} as file_path",
        f"{_OBJECT_SIZE} as size",
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 37) as last_modified",
        "text as content",
    )


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines of both formats, errors, blank lines and four kinds of bad lines."""
    rid = F.concat(F.lit("0_"), F.col("doc_id").cast("string"))
    text = F.col("text")
    ok_a = F.to_json(
        F.expr(
            "named_struct('recordId', concat('0_', cast(doc_id as string)), 'modelOutput', named_struct("
            "'content', array(named_struct('type', 'text', 'text', text)),"
            "'stop_reason', case when doc_id % 2 = 0 then 'end_turn' end,"
            "'usage', named_struct('input_tokens', n_chars, 'output_tokens', doc_id % 300)))"
        )
    )
    ok_b = F.to_json(
        F.struct(
            rid.alias("recordId"),
            F.struct(
                F.struct(
                    F.struct(F.array(F.struct(text.alias("text"))).alias("content")).alias("message")
                ).alias("output"),
                F.lit("end_turn").alias("stopReason"),
                F.expr("named_struct('inputTokens', n_chars, 'outputTokens', doc_id % 300)").alias("usage"),
            ).alias("modelOutput"),
        )
    )
    er = F.to_json(
        F.struct(
            rid.alias("recordId"),
            F.expr(
                "named_struct('errorCode', case when doc_id % 4 = 0 then 429 else 400 end,"
                "'errorMessage', 'bad input', 'retryable', doc_id % 4 = 0)"
            ).alias("error"),
        )
    )
    kind = F.col("doc_id") % 9  # only the text a row uses is built
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(kind.isin(1, 6, 7, 8), ok_a).alias("ok_a"),
        F.when(kind.isin(4, 5), ok_b).alias("ok_b"),
        F.when(kind == 2, er).alias("er"),
    )
    return docs.selectExpr("doc_id", f"{_LINE_CHOICE} as line")


def job_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result lines as files of jobs; one job owns over a third of them."""
    lines = result_lines(spark, sf_dir).selectExpr(f"{_JOB_OF_DOC} as job_id", "doc_id", "line")
    return lines.selectExpr("job_id", f"{_FILE_OF_DOC} as file_path", "doc_id", "line")


def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of those jobs' folders: result files, a folder key, sometimes a manifest."""
    docs = table(spark, sf_dir, "documents").selectExpr(f"{_JOB_OF_DOC} as job_id", "doc_id")
    files = docs.selectExpr("job_id", f"{_FILE_OF_DOC} as file_path").distinct()
    jobs = docs.select("job_id").distinct()
    extra = jobs.selectExpr(
        "job_id",
        "explode(array(concat('out/', job_id, '/'), concat('out/', job_id, '/manifest.json.out'))) as file_path",
    )
    return files.unionByName(
        extra.filter("file_path like '%/' or substr(job_id, -1, 1) in ('0', '2', '4', '6', '8')")
    )


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('job/', cast(o_custkey as string)) as job_arn",
        "case when o_custkey % 2 = 0 then 'us-west-2' else 'us-east-1' end as aws_region",
        "o_orderkey as seq",
        "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') as ts",
    )


def registry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries with all fields, some of them null, some with the marks that JSON has to escape."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as seq", *_REGISTRY_FIELDS)


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several status rows per job, the newest with the highest ``seq``."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('job/', cast(o_custkey as string)) as job_arn",
        f"{_STATUS} as status",
        "concat('s3://', 'out-', cast(o_custkey % 5 as string), '/res') as uri",
        "o_orderkey as seq",
        "case when o_orderstatus not in ('F', 'O') then concat('input ', cast(o_orderkey as string)) end as message",
        "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') as ts",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted jobs with raw prefixes and optional names."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('arn:x:job/', cast(o_orderkey as string)) as job_arn",
        f"{_PREFIX} as prefix",
        "case o_orderkey % 3 when 0 then null when 1 then '' else concat('run-', cast(o_orderkey as string)) end"
        " as job_name",
        "case o_orderkey % 3 when 0 then 'text' when 1 then 'image' else 'video' end as modality",
        "1700000000 + o_orderkey as ts",
        "case o_orderkey % 4 when 0 then 's3://bkt' when 1 then 's3://bkt/' when 2 then 's3://bkt/a/b'"
        " else 's3://bkt/a/b/' end as output_s3_uri",
    )


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in job folders, of every kind."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('job/', cast(o_custkey as string)) as job_id",
        "concat('out/', cast(o_custkey as string), '/', cast(o_orderkey as string), " + _KEY_KIND + ") as file_path",
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as cfg_id",
        f"{_ROLE} as role_arn",
        f"{_INPUT_BUCKET} as input_bucket",
        f"{_OUTPUT_BUCKET} as output_bucket",
        f"{_MODEL_ID} as model_id",
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as cfg_id",
        f"{_MODALITY} as modality",
        f"{_MODEL_NAME} as model_name",
        f"{_ROLE} as role_arn",
        f"{_INPUT_BUCKET} as input_bucket",
        f"{_OUTPUT_BUCKET} as output_bucket",
        "c_custkey % 2 = 0 as use_jsonl",
        "case when c_custkey % 10 = 4 then '' else 's3://b/x.jsonl' end as jsonl_s3_uri",
        "case when c_custkey % 9 = 1 then '' else ' ' end as prompt",
    )


# ---------------------------------------------------------------- the same views as SQL text

_OK_A = """json_object('recordId', '0_' || doc_id, 'modelOutput', case when doc_id % 2 = 0
    then json_object('content', json_array(json_object('type', 'text', 'text', text)),
      'stop_reason', 'end_turn', 'usage', json_object('input_tokens', n_chars, 'output_tokens', doc_id % 300))
    else json_object('content', json_array(json_object('type', 'text', 'text', text)),
      'usage', json_object('input_tokens', n_chars, 'output_tokens', doc_id % 300)) end)::varchar"""
_OK_B = """json_object('recordId', '0_' || doc_id, 'modelOutput', json_object(
    'output', json_object('message', json_object('content', json_array(json_object('text', text)))),
    'stopReason', 'end_turn', 'usage', json_object('inputTokens', n_chars, 'outputTokens', doc_id % 300)))::varchar"""
_ER = """json_object('recordId', '0_' || doc_id, 'error', json_object('errorCode',
    case when doc_id % 4 = 0 then 429 else 400 end, 'errorMessage', 'bad input', 'retryable', doc_id % 4 = 0))::varchar"""

SQL_VIEWS = {
    "objects": f"""select doc_id, {_OBJECT_PATH} as file_path, {_OBJECT_SIZE} as size,
  timestamp '2024-01-01 00:00:00' + to_seconds(doc_id * 37) as last_modified, text as content from documents""",
    "named_objects": """select *, split_part(file_path, '/', -1) as file_name from objects
  where not (file_path = '' or file_path like '%/' or size = 0)""",
    "result_lines": f"""select doc_id, {_LINE_CHOICE} as line
  from (select doc_id, {_OK_A} as ok_a, {_OK_B} as ok_b, {_ER} as er from documents)""",
    "ok_lines": "select * from result_lines where json_valid(line)",
    "job_lines": f"""select job_id, {_FILE_OF_DOC} as file_path, doc_id, line
  from (select {_JOB_OF_DOC} as job_id, doc_id, line from result_lines)""",
    "job_files": f"""select distinct job_id, {_FILE_OF_DOC} as file_path
  from (select {_JOB_OF_DOC} as job_id, doc_id from documents)
  union all select distinct {_JOB_OF_DOC}, concat('out/', {_JOB_OF_DOC}, '/') from documents
  union all select * from (select distinct {_JOB_OF_DOC} as j, concat('out/', {_JOB_OF_DOC}, '/manifest.json.out')
    from documents) where right(j, 1) in ('0', '2', '4', '6', '8')""",
    "job_log": """select 'job/' || o_custkey as job_arn,
  case when o_custkey % 2 = 0 then 'us-west-2' else 'us-east-1' end as aws_region, o_orderkey as seq,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as ts from orders""",
    "states": """select job_arn, arg_max(aws_region, seq) as aws_region, arg_max(ts, seq) as ts,
  min(seq) as position, max(seq) as seq from job_log group by job_arn""",
    "registry_log": f"""select o_orderkey as seq, {", ".join(_REGISTRY_FIELDS)} from orders""",
    "status_log": f"""select 'job/' || o_custkey as job_arn, {_STATUS} as status,
  's3://out-' || (o_custkey % 5) || '/res' as uri, o_orderkey as seq,
  case when o_orderstatus not in ('F', 'O') then 'input ' || o_orderkey end as message,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as ts from orders""",
    "jobs": f"""select 'arn:x:job/' || o_orderkey as job_arn, {_PREFIX} as prefix,
  case o_orderkey % 3 when 0 then null when 1 then '' else 'run-' || o_orderkey end as job_name,
  case o_orderkey % 3 when 0 then 'text' when 1 then 'image' else 'video' end as modality,
  1700000000 + o_orderkey as ts,
  case o_orderkey % 4 when 0 then 's3://bkt' when 1 then 's3://bkt/' when 2 then 's3://bkt/a/b'
    else 's3://bkt/a/b/' end as output_s3_uri from orders""",
    "clean_jobs": """select *, case when bare = '' or bare like '%/' then bare else bare || '/' end as clean
  from (select *, ltrim(coalesce(prefix, ''), '/') as bare from jobs)""",
    "order_keys": f"""select 'job/' || o_custkey as job_id,
  concat('out/', cast(o_custkey as string), '/', cast(o_orderkey as string), {_KEY_KIND}) as file_path from orders""",
    "configs": f"""select c_custkey as cfg_id, {_ROLE} as role_arn, {_INPUT_BUCKET} as input_bucket,
  {_OUTPUT_BUCKET} as output_bucket, {_MODEL_ID} as model_id from customer""",
    "submissions": f"""select c_custkey as cfg_id, {_MODALITY} as modality, {_MODEL_NAME} as model_name,
  {_ROLE} as role_arn, {_INPUT_BUCKET} as input_bucket, {_OUTPUT_BUCKET} as output_bucket,
  c_custkey % 2 = 0 as use_jsonl, case when c_custkey % 10 = 4 then '' else 's3://b/x.jsonl' end as jsonl_s3_uri,
  case when c_custkey % 9 = 1 then '' else ' ' end as prompt from customer""",
}

_NEEDS = {
    "named_objects": ["objects"],
    "ok_lines": ["result_lines"],
    "job_lines": ["result_lines"],
    "states": ["job_log"],
    "clean_jobs": ["jobs"],
}


def with_views(query: str, *names: str, **extra: str) -> str:
    """``query`` with the named views (and what they need) as leading CTEs."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as materialized ({SQL_VIEWS[n]})" for n in wanted]
    parts += [f"{n} as materialized ({text})" for n, text in extra.items()]
    return f"with {', '.join(parts)} {query}" if parts else query
