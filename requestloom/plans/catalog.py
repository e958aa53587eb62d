"""Query catalogue: every operator over the given tables, with its SQL check.

``CATALOG`` maps a query name to (DataFrame function, SQL text or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..functions.preview import request_preview
from ..operators import infer as I
from ..operators import models as M
from ..operators import numbering as N
from ..operators import objects as O
from ..operators import progress as W
from ..operators import registry as R
from ..operators import requests as Q
from ..operators import results as P
from ..operators import rules as V
from ..session import shared_path
from ..sources import fetch as D
from ..sources import heads as H
from ..sources import lines as L
from ..sources import listing as T
from ..sources import objects as S
from ..sources import registry as G
from ..sources import sinks as K
from ..sources.stores import ArrowStore
from . import views
from .scorers import make_length_scorer
from .views import BATCH_TS, BUCKET, with_views

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}

CLAUDE = "us.anthropic.claude-3-haiku-20240307-v1:0"
NOVA = "us.amazon.nova-pro-v1:0"
PROMPT = "请总结 Summarize:"
SYSTEM = "You are a careful reader."
# Limits for the payload queries, low enough that the view has objects on both sides.
IMAGE_LIMIT, VIDEO_LIMIT = 4_000_000, 1_000_000
LIMITS = {"image": IMAGE_LIMIT, "video": VIDEO_LIMIT}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        CATALOG[name] = (function, sql)
        return function

    return register


# ---------------------------------------------------------------- object table


@query(
    "list_objects",
    with_views(
        "select file_path, file_name, size, strftime(last_modified, '%Y-%m-%d %H:%M:%S') as last_modified"
        " from named_objects where starts_with(file_path, 'input/')",
        "named_objects",
    ),
)
def list_objects(spark, sf_dir):
    return O.describe(O.list_objects(views.objects(spark, sf_dir), "input/"))


@query(
    "preview_objects",
    with_views(
        "select file_path, file_name, size, strftime(last_modified, '%Y-%m-%d %H:%M:%S') as last_modified"
        " from named_objects where starts_with(file_path, 'input/src1')",
        "named_objects",
    ),
)
def preview_objects(spark, sf_dir):
    return O.describe(O.list_objects(views.objects(spark, sf_dir), "input/src1"))


@query(
    "preview_report",
    with_views(
        "select case when count(*) = 0 then 'no_objects' else 'found' end as state, count(*) as n_objects"
        " from named_objects where starts_with(file_path, 'input/src1')",
        "named_objects",
    ),
)
def preview_report(spark, sf_dir):
    return O.preview_report(views.objects(spark, sf_dir), "bucket", "input/src1")


@query("valid_objects", with_views("select file_path, size from named_objects", "named_objects"))
def valid_objects(spark, sf_dir):
    return O.valid_objects(views.objects(spark, sf_dir)).select("file_path", "size")


@query(
    "object_descriptors",
    with_views(
        "select file_path, split_part(file_path, '/', -1) as file_name, size,"
        " strftime(last_modified, '%Y-%m-%d %H:%M:%S') as last_modified from objects",
        "objects",
    ),
)
def object_descriptors(spark, sf_dir):
    return O.describe(views.objects(spark, sf_dir))


_SIZE_LABEL = """case when size < 1024 then size || 'B'
  when size < 1048576 then printf('%.1fKB', size / 1024.0::double)
  else printf('%.1fMB', size / 1048576.0::double) end"""


@query("size_labels", with_views(f"select file_path, size, {_SIZE_LABEL} as size_label from objects", "objects"))
def size_labels(spark, sf_dir):
    return O.with_size_label(views.objects(spark, sf_dir)).select("file_path", "size", "size_label")


_IS = {
    "text": r"regexp_matches(lower(file_name), '\.txt$')",
    "image": r"regexp_matches(lower(file_name), '\.(jpg|jpeg|png|gif|bmp|webp)$')",
    "video": r"regexp_matches(lower(file_name), '\.(mp4|mov|avi|mkv|webm|flv)$')",
}


def _route_query(modality: str) -> Query:
    def run(spark, sf_dir):
        return O.route(O.list_objects(views.objects(spark, sf_dir)), modality).select("file_path", "file_name", "size")

    return run


for _m in fixed.MODALITIES:
    query(
        f"route_{_m}",
        with_views(f"select file_path, file_name, size from named_objects where {_IS[_m]}", "named_objects"),
    )(_route_query(_m))


@query(
    "listing_stats",
    with_views(
        "select count(*) as scanned, count(*) - (select count(*) from named_objects) as skipped,"
        " (select count(*) from named_objects) as kept from objects",
        "named_objects",
    ),
)
def listing_stats(spark, sf_dir):
    return O.listing_stats(views.objects(spark, sf_dir))


_COUNTS = " union all ".join(
    f"select '{m}' as modality, count(*) filter (where {_IS[m]}) as matched, count(*) as scanned from scope"
    for m in fixed.MODALITIES
)


@query("modality_counts", with_views(_COUNTS, "named_objects", scope="select * from named_objects"))
def modality_counts(spark, sf_dir):
    return O.modality_counts(views.objects(spark, sf_dir))


@query(
    "require_nonempty",
    with_views(
        "select modality, case when scanned = 0 then 'no_objects' when matched = 0 then 'none_of_modality'"
        " else 'ok' end as state, case when scanned = 0 then place || '中未找到任何文件'"
        " when matched > 0 then null when modality = 'text' then place || '中未找到任何.txt文件（共' || scanned || '个文件）'"
        " when modality = 'image' then place || '中未找到任何图片文件' else place || '中未找到任何视频文件' end as message"
        " from (select *, '在 bucket/input/src8/000000 ' as place from counts)",
        "named_objects",
        scope="select * from named_objects where starts_with(file_path, 'input/src8/000000')",
        counts=_COUNTS,
    ),
)
def require_nonempty(spark, sf_dir):
    return O.nonempty_report(views.objects(spark, sf_dir), "bucket", "input/src8/000000")


@query(
    "oversize_report",
    with_views(
        f"select file_path, file_name, size, {_SIZE_LABEL} as size_label from named_objects"
        f" where {_IS['video']} and size > 2000000",
        "named_objects",
    ),
)
def oversize_report(spark, sf_dir):
    return O.oversize_report(O.valid_objects(views.objects(spark, sf_dir)), limit=2_000_000)


@query(
    "sample_objects",
    with_views(
        "select file_path, file_name from named_objects order by md5('7:' || file_path), file_path limit 25",
        "named_objects",
    ),
)
def sample_objects(spark, sf_dir):
    listed = O.list_objects(views.objects(spark, sf_dir))
    return O.sample_objects(listed, n=25, seed=7).select("file_path", "file_name")


# ---------------------------------------------------------------- requests


def _valid(spark, sf_dir):
    return O.valid_objects(views.objects(spark, sf_dir))


_NUMBERED = "select *, row_number() over (order by file_path) - 1 as record_index from named_objects where {}"
_TEXT = "'{}' || chr(10) || chr(10) || '原始文本:' || chr(10) || content".format(PROMPT)
_RID = f"'{BATCH_TS}_' || record_index"
_CLAUDE_TEXT_INPUT = f"""json_object('anthropic_version', 'bedrock-2023-05-31', 'max_tokens', 2048, 'temperature', 0.1,
  'messages', json_array(json_object('role', 'user', 'content',
    json_array(json_object('type', 'text', 'text', {_TEXT})))))"""
_NOVA_TEXT_INPUT = f"""json_object('schemaVersion', 'messages-v1', 'messages', json_array(json_object('role', 'user',
  'content', json_array(json_object('text', {_TEXT})))),
  'inferenceConfig', json_object('maxTokens', 2048, 'temperature', 0.1, 'topP', 0.9))"""


def _line_sql(model_input: str) -> str:
    return f"json_object('recordId', {_RID}, 'modelInput', {model_input})::varchar"


def _requests_sql(modality: str, model_input: str, limit: int | None = None) -> str:
    where = _IS[modality] + ("" if limit is None else f" and ((size + 2) // 3) * 4 <= {limit}")
    return with_views(
        f"select file_path, {_RID} as record_id, {_line_sql(model_input)} as value from numbered",
        "named_objects",
        numbered=_NUMBERED.format(where),
    )


def _text_batch(spark, sf_dir, model_id=CLAUDE) -> DataFrame:
    batch = Q.prepare_batch(
        _valid(spark, sf_dir), "text", model_id, batch_ts=BATCH_TS, prompt=PROMPT, on_error="fail"
    )
    return batch.requests


@query("text_requests_claude", _requests_sql("text", _CLAUDE_TEXT_INPUT))
def text_requests_claude(spark, sf_dir):
    return _text_batch(spark, sf_dir, CLAUDE)


@query("text_requests_nova", _requests_sql("text", _NOVA_TEXT_INPUT))
def text_requests_nova(spark, sf_dir):
    return _text_batch(spark, sf_dir, NOVA)


_IMAGE_DATA = "to_base64(encode(content))"
_CLAUDE_IMAGE_INPUT = f"""json_object('anthropic_version', 'bedrock-2023-05-31', 'max_tokens', 300,
  'temperature', 0.1, 'top_p', 0.1, 'top_k', 100,
  'messages', json_array(json_object('role', 'user', 'content', json_array(
    json_object('type', 'image', 'source', json_object('type', 'base64', 'media_type', 'image/jpeg', 'data', {_IMAGE_DATA})),
    json_object('type', 'text', 'text', '{PROMPT}')))), 'system', '{SYSTEM}')"""
_NOVA_IMAGE_INPUT = f"""json_object('schemaVersion', 'messages-v1',
  'messages', json_array(json_object('role', 'user', 'content', json_array(
    json_object('image', json_object('format', 'jpeg', 'source', json_object('bytes', {_IMAGE_DATA}))),
    json_object('text', '{PROMPT}')))),
  'inferenceConfig', json_object('maxTokens', 300, 'temperature', 0.1, 'topP', 0.9))"""
_VIDEO_INPUT = f"""json_object('schemaVersion', 'messages-v1',
  'messages', json_array(json_object('role', 'user', 'content', json_array(
    json_object('video', json_object('format', 'mp4', 'source', json_object('bytes', {_IMAGE_DATA}))),
    json_object('text', '{PROMPT}')))),
  'system', json_array(json_object('text', '你是一个专业的视频分析助手。')),
  'inferenceConfig', json_object('maxTokens', 300, 'topP', 0.1, 'topK', 20, 'temperature', 0.3))"""


def _media_batch(spark, sf_dir, modality, model_id, system=None) -> DataFrame:
    batch = Q.prepare_batch(
        _valid(spark, sf_dir),
        modality,
        model_id,
        batch_ts=BATCH_TS,
        prompt=PROMPT,
        system_prompt=system,
        on_error="fail",
        max_base64=LIMITS[modality],
    )
    return batch.requests


@query("image_requests_claude", _requests_sql("image", _CLAUDE_IMAGE_INPUT, IMAGE_LIMIT))
def image_requests_claude(spark, sf_dir):
    return _media_batch(spark, sf_dir, "image", CLAUDE, SYSTEM)


@query("image_requests_nova", _requests_sql("image", _NOVA_IMAGE_INPUT, IMAGE_LIMIT))
def image_requests_nova(spark, sf_dir):
    return _media_batch(spark, sf_dir, "image", NOVA, "")


@query("video_requests", _requests_sql("video", _VIDEO_INPUT, VIDEO_LIMIT))
def video_requests(spark, sf_dir):
    return _media_batch(spark, sf_dir, "video", NOVA)


@query(
    "route_format",
    with_views(
        "select cfg_id, model_id, case when lower(model_id) like '%nova%' then 'nova' else 'claude' end as format"
        " from configs",
        "configs",
    ),
)
def route_format(spark, sf_dir):
    return Q.route_format(views.configs(spark, sf_dir)).select("cfg_id", "model_id", "format")


@query(
    "number_records",
    with_views("select file_path, record_index from numbered", "named_objects", numbered=_NUMBERED.format("true")),
)
def number_records(spark, sf_dir):
    return N.number_records(_valid(spark, sf_dir)).frame


@query(
    "encode_jsonl",
    with_views(
        "select doc_id, case when doc_id % 2 = 0 then"
        f" json_object('recordId', cast(doc_id as varchar), 'modelInput', {_NOVA_TEXT_INPUT})::varchar else"
        f" json_object('recordId', cast(doc_id as varchar), 'modelInput', {_CLAUDE_TEXT_INPUT})::varchar end as value"
        " from objects",
        "objects",
    ),
)
def encode_jsonl(spark, sf_dir):
    """Rows of both formats in one table: the format follows each row's model id."""
    model_id = F.when(F.col("doc_id") % 2 == 0, NOVA).otherwise(CLAUDE)
    text = Q.text_prompt(PROMPT, "content")
    line = Q.routed_line(
        F.col("doc_id").cast("string"), model_id, Q.claude_text_input(text), Q.nova_text_input(text)
    )
    return views.objects(spark, sf_dir).select("doc_id", line.alias("value"))


@query(
    "encode_payloads",
    "select page_id, to_base64(encode(html)) as payload, length(to_base64(encode(html))) as n_chars from pages",
)
def encode_payloads(spark, sf_dir):
    content = F.encode("html", "UTF-8")
    return views.table(spark, sf_dir, "pages").select(
        "page_id",
        C.base64_text(content).alias("payload"),
        C.base64_length(F.octet_length("html")).alias("n_chars"),
    )


def _payload_sql(modality: str) -> str:
    size = "((size + 2) // 3) * 4"
    limit = LIMITS[modality]
    return with_views(
        f"select file_path, file_name, case when {size} <= {limit} then null else"
        f" 'Base64编码后大小 ' || cast({size} as bigint) || ' 字符超过限制 {limit}' end as reason"
        f" from named_objects where {_IS[modality]}",
        "named_objects",
    )


def _payload_query(modality: str) -> Query:
    def run(spark, sf_dir):
        kept, rejects = Q.split_by_payload(O.route(_valid(spark, sf_dir), modality), modality, LIMITS[modality])
        name = C.basename("file_path").alias("file_name")
        kept = kept.select("file_path", name, F.lit(None).cast("string").alias("reason"))
        return kept.unionByName(rejects)

    return run


for _m in ("image", "video"):
    query(f"{_m}_payload_filter", _payload_sql(_m))(_payload_query(_m))


@query(
    "prepare_stats",
    with_views(
        " union all ".join(
            f"select '{m}' as modality, count(*) filter (where {_IS[m]} and fits_{m}) as processed,"
            f" count(*) filter (where {_IS[m]} and not fits_{m}) as skipped from sized"
            for m in fixed.MODALITIES
        ),
        "named_objects",
        sized=f"select *, true as fits_text, ((size + 2) // 3) * 4 <= {IMAGE_LIMIT} as fits_image,"
        f" ((size + 2) // 3) * 4 <= {VIDEO_LIMIT} as fits_video from named_objects",
    ),
)
def prepare_stats(spark, sf_dir):
    return Q.prepare_stats(_valid(spark, sf_dir), LIMITS)


@query(
    "reject_unreadable",
    with_views(
        "select file_path, case when doc_id % 10 = 3 then 'unreadable content' end as reason"
        f" from named_objects where {_IS['text']}",
        "named_objects",
    ),
)
def reject_unreadable(spark, sf_dir):
    """Every tenth document gets a byte that is not valid UTF-8."""
    raw = F.encode("content", "UTF-8")
    broken = F.when(F.col("doc_id") % 10 == 3, F.concat(F.unhex(F.lit("C3")), raw)).otherwise(raw)
    objects = O.route(_valid(spark, sf_dir), "text").withColumn("content", broken)
    good, rejects = Q.split_unreadable(objects, "text")
    good = good.select("file_path", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(rejects.select("file_path", "reason"))


_TEXT_NUMBERED = {"numbered": _NUMBERED.format(_IS["text"])}


@query(
    "check_format",
    with_views(
        f"select {_RID} as record_id, case when doc_id % 2 = 0 then 'nova' else 'claude' end as format,"
        " doc_id % 2 = 0 as matches from numbered",
        "named_objects",
        **_TEXT_NUMBERED,
    ),
)
def check_format(spark, sf_dir):
    """Requests of both formats against one model."""
    objects = O.route(_valid(spark, sf_dir), "text")
    rows = N.attach_numbers(objects, N.number_records(objects))
    model_id = F.when(F.col("doc_id") % 2 == 0, NOVA).otherwise(CLAUDE)
    text = Q.text_prompt(PROMPT, "content")
    line = Q.routed_line(Q.record_id(BATCH_TS), model_id, Q.claude_text_input(text), Q.nova_text_input(text))
    return V.check_format(rows.select(line.alias("line")), NOVA).drop("message")


def _indent_sql(json_text: str) -> str:
    """Four-space indentation of a JSON text reduced to two spaces."""
    out = f"json_pretty({json_text})"
    for depth in range(1, 9):
        out = f"regexp_replace({out}, chr(10) || '{' ' * 4 * depth}([^ ])', chr(10) || '{' ' * 2 * depth}\\1', 'g')"
    return out


@query(
    "request_preview",
    with_views(
        f"select {_RID} as record_id, left({_indent_sql(_NOVA_TEXT_INPUT)}, 500) || '...' as preview from numbered",
        "named_objects",
        **_TEXT_NUMBERED,
    ),
)
def request_preview_query(spark, sf_dir):
    return _text_batch(spark, sf_dir, NOVA).select("record_id", request_preview("value").alias("preview"))


@query(
    "first_request",
    with_views(
        f"select {_RID} as record_id, {_CLAUDE_TEXT_INPUT}::varchar as model_input from numbered"
        " where record_index = 0",
        "named_objects",
        **_TEXT_NUMBERED,
    ),
)
def first_request(spark, sf_dir):
    lines = _text_batch(spark, sf_dir).select("file_path", F.col("value").alias("line"))
    return L.first_request(lines, ["file_path"]).select("record_id", "model_input")


# ---------------------------------------------------------------- result lines


def _lines(spark, sf_dir):
    return views.result_lines(spark, sf_dir)


_KIND = """case when not json_valid(line) then 'invalid' when json_exists(line, '$.modelOutput') then 'success'
  when json_exists(line, '$.error') then 'error' else 'invalid' end"""


@query(
    "classify_results",
    with_views(
        "select l.doc_id, case when o.doc_id is null then 'invalid' else o.kind end as kind from result_lines l"
        " left join kinds o using (doc_id) where trim(l.line) <> ''",
        "ok_lines",
        kinds=f"select doc_id, {_KIND} as kind from ok_lines",
    ),
)
def classify_results(spark, sf_dir):
    return P.classify_results(_lines(spark, sf_dir)).select("doc_id", "kind")


_ROWS = """select *, line->>'$.recordId' as record_id,
  case when json_exists(line, '$.modelOutput.content') then line->>'$.modelOutput.content[0].text'
       when json_exists(line, '$.modelOutput') then line->>'$.modelOutput.output.message.content[0].text'
       else '[处理失败] 错误码' || (line->>'$.error.errorCode') || ': ' || (line->>'$.error.errorMessage') end as output_text,
  case when json_exists(line, '$.error') then 'error'
       when json_exists(line, '$.modelOutput.content') then coalesce(line->>'$.modelOutput.stop_reason', 'unknown')
       else coalesce(line->>'$.modelOutput.stopReason', 'unknown') end as stop_reason,
  json_exists(line, '$.error') as has_error, line->>'$.error.errorCode' as error_code,
  line->>'$.error.errorMessage' as error_message, cast(line->>'$.error.retryable' as boolean) as retryable,
  coalesce(cast(line->>'$.modelOutput.usage.input_tokens' as bigint),
           cast(line->>'$.modelOutput.usage.inputTokens' as bigint), 0) as input_tokens,
  coalesce(cast(line->>'$.modelOutput.usage.output_tokens' as bigint),
           cast(line->>'$.modelOutput.usage.outputTokens' as bigint), 0) as output_tokens
  from source where json_exists(line, '$.modelOutput') or json_exists(line, '$.error')"""


def _rows_sql(source: str) -> str:
    """Result rows of the lines in a relation; lines that are not JSON become a JSON null first."""
    safe = f"(select * replace (case when json_valid(line) then line else 'null' end as line) from {source})"
    return _ROWS.replace("from source", f"from {safe}")


_PARSED = {"parsed": _rows_sql("ok_lines")}
_RESULT_COLUMNS = "doc_id, record_id, output_text, stop_reason, has_error, error_code, error_message, retryable"


@query("parse_results", with_views(f"select {_RESULT_COLUMNS} from parsed", "ok_lines", **_PARSED))
def parse_results(spark, sf_dir):
    return P.parse_results(_lines(spark, sf_dir))


@query("parse_errors", with_views(f"select {_RESULT_COLUMNS} from parsed where has_error", "ok_lines", **_PARSED))
def parse_errors(spark, sf_dir):
    return P.parse_errors(_lines(spark, sf_dir))


@query(
    "invalid_results",
    with_views(
        "select l.doc_id, l.line, case when o.doc_id is null then 'malformed_json' else 'neither_key' end as reason"
        " from result_lines l left join ok_lines o using (doc_id) where trim(l.line) <> ''"
        " and l.doc_id not in (select doc_id from parsed)",
        "ok_lines",
        **_PARSED,
    ),
)
def invalid_results(spark, sf_dir):
    return P.invalid_results(_lines(spark, sf_dir))


@query(
    "stop_reason_counts",
    with_views("select stop_reason, count(*) as n_rows from parsed group by stop_reason", "ok_lines", **_PARSED),
)
def stop_reason_counts(spark, sf_dir):
    return P.stop_reason_counts(_lines(spark, sf_dir))


@query(
    "token_usage",
    with_views(
        "select doc_id, record_id, input_tokens, output_tokens from parsed where not has_error", "ok_lines", **_PARSED
    ),
)
def token_usage(spark, sf_dir):
    return P.token_usage(_lines(spark, sf_dir))


def _manifest_sql(lines: str, parsed: str, where: str = "") -> str:
    return f"""(select count(*) from {lines} l where trim(l.line) <> '' {where}) as "totalRecordCount",
  count(*) as "processedRecordCount", count(*) filter (where not has_error) as "successRecordCount",
  count(*) filter (where has_error) as "errorRecordCount",
  cast(coalesce(sum(input_tokens), 0) as bigint) as "inputTokenCount",
  cast(coalesce(sum(output_tokens), 0) as bigint) as "outputTokenCount" from {parsed}"""


@query(
    "run_manifest",
    with_views("select " + _manifest_sql("result_lines", "parsed"), "ok_lines", **_PARSED),
)
def run_manifest(spark, sf_dir):
    return P.run_manifest(_lines(spark, sf_dir))


@query(
    "preview_results",
    with_views(
        "select doc_id, record_id, case when length(output_text) > 200 then left(output_text, 200) || '...'"
        " else output_text end as output_text, stop_reason from parsed where doc_id in"
        " (select doc_id from result_lines where trim(line) <> '' order by doc_id limit 3)",
        "ok_lines",
        **_PARSED,
    ),
)
def preview_results(spark, sf_dir):
    return P.preview_results(_lines(spark, sf_dir), ["doc_id"])


# Previews of the files of jobs.
_PREVIEW_FIELDS = "record_id, output_text, stop_reason, has_error, error_code, error_message, retryable"
_FIRST_LINES = {
    "heads": "select * from (select *, row_number() over (partition by job_id, file_path order by doc_id) as line_no"
    " from job_lines where trim(line) <> '') where line_no <= 3",
    "chosen": "select job_id, min(file_path) as file_path from job_files where file_path like '%.jsonl.out'"
    " and lower(file_path) not like '%manifest.json.out%' group by job_id",
    "chosen_heads": "select * from heads join chosen using (job_id, file_path) where json_valid(line)",
    "primary_rows": _rows_sql("chosen_heads"),
    # fallback: five lines from the first non-blank one; a line cut by the byte window is no valid JSON
    "positions": "select *, row_number() over (partition by job_id, file_path order by doc_id) as n,"
    " coalesce(sum(strlen(line) + 1) over (partition by job_id, file_path order by doc_id"
    " rows between unbounded preceding and 1 preceding), 0) as start_byte from job_lines",
    "inside": "select *, start_byte < 51200 and start_byte + strlen(line) > 51200 and"
    " substr(hex(encode(line)), cast(2 * (51200 - start_byte) + 1 as bigint), 1) in ('8', '9', 'A', 'B') as torn"
    " from positions where start_byte < 51200",
    "starts": "select job_id, file_path, min(n) filter (where trim(line) <> '') as first_n, bool_or(torn) as torn_file"
    " from inside group by job_id, file_path having not bool_or(torn)",
    "candidates": "select i.job_id, i.file_path, i.n as line_no, i.line from inside i join starts s"
    " using (job_id, file_path) where i.n >= first_n and i.n < first_n + 5 and start_byte + strlen(i.line) <= 51200"
    " and json_valid(i.line)",
    "fallback_rows": "select * from (" + _rows_sql("candidates") + ") where not has_error",
    "fallback_best": "select job_id, min(file_path) as file_path from fallback_rows group by job_id",
    "fallback": "select f.* from fallback_rows f join fallback_best using (job_id, file_path)",
    "previews": "select job_id, file_path, line_no, "
    + _PREVIEW_FIELDS
    + " from primary_rows"
    " union all select job_id, file_path, line_no, "
    + _PREVIEW_FIELDS
    + " from fallback"
    " where job_id not in (select job_id from primary_rows)",
}


def _job_previews(spark, sf_dir):
    return P.job_previews(views.job_files(spark, sf_dir), views.job_lines(spark, sf_dir), ["doc_id"])


@query(
    "job_previews",
    with_views("select * from previews", "job_lines", "job_files", **_FIRST_LINES),
)
def job_previews(spark, sf_dir):
    return _job_previews(spark, sf_dir)


@query(
    "read_results_fallback",
    with_views(
        "select job_id, file_path, line_no, "
    + _PREVIEW_FIELDS
    + " from fallback",
        "job_lines",
        "job_files",
        **_FIRST_LINES,
    ),
)
def read_results_fallback(spark, sf_dir):
    return P.read_results_fallback(views.job_lines(spark, sf_dir), ["doc_id"])


@query(
    "parse_warnings",
    with_views(
        "select f.job_id, c.file_path as file_key, f.n_files, case when c.file_path is null then 'error'"
        " else 'warning' end as level, case when c.file_path is null then '未找到结果文件'"
        " else '结果文件已找到，但预览数据解析失败。请直接访问S3文件获取完整结果。' end as message"
        " from (select job_id, count(*) as n_files from job_files group by job_id) f left join chosen c using (job_id)"
        " where job_id not in (select job_id from primary_rows)",
        "job_lines",
        "job_files",
        **_FIRST_LINES,
    ),
)
def parse_warnings(spark, sf_dir):
    """Jobs whose first result file gives nothing (before any fallback)."""
    listing, lines = views.job_files(spark, sf_dir), views.job_lines(spark, sf_dir)
    chosen = P.discover_result_files(listing).select("job_id", F.col("result_key").alias("file_path"))
    heads = P.first_lines(lines, 3, ["doc_id"], ["job_id", "file_path"])
    rows = P.parse_results(heads.join(chosen, ["job_id", "file_path"], "left_semi"))
    return P.parse_warnings(listing, rows)


@query(
    "result_bundle",
    with_views(
        "select d.job_id, 'results-bucket' as bucket, coalesce(p.file_path, d.result_key) as key,"
        " split_part(coalesce(p.file_path, d.result_key), '/', -1) as file_name,"
        " 's3://results-bucket/' || coalesce(p.file_path, d.result_key) as s3_uri, coalesce(p.preview, '') as preview,"
        " case when p.job_id is not null then 's3://results-bucket/' || d.manifest_key end as manifest_s3_uri,"
        ' case when p.job_id is not null and d.manifest_key is not null then cast(m."totalRecordCount" as varchar) end as "totalRecordCount",'
        ' case when p.job_id is not null and d.manifest_key is not null then cast(m."successRecordCount" as varchar) end as "successRecordCount",'
        " case when p.job_id is null then '结果文件已找到，但预览数据解析失败。请直接访问S3文件获取完整结果。' end as parse_warning"
        " from found d left join packed p using (job_id) left join totals m using (job_id)"
        " where coalesce(p.file_path, d.result_key) is not null",
        "job_lines",
        "job_files",
        **_FIRST_LINES,
        found="select job_id, min(file_path) filter (where file_path like '%.jsonl.out') as result_key,"
        " max(file_path) filter (where file_path like '%manifest.json.out') as manifest_key from job_files group by job_id",
        packed="select job_id, min(file_path) as file_path, string_agg(concat_ws('=', record_id, output_text, has_error,"
        " error_code, error_message, retryable), chr(10)"
        " order by line_no) as preview from previews group by job_id",
        valid_rows="select * from job_lines where json_valid(line)",
        parsed_rows=_rows_sql("valid_rows"),
        totals='select job_id, count(*) as "totalRecordCount", (select count(*) from parsed_rows r'
        ' where r.job_id = j.job_id and not has_error) as "successRecordCount" from job_lines j'
        " where trim(line) <> '' group by job_id",
    ),
)
def result_bundle(spark, sf_dir):
    listing, lines = views.job_files(spark, sf_dir), views.job_lines(spark, sf_dir)
    manifests = P.run_manifest(lines, by=["job_id"]).select(
        F.concat(F.lit("out/"), F.col("job_id"), F.lit("/manifest.json.out")).alias("file_path"),
        "totalRecordCount",
        "successRecordCount",
    )
    bundle = P.result_bundle(listing, _job_previews(spark, sf_dir), manifests, BUCKET)
    shown = ("record_id", "output_text", "has_error", "error_code", "error_message", "retryable")
    item = F.transform("preview", lambda p: F.concat_ws("=", *[p[c].cast("string") for c in shown]))
    counts = {c: F.col(c).cast("string") for c in ("totalRecordCount", "successRecordCount")}
    return bundle.withColumns({"preview": F.array_join(item, "\n"), **counts})


_FOUND_KEYS = {
    "found": "select job_id, count(*) as n_files,"
    " min(file_path) filter (where file_path like '%.jsonl.out') as result_key,"
    " max(file_path) filter (where lower(file_path) like '%manifest.json.out%') as manifest_key"
    " from order_keys group by job_id"
}


@query("discover_result_files", with_views("select * from found", "order_keys", **_FOUND_KEYS))
def discover_result_files(spark, sf_dir):
    return P.discover_result_files(views.order_keys(spark, sf_dir))


@query(
    "missing_result_files",
    with_views(
        "select job_id, n_files, k.file_path as found_key, '未找到结果文件' as message from order_keys k"
        " join found using (job_id) where result_key is null",
        "order_keys",
        **_FOUND_KEYS,
    ),
)
def missing_result_files(spark, sf_dir):
    return P.missing_result_files(views.order_keys(spark, sf_dir))


# ---------------------------------------------------------------- registry and jobs


@query(
    "registry_rows",
    with_views("select job_arn as job_key, job_arn, aws_region, ts as timestamp from job_log", "job_log"),
)
def registry_rows(spark, sf_dir):
    """The log as registry documents, read back to rows."""
    entry = F.struct("job_arn", "aws_region", F.col("ts").alias("timestamp"))
    documents = views.job_log(spark, sf_dir).select(F.to_json(F.create_map("job_arn", entry)).alias("value"))
    return G.registry_rows(documents).select("job_key", "job_arn", "aws_region", "timestamp")


def _states(spark, sf_dir):
    return R.registry_upsert(views.job_log(spark, sf_dir))


@query("registry_upsert", with_views("select job_arn, aws_region, ts, position, seq from states", "states"))
def registry_upsert(spark, sf_dir):
    return _states(spark, sf_dir)


_NEWEST = "select job_arn, aws_region, ts, position from states order by ts desc, position limit "


@query("registry_recent", with_views(_NEWEST + "10", "states"))
def registry_recent(spark, sf_dir):
    return R.registry_recent(_states(spark, sf_dir), "ts").drop("seq")


@query("registry_latest", with_views(_NEWEST + "1", "states"))
def registry_latest(spark, sf_dir):
    return R.registry_latest(_states(spark, sf_dir), "ts").drop("seq")


@query(
    "registry_get", with_views("select job_arn, aws_region, ts, position from states where job_arn = 'job/7'", "states")
)
def registry_get(spark, sf_dir):
    return R.registry_get(_states(spark, sf_dir), "job/7").drop("seq")


@query(
    "job_status",
    with_views(
        "select job_arn, status, status in ('Completed', 'Failed', 'Stopped') as is_terminal, status = 'Error' as is_error,"
        " status = 'Completed' as results_ready, case status when 'Completed' then 'results_ready'"
        " when 'Failed' then 'check_configuration' when 'InProgress' then 'refresh_later' else '' end as hint,"
        " case when status = 'Completed' then uri end as output_s3_uri, message, submit_time, last_modified from now",
        "status_log",
        now="select job_arn, arg_max(status, seq) as status, arg_max(uri, seq) as uri, arg_max_null(message, seq) as message,"
        " arg_min(ts, seq) as submit_time, arg_max(ts, seq) as last_modified from status_log group by job_arn",
    ),
)
def job_status(spark, sf_dir):
    return R.job_status(views.status_log(spark, sf_dir), output_uri="uri")


@query(
    "result_locations",
    with_views(
        "select job_arn, 'bkt' as result_bucket, root as result_root, split_part(job_arn, '/', -1) as job_id,"
        " root || split_part(job_arn, '/', -1) || '/' as result_prefix from (select *,"
        " case when output_s3_uri like '%a/b%' then 'a/b/' else '' end as root from jobs)",
        "jobs",
    ),
)
def result_locations(spark, sf_dir):
    return R.result_locations(views.jobs(spark, sf_dir)).select(
        "job_arn", "result_bucket", "result_root", "job_id", "result_prefix"
    )


@query("normalize_prefixes", with_views("select job_arn, clean as prefix from clean_jobs", "clean_jobs"))
def normalize_prefixes(spark, sf_dir):
    return R.normalize_prefixes(views.jobs(spark, sf_dir), "prefix").select("job_arn", "prefix")


_FILE = "'batch-' || case modality when 'text' then '' when 'image' then 'image-' else 'video-' end || ts || '.jsonl'"


@query(
    "job_names",
    with_views(
        f"select job_arn, case when coalesce(job_name, '') = '' then 'batch-job-' || ts else job_name end as job_name,"
        f" {_FILE} as request_file from jobs",
        "jobs",
    ),
)
def job_names(spark, sf_dir):
    return R.job_names(views.jobs(spark, sf_dir)).select("job_arn", "job_name", "request_file")


@query(
    "output_uris",
    with_views(
        f"select job_arn, 's3://out-b/' || clean as output_s3_uri, 's3://in-b/' || clean || {_FILE} as request_s3_uri"
        " from clean_jobs",
        "clean_jobs",
    ),
)
def output_uris(spark, sf_dir):
    jobs = R.normalize_prefixes(R.job_names(views.jobs(spark, sf_dir)), "prefix").withColumns(
        {"output_bucket": F.lit("out-b"), "input_bucket": F.lit("in-b")}
    )
    named = R.output_uris(jobs, output_prefix="prefix", input_prefix="prefix")
    return named.select("job_arn", "output_s3_uri", "request_s3_uri")


# ---------------------------------------------------------------- rules and lookups

_BUCKET_OK = "(length({0}) between 3 and 63 and regexp_matches({0}, '^[a-z0-9][a-z0-9.\\-]*[a-z0-9]$'))"
_IN_OK, _OUT_OK = _BUCKET_OK.format("input_bucket"), _BUCKET_OK.format("output_bucket")
_W = "chr(10)"
_RULES = {
    "tested": f"select *, starts_with(role_arn, 'arn:aws:iam::') as role_ok, {_IN_OK} as in_ok, {_OUT_OK} as out_ok,"
    " trim(model_id) <> '' as model_ok from configs",
    "checked": f"""select *, role_ok and in_ok and out_ok and model_ok as valid,
  case when not role_ok then '' else concat_ws(chr(10), '✓ Role ARN格式正确',
    case when in_ok then '✓ 输入bucket名称格式有效: ' || input_bucket end,
    case when out_ok then '✓ 输出bucket名称格式有效: ' || output_bucket end,
    case when model_ok then '✓ 模型ID格式有效: ' || model_id end) end as checks,
  case when not role_ok then '✗ Role ARN格式不正确: ' || role_arn else concat_ws(chr(10),
    case when not in_ok then '✗ 输入bucket名称格式无效: ' || input_bucket end,
    case when not out_ok then '✗ 输出bucket名称格式无效: ' || output_bucket end,
    case when not model_ok then '✗ 模型ID格式无效: ' || model_id end) end as errors,
  case when not role_ok then '' else '{chr(10).join(fixed.CONFIG_WARNINGS)}' end as warnings from tested""",
}


@query(
    "validate_configs",
    with_views("select cfg_id, valid, checks, errors, warnings from checked", "configs", **_RULES),
)
def validate_configs(spark, sf_dir):
    checked = V.validate_configs(views.configs(spark, sf_dir))
    joined = [F.array_join(c, "\n").alias(c) for c in ("checks", "errors", "warnings")]
    return checked.select("cfg_id", "valid", *joined)


@query(
    "config_report",
    with_views(
        "select cfg_id, valid and role_arn <> '' as valid, case when role_arn = '' then '请填写所有必填配置项' else"
        " concat_ws(chr(10), nullif(checks, ''), nullif(warnings, ''), nullif(errors, ''),"
        " case when valid then '配置验证通过，可以开始批处理！' else '请修复上述问题后再提交任务' end) end as report from checked",
        "configs",
        **_RULES,
    ),
)
def config_report(spark, sf_dir):
    return V.config_report(views.configs(spark, sf_dir)).select("cfg_id", "valid", "report")


_CATALOG_SQL = "select * from (values " + ", ".join(
    f"('{a}', '{b}', '{c}', {fixed.MODALITIES.index(a)})" for a, b, c in fixed.MODEL_CATALOG
) + ") as t(modality, model_name, model_id, rank)"
_LOOKUP = {"catalog": _CATALOG_SQL}


@query(
    "resolve_models",
    with_views(
        "select cfg_id, s.modality, s.model_name, c.model_id from submissions s left join catalog c"
        " on c.modality = s.modality and c.model_name = s.model_name",
        "submissions",
        **_LOOKUP,
    ),
)
def resolve_models(spark, sf_dir):
    return M.resolve_models(views.submissions(spark, sf_dir)).select("cfg_id", "modality", "model_name", "model_id")


@query(
    "resolve_models_any",
    with_views(
        "select cfg_id, s.model_name, c.model_id from submissions s left join firsts c using (model_name)",
        "submissions",
        **_LOOKUP,
        firsts="select model_name, arg_min(model_id, rank) as model_id from catalog group by model_name",
    ),
)
def resolve_models_any(spark, sf_dir):
    return M.resolve_models_any(views.submissions(spark, sf_dir)).select("cfg_id", "model_name", "model_id")


_RULE_ORDER = {
    "text": ("no_model", "no_uri", "no_input"),
    "image": ("no_uri", "no_input", "no_model"),
    "video": ("no_uri", "no_input", "no_model"),
}
_RULE_NAME = {"no_model": "invalid_model", "no_uri": "missing_jsonl_uri", "no_input": "missing_input"}


@query(
    "required_fields",
    with_views(
        " union all ".join(
            "select cfg_id, modality, case when no_base then 'missing_required' "
            + " ".join(f"when {r} then '{_RULE_NAME[r]}'" for r in _RULE_ORDER[m])
            + f" else 'ok' end as rule from broken where modality = '{m}'"
            for m in fixed.MODALITIES
        ),
        "submissions",
        **_LOOKUP,
        broken="select s.cfg_id, s.modality, s.model_name = '' or s.role_arn = '' or s.output_bucket = '' as no_base,"
        " c.model_id is null as no_model, use_jsonl and jsonl_s3_uri = '' as no_uri,"
        " not use_jsonl and (input_bucket = '' or prompt = '') as no_input from submissions s left join catalog c"
        " on c.modality = s.modality and c.model_name = s.model_name",
    ),
)
def required_fields(spark, sf_dir):
    resolved = M.resolve_models(views.submissions(spark, sf_dir))
    return V.required_fields(resolved).select("cfg_id", "modality", "rule")


# ---------------------------------------------------------------- files, sinks, inference


def _one_file_per_row(spark, rows: DataFrame, label: str) -> str:
    """Each text of a one-column table as a file of its own, ten thousand rows of a partition in a folder."""
    root, (column,) = shared_path(spark, label), rows.columns
    if not ArrowStore.knows(root):
        spread = rows.repartition(spark.sparkContext.defaultParallelism)
        spread.write.option("maxRecordsPerFile", 1).text(root)
        return root
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    folder = F.floor(row / 10000).cast("bigint")
    name = F.format_string("%05d-%06d/%010d.txt", F.spark_partition_id(), folder, row)
    content = F.concat(F.coalesce(column, F.lit("")), F.lit("\n")).cast("binary")
    return K.write_objects(rows.select(name.alias("name"), content.alias("content")), root)


@query(
    "read_text_objects",
    "select strlen(text) + 1 as size, md5(text || chr(10)) as content_md5 from documents",
)
def read_text_objects(spark, sf_dir):
    root = _one_file_per_row(spark, views.table(spark, sf_dir, "documents").select("text"), "documents")
    return S.read_text_objects(spark, root).select("size", F.md5("content").alias("content_md5"))


@query(
    "read_binary_objects",
    "select strlen(html) + 1 as size, md5(to_base64(encode(html || chr(10)))) as payload_md5 from pages",
)
def read_binary_objects(spark, sf_dir):
    root = _one_file_per_row(spark, views.table(spark, sf_dir, "pages").select("html"), "pages")
    return S.read_binary_objects(spark, root).select("size", F.md5(C.base64_text("content")).alias("payload_md5"))


@query(
    "read_listed_objects",
    "select strlen(html) + 1 as size, md5(to_base64(encode(html || chr(10)))) as payload_md5 from pages",
)
def read_listed_objects(spark, sf_dir):
    """The same files from their listing: tasks open the objects they are given."""
    root = _one_file_per_row(spark, views.table(spark, sf_dir, "pages").select("html"), "pages")
    listing = S.scan_objects(spark, root).select(F.col("file_path").alias("uri"), "size")
    tasks = D.task_count(*listing.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first())
    return D.fetch_content(listing, tasks=tasks).select("size", F.md5(C.base64_text("content")).alias("payload_md5"))


@query("write_requests", with_views(f"select {_line_sql(_CLAUDE_TEXT_INPUT)} as line from numbered", "named_objects", **_TEXT_NUMBERED))
def write_requests(spark, sf_dir):
    uri = K.write_requests(_text_batch(spark, sf_dir), shared_path(spark, "requests"))
    return L.read_lines(spark, uri).select("line")


@query(
    "read_requests",
    with_views(
        f"select {_RID} as record_id, {_NOVA_TEXT_INPUT}::varchar as model_input from numbered",
        "named_objects",
        **_TEXT_NUMBERED,
    ),
)
def read_requests(spark, sf_dir):
    uri = K.write_requests(_text_batch(spark, sf_dir, NOVA), shared_path(spark, "requests"))
    return L.read_requests(spark, uri).select("record_id", "model_input")


@query(
    "read_requests_rejects",
    """select case when not bad then '0_' || doc_id end as record_id,
  case when not bad then '{"n":' || n_chars || '}' end as model_input,
  case when doc_id % 13 = 0 then 'malformed_text' when doc_id % 11 = 0 then 'malformed_json' end as reason
  from (select *, doc_id % 11 = 0 or doc_id % 13 = 0 as bad from documents)""",
)
def read_requests_rejects(spark, sf_dir):
    """Good lines, cut ones and ones with a byte that is no UTF-8: each is a request or a reject with its reason."""
    uri = shared_path(spark, "requests")
    views.table(spark, sf_dir, "documents").selectExpr(
        """concat('{"recordId":"0_', doc_id, '","modelInput":{"n":', n_chars,
        case when doc_id % 13 = 0 then concat(',"b":"', cast(unhex('FF') as string), '"') else '' end,
        case when doc_id % 11 = 0 then '}' else '}}' end) as line"""
    ).write.text(uri)
    rows = L.read_requests(spark, uri)
    good = rows.filter("model_input is not null").withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(L.request_rejects(rows)).select("record_id", "model_input", "reason")


@query("stage_requests", _requests_sql("text", _CLAUDE_TEXT_INPUT))
def stage_requests(spark, sf_dir):
    return K.stage_requests(_text_batch(spark, sf_dir), shared_path(spark, "staged"))


@query("read_results", with_views("select line from result_lines", "result_lines"))
def read_results(spark, sf_dir):
    uri = shared_path(spark, "results")
    _lines(spark, sf_dir).select("line").write.text(uri)
    return L.read_results(spark, uri).select("line")


@query(
    "read_manifest",
    with_views(
        'select j.job_id, j."totalRecordCount", coalesce(p."successRecordCount", 0) as "successRecordCount",'
        ' coalesce(p."errorRecordCount", 0) as "errorRecordCount", coalesce(p."outputTokenCount", 0) as "outputTokenCount"'
        " from (select job_id, count(*) as \"totalRecordCount\" from job_lines where trim(line) <> '' group by job_id) j"
        " left join (select job_id, count(*) filter (where not has_error) as \"successRecordCount\","
        ' count(*) filter (where has_error) as "errorRecordCount", cast(sum(output_tokens) as bigint) as "outputTokenCount"'
        " from parsed_rows group by job_id) p using (job_id)",
        "job_lines",
        valid_rows="select * from job_lines where json_valid(line)",
        parsed_rows=_rows_sql("valid_rows"),
    ),
)
def read_manifest(spark, sf_dir):
    uri = shared_path(spark, "manifests")
    P.run_manifest(views.job_lines(spark, sf_dir), by=["job_id"]).write.partitionBy("job_id").json(uri)
    return L.read_manifest(spark, uri).select(
        F.regexp_extract("file_path", "job_id=([^/]+)/", 1).alias("job_id"),
        "totalRecordCount",
        "successRecordCount",
        "errorRecordCount",
        "outputTokenCount",
    )


_SCORED = f"length({_TEXT})"


@query(
    "infer_batch",
    with_views(
        f"select {_RID} as record_id, case when n % 7 = 0 then '[处理失败] 错误码429: bad input' else 'chars=' || n end as output_text,"
        " case when n % 7 = 0 then 'error' else 'end_turn' end as stop_reason, n % 7 = 0 as has_error,"
        " case when n % 7 = 0 then true end as retryable, case when n % 7 = 0 then 0 else n end as input_tokens"
        f" from (select *, {_SCORED} as n from numbered)",
        "named_objects",
        **_TEXT_NUMBERED,
    ),
)
def infer_batch(spark, sf_dir):
    scored = I.infer_batch(_text_batch(spark, sf_dir), make_length_scorer)
    rows = P.parse_results(scored.select(F.col("value").alias("line")), tokens=True)
    return rows.select("record_id", "output_text", "stop_reason", "has_error", "retryable", "input_tokens")


@query(
    "infer_sample",
    with_views(
        "select file_path as file_info, n % 7 <> 0 as success, case when n % 7 <> 0 then 'chars=' || n end as output_text,"
        " case when n % 7 <> 0 then cast(n as varchar) end as input_tokens, case when n % 7 = 0 then 'bad input' end as error,"
        f" left({_indent_sql(_CLAUDE_TEXT_INPUT)}, 500) || '...' as model_input_preview"
        f" from (select *, {_SCORED} as n from named_objects where {_IS['text']}"
        " order by md5('3:' || file_path), file_path limit 20)",
        "named_objects",
    ),
)
def infer_sample(spark, sf_dir):
    sample = O.sampled_content(O.route(_valid(spark, sf_dir), "text"), n=20, seed=3)
    text = Q.text_prompt(PROMPT, "content")
    rows = sample.select(
        "file_path",
        F.col("file_path").alias("record_id"),
        Q.routed_line(F.col("file_path"), CLAUDE, Q.claude_text_input(text), Q.nova_text_input(text)).alias("value"),
    )
    return I.infer_sample(rows, make_length_scorer, info="file_path").select(
        "file_info",
        "success",
        "output_text",
        F.col("input_tokens").cast("string").alias("input_tokens"),
        "error",
        "model_input_preview",
    )


# ---------------------------------------------------------------- files listed, opened and read in part by the tasks


def _result_folders(spark, sf_dir) -> DataFrame:
    """The result lines of jobs as files that are folders of parts, listed: job_id, file_path, part, uri, size.

    Parts follow the order of the lines, so a job that owns most of them is written by many tasks.
    """
    root = shared_path(spark, "result_files")
    lines = views.job_lines(spark, sf_dir).withColumn("name", C.basename("file_path"))
    lines = lines.repartitionByRange("doc_id").sortWithinPartitions("job_id", "name", "doc_id")
    lines.select("job_id", "name", "line").write.partitionBy("job_id", "name").option("lineSep", "\n").text(root)
    part = F.regexp_extract("file_path", "^job_id=([^/]*)/name=([^/]*)/", 0)
    job = F.regexp_extract(part, "job_id=([^/]*)/", 1)
    name = F.regexp_extract(part, "name=([^/]*)/", 1)
    return T.list_tree(spark, root, hidden=False).select(
        job.alias("job_id"),
        F.concat(F.lit("out/"), job, F.lit("/"), name).alias("file_path"),
        F.col("file_path").alias("part"),
        F.concat(F.lit(root + "/"), F.col("file_path")).alias("uri"),
        "size",
    )


_PREVIEW_COLUMNS = ("job_id", "file_path", "line_no", *P.RESULT_FIELDS)


@query("fallback_from_files", CATALOG["read_results_fallback"][1])
def fallback_from_files(spark, sf_dir):
    """The fallback from the first bytes of files: no line is moved."""
    rows = P.fallback_from_files(_result_folders(spark, sf_dir), part="part")
    return rows.select(*_PREVIEW_COLUMNS)


@query("previews_from_files", CATALOG["job_previews"][1])
def previews_from_files(spark, sf_dir):
    """Previews from as much of each chosen file as holds them."""
    return P.previews_from_files(_result_folders(spark, sf_dir), 3, part="part").select(*_PREVIEW_COLUMNS)


@query("first_request_of_file", CATALOG["first_request"][1])
def first_request_of_file(spark, sf_dir):
    """The first request of a request file in parts, which is not read further than that."""
    root = shared_path(spark, "requests")
    rows = _text_batch(spark, sf_dir).repartitionByRange("file_path").sortWithinPartitions("file_path")
    K.write_requests(rows, root)
    uri = F.concat(F.lit(root + "/"), F.col("file_path")).alias("uri")
    parts = T.list_tree(spark, root, hidden=False).select(F.lit("f").alias("file"), F.col("file_path").alias("part"), uri)
    return L.request_rows(H.head_lines_of_parts(parts, 1, ["file"])).select("record_id", "model_input")


@query(
    "list_tree",
    "select lang, source, cast(sum(strlen(coalesce(text, '')) + 1) as bigint) as size from documents"
    " where starts_with(source, 'src1') and lang = 'en' group by lang, source",
)
def list_tree(spark, sf_dir):
    """A tree of files by language and source, listed by the tasks from a prefix that ends inside a folder's name."""
    root = shared_path(spark, "tree")
    docs = views.table(spark, sf_dir, "documents").select("lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    docs.write.partitionBy("lang", "source").option("lineSep", "\n").text(root)
    found = T.list_tree(spark, root, "lang=en/source=src1", hidden=False)
    lang, source = (F.regexp_extract("file_path", f"{c}=([^/]*)/", 1).alias(c) for c in ("lang", "source"))
    return found.groupBy(lang, source).agg(F.sum("size").alias("size"))


# Limit of the listed media, low enough that some are rejected.
LISTED_LIMIT = 8000
_LISTED_INPUT = {"text": _NOVA_TEXT_INPUT, "image": _CLAUDE_IMAGE_INPUT, "video": _VIDEO_INPUT}


def _listed_sql(modality: str) -> str:
    chars = "((strlen(content) + 2) // 3) * 4"
    content = "text" if modality == "text" else "to_base64(encode(text))"
    bad = "doc_id % 7 = 3" if modality == "text" else "false"
    large = "false" if modality == "text" else f"{chars} > {LISTED_LIMIT}"
    model_input = _LISTED_INPUT[modality]
    return with_views(
        f"select k, {_RID} as record_id, {_line_sql(model_input)} as value, null as reason from numbered"
        f" union all select k, null, null, case when large then 'Base64编码后大小 ' || cast({chars} as bigint) ||"
        f" ' 字符超过限制 {LISTED_LIMIT}' else 'unreadable content' end from objects where large or bad"
        " union all select k, null, null, 'unreadable content' from objects where doc_id % 11 = 5",
        objects=f"select *, {large} as large, {bad} as bad from (select doc_id, lpad(cast(doc_id as varchar), 12, '0') as k,"
        f" {content} || chr(10) as content from (select doc_id, coalesce(text, '') as text from documents))",
        numbered="select *, row_number() over (order by k) - 1 as record_index from objects where not large and not bad",
    )


def _listed_query(modality: str) -> Query:
    def run(spark, sf_dir):
        root, text = shared_path(spark, f"{modality}_objects"), F.coalesce("text", F.lit(""))
        if modality == "text":
            not_text = F.expr("cast(unhex('FF') as string)")
            content = F.when(F.col("doc_id") % 7 == 3, F.concat(not_text, text)).otherwise(text)
        else:
            content = C.base64_text(F.encode(text, "UTF-8"))
        docs = views.table(spark, sf_dir, "documents")
        k = F.lpad(F.col("doc_id").cast("string"), 12, "0")
        docs = docs.select(F.coalesce(k, F.lit("__HIVE_DEFAULT_PARTITION__")).alias("k"), "doc_id", content.alias("content"))
        ending = {"text": "txt", "image": "png", "video": "mp4"}[modality]
        place = F.concat(F.lit("k="), F.substring("k", 1, 9), F.lit("/k="), "k")  # in the order of the keys
        part = F.concat(place, F.format_string(f".%05d.{ending}", F.spark_partition_id())).alias("name")
        line = F.concat("content", F.lit("\n")).cast("binary").alias("content")
        K.write_objects(docs.select(part, line).sortWithinPartitions("name"), root)
        listing = T.list_tree(spark, root, hidden=False).select("file_path", "size")
        gone = docs.filter("doc_id % 11 = 5").select(
            F.concat(place, F.lit(f".gone.{ending}")).alias("file_path"), F.lit(4).cast("bigint").alias("size")
        )
        batch = Q.prepare_listed_batch(
            listing.unionAll(gone),
            root + "/",
            modality,
            CLAUDE if modality == "image" else NOVA,
            batch_ts=BATCH_TS,
            prompt=PROMPT,
            system_prompt=SYSTEM if modality == "image" else None,
            max_base64=LISTED_LIMIT,
        )
        k = F.regexp_extract("file_path", "/k=([^.]*)[.]", 1).alias("k")
        empty = F.lit(None).cast("string")
        rejects = batch.rejects.select(k, empty.alias("record_id"), empty.alias("value"), "reason")
        return batch.requests.select(k, "record_id", "value", empty.alias("reason")).unionAll(rejects)

    return run


for _m in fixed.MODALITIES:
    query(f"listed_{_m}_requests", _listed_sql(_m))(_listed_query(_m))


_REGISTRY = "job_arn, output_bucket, output_prefix, aws_region, input_bucket, input_prefix"


@query(
    "read_registry",
    with_views(
        f"select cast(row_number() over (order by seq) - 1 as integer) as seq_in_doc, job_arn as job_key, {_REGISTRY},"
        " 'at ' || seq as timestamp from registry_log",
        "registry_log",
    ),
)
def read_registry(spark, sf_dir):
    """All entries as one JSON object in a folder of parts, cut into entries by the tasks that read its ranges."""
    root = shared_path(spark, "registry_document")
    log = views.registry_log(spark, sf_dir)
    first, last = log.agg(F.min("seq"), F.max("seq")).first()
    value = F.to_json(F.struct(*_REGISTRY.split(", "), F.concat(F.lit("at "), F.col("seq").cast("string")).alias("timestamp")))
    line = F.concat(
        F.when(F.col("seq") == first, "{").otherwise(","),
        F.to_json(F.struct(F.col("job_arn").alias("k"))).substr(F.lit(6), F.char_length("job_arn") + 2),
        F.lit(":"),
        value,
        F.when(F.col("seq") == last, "}").otherwise(""),
    )
    rows = log.repartitionByRange("seq").sortWithinPartitions("seq").select(line.alias("value"))
    K.write_requests(rows, root)
    return G.read_registry(spark, root, range_bytes=1 << 18)


def _metrics_sql(step: str, source: str, **metrics: str) -> list[str]:
    return [f"select '{step}' as step, '{m}' as metric, cast({e} as bigint) as value from {source}" for m, e in metrics.items()]


_IMAGE_FITS = f"((size + 2) // 3) * 4 <= {IMAGE_LIMIT}"


@query(
    "progress_counts",
    with_views(
        " union all ".join(
            _metrics_sql(
                "scan",
                "objects",
                scanned="count(*)",
                skipped="count(*) - (select count(*) from named_objects)",
                kept="min((select count(*) from named_objects))",
            )
            + _metrics_sql(
                "process",
                "named_objects",
                scanned="count(*)",
                matched=f"count(*) filter (where {_IS['image']})",
                accepted=f"count(*) filter (where {_IS['image']} and {_IMAGE_FITS})",
                oversized=f"count(*) filter (where {_IS['image']} and not {_IMAGE_FITS})",
            )
            + _metrics_sql("generate", "lines", records="count(*)", characters="coalesce(sum(length(value)), 0)")
        ),
        "named_objects",
        **_TEXT_NUMBERED,
        lines=f"select {_line_sql(_CLAUDE_TEXT_INPUT)} as value from numbered",
    ),
)
def progress_counts(spark, sf_dir):
    """What the steps of two batches counted while they ran."""
    kept, scan = W.observe_listing(views.objects(spark, sf_dir))
    accepted, process = W.observe_batch(kept, "image", IMAGE_LIMIT)
    accepted.select("file_path").write.parquet(shared_path(spark, "accepted"))
    requests, generate = W.observe_requests(_text_batch(spark, sf_dir))
    K.write_requests(requests, shared_path(spark, "requests"))
    return W.progress_rows(spark, {"scan": scan, "process": process, "generate": generate})
