"""Request assembly: one structured JSON request per object.

The ``*_input`` functions build the ``modelInput`` struct of one format and
modality as a column; :func:`request_line` turns it into the JSON line.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import columns as C
from ..functions import fixed
from ..functions.columns import ColumnOrName, as_col
from ..session import small_table, stage_table
from ..sources.fetch import fetch_content, task_count
from .numbering import DuplicateKeyError, attach_numbers, number_records
from .objects import route


def _text(value: str | Column) -> Column:
    """Prompts are given as text or as a column."""
    return value if isinstance(value, Column) else F.lit(value)


def _optional(value: str | Column | None) -> Column:
    return F.nullif(F.lit(None).cast("string") if value is None else _text(value), F.lit(""))


def _user_message(*content: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), F.array(*content).alias("content")))


# ---------------------------------------------------------------- text


def text_prompt(prompt: str | Column, content: ColumnOrName, separator: str = fixed.TEXT_SEPARATOR) -> Column:
    return F.concat(_text(prompt), F.lit(separator), as_col(content))


def claude_text_input(
    text: Column, max_tokens: int = fixed.TEXT_MAX_TOKENS, temperature: float = fixed.TEXT_TEMPERATURE
) -> Column:
    item = F.struct(F.lit("text").alias("type"), text.alias("text"))
    return F.struct(
        F.lit(fixed.CLAUDE_VERSION).alias("anthropic_version"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(temperature).alias("temperature"),
        _user_message(item).alias("messages"),
    )


def nova_text_input(
    text: Column, max_tokens: int = fixed.TEXT_MAX_TOKENS, temperature: float = fixed.TEXT_TEMPERATURE
) -> Column:
    return F.struct(
        F.lit(fixed.NOVA_SCHEMA_VERSION).alias("schemaVersion"),
        _user_message(F.struct(text.alias("text"))).alias("messages"),
        F.struct(
            F.lit(max_tokens).alias("maxTokens"),
            F.lit(temperature).alias("temperature"),
            F.lit(0.9).alias("topP"),
        ).alias("inferenceConfig"),
    )


# ---------------------------------------------------------------- image


def image_format(file_name: ColumnOrName) -> Column:
    """Format named by the file ending, with ``jpg`` called ``jpeg``."""
    ext = C.last_extension(file_name)
    return F.when(ext == "jpg", fixed.DEFAULT_IMAGE_FORMAT).otherwise(ext)


def claude_image_input(
    data: Column,
    user_prompt: str | Column,
    system_prompt: str | Column | None = None,
    image_type: Column | None = None,
) -> Column:
    kind = F.lit(fixed.DEFAULT_IMAGE_FORMAT) if image_type is None else image_type
    source = F.struct(
        F.lit("base64").alias("type"),
        F.concat(F.lit("image/"), kind).alias("media_type"),
        data.alias("data"),
    )
    picture = F.struct(
        F.lit("image").alias("type"), source.alias("source"), F.lit(None).cast("string").alias("text")
    )
    no_source = F.lit(None).cast("struct<type:string,media_type:string,data:string>")
    words = F.struct(
        F.lit("text").alias("type"), no_source.alias("source"), _text(user_prompt).alias("text")
    )
    return F.struct(
        F.lit(fixed.CLAUDE_VERSION).alias("anthropic_version"),
        F.lit(fixed.MEDIA_MAX_TOKENS).alias("max_tokens"),
        F.lit(0.1).alias("temperature"),
        F.lit(0.1).alias("top_p"),
        F.lit(100).alias("top_k"),
        _user_message(picture, words).alias("messages"),
        _optional(system_prompt).alias("system"),
    )


def _nova_media_items(name: str, kind: Column, data: Column, user_prompt: str | Column) -> list[Column]:
    media = F.struct(kind.alias("format"), F.struct(data.alias("bytes")).alias("source"))
    no_media = F.lit(None).cast("struct<format:string,source:struct<bytes:string>>")
    return [
        F.struct(media.alias(name), F.lit(None).cast("string").alias("text")),
        F.struct(no_media.alias(name), _text(user_prompt).alias("text")),
    ]


def nova_image_input(
    data: Column,
    user_prompt: str | Column,
    system_prompt: str | Column | None = None,
    image_type: Column | None = None,
) -> Column:
    kind = F.lit(fixed.DEFAULT_IMAGE_FORMAT) if image_type is None else image_type
    system = _optional(system_prompt)
    return F.struct(
        F.lit(fixed.NOVA_SCHEMA_VERSION).alias("schemaVersion"),
        _user_message(*_nova_media_items("image", kind, data, user_prompt)).alias("messages"),
        F.struct(
            F.lit(fixed.MEDIA_MAX_TOKENS).alias("maxTokens"),
            F.lit(0.1).alias("temperature"),
            F.lit(0.9).alias("topP"),
        ).alias("inferenceConfig"),
        F.when(system.isNotNull(), F.array(F.struct(system.alias("text")))).alias("system"),
    )


# ---------------------------------------------------------------- video


def video_format(file_name: ColumnOrName) -> Column:
    ext = C.last_extension(file_name)
    return F.when(ext.isin(*fixed.VIDEO_EXTENSIONS), ext).otherwise(fixed.DEFAULT_VIDEO_FORMAT)


def video_input(
    data: Column,
    file_name: ColumnOrName,
    user_prompt: str | Column,
    system_prompt: str | Column | None = None,
) -> Column:
    system = F.coalesce(_optional(system_prompt), F.lit(fixed.DEFAULT_VIDEO_SYSTEM))
    return F.struct(
        F.lit(fixed.NOVA_SCHEMA_VERSION).alias("schemaVersion"),
        _user_message(
            *_nova_media_items("video", video_format(file_name), data, user_prompt)
        ).alias("messages"),
        F.array(F.struct(system.alias("text"))).alias("system"),
        F.struct(
            F.lit(fixed.MEDIA_MAX_TOKENS).alias("maxTokens"),
            F.lit(0.1).alias("topP"),
            F.lit(20).alias("topK"),
            F.lit(0.3).alias("temperature"),
        ).alias("inferenceConfig"),
    )


# ---------------------------------------------------------------- lines and ids


def request_line(record_id: Column, model_input: Column) -> Column:
    return F.to_json(F.struct(record_id.alias("recordId"), model_input.alias("modelInput")))


def record_id(batch_ts: int) -> Column:
    return F.concat(F.lit(f"{batch_ts}_"), F.col("record_index").cast("string"))


def routed_line(record_id: Column, model_id: str | Column, claude: Column, nova: Column) -> Column:
    """The line in the format the model takes; a fixed model picks it at plan time."""
    if isinstance(model_id, str):
        return request_line(record_id, nova if "nova" in model_id.lower() else claude)
    return F.when(C.is_nova(model_id), request_line(record_id, nova)).otherwise(
        request_line(record_id, claude)
    )


def route_format(requests: DataFrame, model_id: ColumnOrName = "model_id", modality: str = "text") -> DataFrame:
    """Add the request format of each row; video has one format only."""
    if modality == "video":
        return requests.withColumn("format", F.lit("nova"))
    return requests.withColumn("format", F.when(C.is_nova(model_id), "nova").otherwise("claude"))


# ---------------------------------------------------------------- payload checks


def payload_fits(modality: str, max_base64: int | None = None) -> Column:
    """Whether the base64 text would be within the limit, from the size alone."""
    limit = fixed.MAX_BASE64[modality] if max_base64 is None else max_base64
    return F.col("size") <= C.max_raw_bytes(limit)


def split_by_payload(
    objects: DataFrame, modality: str, max_base64: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Accepted objects, and one reject row with a reason per oversized object.

    The test is a literal bound on ``size``, so content of rejected objects is
    never read; both sides are narrow.
    """
    limit = fixed.MAX_BASE64[modality] if max_base64 is None else max_base64
    fits = payload_fits(modality, limit)
    before, after = fixed.OVERSIZED.format("{}", limit).split("{}")
    reason = F.concat(F.lit(before), C.base64_length("size").cast("string"), F.lit(after))
    rejects = objects.filter(~fits).select(
        "file_path", C.basename("file_path").alias("file_name"), reason.alias("reason")
    )
    return objects.filter(fits), rejects


def text_content(content: Column, is_binary: bool) -> Column:
    """Content as text; bytes that are not valid UTF-8 give null."""
    return F.try_validate_utf8(content.cast("string")) if is_binary else content


def split_unreadable(objects: DataFrame, modality: str) -> tuple[DataFrame, DataFrame]:
    """Readable objects, and reject rows for those without usable content."""
    is_binary = dict(objects.dtypes)["content"] == "binary"
    usable = F.col("content")
    if modality == "text":
        usable = text_content(usable, is_binary)
    good = usable.isNotNull()
    rejects = objects.filter(~good).select(
        "file_path", C.basename("file_path").alias("file_name"), F.lit(fixed.UNREADABLE).alias("reason")
    )
    return objects.filter(good), rejects


# ---------------------------------------------------------------- whole batches


@dataclass(frozen=True)
class Batch:
    """Requests (``file_path, record_id, value``) and the objects left out."""

    requests: DataFrame
    rejects: DataFrame
    rows: int


def prepare_batch(
    objects: DataFrame,
    modality: str,
    model_id: str | Column,
    *,
    batch_ts: int,
    prompt: str | Column = "",
    system_prompt: str | Column | None = None,
    on_error: str = "reject",
    max_base64: int | None = None,
    max_tokens: int = fixed.TEXT_MAX_TOKENS,
    temperature: float = fixed.TEXT_TEMPERATURE,
    separator: str = fixed.TEXT_SEPARATOR,
    media_type: str = "jpeg",
    broadcast_bytes: int | None = None,
) -> Batch:
    """Numbered requests for every accepted object of one modality.

    ``objects`` holds valid objects with ``file_path``, ``size`` and ``content``
    (string or binary).  ``on_error='reject'`` moves unreadable objects to the
    rejects, which makes the numbering pass read the content as well;
    ``on_error='fail'`` numbers from the listing columns alone and stops the job
    at the first unreadable object.  ``media_type='from_name'`` labels images by
    their file ending.  ``broadcast_bytes`` bounds the numbers that are brought to
    the content instead of the content to the numbers.
    """
    if on_error not in ("reject", "fail"):
        raise ValueError("on_error is 'reject' or 'fail'")
    accepted = route(objects, modality)
    rejects = None
    if modality in fixed.MAX_BASE64:
        accepted, rejects = split_by_payload(accepted, modality, max_base64)
    if on_error == "reject":
        accepted, unreadable = split_unreadable(accepted, modality)
        rejects = unreadable if rejects is None else rejects.unionByName(unreadable)
    if rejects is None:
        rejects = accepted.sparkSession.createDataFrame([], schemas.REJECTS)

    numbering = number_records(accepted, stage_keys=on_error == "reject")
    rows = attach_numbers(accepted.select("file_path", "content"), numbering, broadcast_bytes)
    choices = (prompt, system_prompt, max_tokens, temperature, separator, media_type)
    line = _batch_line(rows, modality, model_id, batch_ts, on_error, choices)
    requests = rows.select("file_path", record_id(batch_ts).alias("record_id"), line.alias("value"))
    return Batch(requests, rejects, numbering.rows)


def prepare_listed_batch(
    listing: DataFrame,
    root: str,
    modality: str,
    model_id: str,
    *,
    batch_ts: int,
    prompt: str = "",
    system_prompt: str | None = None,
    on_error: str = "reject",
    max_base64: int | None = None,
    max_tokens: int = fixed.TEXT_MAX_TOKENS,
    temperature: float = fixed.TEXT_TEMPERATURE,
    separator: str = fixed.TEXT_SEPARATOR,
    media_type: str = "jpeg",
    store=None,
) -> Batch:
    """The same batch from a listing without content: ``root`` + ``file_path`` names each object.

    Content is neither joined nor shuffled, and each object is opened once.  With
    ``fail`` the numbers come from the listing, and the tasks that build the
    requests read the objects.  With ``reject`` numbers only count objects that
    can be read: the listing is sorted into ranges of paths, tasks read their range
    and write the body of each request with its position among the good ones, and
    the number, first of the range plus position, is put in front at the end.
    """
    if on_error not in ("reject", "fail"):
        raise ValueError("on_error is 'reject' or 'fail'")
    accepted, rejects = route(listing, modality).select("file_path", "size"), None
    if modality in fixed.MAX_BASE64:
        accepted, rejects = split_by_payload(accepted, modality, max_base64)
    n, total = accepted.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = task_count(n, total)
    uri = F.concat(F.lit(root), F.col("file_path")).alias("uri")
    choices = (prompt, system_prompt, max_tokens, temperature, separator, media_type)
    if on_error == "reject":
        requests, unreadable, rows = _read_once(accepted.select("file_path", uri), modality, model_id, batch_ts, tasks, store, choices)
        return Batch(requests, unreadable if rejects is None else rejects.unionByName(unreadable), rows)
    if rejects is None:
        rejects = listing.sparkSession.createDataFrame([], schemas.REJECTS)
    numbering = number_records(accepted)
    rows = fetch_content(numbering.frame.select("file_path", "record_index", uri), tasks=tasks, store=store)
    line = _batch_line(rows, modality, model_id, batch_ts, "fail", choices)
    requests = rows.select("file_path", record_id(batch_ts).alias("record_id"), line.alias("value"))
    return Batch(requests, rejects, numbering.rows)


def _read_once(
    objects: DataFrame, modality: str, model_id: str, batch_ts: int, tasks: int, store, choices: tuple
) -> tuple[DataFrame, DataFrame, int]:
    """Requests, rejects and the number of requests of objects (``file_path``, ``uri``), each of which is opened once."""
    copy = F.row_number().over(Window.partitionBy("file_path").orderBy("file_path"))
    ranged = objects.repartitionByRange(tasks, "file_path").select("file_path", "uri", copy.alias("copy"))
    ranged = ranged.sortWithinPartitions("file_path")
    read = fetch_content(ranged, store=store, as_text=modality == "text", count_good=True)
    content = F.col("content").cast("string") if modality == "text" else C.base64_text("content")
    claude, nova = _inputs(content, C.basename("file_path"), modality, choices)
    body = F.to_json(nova if modality == "video" or "nova" in model_id.lower() else claude)
    good = F.col("problem").isNull()
    bodies = stage_table(
        read.select(
            "file_path", "copy", "position", F.spark_partition_id().alias("bucket"), F.when(good, body).alias("body")
        ),
        "bodies",
        "zstd",
    )
    good = F.col("body").isNotNull()
    counts = bodies.groupBy("bucket").agg(F.count_if(good).alias("n"), F.max("copy").alias("copies")).collect()
    if any(r["copies"] > 1 for r in counts):
        raise DuplicateKeyError(f"file_path is not unique: {bodies.filter('copy > 1').first()['file_path']!r} occurs twice")
    counts.sort()  # a row per range
    starts = [0, *accumulate(r["n"] for r in counts)]
    offsets = small_table(
        objects.sparkSession, "bucket int, first_index bigint", [r["bucket"] for r in counts], starts[: len(counts)]
    )
    numbered = bodies.filter(good).join(F.broadcast(offsets), "bucket")
    numbered = numbered.withColumn("record_index", F.col("first_index") + F.col("position"))
    value = F.concat(
        F.lit('{"recordId":"'), record_id(batch_ts), F.lit('","modelInput":'), F.col("body"), F.lit("}")
    )
    rejects = bodies.filter(~good).select(
        "file_path", C.basename("file_path").alias("file_name"), F.lit(fixed.UNREADABLE).alias("reason")
    )
    return numbered.select("file_path", record_id(batch_ts).alias("record_id"), value.alias("value")), rejects, starts[-1]


def _inputs(content: Column, name: Column, modality: str, choices: tuple) -> tuple[Column, Column]:
    """``modelInput`` in both formats, from a text or the base64 text of a payload; a video has one format only."""
    prompt, system_prompt, max_tokens, temperature, separator, media_type = choices
    if modality == "text":
        text = text_prompt(prompt, content, separator)
        return claude_text_input(text, max_tokens, temperature), nova_text_input(text, max_tokens, temperature)
    if modality == "video":
        film = video_input(content, name, prompt, system_prompt)
        return film, film
    kind = image_format(name) if media_type == "from_name" else None
    return (
        claude_image_input(content, prompt, system_prompt, kind),
        nova_image_input(content, prompt, system_prompt, kind),
    )


def _batch_line(rows: DataFrame, modality: str, model_id, batch_ts: int, on_error: str, choices: tuple) -> Column:
    """Request line of rows with ``file_path, record_index, content``."""
    is_binary = dict(rows.dtypes)["content"] == "binary"
    rid, content = record_id(batch_ts), F.col("content")
    if modality == "text":
        content = text_content(content, is_binary)
    if on_error == "fail":
        problem = F.raise_error(F.concat(F.lit("unreadable object "), F.col("file_path")))
        kind = "binary" if is_binary and modality != "text" else "string"
        content = F.coalesce(content, problem.cast("string").cast(kind))
    if modality != "text":
        content = C.base64_text(content if is_binary else F.encode(content, "UTF-8"))
    claude, nova = _inputs(content, C.basename("file_path"), modality, choices)
    return request_line(rid, nova) if modality == "video" else routed_line(rid, model_id, claude, nova)


def prepare_stats(objects: DataFrame, max_base64: dict[str, int] | None = None) -> DataFrame:
    """Per modality: processed and skipped counts, from names and sizes alone."""
    limits = {**fixed.MAX_BASE64, **(max_base64 or {})}
    aggs = []
    for m in fixed.MODALITIES:
        mine = C.has_extension("file_path", fixed.EXTENSIONS[m])
        fits = payload_fits(m, limits[m]) if m in limits else F.lit(True)
        aggs += [F.count_if(mine & fits).alias(m + "_in"), F.count_if(mine & ~fits).alias(m + "_out")]
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("modality"),
                F.col(m + "_in").alias("processed"),
                F.col(m + "_out").alias("skipped"),
            )
            for m in fixed.MODALITIES
        ]
    )
    return objects.agg(*aggs).select(F.explode(rows).alias("m")).select("m.*")
