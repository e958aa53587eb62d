"""Result lines: parsing, quarantine, previews, statistics, per-job bundles.

A line table has the text in ``line``; per-job operators also use ``job_id``,
``file_path`` and an order inside the file.  Parsing is narrow and parses each
line once.  Everything kept per job is small by construction (first file, last
manifest, first few lines, counts) and is found by aggregates with map-side
combine or by a group-limited rank, so one job may own most of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..functions import jsonl as J
from ..functions.topn import top_n
from ..session import stage_table
from ..sources.fetch import fetch_content, task_count
from ..sources.heads import head_lines_of_parts


def nonblank(lines: DataFrame, col: str = "line") -> DataFrame:
    return lines.filter(~C.is_blank(col))


def _open(lines: DataFrame, col: str = "line", tokens: bool = False) -> DataFrame:
    """Non-blank lines with the pieces of each envelope, from one parse per line.

    The pieces come out of an ``inline`` over at most one element, which the
    optimizer does not move: filters on them stay above it (below, each would
    repeat the parse), and the blank-line test does not repeat the making of the
    line.  Paths that a line's kind makes pointless are not looked up.
    """
    line = C.strip_line(col)
    parsed = lines.withColumn("_w", J.strict_variant(line))
    parsed = parsed.withColumn("_v", F.when(J.is_one_value("_w", line), F.col("_w")))
    # a ``content`` key, whatever it holds, makes it the first format
    parsed = parsed.withColumn("_a", J.item("_v", ".modelOutput.content[0].text"))
    no_content = F.col("_a").isNull() & J.item("_v", ".modelOutput.content").isNull()
    parsed = parsed.withColumn(
        "_b", F.when(no_content, J.item("_v", ".modelOutput.output.message.content[0].text"))
    )
    text = F.coalesce("_a", "_b")

    def by_format(a_path: str, b_path: str) -> Column:
        return F.when(F.col("_a").isNotNull(), J.item("_v", ".modelOutput." + a_path)).when(
            F.col("_b").isNotNull(), J.item("_v", ".modelOutput." + b_path)
        )

    def without_text(path: str, kind: str = "variant") -> Column:
        return F.when(text.isNull(), J.item("_v", path, kind))

    pieces = [
        F.is_valid_utf8(col).alias("_is_text"),
        F.col("_v").isNotNull().alias("_is_json"),
        J.item("_v", ".recordId").alias("_id"),
        text.alias("_text"),
        (text.isNotNull() | J.item("_v", ".modelOutput").isNotNull()).alias("_has_output"),
        by_format("stop_reason", "stopReason").alias("_stop"),
        without_text(".error").isNotNull().alias("_has_error"),
        without_text(".error", "map<string,variant>").isNotNull().alias("_is_error"),
        without_text(".error.errorCode").alias("_code"),
        without_text(".error.errorMessage").alias("_message"),
        without_text(".error.retryable").alias("_retry"),
    ]
    if tokens:
        pieces += [
            by_format("usage.input_tokens", "usage.inputTokens").alias("_tokens_in"),
            by_format("usage.output_tokens", "usage.outputTokens").alias("_tokens_out"),
        ]
    return parsed.select(*lines.columns, F.inline(F.when(~C.is_blank(col), F.array(F.struct(*pieces)))))


def classify_results(lines: DataFrame, col: str = "line") -> DataFrame:
    """Envelope kind of each non-blank line, by which key it carries."""
    kind = F.when(F.col("_has_output") & F.col("_is_text"), "success").when(F.col("_has_error") & F.col("_is_text"), "error").otherwise("invalid")
    return _open(lines, col).select(*lines.columns, kind.alias("kind"))


def _plain(value: str, default: str | None = None) -> Column:
    """Text of a JSON value: the default for a missing key, null for a JSON null."""
    text = F.try_variant_get(value, "$", "string")
    return text if default is None else F.when(F.col(value).isNull(), F.lit(default)).otherwise(text)


def _message_part(value: str, default: str) -> Column:
    return F.when(F.col(value).isNull(), F.lit(default)).otherwise(J.display_text(value))


def _parsed(lines: DataFrame, col: str, tokens: bool = False) -> DataFrame:
    """All non-blank lines with ``_state``: success, error, or the reject reason."""
    state = (
        F.when(~F.col("_is_text"), "malformed_text")
        .when(~F.col("_is_json"), "malformed_json")
        .when(F.col("_text").isNotNull(), "success")
        .when(F.col("_has_output"), "unrecognised_output")
        .when(F.col("_is_error"), "error")
        .when(F.col("_has_error"), "unrecognised_error")
        .otherwise("neither_key")
    )
    return _open(lines, col, tokens).withColumn("_state", state)


RESULT_FIELDS = (
    "record_id",
    "output_text",
    "stop_reason",
    "has_error",
    "error_code",
    "error_message",
    "retryable",
)
RESULT_SCHEMA = (
    "record_id string, output_text string, stop_reason string, has_error boolean, error_code string,"
    " error_message string, retryable boolean"
)


def _result_columns() -> list[Column]:
    """Result columns of rows in state success or error."""
    ok = F.col("_state") == "success"

    def of_error(value: Column) -> Column:
        return F.when(~ok, value)

    shown_error = F.concat(
        F.lit(fixed.FAILED_PREFIX),
        _message_part("_code", fixed.MISSING_ERROR_CODE),
        F.lit(": "),
        _message_part("_message", fixed.MISSING_ERROR_MESSAGE),
    )
    retry = F.when(F.col("_retry").isNull(), F.lit(False)).otherwise(F.try_variant_get("_retry", "$", "boolean"))
    return [
        _plain("_id").alias("record_id"),
        F.when(ok, _plain("_text")).otherwise(shown_error).alias("output_text"),
        F.when(ok, _plain("_stop", fixed.UNKNOWN_STOP)).otherwise(fixed.ERROR_STOP).alias("stop_reason"),
        (~ok).alias("has_error"),
        of_error(_plain("_code")).alias("error_code"),
        of_error(_plain("_message")).alias("error_message"),
        of_error(retry).alias("retryable"),
    ]


def _token_columns() -> list[Column]:
    def count(value: str) -> Column:
        return F.coalesce(F.try_variant_get(value, "$", "bigint"), F.lit(0).cast("bigint"))

    return [count("_tokens_in").alias("input_tokens"), count("_tokens_out").alias("output_tokens")]


_PARSED = ("success", "error")


def _others(lines: DataFrame, col: str) -> list[str]:
    return [c for c in lines.columns if c != col]


def parse_results(lines: DataFrame, col: str = "line", tokens: bool = False) -> DataFrame:
    """One flat row per line that holds an output or an error.

    ``tokens`` adds the input and output token counts (0 on error rows).
    """
    rows = _parsed(lines, col, tokens).filter(F.col("_state").isin(*_PARSED))
    usage = _token_columns() if tokens else []
    return rows.select(*_others(lines, col), *_result_columns(), *usage)


def parse_errors(lines: DataFrame, col: str = "line") -> DataFrame:
    """Only the error rows."""
    rows = _parsed(lines, col).filter(F.col("_state") == "error")
    return rows.select(*_others(lines, col), *_result_columns())


def invalid_results(lines: DataFrame, col: str = "line") -> DataFrame:
    """Quarantine: non-blank lines that give no row, with the reason."""
    rows = _parsed(lines, col).filter(~F.col("_state").isin(*_PARSED))
    return rows.select(*_others(lines, col), col, F.col("_state").alias("reason"))


def token_usage(lines: DataFrame, col: str = "line") -> DataFrame:
    """Input and output tokens of each success row; absent counts are 0."""
    rows = _parsed(lines, col, tokens=True).filter(F.col("_state") == "success")
    return rows.select(*_others(lines, col), _plain("_id").alias("record_id"), *_token_columns())


def stop_reason_counts(lines: DataFrame, col: str = "line") -> DataFrame:
    return parse_results(lines, col).groupBy("stop_reason").agg(F.count(F.lit(1)).alias("n_rows"))


def run_manifest(lines: DataFrame, by: list[str] | None = None, col: str = "line") -> DataFrame:
    """The six run totals, over all lines or per group."""
    ok, failed = F.col("_state") == "success", F.col("_state") == "error"
    zero = F.lit(0).cast("bigint")
    counted = _parsed(lines, col, tokens=True).select(*(by or []), "_state", *_token_columns())
    return (
        counted.groupBy(*(by or []))
        .agg(
            F.count(F.lit(1)).alias("totalRecordCount"),
            F.count_if(ok | failed).alias("processedRecordCount"),
            F.count_if(ok).alias("successRecordCount"),
            F.count_if(failed).alias("errorRecordCount"),
            F.coalesce(F.sum(F.when(ok, F.col("input_tokens"))), zero).alias("inputTokenCount"),
            F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), zero).alias("outputTokenCount"),
        )
    )


# ---------------------------------------------------------------- previews


def first_lines(
    lines: DataFrame, n: int, order: list[str], by: list[str] | None = None, col: str = "line"
) -> DataFrame:
    """The first ``n`` non-blank lines in file order, overall or per group.

    Malformed lines count, but for those whose bytes are not text.  Per group the rank filter becomes a group limit that
    runs before the shuffle, so at most ``n`` rows per group and task are moved.
    """
    kept = nonblank(lines, col).filter(F.is_valid_utf8(col))
    if not by:
        return top_n(kept, n, *order)
    place = Window.partitionBy(*by).orderBy(*order)
    return kept.withColumn("line_no", F.row_number().over(place)).filter(F.col("line_no") <= n)


def preview_results(
    lines: DataFrame,
    order: list[str],
    modality: str = "text",
    by: list[str] | None = None,
    n: int | None = None,
    col: str = "line",
) -> DataFrame:
    """Rows of the first lines, then parsed: record id, shortened text, stop reason."""
    n = fixed.PREVIEW_LINES[modality] if n is None else n
    rows = parse_results(first_lines(lines, n, order, by, col), col)
    keep = [*(by or []), *[c for c in order if c not in (by or [])]]
    if by:
        keep.append("line_no")
    return rows.select(
        *keep,
        "record_id",
        C.shorten("output_text", fixed.PREVIEW_CHARS).alias("output_text"),
        "stop_reason",
    )


# ---------------------------------------------------------------- result files of jobs


def file_kind(path: str = "file_path") -> Column:
    p = F.col(path)
    return (
        F.when(p.endswith("/"), "folder")
        .when(F.lower(p).contains("manifest.json.out"), "manifest")
        .when(p.endswith(".jsonl.out"), "result")
        .otherwise("other")
    )


def discover_result_files(listing: DataFrame, by: str = "job_id") -> DataFrame:
    """Per job: number of keys, first result file, last manifest file in listing order."""
    kind = file_kind()
    return listing.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min(F.when(kind == "result", F.col("file_path"))).alias("result_key"),
        F.max(F.when(kind == "manifest", F.col("file_path"))).alias("manifest_key"),
    )


def missing_result_files(listing: DataFrame, by: str = "job_id") -> DataFrame:
    """For jobs without a result file: one row per key that was found instead.

    The found keys stay rows; they are not gathered into one message, since a
    job's folder may hold any number of keys.
    """
    jobs = discover_result_files(listing, by).filter(F.col("result_key").isNull()).select(by, "n_files")
    return listing.join(jobs, by).select(
        by, "n_files", F.col("file_path").alias("found_key"), F.lit(fixed.NO_RESULT_FILE).alias("message")
    )


def read_results_fallback(
    lines: DataFrame,
    order: list[str],
    by: str = "job_id",
    col: str = "line",
    max_bytes: int = fixed.FALLBACK_BYTES,
    max_lines: int = fixed.FALLBACK_LINES,
) -> DataFrame:
    """Rows for jobs whose chosen file gave none: look into the start of every file.

    Of each file that is no folder and no manifest, the first ``max_bytes`` bytes
    are taken, blank space around them is removed, and the first ``max_lines``
    lines are parsed for outputs only.  Per job, the first file in listing order
    that gives rows wins.  ``lines`` holds the lines of each file in ``order``.

    The running length of a file is taken per input partition first, which drops
    everything that cannot be in the window, and then over what is left of the
    file; so a file that holds most of the lines is spread over many tasks.
    Lines with a ``block_start`` are only looked at in blocks the window reaches.
    The few rows of each file are written to the shared folder before the winning
    file is chosen, so the lines are read once.
    """
    usable = lines.filter(
        ~F.col("file_path").endswith("/") & ~F.lower("file_path").contains("manifest")
    )
    if "block_start" in lines.columns:
        usable = usable.filter(F.col("block_start") < max_bytes)
    key = [by, "file_path"]

    def window_start(rows: DataFrame, *group: str) -> DataFrame:
        """Rows whose first byte is inside the window, counted within a group."""
        before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum(F.octet_length("_b") + 1).over(before), F.lit(0))
        return rows.withColumn("_start", start).filter(F.col("_start") < max_bytes)

    # a prefix one byte longer than the window is all of a line that can matter
    cut = F.substring(F.col(col).cast("binary"), 1, max_bytes + 1)
    head = usable.select(*key, *[c for c in order if c not in key], cut.alias("_b"))
    head = window_start(head.withColumn("_part", F.spark_partition_id()), *key, "_part")
    head = window_start(head.drop("_part", "_start"), *key)
    in_file = Window.partitionBy(*key).orderBy(*order)
    head = head.withColumn("_n", F.row_number().over(in_file))
    # the byte window may end inside a line, even inside a character
    piece = F.substring(F.col("_b"), F.lit(1), (F.lit(max_bytes) - F.col("_start")).cast("int"))
    head = head.withColumn(col, F.try_validate_utf8(piece.cast("string")))
    readable = Window.partitionBy(*key)
    bad = F.max(F.col(col).isNull().cast("int")).over(readable)
    first = F.min(F.when(~C.is_blank(col), F.col("_n"))).over(readable)
    head = (
        head.withColumns({"_bad": bad, "_first": first})
        .filter((F.col("_bad") == 0) & (F.col("_n") >= F.col("_first")))
        .filter(F.col("_n") < F.col("_first") + max_lines)
        .select(*key, F.col("_n").alias("line_no"), col)
    )
    rows = _parsed(head, col).filter(F.col("_state") == "success")
    rows = stage_table(rows.select(*key, "line_no", *_result_columns()), "fallback")
    winner = rows.groupBy(by).agg(F.min("file_path").alias("file_path"))
    return rows.join(winner, key, "left_semi")


def job_previews(
    listing: DataFrame,
    lines: DataFrame,
    order: list[str],
    n: int = fixed.PREVIEW_LINES["text"],
    by: str = "job_id",
    col: str = "line",
) -> DataFrame:
    """Preview rows per job: from its first result file, else from the fallback scan.

    Each file is cut to its first ``n`` lines before anything is joined, so only
    a few rows per file meet the chosen files.  These rows are written to the
    shared folder, since both the result and the choice of jobs for the fallback
    need them and the lines should be read for them only once.
    """
    chosen = discover_result_files(listing, by).select(by, F.col("result_key").alias("file_path"))
    heads = first_lines(lines, n, order, [by, "file_path"], col)
    picked = heads.join(chosen.filter(F.col("file_path").isNotNull()), [by, "file_path"], "left_semi")
    wanted = [by, "file_path", "line_no", *RESULT_FIELDS]
    rows = stage_table(parse_results(picked, col).select(*wanted), "previews")
    done = rows.select(by).distinct()
    rest = read_results_fallback(lines.join(done, by, "left_anti"), order, by, col)
    return rows.unionByName(rest.select(*wanted))


def fallback_from_files(
    files: DataFrame,
    by: str = "job_id",
    part: str | None = None,
    store=None,
    max_bytes: int = fixed.FALLBACK_BYTES,
    max_lines: int = fixed.FALLBACK_LINES,
) -> DataFrame:
    """The rows of :func:`read_results_fallback`, from the files themselves.

    ``files`` has ``by``, ``file_path`` and ``uri``.  Tasks read no more than the first ``max_bytes`` bytes of each file;
    no line is moved.  With ``part``, a file is a folder of parts in that order and ``files`` has their ``size``: parts
    beyond the window are not opened, and only what is inside it comes together.  Files that cannot be read, or not as
    text, are passed over.
    """
    usable = files.filter(~F.col("file_path").endswith("/") & ~F.lower("file_path").contains("manifest"))
    key = [by, "file_path"]
    if part:
        before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        usable = usable.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        usable = usable.filter(F.col("start") < max_bytes).select(
            *key, "uri", "start", (F.lit(max_bytes) - F.col("start")).alias("most")
        )
        tasks = task_count(usable.count(), 0)
        heads = fetch_content(usable, tasks=tasks, store=store, head_bytes="most")
        held = F.array_sort(F.collect_list(F.struct("start", "content")))
        heads = heads.groupBy(*key).agg(held.alias("held"), F.max("problem").alias("problem"))
        whole = F.expr("aggregate(held, cast('' as binary), (all, one) -> concat(all, one.content))")
        heads = heads.filter("problem is null").select(*key, whole.alias("content"))
    else:
        usable = usable.select(*key, "uri")
        heads = fetch_content(usable, tasks=task_count(usable.count(), 0), store=store, head_bytes=max_bytes)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    heads = heads.select(*key, text.alias("text")).filter("text is not null")
    lead = F.expr("left(text, char_length(text) - char_length(unled))")
    skipped = F.char_length(lead) - F.char_length(F.replace(lead, F.lit("\n"), F.lit("")))
    body = F.split(C.strip("text"), "\n", max_lines + 1)
    lines = (
        heads.withColumn("unled", F.ltrim("text", F.lit(fixed.WHITESPACE)))
        .select(*key, skipped.alias("skipped"), F.posexplode(F.slice(body, 1, max_lines)).alias("at", "line"))
        .filter(~C.is_blank("line"))
        .select(*key, (F.col("skipped") + F.col("at") + 1).alias("line_no"), "line")
    )
    rows = _parsed(lines, "line").filter(F.col("_state") == "success")
    rows = stage_table(rows.select(*key, "line_no", *_result_columns()), "fallback")
    winner = rows.groupBy(by).agg(F.min("file_path").alias("file_path"))
    return rows.join(winner, key, "left_semi")


def previews_from_files(
    files: DataFrame,
    n: int = fixed.PREVIEW_LINES["text"],
    by: str = "job_id",
    part: str | None = None,
    store=None,
) -> DataFrame:
    """The rows of :func:`job_previews`, from the files themselves (see :func:`fallback_from_files`).

    Of each job's first result file so much is read as holds ``n`` lines; the list of files, not their lines, tells which
    jobs the fallback looks into.
    """
    chosen = discover_result_files(files.select(by, "file_path").distinct(), by)
    chosen = chosen.filter("result_key is not null").select(by, F.col("result_key").alias("file_path"))
    parts = files.withColumn("_part", F.col(part or "file_path")).join(chosen, [by, "file_path"], "left_semi")
    heads = head_lines_of_parts(parts, n, [by, "file_path"], "_part", store=store, on_error="skip")
    wanted = [by, "file_path", "line_no", *RESULT_FIELDS]
    rows = stage_table(parse_results(heads).select(*wanted), "previews")
    rest = files.join(rows.select(by).distinct(), by, "left_anti")
    return rows.unionByName(fallback_from_files(rest, by, part, store).select(*wanted))


def parse_warnings(listing: DataFrame, previews: DataFrame, by: str = "job_id") -> DataFrame:
    """Jobs with a result file but no preview row (warning), or with no result file (error)."""
    shown = previews.select(by).distinct()
    key = F.col("result_key")
    return (
        discover_result_files(listing, by)
        .join(shown, by, "left_anti")
        .select(
            by,
            key.alias("file_key"),
            "n_files",
            F.when(key.isNull(), "error").otherwise("warning").alias("level"),
            F.when(key.isNull(), fixed.NO_RESULT_FILE).otherwise(fixed.PARSE_WARNING).alias("message"),
        )
    )


_PREVIEW_ITEM = (
    "struct<line_no:int,record_id:string,output_text:string,stop_reason:string,"
    "has_error:boolean,error_code:string,error_message:string,retryable:boolean>"
)


def result_bundle(
    listing: DataFrame,
    previews: DataFrame,
    manifests: DataFrame,
    bucket: str,
    by: str = "job_id",
) -> DataFrame:
    """Per job: where its results are, the preview rows, and the manifest if there is one.

    ``previews`` holds at most a few rows per job (see :func:`job_previews`), so
    gathering them per job is bounded.  ``manifests`` has one row per manifest
    file.  A manifest is only reported together with a preview, and only if it could
    be read and holds a total.
    """
    entry = F.struct("line_no", *RESULT_FIELDS)
    packed = previews.groupBy(by).agg(
        F.min("file_path").alias("preview_key"), F.array_sort(F.collect_list(entry)).alias("preview")
    )
    stats = manifests.withColumnsRenamed({"file_path": "manifest_key"})
    totals = [c for c in stats.columns if c not in ("manifest_key", by)]
    stats = stats.select("manifest_key", *totals, F.coalesce(*[F.col(c) for c in totals]).isNotNull().alias("_read"))
    place = F.lit(f"s3://{bucket}/")
    shown = F.col("preview").isNotNull()
    known = shown & F.coalesce("_read", F.lit(False))
    return (
        discover_result_files(listing, by)
        .join(packed, by, "left")
        .withColumn("key", F.coalesce("preview_key", "result_key"))
        .filter(F.col("key").isNotNull())
        .join(stats, "manifest_key", "left")
        .select(
            by,
            F.lit(bucket).alias("bucket"),
            "key",
            C.basename("key").alias("file_name"),
            F.concat(place, F.col("key")).alias("s3_uri"),
            F.coalesce("preview", F.array().cast(f"array<{_PREVIEW_ITEM}>")).alias("preview"),
            F.when(known, F.concat(place, F.col("manifest_key"))).alias("manifest_s3_uri"),
            *[F.when(known, F.col(c)).alias(c) for c in totals],
            F.when(~shown, F.lit(fixed.PARSE_WARNING)).alias("parse_warning"),
        )
    )
