"""Rule checks over configuration and request tables; all narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..functions import jsonl as J
from ..functions.columns import ColumnOrName, as_col


def valid_bucket(name: ColumnOrName) -> Column:
    n = as_col(name)
    ok = F.char_length(n).between(fixed.BUCKET_MIN, fixed.BUCKET_MAX) & n.rlike(fixed.BUCKET_PATTERN)
    return F.coalesce(ok, F.lit(False))


def valid_model_id(model_id: ColumnOrName) -> Column:
    return F.coalesce(~C.is_blank(model_id), F.lit(False))


def _only(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def validate_configs(configs: DataFrame) -> DataFrame:
    """Add ``valid, checks, errors, warnings`` to rows of role, buckets and model id.

    A wrong role ends the check with that one error; otherwise both buckets and
    the model id, if one is given, are checked and fixed warnings are added.
    """
    role, model = F.col("role_arn"), F.col("model_id")
    good_role = F.coalesce(role.startswith(fixed.ROLE_PREFIX), F.lit(False))
    role_error = F.array(F.concat(F.lit(fixed.ROLE_BAD), C.shown(role)))
    none = F.array().cast("array<string>")

    checks: list[Column] = [F.lit(fixed.ROLE_OK)]
    errors: list[Column] = []
    for column, good, bad in (
        ("input_bucket", fixed.INPUT_BUCKET_OK, fixed.INPUT_BUCKET_BAD),
        ("output_bucket", fixed.OUTPUT_BUCKET_OK, fixed.OUTPUT_BUCKET_BAD),
    ):
        fine = valid_bucket(column)
        checks.append(F.when(fine, F.concat(F.lit(good), F.col(column))))
        errors.append(F.when(~fine, F.concat(F.lit(bad), C.shown(column))))
    given, fine = C.is_given(model), valid_model_id(model)
    checks.append(F.when(given & fine, F.concat(F.lit(fixed.MODEL_OK), model)))
    errors.append(F.when(given & ~fine, F.concat(F.lit(fixed.MODEL_BAD), model)))

    warnings = F.array(*[F.lit(w) for w in fixed.CONFIG_WARNINGS])
    return configs.withColumns(
        {
            "checks": F.when(good_role, _only(*checks)).otherwise(none),
            "errors": F.when(good_role, _only(*errors)).otherwise(role_error),
            "warnings": F.when(good_role, warnings).otherwise(none),
        }
    ).withColumn("valid", F.size("errors") == 0)


def config_report(configs: DataFrame) -> DataFrame:
    """One text per configuration: checks, warnings, errors, verdict."""
    missing = ~(C.is_given("input_bucket") & C.is_given("output_bucket") & C.is_given("role_arn"))
    checked = validate_configs(configs)
    verdict = F.when(F.col("valid"), fixed.CONFIG_PASSED).otherwise(fixed.CONFIG_FAILED)
    lines = F.concat(F.col("checks"), F.col("warnings"), F.col("errors"), F.array(verdict))
    return checked.withColumn(
        "report",
        F.when(missing, F.lit(fixed.CONFIG_INCOMPLETE)).otherwise(F.array_join(lines, "\n")),
    ).withColumn("valid", F.col("valid") & ~missing)


def _first_broken(modality: str) -> tuple[Column, Column]:
    """Name and message of the first rule a submission of a modality breaks."""
    base = ~(C.is_given("output_bucket") & C.is_given("model_name") & C.is_given("role_arn"))
    no_model = ~C.is_given("model_id")
    use_jsonl = F.coalesce(F.col("use_jsonl"), F.lit(False))
    no_uri = use_jsonl & ~C.is_given("jsonl_s3_uri")
    no_input = ~use_jsonl & ~(C.is_given("input_bucket") & C.is_given("prompt"))
    mode_rules = [
        (no_uri, "missing_jsonl_uri", fixed.MISSING_URI[modality]),
        (no_input, "missing_input", fixed.MISSING_INPUT[modality]),
    ]
    model_rule = [(no_model, "invalid_model", fixed.INVALID_MODEL)]
    rules = [(base, "missing_required", fixed.MISSING_REQUIRED)]
    rules += model_rule + mode_rules if modality == "text" else mode_rules + model_rule
    rule, message = F, F
    for broken, name, text in rules:
        rule, message = rule.when(broken, F.lit(name)), message.when(broken, F.lit(text))
    return rule.otherwise(F.lit("ok")), message.otherwise(F.lit(None).cast("string"))


def required_fields(submissions: DataFrame) -> DataFrame:
    """First rule a job submission breaks, in the order its modality checks them.

    ``model_id`` is the looked-up id (null for an unknown model name).  The test
    is for empty text; blank text passes.
    """
    rule, message = F, F
    for m in fixed.MODALITIES:
        first, text = _first_broken(m)
        mine = F.col("modality") == m
        rule, message = rule.when(mine, first), message.when(mine, text)
    return submissions.withColumns({"rule": rule, "message": message})


def check_format(lines: DataFrame, model_id: str | Column, col: str = "line") -> DataFrame:
    """Format of every non-blank request line and whether it suits the model; broken lines suit none."""
    nova_model = F.lit("nova" in model_id.lower()) if isinstance(model_id, str) else C.is_nova(model_id)
    text = C.strip_line(col)
    opened = lines.withColumn("_h", J.request_head(text))
    good = F.coalesce(F.col("_h.h") == F.xxhash64(text), F.lit(False)) & F.is_valid_utf8(col)
    body = "_h.r.modelInput."
    nova = F.col(body + "schemaVersion").isNotNull() & F.col(body + "inferenceConfig").isNotNull()
    claude = F.col(body + "anthropic_version").isNotNull() & F.col(body + "max_tokens").isNotNull()
    clash = F.when(nova_model & claude, F.lit(fixed.CLAUDE_FILE_FOR_NOVA)).when(
        ~nova_model & nova, F.lit(fixed.NOVA_FILE_FOR_CLAUDE)
    )
    verdict = F.struct(
        F.coalesce(F.try_variant_get("_h.r.recordId", "$", "string"), F.lit("unknown")).alias("record_id"),
        F.when(~good, "malformed")
        .when(nova & claude, "both")
        .when(nova, "nova")
        .when(claude, "claude")
        .otherwise("other")
        .alias("format"),
        (good & clash.isNull()).alias("matches"),
        clash.alias("message"),
    )
    # as an inline, so that neither the blank test nor later filters repeat the making of a line
    others = [c for c in lines.columns if c != col]
    return opened.select(*others, F.inline(F.when(~C.is_blank(col), F.array(verdict))))
