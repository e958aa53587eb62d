"""Strict reading of JSON lines.

Spark's JSON functions stop after the first complete value, so ``{"a":1} x``
would pass.  The line is therefore wrapped together with its own hash, and the
line counts as one valid JSON value only if the hash comes back from the place
where it was put.  That needs a single parse per line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnOrName, as_col


# Strict quoting, and strings as long as an encoded video (the parser's own default stops at 20 million
# characters).  NaN and Infinity are numbers by default.
JSON_OPTIONS = {"allowSingleQuotes": "false", "maxStringLen": "2000000000"}


def strict_variant(line: ColumnOrName) -> Column:
    """``[line, hash]`` as a VARIANT, null when it cannot be parsed at all."""
    text = as_col(line)
    wrapped = F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]"))
    return F.from_json(wrapped, "variant", JSON_OPTIONS)


def is_one_value(wrapped: ColumnOrName, line: ColumnOrName) -> Column:
    """Whether the wrapped line was exactly one JSON value."""
    tail = F.try_variant_get(as_col(wrapped), "$[1]", "bigint")
    return F.coalesce(tail == F.xxhash64(as_col(line)), F.lit(False))


def item(wrapped: ColumnOrName, path: str, kind: str = "variant") -> Column:
    """A path inside the wrapped line.  As ``variant``, null means *no such key*."""
    return F.try_variant_get(as_col(wrapped), "$[0]" + path, kind)


def display_text(value: ColumnOrName) -> Column:
    """A JSON value inside a message: ``None``, ``True``, ``False`` or its plain text."""
    v = as_col(value)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(F.is_variant_null(v), F.lit("None"))
        .when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


REQUEST_HEAD = (
    "r struct<recordId variant, modelInput struct<schemaVersion variant, inferenceConfig variant, "
    "anthropic_version variant, max_tokens variant>>, h bigint"
)


def request_head(line: ColumnOrName) -> Column:
    """Identity and format markers of a request line in one pass.

    Only the named fields are built; the message payload, which may be tens of
    megabytes, is skipped by the parser.  ``h`` is the hash of the line when the
    line is one valid JSON object, and null otherwise.
    """
    text = as_col(line)
    wrapped = F.concat(
        F.lit('{"r":'), text, F.lit(',"h":'), F.xxhash64(text).cast("string"), F.lit("}")
    )
    return F.from_json(wrapped, REQUEST_HEAD, JSON_OPTIONS)


def request_body(line: ColumnOrName) -> Column:
    """``modelInput`` of a request line as JSON text, ``{}`` if there is none."""
    return F.coalesce(F.from_json(as_col(line), "modelInput string", JSON_OPTIONS)["modelInput"], F.lit("{}"))
