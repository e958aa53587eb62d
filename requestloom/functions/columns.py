"""Path, size, payload and string helpers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ColumnOrName = Column | str


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def basename(path: ColumnOrName) -> Column:
    """The part of a path after its last slash."""
    return F.substring_index(as_col(path), "/", -1)


def second_string(ts: ColumnOrName) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd HH:mm:ss")


def size_label(size: ColumnOrName) -> Column:
    """``12B``, ``1.2KB``, ``3.4MB``; exact ties round to the even digit."""
    n = as_col(size)

    def one_decimal(unit: int, suffix: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(n.cast("double") / unit, 1)), F.lit(suffix))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
        .when(n < 1024 * 1024, one_decimal(1024, "KB"))
        .otherwise(one_decimal(1024 * 1024, "MB"))
    )


def has_extension(file_name: ColumnOrName, extensions: tuple[str, ...]) -> Column:
    name = F.lower(as_col(file_name))
    return reduce(lambda a, b: a | b, [name.endswith("." + e) for e in extensions])


def modality_of(file_name: ColumnOrName) -> Column:
    """text / image / video, or null for any other name."""
    out = F
    for modality in fixed.MODALITIES:
        out = out.when(has_extension(file_name, fixed.EXTENSIONS[modality]), F.lit(modality))
    return out


def last_extension(file_name: ColumnOrName) -> Column:
    """Lower-cased text after the last dot (the whole name if there is none)."""
    return F.substring_index(F.lower(as_col(file_name)), ".", -1)


def base64_length(size: ColumnOrName) -> Column:
    """Characters of base64 text for a payload of ``size`` bytes, without encoding it."""
    return F.floor((as_col(size) + 2) / 3) * 4


def max_raw_bytes(max_base64: int) -> int:
    """Largest payload whose base64 text is within ``max_base64`` characters.

    A bound on the raw size is a plain comparison with a literal, which a file
    source can use before it reads any content.
    """
    return max_base64 // 4 * 3


def base64_text(content: ColumnOrName) -> Column:
    """Base64 on one line, whatever the session's chunking setting is."""
    return F.translate(F.base64(as_col(content)), "\r\n", "")


def strip(text: ColumnOrName) -> Column:
    return F.btrim(as_col(text), F.lit(fixed.WHITESPACE))


def strip_line(line: ColumnOrName) -> Column:
    """``strip`` with a short cut for what most lines are: a JSON object without space around it."""
    t = as_col(line)
    return F.when(t.startswith("{") & t.endswith("}"), t).otherwise(strip(t))


def is_blank(text: ColumnOrName) -> Column:
    t = as_col(text)
    return F.when(t.startswith("{"), False).otherwise(strip(t) == "")


def is_given(text: ColumnOrName) -> Column:
    """Neither null nor the empty string."""
    return F.coalesce(as_col(text) != "", F.lit(False))


def shown(value: ColumnOrName) -> Column:
    """A value inside a message; null is shown as ``None``."""
    return F.coalesce(as_col(value).cast("string"), F.lit("None"))


def normalize_prefix(prefix: ColumnOrName) -> Column:
    bare = F.ltrim(F.coalesce(as_col(prefix), F.lit("")), F.lit("/"))
    return F.when((bare == "") | bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/")))


def shorten(text: ColumnOrName, limit: int) -> Column:
    """The first ``limit`` characters, with an ellipsis only if something was cut."""
    t = as_col(text)
    return F.when(F.char_length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("..."))).otherwise(t)


def is_nova(model_id: ColumnOrName) -> Column:
    return F.lower(as_col(model_id)).contains("nova")
