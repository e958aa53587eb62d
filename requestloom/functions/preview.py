"""Indented preview of a request."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import fixed


@pandas_udf(StringType())
def request_preview(lines: pd.Series) -> pd.Series:
    """Start of the indented ``modelInput``, always followed by an ellipsis.

    Runs in Arrow batches: the indentation has a fixed layout that Spark's own
    pretty printer does not produce.
    """

    def start(line: str) -> str:
        body = json.loads(line).get("modelInput", {})
        return json.dumps(body, ensure_ascii=False, indent=2)[: fixed.REQUEST_PREVIEW_CHARS] + "..."

    return lines.map(start, na_action="ignore")
