"""Progress of a batch as observed metrics.

The counts ride along with the job that reads or writes the rows; nothing is
called per row and no extra job is started.  Once that job has run, its counts
can be kept as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .objects import is_valid_object
from .requests import payload_fits


def observe_listing(objects: DataFrame, prefix: str = "") -> tuple[DataFrame, Observation]:
    """Valid objects, and the scanned / skipped / kept counts of the pass that reads them."""
    seen = Observation("scan")
    kept = is_valid_object(prefix)
    watched = objects.observe(
        seen,
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(~kept).alias("skipped"),
        F.count_if(kept).alias("kept"),
    )
    return watched.filter(kept), seen


def observe_batch(
    objects: DataFrame, modality: str, max_base64: int | None = None
) -> tuple[DataFrame, Observation]:
    """Accepted objects of a modality, and the matched / accepted / oversized counts."""
    seen = Observation("process")
    mine = C.has_extension("file_path", fixed.EXTENSIONS[modality])
    fits = payload_fits(modality, max_base64) if modality in fixed.MAX_BASE64 else F.lit(True)
    watched = objects.observe(
        seen,
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(mine).alias("matched"),
        F.count_if(mine & fits).alias("accepted"),
        F.count_if(mine & ~fits).alias("oversized"),
    )
    return watched.filter(mine & fits), seen


def observe_requests(requests: DataFrame) -> tuple[DataFrame, Observation]:
    """The requests, and how many lines and characters a write of them produces."""
    seen = Observation("generate")
    watched = requests.observe(
        seen,
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(F.char_length("value")), F.lit(0)).alias("characters"),
    )
    return watched, seen


def progress_rows(spark: SparkSession, seen: dict[str, Observation | dict[str, int]]) -> DataFrame:
    """``step``, ``metric``, ``value`` of steps that have run; counts known otherwise may be given as they are."""
    rows = [
        (step, metric, int(value))
        for step, counts in seen.items()
        for metric, value in (counts.get if isinstance(counts, Observation) else counts).items()
    ]
    return spark.createDataFrame(rows, "step string, metric string, value bigint")
