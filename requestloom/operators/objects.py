"""Operators over the object table: listing filters, routing, counters, samples.

An object table has at least ``file_path`` and ``size``.  All filters are narrow
(no shuffle); the counters are single aggregates with map-side combine, and none
of them reads object content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..functions.topn import top_n


class EmptyInputError(ValueError):
    """No object, or no object of the wanted modality, below the prefix."""


def is_valid_object(prefix: str = "") -> Column:
    """Not the prefix itself, not a folder key, not empty."""
    path = F.col("file_path")
    return (path != prefix) & ~path.endswith("/") & (F.col("size") != 0)


def under_prefix(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Keys starting with a prefix, taken as plain text and not as a folder."""
    return objects.filter(F.col("file_path").startswith(prefix)) if prefix else objects


def valid_objects(objects: DataFrame, prefix: str = "") -> DataFrame:
    return objects.filter(is_valid_object(prefix))


def describe(objects: DataFrame) -> DataFrame:
    """Listing rows as shown: path, name, size, second-precision time string."""
    return objects.select(
        "file_path",
        C.basename("file_path").alias("file_name"),
        "size",
        C.second_string("last_modified").alias("last_modified"),
    )


def list_objects(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Every valid object below a prefix, with its name."""
    kept = valid_objects(under_prefix(objects, prefix), prefix)
    return kept.withColumn("file_name", C.basename("file_path"))


def preview_report(objects: DataFrame, bucket: str, prefix: str = "") -> DataFrame:
    """One row saying whether a listing preview has anything to show."""
    kept = list_objects(objects, prefix).agg(F.count(F.lit(1)).alias("n_objects"))
    state = F.when(F.lit(bucket or "") == "", "missing_bucket").when(
        F.col("n_objects") == 0, "no_objects"
    )
    return kept.select(state.otherwise("found").alias("state"), "n_objects")


def route(objects: DataFrame, modality: str) -> DataFrame:
    """Objects whose name has one of the endings of a modality."""
    return objects.filter(C.has_extension("file_path", fixed.EXTENSIONS[modality]))


def with_size_label(objects: DataFrame) -> DataFrame:
    return objects.withColumn("size_label", C.size_label("size"))


def listing_stats(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Scanned, skipped and kept counts of one listing."""
    kept = F.count_if(is_valid_object(prefix))
    return under_prefix(objects, prefix).agg(
        F.count(F.lit(1)).alias("scanned"),
        (F.count(F.lit(1)) - kept).alias("skipped"),
        kept.alias("kept"),
    )


def modality_counts(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Per modality: matching objects, and objects scanned.  One pass, three rows."""
    listed = list_objects(objects, prefix)
    matches = [
        F.count_if(C.has_extension("file_path", fixed.EXTENSIONS[m])).alias(m)
        for m in fixed.MODALITIES
    ]
    totals = listed.agg(F.count(F.lit(1)).alias("scanned"), *matches)
    rows = F.array(
        *[F.struct(F.lit(m).alias("modality"), F.col(m).alias("matched")) for m in fixed.MODALITIES]
    )
    return totals.select(F.explode(rows).alias("m"), "scanned").select(
        "m.modality", "m.matched", "scanned"
    )


def nonempty_report(objects: DataFrame, bucket: str, prefix: str = "") -> DataFrame:
    """Per modality: whether there is input at all, and the message if not."""
    place = f"在 {bucket}/{prefix} "
    modality = F.col("modality")
    text_message = F.replace(F.lit(fixed.NO_TEXT), F.lit("{}"), F.col("scanned").cast("string"))
    none_of = (
        F.when(modality == "text", text_message)
        .when(modality == "image", fixed.NO_IMAGES)
        .otherwise(fixed.NO_VIDEOS)
    )
    return modality_counts(objects, prefix).select(
        "modality",
        F.when(F.col("scanned") == 0, "no_objects")
        .when(F.col("matched") == 0, "none_of_modality")
        .otherwise("ok")
        .alias("state"),
        F.concat(
            F.lit(place),
            F.when(F.col("scanned") == 0, fixed.NO_OBJECTS).when(F.col("matched") == 0, none_of),
        ).alias("message"),
    )


def require_nonempty(objects: DataFrame, modality: str, bucket: str, prefix: str = "") -> None:
    """Raise when a batch of the modality would have no input."""
    row = nonempty_report(objects, bucket, prefix).filter(F.col("modality") == modality).first()
    if row["state"] != "ok":
        raise EmptyInputError(row["message"])


def oversize_report(objects: DataFrame, limit: int = fixed.VIDEO_ADVISORY_BYTES) -> DataFrame:
    """Videos above the advised raw size, with their size labels."""
    return with_size_label(route(objects, "video").filter(F.col("size") > limit)).select(
        "file_path", C.basename("file_path").alias("file_name"), "size", "size_label"
    )


def sample_objects(objects: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """``n`` objects in an order drawn by hashing path and seed.

    The draw is uniform over paths, repeatable, and needs only a top-n per task.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("file_path")))
    return top_n(objects, n, draw, "file_path")


def sampled_content(objects: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """The sampled rows with all their columns, content included.

    Draws from paths alone, then selects the ``n`` drawn paths as literals, so a
    source ordered by path reads only the parts that hold them.
    """
    drawn = sample_objects(objects.select("file_path"), n, seed).collect()  # n rows
    return objects.filter(F.col("file_path").isin([r["file_path"] for r in drawn]))
