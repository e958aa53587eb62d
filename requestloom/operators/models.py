"""Model lookups against the catalog, a fixed table of 29 rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed
from ..session import small_table


def model_catalog(spark: SparkSession) -> DataFrame:
    return small_table(spark, schemas.CATALOG, *map(list, zip(*fixed.MODEL_CATALOG)))


def resolve_models(requests: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Add ``model_id`` for (modality, model name); null when there is no such model.

    The default catalog has a fixed size and is broadcast; a catalog passed in is
    left to the optimizer's own size estimate.
    """
    if catalog is None:
        catalog = F.broadcast(model_catalog(requests.sparkSession))
    return requests.join(catalog, ["modality", "model_name"], "left")


def resolve_models_any(requests: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Add ``model_id`` by name alone: the first of text, image, video that has it."""
    fixed_size = catalog is None
    if fixed_size:
        catalog = model_catalog(requests.sparkSession)
    rank = F.array_position(F.array(*[F.lit(m) for m in fixed.MODALITIES]), F.col("modality"))
    first = catalog.groupBy("model_name").agg(F.min_by("model_id", rank).alias("model_id"))
    return requests.join(F.broadcast(first) if fixed_size else first, "model_name", "left")
