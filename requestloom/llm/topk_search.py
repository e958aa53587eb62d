"""Exact top-k by inner product, with a pivot-distance index.

Components are turned into whole numbers, so scores are exact.  With one more component that brings every row to the
largest norm, a larger inner product is a smaller distance, and the triangle inequality applies.  Rows are keyed by their
nearest pivot and, around it, by annuli of distance.  A query's distance to the pivot bounds its distance to everything in
an annulus from below.  A query expands annuli in the order of these bounds until it has k rows; the k-th score then
stops it: annuli whose bound cannot reach that score are never visited.

Annuli are kept as blocks of about ``BLOCK`` rows, and the queries that visit an annulus in groups of about ``GROUP``, so
a crowded annulus is many small pieces of work.  The index covers every row; only the pivots come from a sample.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id.  Vectors meet
those of the same length only.  Scores are 64-bit numbers; vectors so large that a score might not fit are refused with an error.  Of queries that repeat an id the smallest vector counts; candidates that repeat an id are
rows of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from . import common as C

#: Rows from which the pivots are chosen, pivots, and annuli around each at most.
SAMPLE, PIVOTS, RINGS = 2048, 48, 24
BLOCK, GROUP = 1024, 256


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, v): usable rows with components floor(scale * x)."""
    x = F.col(vector_col)
    usable = (
        F.col(id_col).isNotNull()
        & x.isNotNull()
        & (F.size(x) > 0)
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    )
    return vectors.where(usable).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"),
    )


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows that are far from each other: each next one is the farthest from those before."""
    chosen = [0]
    gaps = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and gaps.max() > 0:
        chosen.append(int(gaps.argmax()))
        gaps = np.minimum(gaps, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def raised(v: np.ndarray, top: float) -> np.ndarray:
    """Rows with a last component that brings their squared norm to ``top``."""
    v = v.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(0, top - (v * v).sum(axis=1)))[:, None]], axis=1)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(0, squares))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: by floats where every sum stays below 2^53, else by whole numbers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class PivotIndex:
    """The index of one vector length: pivots, the bounds of its annuli (at most PIVOTS x RINGS), and blocks of rows."""

    def __init__(self, rows: DataFrame, top: float):
        """``rows`` (id, v) with vectors of one length; ``top`` is their largest squared norm."""
        spark = rows.sparkSession
        self.top = float(top)
        sample = rows.select("v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
        self.pivots = raised(choose_pivots(np.array([r.v for r in sample], np.float64), PIVOTS), self.top)
        shared = spark.sparkContext.broadcast((self.pivots, self.top))

        def assign(batches):
            import pyarrow as pa

            pivots, top = shared.value
            for batch in batches:
                if batch.num_rows:
                    far = distances(raised(_matrix(batch.column(1)), top), pivots)
                    nearest = far.argmin(axis=1)
                    gap = far[np.arange(len(far)), nearest]
                    columns = [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(gap)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "v", "pivot", "gap"])

        keyed = stage_table(
            rows.mapInArrow(assign, "id bigint, v array<bigint>, pivot int, gap double"), "pivot_keys"
        )
        reach = keyed.groupBy("pivot").agg(F.min("gap").alias("lo"), F.max("gap").alias("hi"))
        ringed = keyed.join(F.broadcast(reach), "pivot").withColumn(  # a row per pivot
            "ring",
            F.when(F.col("hi") > F.col("lo"), F.floor((F.col("gap") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RINGS))
            .otherwise(0)
            .cast("int"),
        )
        ringed = ringed.withColumn("cell", F.col("pivot") * (RINGS + 1) + F.col("ring"))
        cells = (
            ringed.groupBy("cell")
            .agg(
                F.min("pivot").alias("pivot"),
                F.min("gap").alias("lo"),
                F.max("gap").alias("hi"),
                F.count(F.lit(1)).alias("rows"),
            )
            .orderBy("cell")
            .collect()  # PIVOTS * (RINGS + 1) rows at most
        )
        self.cells = np.array([tuple(c) for c in cells], np.float64).reshape(-1, 5)
        sizes = spark.createDataFrame([(int(c.cell), int(c.rows)) for c in cells], "cell int, rows bigint")
        piece = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / BLOCK))
        self.blocks = stage_table(
            ringed.join(F.broadcast(sizes), "cell")
            .groupBy("cell", piece.alias("piece"))
            .agg(F.collect_list(F.struct("id", "v")).alias("held"))
            .select("cell", F.col("held.id").alias("ids"), F.flatten("held.v").alias("matrix")),
            "pivot_blocks",
        )

    def visits(self, queries: DataFrame, k: int, reached: bool) -> DataFrame:
        """(id, v, cell): the annuli that a query (id, v) expands.

        At first those of the smallest bounds that together hold more than k rows.  When the query has ``reached`` a k-th
        score (column ``least``, null if it has fewer), all others whose bound allows that score.
        """
        shared = queries.sparkSession.sparkContext.broadcast((self.pivots, self.cells, self.top))

        def expand(batches):
            import pyarrow as pa

            pivots, cells, top = shared.value
            numbers, pivot, lo, hi, rows = cells.T
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column(1)).astype(np.float64)
                norm = (q * q).sum(axis=1)
                flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
                gap = distances(flat, pivots)[:, pivot.astype(np.int64)]
                bound = np.maximum(0, np.maximum(gap - hi, lo - gap))
                order = np.argsort(bound, axis=1, kind="stable")
                seen = np.cumsum(rows[order], axis=1) - rows[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, seen <= k, axis=1)
                wanted = first
                if reached:
                    # Rounding of the bounds is far below this slack.
                    best = (norm[:, None] + top - bound * bound) / 2 + 1e-6 * (norm[:, None] + top) + 1
                    least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    wanted = ~first & ~(best < least[:, None])
                at, cell = np.nonzero(wanted)
                part = batch.select(["id", "v"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(numbers[cell].astype(np.int32))], ["id", "v", "cell"]
                )

        columns = ["id", "v", "least"] if reached else ["id", "v"]
        return queries.select(*columns).mapInArrow(expand, "id bigint, v array<bigint>, cell int")

    def search(self, visits: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): per query and block its k best rows, ties to smaller ids."""
        visits = stage_table(visits, "visits")
        crowds = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
        groups = (
            visits.join(F.broadcast(crowds), "cell")  # a row per annulus
            .groupBy("cell", F.pmod(F.xxhash64("id"), F.col("groups")).alias("part"))
            .agg(F.collect_list(F.struct("id", "v")).alias("asked"))
            .select("cell", F.col("asked.id").alias("queries"), F.flatten("asked.v").alias("vectors"))
        )

        def meet(batches):
            import pyarrow as pa

            for batch in batches:
                for i in range(batch.num_rows):
                    asked, q, ids, m = (batch.column(c)[i].values.to_numpy() for c in range(4))
                    order = np.argsort(ids, kind="stable")
                    ids, m = ids[order], m.reshape(len(ids), -1)[order]
                    scores = inner_products(q.reshape(len(asked), -1), m)
                    for query, row in zip(asked.tolist(), scores):
                        other = np.flatnonzero(ids != query)
                        if len(other) > k:
                            least = np.partition(row[other], -k)[-k]
                            other = other[row[other] >= least]
                            other = other[np.argsort(-row[other], kind="stable")[:k]]
                        columns = [np.full(len(other), query), ids[other], row[other]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) for c in columns], ["query_id", "vec_id", "score"]
                        )

        schema = "query_id bigint, vec_id bigint, score bigint"
        partitions = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = groups.join(self.blocks, "cell").select("queries", "vectors", "ids", "matrix")
        return met.repartition(partitions).mapInArrow(meet, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    k: int = 10,
    is_query: str = "id % 100 = 0",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k best rows: query_id, rank (from 1), vec_id, score.  ``is_query`` is SQL over ``id``."""
    rows = stage_table(whole_numbers(vectors, id_col, vector_col).withColumn("length", F.size("v")), "whole_numbers")
    norm = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    lengths = rows.groupBy("length").agg(F.max(norm).alias("top")).orderBy("length").collect()
    results = []
    for length, top in lengths:  # as a rule one
        if top >= 2**62:
            raise ValueError(f"vectors of a squared norm of {top / 1024**2} are too large for scores in 64 bits")
        held = rows.where(F.col("length") == length).select("id", "v")
        index = PivotIndex(held, top)
        queries = held.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
        first = stage_table(ranked(index.search(index.visits(queries, k, False), k), k), "first_best")
        least = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        rest = index.search(index.visits(queries.join(least, "id", "left"), k, True), k)
        results.append(ranked(first.drop("rank").unionByName(rest), k))
    if not results:
        empty = "query_id bigint, rank int, vec_id bigint, score bigint"
        return vectors.sparkSession.createDataFrame([], empty)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "rank", "vec_id", "score")
