"""Toxicity by a logistic model that is held to the same score when identity terms are swapped.

A document is the set of its words and word beginnings of four to six letters.  Of these the model takes the
``FEATURES`` whose share in toxic and other labelled documents differs most.  Labelled documents that mention a group are
written again with the terms of their sentences swapped for others of the same list; the loss adds the squared difference
of the two log odds, so that mentioning a group is not what decides.

The fit uses at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of their id, and counts over them run
as Spark jobs; what reaches the driver is bounded by ``TRAIN_ROWS`` and ``FEATURES``.  Rows whose crc32(id) mod 3 is 1 are
never learned from.

Null and empty texts get the score of a text without words.  Rows are scored one by one, so repeated rows get equal
scores.  Labels that are null are left out; if an id is labelled more than once the largest label counts.  With labels of
one kind only, the score is their smoothed share.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from . import common as C

#: Labelled documents used in the fit at most; features of the model; buckets that features are counted in.
TRAIN_ROWS, FEATURES, BUCKETS = 20_000, 600, 1 << 22
#: Weight of the squared change under swaps, and of squared weights.
SWAP_PENALTY, RIDGE = 5.0, 1e-4
TOXIC_FROM = 0.7
#: Terms of a list stand for each other.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "citizens", "refugees", "foreigners"),
    ("old", "young", "disabled"),
)
SWAP = {term: terms[(i + 1) % len(terms)] for terms in IDENTITY for i, term in enumerate(terms)}
TERM = re.compile(r"(?i)\b(?:" + "|".join(sorted(SWAP, key=len, reverse=True)) + r")\b")
EDGES = ".,;:!?\"'()[]{}*#$%&<>-_/\\"


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    import xxhash

    word = word.strip(EDGES)
    if not word:
        return ()
    parts = [f"={word}", *[word[:n] for n in (4, 5, 6) if len(word) >= n]]
    return tuple(xxhash.xxh32_intdigest(p) % BUCKETS for p in parts)


def features(text: str | None) -> set[int]:
    known = C.per_process("word features", lambda: C.Bounded(word_features, 200_000))
    found: set[int] = set()
    for word in set(text.lower().split()) if text else ():
        found.update(known[word])
    return found


def swapped(text: str) -> str | None:
    """The text with the identity terms of its sentences swapped; None if it has none."""
    out, n = TERM.subn(lambda m: SWAP[m[0].lower()], text)
    return out if n else None


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        weight_of = dict(zip(self.buckets.tolist(), self.weights.tolist()))

        def chosen(word: str) -> tuple[int, ...]:
            return tuple(f for f in word_features(word) if f in weight_of)

        known = C.Bounded(chosen, 300_000)

        def score(text: str | None) -> float:
            found: set[int] = set()
            for word in set(text.lower().split()) if text else ():
                if of_word := known[word]:
                    found.update(of_word)
            # In a fixed order, so that equal texts get equal scores to the last bit.
            odds = self.bias + sum(weight_of[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

        return score


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label) of the labelled documents that are learned from: ``TRAIN_ROWS`` at most.

    Of rows that repeat an id the smallest text counts.
    """
    labelled = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).alias("label"))
    )
    chosen = stage_table(labelled.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS), "toxic_labels")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen),  # TRAIN_ROWS rows at most
        "_id",
    )
    return rows.groupBy("_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def _counts(training: DataFrame) -> DataFrame:
    """Per bucket: in how many toxic and other documents it occurs."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            found = ([], [])
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[label == 1].append(np.fromiter(features(text), np.int64))
            both = [np.concatenate(f) if f else np.empty(0, np.int64) for f in found]
            for toxic, values in enumerate(both):
                buckets, times = np.unique(values, return_counts=True)
                zero = np.zeros(len(times), np.int64)
                columns = [buckets, times if toxic else zero, zero if toxic else times]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "toxic", "other"])

    return (
        training.select("text", "label")
        .mapInArrow(count, "bucket bigint, toxic bigint, other bigint")
        .groupBy("bucket")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    )


def _examples(training: DataFrame, buckets: np.ndarray) -> list:
    """(label, places of the model's features, the same after swaps or null) of each labelled document."""
    place = {int(b): i for i, b in enumerate(buckets)}

    def read(batches):
        import pyarrow as pa

        def places(text):
            return sorted(place[f] for f in features(text) if f in place)

        for batch in batches:
            texts = batch.column(0).to_pylist()
            other = [swapped(t) if t else None for t in texts]
            kind = pa.list_(pa.int32())
            columns = [
                batch.column(1).cast(pa.int32()),
                pa.array([places(t) for t in texts], kind),
                pa.array([None if t is None else places(t) for t in other], kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["label", "held", "swapped"])

    schema = "label int, held array<int>, swapped array<int>"
    return training.select("text", "label").mapInArrow(read, schema).collect()


def _dense(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.float32)
    for row, places in zip(out, lists):
        row[places] = 1
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """Newton's method for the log loss, a ridge, and the squared change of the log odds under swaps; bias last."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    changes = np.concatenate([changes, np.zeros((len(changes), 1), np.float32)], axis=1)
    ridge = np.full(x.shape[1], RIDGE * len(x))
    ridge[-1] = 1e-6
    fixed = np.diag(ridge) + SWAP_PENALTY * (changes.T @ changes).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + fixed @ w
        curve = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + fixed
        step = np.linalg.solve(curve + 1e-9 * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    training = _training(docs, labels, id_col, text_col, label_col)
    totals = dict(training.groupBy((F.col("label") == 1).alias("toxic")).count().collect())
    toxic, other = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not other:
        share = (toxic + 0.5) / (toxic + other + 1)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    # Difference of the shares over its standard error.
    pooled = (F.col("toxic") + F.col("other") + 1) / float(toxic + other + 2)
    gap = F.col("toxic") / float(toxic) - F.col("other") / float(other)
    strength = F.abs(gap) / F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / other))
    best = _counts(training).select("bucket", strength.alias("strength")).orderBy(F.desc("strength"), "bucket")
    buckets = np.array(sorted(row.bucket for row in best.limit(FEATURES).collect()), np.int64)
    # In a fixed order: sums of floats then do not depend on which task ended first.
    rows = sorted(_examples(training, buckets), key=lambda r: (r.label, r.held, r.swapped or []))
    x = _dense([r.held for r in rows], len(buckets))
    pairs = [r for r in rows if r.swapped is not None]
    changes = _dense([r.held for r in pairs], len(buckets)) - _dense([r.swapped for r in pairs], len(buckets))
    w = fit_weights(x, np.array([r.label == 1 for r in rows], np.float64), changes)
    return Model(buckets, w[:-1], float(w[-1]))


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score of a text, 0 to 1."""
    # Plain values: workers may not have this package to load an object of its classes.
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = Model(*shared.value)
        key = "toxicity", model.buckets.tobytes(), model.weights.tobytes(), model.bias
        return texts.map(C.per_process(hash(key), model.scorer)).astype("float64")

    return score(F.col(text_col))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, held_out, score, predicted (1 from a score of ``TOXIC_FROM``)."""
    score = score_column(docs, fit(docs, labels, id_col, text_col), text_col)
    return docs.select(id_col, held_out(id_col).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= TOXIC_FROM).cast("int")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic."""
    score = score_column(docs, fit(docs, labels, id_col, text_col), text_col)
    return docs.where(score < TOXIC_FROM)
