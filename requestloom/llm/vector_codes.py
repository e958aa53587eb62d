"""Vectors compressed to one code per part, with codebooks that adaptive bounds keep exact.

Vectors are turned into whole numbers, floor(1024 x), and cut into ``PARTS`` consecutive parts, each with a codebook of
``ENTRIES`` entries.  The codebooks start as the parts of the rows of the smallest ids; ``ROUNDS`` times every part is
assigned to its nearest entry and every entry becomes the floor of its parts' mean; then parts are assigned once more.

Assignments after the first are settled by bounds where bounds can.  A written state keeps, for each part of each row,
its entry with an upper bound of the distance to it, the ``b`` entries that were next closest with a lower bound each, in
order, and one outer bound for all entries beyond them.  When entries move, the upper bound grows and the lower ones
shrink by how far.  A part whose upper bound is below the first lower bound keeps its entry.  Otherwise the distance to
its entry is computed, then those to the entries whose lower bounds it reaches, and only if it reaches the outer bound,
those to all.  Whatever is compared is compared in whole numbers, ties to the lower index; bounds are rounded outward.
After each round ``b`` is lowered to what nearly all parts looked at, so the state shrinks as entries come to rest.

One state is written per round, with the vectors in it, so rounds need no join or shuffle of rows.  Sums per entry are
made in the tasks first.  What reaches the driver is of the codebooks' size and a count per rank.

Vectors that are null or hold null or non-finite components are dropped.  Vectors of each length have codebooks of their
own; where a length is no multiple of ``PARTS`` the first parts are one shorter; empty vectors have empty parts and
error zero.  Rows with a null id are coded but start no entry.  Rows that repeat an id count each, the smaller vector
first.  With fewer rows than ``ENTRIES`` there are as many entries as rows.  Components so large that squared distances
would leave 64 bits are refused with an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Closest entries that a first state keeps, the fewest of a later one, and the share of parts that ``b`` is to serve.
CLOSEST, FEWEST, SERVED = ENTRIES // 4, ENTRIES // 32, 0.99
#: Distances that a task computes at a time.
AT_ONCE = 1 << 20
#: Beyond rounding of bounds, by far.
SLACK = 1e-9


def cuts(length: int, parts: int) -> list[slice]:
    return [slice(i * length // parts, (i + 1) * length // parts) for i in range(parts)]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, x, size): the rows that are coded, with components still as they are."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(usable).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).alias("label"),
        F.transform(x, lambda c: c.cast("double")).alias("x"),
        F.size(x).alias("size"),
    )


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def roots_down(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - SLACK) - SLACK


def roots_up(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + SLACK) + SLACK


def scan(x: np.ndarray, book: np.ndarray, b: int):
    """Entry, upper bound, next closest entries (n x b) and bounds (n x (b + 1)) from distances to all entries."""
    n, k = len(x), len(book)
    entry, up = np.zeros(n, np.int64), np.zeros(n)
    near, low = np.zeros((n, b), np.int64), np.full((n, b + 1), np.inf)
    step = max(1, AT_ONCE // k)
    for at in range(0, n, step):
        rows = slice(at, at + step)
        d = squares(x[rows], book)
        own = d.argmin(axis=1)
        entry[rows], up[rows] = own, roots_up(d.min(axis=1))
        others = np.delete(np.arange(d.size), np.arange(len(d)) * k + own).reshape(len(d), k - 1)
        index, others = others % k, d.ravel()[others]
        take = min(b + 1, k - 1)
        if take:
            first = np.argpartition(others, take - 1, axis=1)[:, :take]
            first = np.take_along_axis(first, np.argsort(np.take_along_axis(others, first, 1), axis=1), 1)
            low[rows, :take] = roots_down(np.take_along_axis(others, first, 1))
            near[rows, : min(b, take)] = np.take_along_axis(index, first, 1)[:, :b]
    return entry, up, near, low


def look(x, book, entry, near, low, reach):
    """As ``scan``, from distances to each row's entry and to its first ``reach`` next closest entries."""
    n, most = len(x), int(reach.max(initial=0))
    up = np.zeros(n)
    step = max(1, AT_ONCE // max(1, (most + 1) * max(1, x.shape[1])))
    for at in range(0, n, step):
        rows = slice(at, at + step)
        asked = np.concatenate([entry[rows, None], near[rows, :most]], axis=1)
        d = ((x[rows, None, :] - book[asked]) ** 2).sum(axis=2)
        unseen = np.arange(most + 1) > reach[rows, None]
        least = np.where(unseen, d.max(initial=0), d).min(axis=1)
        best = np.where((d == least[:, None]) & ~unseen, asked, len(book)).min(axis=1)
        entry[rows], up[rows] = best, roots_up(least)
        # The others that were looked at, in order, take the first places; the rest stay where they are.
        far = np.where(unseen, np.inf, roots_down(d))
        far[asked == best[:, None]] = np.where(unseen, np.inf, -np.inf)[asked == best[:, None]]
        order = np.argsort(far, axis=1, kind="stable")[:, 1:]
        seen = ~unseen[:, 1:]
        near[rows, :most] = np.where(seen, np.take_along_axis(asked, order, 1), near[rows, :most])
        low[rows, :most] = np.where(seen, np.take_along_axis(far, order, 1), low[rows, :most])
    return entry, up, near, low


def settle(x, book, moved, entry, up, near, low, b):
    """The state of a part after its entries have moved by ``moved``, and how many next closest entries were looked at
    (b + 1: all entries)."""
    kept = near.shape[1]
    up = (up + moved[entry]) * (1 + SLACK)
    low = low.copy()
    low[:, :kept] -= moved[near]
    low[:, kept] -= moved.max(initial=0)
    low -= SLACK * (1 + np.abs(np.where(np.isfinite(low), low, 0)))
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1].copy()
    near, low = near[:, :b].copy(), low[:, : b + 1].copy()  # what is beyond b is bounded by the bound at b
    reach = np.zeros(len(x), np.int64)
    unsure = np.flatnonzero(up >= low[:, 0])
    up[unsure] = roots_up(((x[unsure] - book[entry[unsure]]) ** 2).sum(axis=1))
    unsure = unsure[up[unsure] >= low[unsure, 0]]
    reach[unsure] = (low[unsure] <= up[unsure, None]).sum(axis=1)
    some = unsure[reach[unsure] <= b]
    if len(some):
        entry[some], up[some], near[some], low[some] = look(
            x[some], book, entry[some], near[some], low[some], reach[some]
        )
    every = unsure[reach[unsure] > b]
    if len(every):
        entry[every], up[every], near[every], low[every] = scan(x[every], book, b)
    return entry, up, near, low, reach


def matrix(column, kind) -> np.ndarray:
    found = column.flatten().to_numpy(zero_copy_only=False)
    return found.reshape(len(column), -1 if len(found) else 0).astype(kind)


class PartCodes:
    """Codebooks and state of the vectors of one length."""

    def __init__(self, rows: DataFrame, length: int, exact_floats: bool, entries: int, rounds: int):
        """``rows`` (id, label, v) are whole numbers; ``exact_floats`` says that squared distances stay below 2^53."""
        self.kind = np.float64 if exact_floats else np.int64
        self.cuts, self.label = cuts(length, PARTS), rows.schema["label"].dataType.simpleString()
        seeds = rows.where("id is not null").select("id", "v").orderBy("id", "v").limit(entries).collect()
        seeds = np.array([row.v for row in seeds], np.int64).reshape(len(seeds), length)
        if not len(seeds):  # no row has an id
            seeds = np.zeros((1, length), np.int64)
        self.books = [seeds[:, cut] for cut in self.cuts]
        self.b, self.looked = min(CLOSEST, len(seeds) - 1), []
        self.state = self._assign(rows, None)
        for _ in range(rounds):
            moved = self._update()
            self.state = self._assign(self.state, moved)

    def _assign(self, rows: DataFrame, moved: list[np.ndarray] | None) -> DataFrame:
        """The next state of all rows, written."""
        b, cut_at, kind = self.b, self.cuts, self.kind
        shared = rows.sparkSession.sparkContext.broadcast((self.books, moved))
        first = moved is None

        def assign(batches):
            import pyarrow as pa

            def lists(array, inner):
                array = np.ascontiguousarray(array)
                width = array.shape[1]
                ends = pa.array(np.arange(len(array) + 1, dtype=np.int32) * width)
                return pa.ListArray.from_arrays(ends, pa.array(array.ravel(), inner))

            books, moved = shared.value
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                v = matrix(batch.column(2), kind)
                kept = [matrix(batch.column(i), k) for i, k in zip(range(3, 7), (np.int64, float, np.int64, float))] if not first else None
                out = []
                for p, cut in enumerate(cut_at):
                    x, book = v[:, cut], books[p].astype(kind)
                    if first:
                        out.append((*scan(x, book, b), np.full(n, b + 1)))
                    else:
                        was = kept[2].shape[1] // PARTS
                        near = kept[2][:, p * was : (p + 1) * was]
                        low = kept[3][:, p * (was + 1) : (p + 1) * (was + 1)]
                        out.append(settle(x, book, moved[p], kept[0][:, p], kept[1][:, p], near, low, b))
                entry, up, reach = (np.stack([o[i] for o in out], axis=1) for i in (0, 1, 4))
                near, low = (np.concatenate([o[i] for o in out], axis=1) for i in (2, 3))
                columns = [
                    *batch.columns[:3],
                    lists(entry, pa.int16()),
                    lists(up, pa.float64()),
                    lists(near, pa.int16()),
                    lists(low, pa.float64()),
                    lists(reach, pa.int16()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "entry", "up", "near", "low", "reach"])

        schema = (
            f"id bigint, label {self.label}, v array<bigint>, entry array<smallint>, up array<double>, "
            "near array<smallint>, low array<double>, reach array<smallint>"
        )
        columns = ["id", "label", "v"] if first else ["id", "label", "v", "entry", "up", "near", "low"]
        state = C.staged(rows.select(*columns).mapInArrow(assign, schema), "part_state")
        self._adapt(state)
        return state

    def _adapt(self, state: DataFrame) -> None:
        """Lower ``b`` to the rank that serves nearly all parts that the lists served at all."""
        counts = state.select(F.explode("reach").alias("reach")).groupBy("reach").count().collect()  # b + 2 rows at most
        self.looked.append({int(r): int(n) for r, n in counts})
        served = {r: n for r, n in self.looked[-1].items() if r <= self.b}
        total, seen = sum(served.values()), 0
        for r in sorted(served):
            seen += served[r]
            if seen >= SERVED * total:
                self.b = max(min(self.b, FEWEST), min(self.b, r))
                break

    def _update(self) -> list[np.ndarray]:
        """Move every entry to the floor of its parts' mean; how far each has moved, rounded up."""
        cut_at, sizes = self.cuts, [len(book) for book in self.books]

        def add(batches):
            import pyarrow as pa

            sums = [np.zeros((k, cut.stop - cut.start), np.int64) for k, cut in zip(sizes, cut_at)]
            times = [np.zeros(k, np.int64) for k in sizes]
            for batch in batches:
                if batch.num_rows:
                    v, entry = matrix(batch.column(0), np.int64), matrix(batch.column(1), np.int64)
                    for p, cut in enumerate(cut_at):
                        np.add.at(sums[p], entry[:, p], v[:, cut])
                        times[p] += np.bincount(entry[:, p], minlength=sizes[p])
            for p in range(PARTS):
                used = np.flatnonzero(times[p])
                columns = [
                    pa.array(np.full(len(used), p, np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array([[int(times[p][i]), *row] for i, row in zip(used, sums[p][used].tolist())], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "sums"])

        partial = self.state.select("v", "entry").mapInArrow(add, "part int, entry int, sums array<bigint>")
        totals = (
            partial.select("part", "entry", F.posexplode("sums").alias("at", "x"))
            .groupBy("part", "entry", "at")
            .agg(F.sum("x").alias("x"))
            .collect()  # one number per component of the codebooks, and one per entry
        )
        found = {(part, entry, at): x for part, entry, at, x in totals}
        moved = []
        for p, book in enumerate(self.books):
            new = book.copy()
            for i in range(len(book)):
                times = found.get((p, i, 0))
                if times:
                    new[i] = [found[p, i, at + 1] // times for at in range(book.shape[1])]
            moved.append(roots_up(((new - book) ** 2).sum(axis=1)))
            moved[-1][(new == book).all(axis=1)] = 0
            self.books[p] = new
        return moved

    def digest(self) -> str:
        numbers = ",".join(str(x) for book in self.books for x in book.ravel().tolist())
        return hashlib.sha256(numbers.encode()).hexdigest()

    def coded(self) -> DataFrame:
        """(id, label, code, error, codebooks_sha256) of all rows."""
        cut_at, kind, digest = self.cuts, self.kind, self.digest()
        shared = self.state.sparkSession.sparkContext.broadcast(self.books)

        def code(batches):
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    v, entry = matrix(batch.column(2), kind), matrix(batch.column(3), np.int64)
                    error = sum(
                        ((v[:, cut] - shared.value[p].astype(kind)[entry[:, p]]) ** 2).sum(axis=1)
                        for p, cut in enumerate(cut_at)
                    )
                    codes = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
                    columns = [*batch.columns[:2], pa.array(codes, pa.string()), pa.array(error.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

        schema = f"id bigint, label {self.label}, code string, error bigint"
        rows = self.state.select("id", "label", "v", "entry").mapInArrow(code, schema)
        return rows.withColumn("codebooks_sha256", F.lit(digest))


def code_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per usable vector: ``id_col``, code, error, label_error, codebooks_sha256."""
    usable = whole_vectors(vectors, id_col, vector_col, label_col)
    largest = F.coalesce(F.array_max(F.transform("x", lambda c: F.abs(c))), F.lit(0.0))
    lengths = usable.groupBy("size").agg(F.max(largest).alias("most"), F.count(F.lit(1)).alias("n")).orderBy("size").collect()
    parts = []
    for size, most, n in lengths:  # as a rule one
        most = SCALE * float(most) + 1
        if 16 * max(1, size) * most * most >= 2**62 or n * most >= 2**62:
            raise ValueError(f"components of up to {most / SCALE} are too large for squared distances in 64 bits")
        whole = usable.where(F.col("size") == size).select(
            "id", "label", F.transform("x", lambda c: F.floor(F.lit(SCALE) * c)).alias("v")
        )
        rows = C.staged(whole, "whole_vectors")
        exact_floats = 16 * max(1, size) * most * most < 2**53
        parts.append(PartCodes(rows, size, exact_floats, entries, rounds).coded())
    columns = [F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256"]
    if not parts:
        kind = "bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}")
    coded = parts[0]
    for more in parts[1:]:
        coded = coded.unionByName(more)
    coded = C.staged(coded, "codes")
    sums = C.staged(
        coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("times")), "label_errors"
    )
    return C.join_hot(coded, sums, "label", "times").select(*columns)
