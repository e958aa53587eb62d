"""Entries of one huge JSON object, cut out by many tasks.

A document, a file or a folder whose parts follow each other by name, is divided into byte ranges.  Where an entry ends
cannot be told from a range alone, since it may begin inside a string or at any depth.  So every range is scanned first
for what it does to each state it may begin in: outside strings, inside one, or inside one after a backslash.  A step along
the ranges, a few numbers each, then tells the state and depth at which every range really begins.  A second scan cuts
each range at the commas and braces of the outermost object; entries that lie across ranges are put together from their
pieces.  No task holds more than a range and the entries in it.
"""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table, stage_table
from .listing import list_tree
from .stores import ArrowStore

RANGE_BYTES = 4 * 1024 * 1024
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
RANGE = "range_no int, uri string, start bigint, length bigint"


class Marks(NamedTuple):
    """Per byte: whether it is outside strings if the range begins in a given state, and the step in depth there."""

    outside: np.ndarray
    step: np.ndarray
    end: int


def marks(data: np.ndarray, state: int) -> Marks:
    """Scan of a range's bytes that begins in ``state``."""
    place = np.arange(len(data))
    slash = data == ord("\\")
    last_other = np.maximum.accumulate(np.where(slash, -1, place)) if len(data) else place
    before = np.concatenate([[-1], last_other[:-1]]) if len(data) else place
    run = place - 1 - before + ((before < 0) & (state == ESCAPED))
    quote = (data == ord('"')) & (run % 2 == 0)
    inside = int(state != OUTSIDE)
    seen = np.cumsum(quote) - quote  # quotes before each byte
    outside = (seen + inside) % 2 == 0
    step = ((data == ord("{")) | (data == ord("["))).astype(np.int64) - ((data == ord("}")) | (data == ord("]")))
    step = np.where(outside, step, 0)
    if (int(quote.sum()) + inside) % 2 == 0:
        end = OUTSIDE
    else:
        trailing = len(data) - 1 - int(last_other[-1]) if len(data) else 0
        if len(data) and last_other[-1] < 0:
            trailing += state == ESCAPED
        end = ESCAPED if (trailing % 2 if len(data) else state == ESCAPED) else INSIDE
    return Marks(outside, step, end)


def pieces(data: bytes, state: int, depth: int) -> tuple[bytes, list[bytes], bytes | None, bool, int]:
    """(before the first cut, entries, after the last cut, whether something is wrong, outermost objects opened).

    Cuts are the outermost braces and the commas between entries.  Without a cut all bytes are before it.  What comes after
    the closing brace, or before the opening one, is blank, or something is wrong.
    """
    b = np.frombuffer(data, np.uint8)
    found = marks(b, state)
    after = depth + np.cumsum(found.step)
    opens = found.outside & (found.step > 0) & (after == 1)
    closes = found.outside & (found.step < 0) & (after == 0)
    commas = found.outside & (b == ord(",")) & (after == 1)
    blank = np.isin(b, np.frombuffer(b" \t\r\n", np.uint8))
    wrong = bool((after < 0).any() or (~blank & found.outside & (after == 0) & ~closes).any())
    wrong |= bool((b[opens] != ord("{")).any() or (b[closes] != ord("}")).any())
    cuts = np.flatnonzero(opens | closes | commas)
    if not len(cuts):
        return (data if depth else b""), [], None, wrong, 0
    head = b"" if opens[cuts[0]] else data[: cuts[0]]
    entries = [data[i + 1 : j] for i, j in zip(cuts[:-1], cuts[1:]) if not (closes[i] or opens[j])]
    tail = None if closes[cuts[-1]] else data[cuts[-1] + 1 :]
    return head, entries, tail, wrong, int(opens.sum())


def document_ranges(parts: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges, in order, of a document in parts (``part``, ``uri``, ``size``)."""
    files = parts.filter("size > 0").orderBy("part").select("uri", "size").collect()  # the parts of one document
    rows = [(f["uri"], at, min(range_bytes, f["size"] - at)) for f in files for at in range(0, f["size"], range_bytes)]
    if not rows:
        return parts.sparkSession.createDataFrame([], RANGE)
    return small_table(parts.sparkSession, RANGE, list(range(len(rows))), *map(list, zip(*rows)))


def object_entries(ranges: DataFrame, store=None) -> DataFrame | None:
    """``seq_in_doc`` and ``entry`` (the text ``"key": value``) of the outermost object; None if it is not one.

    Entries are only cut out: whether each is valid is for the parser to say.
    """
    store = ArrowStore() if store is None else store
    spark = ranges.sparkSession
    count = ranges.count()
    if not count:
        return None
    spread = ranges.repartitionByRange(min(count, 4096), "range_no")

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                b = np.frombuffer(store.read(row["uri"], row["start"], row["length"]), np.uint8)
                ends = [(m.end, int(m.step.sum())) for m in (marks(b, s) for s in (OUTSIDE, INSIDE, ESCAPED))]
                columns = [[row["range_no"]], [[e for e, _ in ends]], [[d for _, d in ends]]]
                kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["range_no", "ends", "steps"]
                )

    effects = spread.mapInArrow(scan, "range_no int, ends array<int>, steps array<bigint>").collect()  # a row per range
    state, depth, begins = OUTSIDE, 0, []
    for row in sorted(effects):
        begins.append((state, depth))
        state, depth = row["ends"][state], depth + row["steps"][state]
    if state != OUTSIDE or depth:
        return None
    known = small_table(
        spark, "range_no int, state int, depth bigint", list(range(count)), [s for s, _ in begins], [d for _, d in begins]
    )

    def cut(batches):
        import pyarrow as pa

        names = ["range_no", "seq", "entry", "wrong", "opened"]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.int32())
        for batch in batches:
            for row in batch.to_pylist():
                data = store.read(row["uri"], row["start"], row["length"])
                head, entries, tail, wrong, opened = pieces(data, row["state"], row["depth"])
                texts = [head, *entries] + ([tail] if tail is not None else [])
                # the head has place -1, entries follow, and the tail has a place of its own
                places = [-1, *range(len(entries))] + ([len(entries)] if tail is not None else [])
                n = len(texts)
                columns = [[row["range_no"]] * n, places, texts, [wrong] * n, [opened] + [0] * (n - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "range_no int, seq int, entry binary, wrong boolean, opened int"
    cuts = stage_table(spread.join(F.broadcast(known), "range_no").mapInArrow(cut, schema), "json_pieces")
    summary = cuts.groupBy("range_no").agg(
        F.max("wrong").alias("wrong"), F.sum("opened").alias("opened"), (F.max("seq") + 1).alias("n")
    )
    summary = sorted(summary.collect())  # a row per range
    if any(r["wrong"] for r in summary) or sum(r["opened"] for r in summary) != 1:
        return None
    # An entry belongs to the range of the cut before it.
    firsts = list(accumulate((r["n"] for r in summary), initial=0))[:count]
    owner, owners = 0, []
    for r in summary:
        owners.append(owner)
        owner = r["range_no"] if r["n"] else owner
    placed = small_table(
        spark, "range_no int, first bigint, owner int", list(range(count)), firsts, owners
    )
    last = small_table(spark, "owner int, last_seq bigint", list(range(count)), [f + r["n"] - 1 for f, r in zip(firsts, summary)])
    rows = cuts.join(F.broadcast(placed), "range_no")
    heads = rows.filter("seq < 0 and octet_length(entry) > 0").join(F.broadcast(last), "owner")
    heads = heads.select(F.col("last_seq").alias("seq_in_doc"), "range_no", "entry")
    whole = rows.filter("seq >= 0").select((F.col("first") + F.col("seq")).alias("seq_in_doc"), "range_no", "entry")
    # Only an entry that lies across ranges has more than one piece.
    across = heads.select("seq_in_doc").distinct()
    joined = (
        whole.join(F.broadcast(across), "seq_in_doc", "left_semi")  # one entry per range at most
        .unionAll(heads)
        .groupBy("seq_in_doc")
        .agg(F.array_sort(F.collect_list(F.struct("range_no", "entry"))).alias("held"))
        .select("seq_in_doc", F.expr("aggregate(held, cast('' as binary), (all, one) -> concat(all, one.entry))").alias("entry"))
    )
    rest = whole.join(F.broadcast(across), "seq_in_doc", "left_anti").select("seq_in_doc", "entry")
    return rest.unionAll(joined).select("seq_in_doc", F.col("entry").cast("string").alias("entry"))


def document_parts(spark: SparkSession, path: str, store=None) -> DataFrame:
    """The parts of a document, which is a file or a folder: part, uri, size."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    folder = folder + slash if slash else "./"
    found = list_tree(spark, folder, name, store, hidden=False)
    mine = (F.col("file_path") == name) | F.col("file_path").startswith(name + "/")
    uri = F.concat(F.lit(folder), F.col("file_path"))
    return found.filter(mine).select(F.col("file_path").alias("part"), uri.alias("uri"), "size")
