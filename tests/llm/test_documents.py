"""Operators 2, 6 and 8 against brute force, and operators 4 and 10 against their rules."""

import hashlib
import re
import time
import zlib
from itertools import combinations
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from requestloom import session
from requestloom.llm import common as C
from requestloom.llm import decontamination, line_dedup, ngram_join, pii, sharding
from requestloom.session import SHUFFLE_CLEANUP, drop_tables, stage_table

from .conftest import words


def shingles(text, lower=str.lower):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w]
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def grouped(nodes, links):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def similar(rows):
    sets = {r[0]: shingles(r[1], lambda t: "".join(c.lower() if c.isascii() else c for c in t)) for r in rows}
    links = [
        (a, b)
        for a, b in combinations(sets, 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return {i: (len(s), c) for (i, s), c in zip(sets.items(), grouped(sets, links).values())}


def test_similar_documents(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()}
    assert got == similar(rows)


def test_similar_documents_in_crowds(spark, monkeypatch):
    """Chains, crowds of near copies and tiles that are cut into pieces."""
    monkeypatch.setattr(C, "PIECE", 16)
    base = words(1, 60).split()
    texts = []
    for i in range(70):
        one = list(base)
        one[i % 60] = f"edit{i}"
        texts.append(" ".join(one))
    text = list(words(2, 200).split())
    for i in range(0, 40, 2):  # each near the one before, the ends far from each other
        text[i * 5] = f"step{i}"
        texts.append(" ".join(text))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == similar(rows)


def test_one_of_each(docs, rows):
    kept = {r.doc_id for r in ngram_join.one_of_each(docs).collect()}
    assert kept == {i for i, (_, c) in similar(rows).items() if i == c}
    assert ngram_join.one_of_each(docs).columns == docs.columns


def test_similar_documents_with_odd_ids(odd_ids, empty):
    got = ngram_join.similar_documents(odd_ids).collect()
    assert len(got) == odd_ids.count()
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.similar_documents(empty).count() == 0


def test_similar_documents_after_null_ids(spark):
    """Rows with a null id come before rows with an id and the same text."""
    base = words(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(None, base), (None, base), (7, base), (9, near), (None, near)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = ngram_join.similar_documents(frame).collect()
    assert {r.doc_id: r.component_id for r in got} == {None: None, 7: 7, 9: 7} and len(got) == len(rows)
    assert sorted(r.doc_id for r in ngram_join.one_of_each(frame).collect() if r.doc_id) == [7]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(300, 299)]
    got = C.components(spark.createDataFrame(links, "a bigint, b bigint"), "t").collect()
    assert {r.node: r.component for r in got} == grouped({n for link in links for n in link}, links)


def test_member_bits(spark):
    ids = spark.range(0, 5000, 7)
    bits = C.member_bits(ids, "id")
    hashes = np.array([r[0] for r in spark.range(5000).select(F.xxhash64("id")).collect()])
    found = C.may_be_member(bits, hashes)
    assert found[::7].all() and found.sum() < 1500


# ---------------------------------------------------------------- decontamination


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, words(3, 20_000)[40:300]), (2, words(50, 30)), (3, None), (4, ""), (5, words(2, 3)), (None, words(1, 40))]
    items.append((6, words(9, 8)))
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_contained_items(docs, rows, benchmark):
    items = {r.item_id: shingles(r.text) for r in benchmark.collect() if r.item_id and r.text}
    expected = {
        (r[0], i, len(s), len(s & shingles(r[1])))
        for r in rows
        for i, s in items.items()
        if s and len(s & shingles(r[1])) >= 0.75 * len(s)
    }
    got = decontamination.contained_items(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == expected and len(expected) >= 3
    kept = decontamination.without_benchmark(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {e[0] for e in expected}
    assert kept.columns == docs.columns


def test_contained_items_of_odd_rows(odd_ids, empty, benchmark):
    assert decontamination.without_benchmark(odd_ids, benchmark).count() == odd_ids.count()
    assert decontamination.contained_items(empty, benchmark).count() == 0
    assert decontamination.without_benchmark(odd_ids, benchmark.limit(0)).count() == odd_ids.count()


def test_decontamination_is_native(docs, benchmark, plan_of):
    assert not re.search("Python|Arrow|Pandas", plan_of(decontamination.contained_items(docs, benchmark)))


# ---------------------------------------------------------------- lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    r = np.random.default_rng(2)
    for _ in range(400):
        a, b = ("".join(r.choice(list("abé"), r.integers(0, 14))) for _ in range(2))
        expected = edit_distance(a, b)
        assert line_dedup.edit_distance(a, b) == expected
        assert line_dedup.within([a] * 15, [b] * 15, list(range(15))).tolist() == [expected <= m for m in range(15)]
    for _ in range(300):
        a = "".join(r.choice(list("abcdé "), r.integers(20, 90)))
        b = list(a)
        for at in r.integers(0, len(a), r.integers(0, 12)):
            b[at] = r.choice(["", "z", b[at] + "y"])
        b, expected = "".join(b), edit_distance(a, "".join(b))
        assert line_dedup.enough_shared([a], [b], np.array([expected])).all()
        assert line_dedup.within([a] * 14, [b] * 14, list(range(14))).tolist() == [expected <= m for m in range(14)]
    assert line_dedup.within(["x" * 3000 + "a" + "y" * 3000], ["x" * 3000 + "b" + "y" * 3000], [1]).all()


def test_few_edits():
    """Many pairs in step, of one to five words of 64 rows, with all letters alike, few or many."""
    r = np.random.default_rng(5)
    shorter, longer = [], []
    for i in range(400):
        letters = list(("ab", "abcdefgh", "\u6f22\u5b57\u00e9\U0001f600ab", "a")[i % 4])
        a = list(r.choice(letters, r.choice([1, 5, 63, 64, 65, 127, 128, 129, 200, 300])))
        b = list(a)
        for at in r.integers(0, len(a), r.integers(0, 1 + len(a) // 3)):
            b[at] = r.choice(["", "z", b[at] + "y"])
        a, b = sorted(("".join(a), "".join(b) or "z"), key=len)
        shorter.append(a)
        longer.append(b)
    distances = [line_dedup.edit_distance(a, b) for a, b in zip(shorter, longer)]
    for most in (0, 1, 5, 20, 64, 300):
        assert line_dedup.few_edits(shorter, longer, [most] * 400).tolist() == [d <= most for d in distances]
    own = [len(b) // 10 for b in longer]
    assert line_dedup.few_edits(shorter, longer, own).tolist() == [d <= m for d, m in zip(distances, own)]
    assert line_dedup.within(shorter, longer, own).tolist() == [d <= m for d, m in zip(distances, own)]


def test_keys_do_not_follow_the_company():
    """The keys of a line and their places are the same, whatever lines are signed with it."""
    lines = [line_dedup.normal_line(words(i, 4 + i % 70).encode()) for i in range(300)]
    lines.append(("aé" * 40 + words(9, 30)).encode())
    chars = [len(line.decode()) for line in lines]
    together = line_dedup.meeting_keys(lines, chars)
    for line, n, (keys, places) in zip(lines, chars, together):
        alone = line_dedup.meeting_keys([line], [n])[0]
        assert sorted(zip(*map(list, alone))) == sorted(zip(keys, places))
        assert (places < n).all()


def plain_lines(rows):
    """The texts after line dedup, by comparing all distinct lines."""
    first = {}
    for doc_id, text, *_ in rows:
        for number, line in enumerate(text.split("\n") if text else ()):
            normal = line_dedup.normal_line(line.encode())
            if normal:
                first.setdefault(normal, (doc_id, number))
    links = [
        (a, b)
        for a, b in combinations(first, 2)
        if 10 * min(map(len, (a.decode(), b.decode()))) >= 9 * max(map(len, (a.decode(), b.decode())))
        and edit_distance(a.decode(), b.decode()) <= max(map(len, (a.decode(), b.decode()))) // 10
    ]
    group = grouped(first, links)
    chosen = {}
    for line, at in first.items():
        chosen[group[line]] = min(at, chosen.get(group[line], at))
    out = {}
    for doc_id, text, *_ in rows:
        normals = [line_dedup.normal_line(x.encode()) for x in text.split("\n")] if text else []
        kept = [
            x
            for number, (x, n) in enumerate(zip(text.split("\n"), normals))
            if not n or chosen[group[n]] == (doc_id, number)
        ] if text else []
        out[doc_id] = "\n".join(kept) if text else text
    return out, len(links)


def test_lines(spark, docs, rows):
    expected, _ = plain_lines(rows)
    got = line_dedup.dedup_lines(docs)
    assert {r.doc_id: r.text for r in got.collect()} == expected
    assert got.columns == [*docs.columns, "_n_lines", "_n_removed"]


def test_lines_in_crowds(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 16)
    base = words(1, 80).split()
    rows = []
    for i in range(60):
        one = list(base)
        one[i] = one[i] + "x"
        rows.append((i, f"own line {words(100 + i, 9)}\n" + " ".join(one)))
    expected, links = plain_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.text for r in got} == expected and links > 100


def test_lines_verified_in_parts(spark, monkeypatch):
    lines = [words(i // 6, 30) + f" {i % 6}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(lines)), "id bigint, text string")
    rows = line_dedup.line_rows(docs).select("key", "line_no").collect()
    keys = [r.key for r in rows]
    pairs = C.staged(spark.createDataFrame(list(combinations(keys, 2)), "a bigint, b bigint"), "pairs")
    monkeypatch.setattr(line_dedup, "DOCS_AT_ONCE", 7)
    monkeypatch.setattr(line_dedup, "VERIFIED_AT_ONCE", 40_000)  # three shares of each side
    found = line_dedup._verified(pairs, docs).collect()
    assert {frozenset(p) for p in found} == {frozenset(p) for p in combinations(keys, 2) if keys.index(p[0]) // 6 == keys.index(p[1]) // 6}
    assert len(found) == 150


def test_line_tables_go_when_they_are_read(spark, monkeypatch, tmp_path):
    """Of what line dedup writes only what its result reads stays, and pairs are there for one part at a time, which are as
    many as the rows that meet ask for; the lines are what they were."""
    root = tmp_path / "requestloom"
    monkeypatch.setattr(session, "shared_root", lambda spark: str(tmp_path))
    rows = []
    for i in range(40):
        one = words(1, 80).split()
        one[i] = one[i] + "x"
        rows.append((i, f"own line {words(100 + i, 9)}\n" + " ".join(one)))
    seen, cross = [], C.cross_pairs

    def counted(*args):
        seen.append([p.name for p in root.iterdir() if p.name.startswith(("line_pairs", "line_tiles", "lines-"))])
        return cross(*args)

    monkeypatch.setattr(C, "cross_pairs", counted)
    monkeypatch.setattr(C, "PIECE", 16)
    monkeypatch.setattr(line_dedup, "PASSES", 1)
    monkeypatch.setattr(line_dedup, "MET_AT_ONCE", 200)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.text for r in got} == plain_lines(rows)[0]
    kinds = {p.name.rpartition("-")[0] for p in root.iterdir()}
    assert kinds <= {"line_places", "kinds", "line_links", "edges", "joined"}
    assert len(seen) > 1 and not any(seen)


def test_staged_tables_are_removed(spark, tmp_path):
    table, other = stage_table(spark.range(9), "é 1"), stage_table(spark.range(9), "other")
    folder = Path(urlsplit(other.inputFiles()[0]).path).parent
    drop_tables(table)
    assert other.count() == 9 and not [p for p in folder.parent.iterdir() if p.name.startswith("é 1-")]
    spark.range(9).write.parquet(f"{tmp_path}/given")
    with pytest.raises(ValueError):
        drop_tables(spark.read.parquet(f"{tmp_path}/given"))
    assert spark.read.parquet(f"{tmp_path}/given").count() == 9


def test_pairs_of_tiles_in_parts(spark):
    rows = spark.createDataFrame(
        [(key, i, i // 2, i % 3, 3) for key in (1, 2) for i in range(12)], "key int, id bigint, component bigint, piece int, pieces int"
    )
    whole = {tuple(p) for p in C.cross_pairs(rows, "true").collect()}
    parts = [C.cross_pairs(rows, "true", F.pmod("id", F.lit(3)) == i).collect() for i in range(3)]
    assert {tuple(p) for part in parts for p in part} == whole == {p for p in combinations(range(12), 2) if p[0] // 2 != p[1] // 2}
    assert all(len(part) < len(whole) for part in parts)


def test_staged_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    before, kept = shuffled(), spark.conf.get(SHUFFLE_CLEANUP)
    table = stage_table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "table")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert table.count() == 7 and spark.conf.get(SHUFFLE_CLEANUP) == kept


def test_lines_of_odd_rows(odd_ids, empty):
    got = line_dedup.dedup_lines(odd_ids).collect()
    assert len(got) == odd_ids.count() and {r.text for r in got if r.doc_id is None} == {None}
    assert len({r.text for r in got if r.doc_id == 3}) == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_by_edit_similarity_alone(spark):
    """Lines of 9 to 500 characters with one letter or one word changed, against all pairs."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        line = words(1000 + i, 60)[: 9 + i % 60 if i < 160 else int(rng.integers(60, 500))].strip()
        other = list(line)
        other[int(rng.integers(len(line)))] = "\u00e9"
        changed = line.split()
        changed[len(changed) // 2] = "q" * len(changed[len(changed) // 2])
        rows += [(3 * i, line), (3 * i + 1, "".join(other)), (3 * i + 2, " ".join(changed))]
    normal = {i: line_dedup.normal_line(t.encode()).decode() for i, t in rows}
    links = [
        (a, b)
        for a, b in combinations(normal, 2)
        if abs(len(normal[a]) - len(normal[b])) <= 50
        and line_dedup.within([normal[a]], [normal[b]], [max(len(normal[a]), len(normal[b])) // 10]).all()
    ]
    group = grouped(normal, links)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in got if r._n_removed} == {i for i in normal if group[i] != i} and len(links) > 300


def test_tiles_of_any_size(spark, monkeypatch):
    """Small tiles give their pairs, larger ones their rows, also where a tile runs over several batches."""
    monkeypatch.setattr(C, "PIECE", 8)
    sizes = [1, 2, 15, 16, 17, 40, 3, 90, 1]
    rows = [(k, 100 * k + i, 7, 50, 3) for k, size in enumerate(sizes) for i in range(size)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = line_dedup.met_in_tiles(spark.createDataFrame(rows, "key bigint, id bigint, sig bigint, chars int, place int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    small = [(k, n) for k, n in enumerate(sizes) if n <= line_dedup.SMALL]
    pairs = [p for k, n in small for p in combinations(range(100 * k, 100 * k + n), 2)]
    assert sorted((r.a, r.b) for r in got if r.key is None) == sorted(pairs)
    large = sorted((r.key, r.a, r.piece) for r in got if r.key is not None)
    assert [(k, i) for k, i, _ in large] == [(r[0], r[1]) for r in rows if sizes[r[0]] > line_dedup.SMALL]
    assert {k: max(p for kk, _, p in large if kk == k) for k, *_ in large} == {4: 2, 5: 4, 7: 11}


def test_keys_are_brought_together_in_parts(docs, monkeypatch):
    """No exchange holds much more than its share of the keys, and together they hold each once."""
    occurrences = line_dedup.line_rows(docs.select(F.col("doc_id").alias("id"), "text")).localCheckpoint()
    exchanged, meet = [], line_dedup.met_in_tiles

    def counted(rows):
        exchanged.append([r.key for r in rows.select("key").collect()])
        return meet(rows)

    monkeypatch.setattr(line_dedup, "met_in_tiles", counted)
    groups = line_dedup.group_lines(docs.select("text"), occurrences).collect()
    keys = occurrences.where("tiles is not null").select(F.explode("tiles")).count()
    assert groups and sum(map(len, exchanged)) == keys and max(map(len, exchanged)) <= keys // 2
    assert sum(len(set(part)) for part in exchanged) == len({key for part in exchanged for key in part})


def test_simhash_of_long_lines():
    lines = [[b"w%d" % j for j in range(i, i + n)] for i, n in enumerate((1, 2, 254, 255, 256, 700))]
    lines.append([b"a", b"|", b"b", b"|", b"c"])
    lengths = np.array([len(line) for line in lines])
    for line, got in zip(lines, C.majorities(C.hash_words([word for line in lines for word in line]), lengths)):
        hashes = C.hash_words(line).tolist()
        bits = sum((2 * sum(h >> i & 1 for h in hashes) > len(line)) << i for i in range(64))
        assert int(got) & (2**64 - 1) == bits


# ---------------------------------------------------------------- shards


def test_shards(docs, rows):
    got = sharding.shard_documents(docs, shards=4, slots=64).collect()
    assert len(got) == len(rows)
    by_id = {r.id: r for r in got}
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        assert (by_id[doc_id].size, by_id[doc_id].crc) == (len(data) + 1, zlib.crc32(data))
    for shard in range(4):
        places = sorted(r.slot for r in got if r.shard == shard)
        assert places == list(range(len(places)))
    # the largest slot first, always to the lightest shard
    slots = {}
    for r in got:
        slots[r.virtual] = slots.get(r.virtual, 0) + r.size
    loads, shard_of = [0] * 4, {}
    for slot, size in sorted(slots.items(), key=lambda s: (-s[1], s[0])):
        shard_of[slot] = loads.index(min(loads))
        loads[shard_of[slot]] += size
    assert {r.virtual: r.shard for r in got} == shard_of


def test_one_more_shard(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) as text")
    first = sharding.first_map(sharding.slot_sums(sharding.sized(rows)), 16)
    grown = sharding.add_shard(first)
    moved = first.alias("a").join(grown.alias("b"), "virtual").where("a.shard <> b.shard")
    assert {r[0] for r in moved.select("b.shard").distinct().collect()} == {16}
    loads = [r[0] for r in grown.groupBy("shard").agg({"bytes": "sum"}).select("sum(bytes)").collect()]
    assert len(loads) == 17 and max(loads) < 1.1 * min(loads)
    assert {r[0] for r in grown.select("version").distinct().collect()} == {2}
    equal = [r[0] for r in first.groupBy("shard").agg({"bytes": "sum"}).select("sum(bytes)").collect()]
    assert max(equal) - min(equal) < 200


def test_shards_of_odd_rows(odd_ids, empty, plan_of):
    got = sharding.shard_documents(odd_ids).collect()
    assert len(got) == odd_ids.count()
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    assert sharding.shard_documents(empty).count() == 0
    assert not re.search("Python|Arrow|Pandas", plan_of(sharding.shard_documents(odd_ids)))


# ---------------------------------------------------------------- personal data


def plain_base(text):
    """Base kinds as stated, by plain patterns."""
    found = []
    for number, (pattern, holds) in enumerate(
        [
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
        ]
    ):
        found += [(m.start(), number, m.end()) for m in re.finditer(pattern, text or "") if holds(m[0])]
    return sorted(found)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


HARD = [
    "a@b@c.com a@b.co@c.com x.y+z%@d-e.f.g.. @a.b a@.b .@a.b%@c.d",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.0002.3.255 1234567.1.1.1 1..2.3.4 00000000001.2.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1112; 4111  1111 1111 1111 0000000000000000 1 2 3 41111111111111111111111",
    "+1 (212) 555-0100, +49 30 1234567890123456 +1 +12 +123 +1234567890. ++1 212 555 0100+1-2",
    "SSN 123-45-6789 or 123-45-6789 alone; IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 DE00370400440532013000",
    "é漢 a@b.cé 1.2.3.4漢 " + "9" * 3000 + "a" * 3000 + "@" + "+" * 50,
]


def test_personal_data(spark, docs, rows):
    found = spark.createDataFrame(list(enumerate(HARD)), "doc_id bigint, text string")
    for frame, texts in ((found, dict(enumerate(HARD))), (docs, {r[0]: r[1] for r in rows})):
        for r in pii.find_personal_data(frame).collect():
            base = [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.kind in pii.BASE]
            assert base == plain_base(texts[r.doc_id])
            assert [(s.start, pii.KINDS.index(s.kind)) for s in r.spans] == sorted(
                (s.start, pii.KINDS.index(s.kind)) for s in r.spans
            )
    added = [(HARD[4][s:e], pii.KINDS[k]) for s, k, e, _ in pii.find_spans(HARD[4]) if k >= len(pii.BASE)]
    assert added == [
        ("123-45-6789", "id"),
        ("123-45-6789", "id"),
        ("DE89 3704 0044 0532 0130 00", "iban"),
        ("GB82WEST12345698765432", "iban"),
    ]
    assert not [s for s in pii.find_spans("order 123-45-6789 of today") if pii.KINDS[s[1]] == "id"]


def test_personal_data_in_random_texts():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("0123456789012..--+ ()@ab_%é\n"), rng.integers(0, 60)))
        base = [(s, k, e) for s, k, e, _ in pii.find_spans(text) if k < len(pii.BASE)]
        assert base == plain_base(text), text


def test_personal_data_of_odd_rows(odd_ids, empty):
    assert pii.find_personal_data(odd_ids).count() == odd_ids.count()
    assert pii.find_personal_data(empty).count() == 0


def test_shingle_hashes_of_bytes():
    assert len(C.shingle_hashes([])) == 0 and len(C.shingle_hashes([b"a"])) == 1
    assert len(C.shingle_hashes(C.words_of(b"A b C d E f"))) == 2
    assert hashlib.sha256(C.shingle_hashes([b"a", b"b"]).tobytes()) is not None


# ---------------------------------------------------------------- names that clash, ids that repeat, large sets


CLASHING = "doc_id bigint, text string, _gone string, _id int, _score double, _n_lines int, _n_removed string, _GONE_ int"


def test_columns_of_clashing_names_are_kept(spark, benchmark):
    from requestloom.llm import toxicity

    rows = [(i, f"{words(60 + i, 12)}\n{words(1, 20)}", f"g{i}", 10 + i, 7.5, 5, "r", 3) for i in range(4)]
    frame = spark.createDataFrame(rows, CLASHING)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, toxic int")
    assert sorted(map(tuple, decontamination.without_benchmark(frame, benchmark).collect())) == rows
    kept = ngram_join.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == rows
    clean = toxicity.without_toxic(frame, labels)
    assert clean.columns == frame.columns and {r._score for r in clean.collect()} <= {7.5}
    out = line_dedup.dedup_lines(frame)
    assert out.columns == [*frame.columns, "_n_lines_", "_n_removed_"]
    got = sorted(out.collect())
    assert [r._n_removed_ for r in got] == [0, 1, 1, 1] and [tuple(r)[2:8] for r in got] == [r[2:] for r in rows]


def test_items_that_repeat_an_id(spark):
    long, short = words(70, 24), words(71, 14)
    items = spark.createDataFrame([(1, long), (1, short)], "item_id bigint, text string")
    docs = spark.createDataFrame([(5, words(72, 30) + " " + short), (6, words(73, 9))], "doc_id bigint, text string")
    got = decontamination.contained_items(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got] == [(5, 1, 10, 10)]


def test_wide_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for n in (1100, 2040, 2050, 3000, 5000):
        for share in (0.0, 0.5, 0.74, 0.75, 0.8, 1.0):
            m = int(n * rng.uniform(0.76, 1))
            both = int(share * m)
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[:both], rng.integers(0, 1 << 63, m - both, dtype=np.uint64)])

            def wide(values):
                bits = np.zeros(1 << (len(values) - 1).bit_length(), np.uint8)
                bits[values & np.uint64(len(bits) - 1)] = 1
                return np.packbits(bits).tobytes()

            allowed = ngram_join.wide_bitmaps_allow(wide(x), wide(y), n, m)
            assert allowed or 100 * both < 75 * (n + m - both)
            assert not (allowed and share == 0.0)


def test_large_documents_that_share_passages(spark):
    """Crowds of long documents with common passages, some of which link; sets of more elements than a bitmap has bits."""
    passage = words(80, 600)
    rows = [(i, passage + " " + words(90 + i, 900)) for i in range(12)]
    rows += [(20 + i, words(200, 1400) + " " + words(300 + i, 150)) for i in range(5)]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == similar(rows)
    assert {r.component_id for r in got if r.doc_id >= 20} == {20}
