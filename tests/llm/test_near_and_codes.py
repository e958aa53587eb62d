"""Operators 11 to 13 against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from requestloom.llm import common as C
from requestloom.llm import simhash_dedup, spelling, vector_codes
from requestloom.llm.catalog import table

from ..conftest import SF
from .conftest import words
from .test_documents import grouped

# ---------------------------------------------------------------- 13


def plain_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    size = min(3, len(found))
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + size]), 42) for i in range(len(found) - size + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_near(rows):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    return {i: (f"{prints[i]:016x}", c) for i, c in grouped(prints, links).items()}


def near(frame):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_documents(frame).collect()}


def test_near_documents(docs, rows, monkeypatch):
    expected = plain_near([(r[0], r[1]) for r in rows])
    assert near(docs) == expected
    monkeypatch.setattr(simhash_dedup, "BLOCK", 1000)  # long texts in blocks
    assert near(docs) == expected


def test_near_documents_of_a_table(spark):
    frame = table(spark, SF, "documents")
    expected = plain_near([(r.doc_id, r.text) for r in frame.collect()])
    assert near(frame) == expected
    assert len({c for _, c in expected.values()}) < len(expected) - 5


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_links_between_fingerprints(spark, monkeypatch, crowd):
    """All components are found, in crowds and out of them."""
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    r = random.Random(crowd)
    prints = {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(12):
        at = r.getrandbits(64)
        for _ in range(40):
            prints.add(at)
            for _ in range(r.choice([1, 2, 2, 3, 4])):
                at ^= 1 << r.randrange(64)
        middle = r.getrandbits(64)
        for _ in range(60):  # a crowd around one fingerprint
            prints.add(middle ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    pairs = [(row.a, row.b) for row in found.collect()]
    mask = (1 << 64) - 1
    assert all(0 < ((a ^ b) & mask).bit_count() <= 2 for a, b in pairs)
    plain = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & mask).bit_count() <= 2]
    assert grouped(signed, pairs) == grouped(signed, plain)
    if crowd == 64:
        assert {tuple(sorted(p)) for p in pairs} <= {tuple(sorted(p)) for p in plain}


def test_near_documents_of_odd_rows(spark, odd_ids, empty):
    assert simhash_dedup.near_documents(empty).count() == 0
    got = simhash_dedup.near_documents(odd_ids).collect()
    assert len(got) == odd_ids.count()
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert {r.fingerprint for r in got if r.doc_id is None} == {"0" * 16}
    base = words(4, 50)
    rows = [(None, base), (3, base), (3, "else " + words(5, 40)), (4, base), (None, None), (8, None), (9, " ")]
    got = simhash_dedup.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(3, 3), (3, 3), (4, 3), (8, 8), (9, 8)]


# ---------------------------------------------------------------- 12


def plain_counts(rows):
    import re

    total = Counter()
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in word)
            if doc is not None and (h := zlib.crc32(f"{doc}:{word}".encode())) % 199 == 0:
                h %= len(word)
                word = word[:h] + word[h + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_counts(rows)
    near = {w: [] for w in n}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for length, here in by_length.items():
        for a, b in [*combinations(here, 2), *((a, b) for a in here for b in by_length.get(length + 1, []))]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


def variants(frame, **more):
    return {tuple(r) for r in spelling.spelling_variants(frame, **more).collect()}


def varied(seed=3):
    """Chains of forms, ties, long words, accents, crowds of words over few letters."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randrange(6, 9))) for _ in range(60)]
    base += ["".join(r.choice("ab") for _ in range(7)) for _ in range(100)] + ["xy" * 600, "straße", "ÿÿÿÿÿÿÿ"]
    texts = []
    for word in base:
        for times in (150, 30, 6, 5):
            texts.append(" ".join([word] * times))
            at = r.randrange(len(word))
            word = r.choice([word[:at] + word[at + 1 :], word[:at] + "e" + word[at:], word[:at] + "ü" + word[at + 1 :]])
    r.shuffle(texts)
    return [(i, t.upper() if i % 3 == 0 and t.isascii() else t) for i, t in enumerate(texts)] + [(None, base[0] + " 1"), (7, None), (8, "")]


@pytest.mark.parametrize(("crowd", "symbols"), [(256, 8), (1, 2), (3, 8)])
def test_spelling_variants(spark, monkeypatch, crowd, symbols):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    monkeypatch.setattr(spelling, "MADE", 2000)  # long words in slices
    rows = varied()
    expected = plain_variants(rows)
    got = variants(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), symbols=symbols)
    assert got == expected
    assert sum(form is not None for _, form, *_ in expected) > 50
    assert any(form != root and form for _, form, root, *_ in expected)


def test_spelling_variants_of_a_table(spark):
    frame = table(spark, SF, "documents")
    assert variants(frame) == plain_variants([(r.doc_id, r.text) for r in frame.collect()])


def test_spelling_variants_of_odd_rows(docs, rows, odd_ids, empty):
    assert variants(empty) == set()
    assert variants(docs) == plain_variants([(r[0], r[1]) for r in rows])
    assert variants(odd_ids) == plain_variants([(r.doc_id, r.text) for r in odd_ids.collect()])


def test_neighbourhoods():
    """The keys of a neighbourhood are those of all reduced words one edit away, and of no others."""
    word, symbols = "abacus", 3
    reduced = "".join(chr(48 + ord(c) % symbols) for c in word)
    letters = [chr(48 + i) for i in range(symbols)]
    around = {reduced} | {reduced[:i] + reduced[i + 1 :] for i in range(len(reduced))}
    around |= {reduced[:i] + c + reduced[i + 1 :] for i in range(len(reduced)) for c in letters}
    around |= {reduced[:i] + c + reduced[i:] for i in range(len(reduced) + 1) for c in letters}
    expected = set(spelling.reduced_keys(sorted(around), symbols).tolist())
    found = [k for _, keys in spelling.neighbourhoods([word], symbols) for k in keys.tolist()]
    assert set(found) == expected and len(found) == len(expected) == len(around)


# ---------------------------------------------------------------- 11


def plain_codes(rows, entries=256, rounds=4):
    kept = []
    for i, x, label in rows:
        if x is not None and all(c is not None and np.isfinite(c) for c in x):
            kept.append((i, [int(np.floor(1024 * float(c))) for c in x], label))
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    d = len(kept[0][1])
    spans = [(p * d // 4, (p + 1) * d // 4) for p in range(4)]
    books = [[v[a:b] for _, v in first] for a, b in spans]

    def nearest(x, book):
        return min((sum((s - t) ** 2 for s, t in zip(x, c)), e) for e, c in enumerate(book))

    def assigned():
        return [[nearest(v[a:b], books[p]) for p, (a, b) in enumerate(spans)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assigned()
        for p, (a, b) in enumerate(spans):
            held = {}
            for (_, v, _), row in zip(kept, found):
                held.setdefault(row[p][1], []).append(v[a:b])
            for e, parts in held.items():
                books[p][e] = [sum(column) // len(parts) for column in zip(*parts)]
    found = assigned()
    sums = Counter()
    for (_, _, label), row in zip(kept, found):
        sums[label] += sum(x for x, _ in row)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return Counter(
        (i, "".join(f"{e:02x}" for _, e in row), sum(x for x, _ in row), sums[label], digest)
        for (i, _, label), row in zip(kept, found)
    )


VECTORS = "vec_id bigint, embedding array<float>, label int, id string, v int, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b") for r in rows], VECTORS).repartition(3)


def codes(frame, **more):
    return Counter(tuple(r) for r in vector_codes.code_vectors(frame, **more).collect())


def drawn(seed, n, d, grid=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) if grid is None else r.integers(-grid, grid + 1, size=(n, d)) / 1024
    return [(int(i), [float(c) for c in x[k].astype(np.float32)], int(i) % 5 or None) for k, i in enumerate(r.permutation(n))]


@pytest.mark.parametrize(("seed", "n", "d", "grid", "entries"), [(1, 400, 8, None, 16), (2, 600, 12, 2, 64), (3, 100, 16, 1, 256), (4, 50, 6, None, 8)])
def test_code_vectors(spark, seed, n, d, grid, entries):
    """Also with many ties (small grids), fewer rows than entries, and lengths that four does not divide."""
    rows = drawn(seed, n, d, grid)
    assert codes(vectors(spark, rows), entries=entries) == plain_codes(rows, entries)


def test_bounds_settle_parts(spark):
    """Later rounds look at few entries, and the lists get shorter."""
    rows = drawn(5, 2000, 8)
    whole = vector_codes.whole_vectors(vectors(spark, rows), "vec_id", "embedding", "label")
    whole = C.staged(whole.select("id", "label", F.transform("x", lambda c: F.floor(1024 * c)).alias("v")), "whole")
    coder = vector_codes.PartCodes(whole, 8, True, 128, 6)
    assert sum(coder.looked[0].values()) == 8000
    last = coder.looked[-1]
    assert last.get(0, 0) > 4000 and coder.b < vector_codes.CLOSEST
    assert sum(n for r, n in last.items() if r < 16) > 7000


def test_code_vectors_of_odd_rows(spark):
    rows = drawn(6, 60, 8)
    rows += [(None, [0.5] * 8, 1), (3, None, 1), (4, [0.1] * 7 + [None], 2), (5, [0.1] * 7 + [float("nan")], 2)]
    rows += [(6, [float("inf")] * 8, 2), rows[0], rows[0], (rows[0][0], [0.25] * 8, None), (99, [-1e-9] * 8, None)]
    assert codes(vectors(spark, rows), entries=16) == plain_codes(rows, 16)
    assert codes(vectors(spark, [])) == Counter()
    assert codes(vectors(spark, [(1, None, 1)])) == Counter()
    only_null = [(None, [0.0, 0.0, 0.0, 1.0], 1)]
    assert [r[1] for r in codes(vectors(spark, only_null))] == ["00000000"]
    mixed = [(i, [float(i)] * (4 if i % 2 else 8), 1) for i in range(10)] + [(77, [], 3)]
    got = codes(vectors(spark, mixed))
    assert {r[0] for r in got} == set(range(10)) | {77} and all(r[2] == 0 for r in got)


def test_code_vectors_of_large_components(spark):
    rows = [(i, [6e3 * i, -5e3 * i, 1.5, 2e3 * i], i % 2) for i in range(40)]
    assert codes(vectors(spark, rows), entries=4) == plain_codes(rows, 4)
    with pytest.raises(ValueError, match="too large"):
        codes(vectors(spark, [(1, [1e30] * 4, 1)]))
