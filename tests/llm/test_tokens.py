"""Operators 1, 5 and 9 against the tokenizer libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from requestloom.llm import bpe, token_counts, token_files, word_tokens

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def test_bpe_documents(docs, rows, library):
    got = {r.doc_id: r for r in bpe.encode_documents(docs, RANKS, P.PATTERN).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        assert got[doc_id].ids == ids and got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_round_trip(docs, rows):
    decoded = bpe.decode_documents(bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in decoded.collect()} == {r[0]: r[1] or "" for r in rows}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(text):
    coder = test_bpe_any_text.coder
    assert coder.encode(text).tolist() == test_bpe_any_text.library.encode_ordinary(text)


@pytest.fixture(autouse=True, scope="module")
def coders(library, tokenizer):
    test_bpe_any_text.library = library
    test_bpe_any_text.coder = bpe.BytePairs(bpe.read_ranks(RANKS), P.PATTERN)
    test_word_ids.library = tokenizer
    test_word_ids.coder = word_tokens.WordTokens(open(WORDS, encoding="utf-8").read())


def test_bpe_every_code_point(library):
    """Each code point before and after letters, numbers and other signs."""
    coder = test_bpe_any_text.coder
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 1 << 16):
        text = " ".join(f"a{chr(c)}b1{chr(c)}2.{chr(c)}" for c in points[start : start + (1 << 16)])
        assert np.array_equal(coder.encode(text), library.encode_ordinary(text))


def test_bpe_other_tables():
    """Small tables, where tokens hide each other: the plain merges decide."""
    coder = bpe.BytePairs({b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5, b"ca": 6, b"cab": 7}, r"\S+")
    for n in range(1, 3**7):
        piece = bytes(b"abc"[(n // 3**i) % 3] for i in range(7))
        assert coder.encode_piece(piece) == ([coder.ranks[piece]] if piece in coder.ranks else bpe.merged(piece, coder.ranks))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_word_ids(text):
    ids = np.frombuffer(test_word_ids.coder.encode([text.encode()])[0], test_word_ids.coder.kind)
    assert ids.tolist() == test_word_ids.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZsTré\u00dfÀÿ'.,<|>09 \t\u0130\u0301ſ\u00b5中" + "\u00d7", max_size=60), st.sampled_from(["", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "'RE'll"]))
def test_word_ids_by_pieces(text, odd):
    coder = word_tokens.WordTokens.__new__(word_tokens.WordTokens)
    coder.__dict__ |= test_word_ids.coder.__dict__ | {"known": {}, "pieces": {}}
    whole = text + odd + text
    ids = np.frombuffer(coder.encode([whole.encode()])[0], coder.kind)
    assert coder.by_pieces and ids.tolist() == test_word_ids.library.encode(whole, add_special_tokens=False).ids


def test_equal_pieces_of_chunks_are_encoded_once():
    coder, asked = word_tokens.WordTokens(open(WORDS, encoding="utf-8").read()), []
    library, long = coder.tokenizer, "ab" * 100

    class Asked:
        def encode_batch_fast(self, texts, **options):
            asked.extend(piece for text in texts for piece in text.split())
            return library.encode_batch_fast(texts, **options)

    coder.tokenizer = Asked()
    texts = ["Cat, cat. (CAT) caT's 'cat", f"cat,cat {long}. {long} {long}!", "中cat"]
    expected = [library.encode(text, add_special_tokens=False).ids for text in texts]
    texts = [text.encode() for text in texts]
    assert [np.frombuffer(ids, coder.kind).tolist() for ids in coder.encode(texts[:1])] == expected[:1]
    assert sorted(asked) == sorted(["cat", ",", ".", "(", ")", "'s", "'"])
    asked.clear()
    assert [np.frombuffer(ids, coder.kind).tolist() for ids in coder.encode(texts)] == expected
    assert sorted(asked) == sorted([long, "!", "中cat"]) and long not in coder.pieces


def test_files_of_other_kinds_are_encoded_whole():
    path = P.path("byte_bpe_50k.json")
    coder = word_tokens.WordTokens(open(path, encoding="utf-8").read())
    assert not coder.by_chunks
    text = " two  blanks\nand more"
    ids = np.frombuffer(coder.encode([text.encode()])[0], coder.kind).tolist()
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_token_counts(spark, docs, rows, tokenizer, tmp_path):
    cache = f"file://{tmp_path}/counts"
    expected = {
        r[0]: (len((r[1] or "").encode()), n := len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), n > 2048)
        for r in rows
    }
    for _ in range(2):
        got = token_counts.count_tokens(docs, WORDS, cache).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == expected and len(got) == len(rows)
    # each distinct content was encoded once, and nothing in the second run
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count()
    assert stored.count() == len({b" ".join((r[1] or "").encode().split()) for r in rows})


def test_stored_counts_are_used(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/counts"
    token_counts.count_tokens(docs, WORDS, cache).collect()
    changed = spark.read.parquet(cache).selectExpr("content", "tokenizer", "n_tokens + 1000000 as n_tokens")
    other = f"file://{tmp_path}/other"
    changed.write.parquet(other)
    assert token_counts.count_tokens(docs, WORDS, other).agg({"n_tokens": "min"}).first()[0] >= 1000000
    # another tokenizer version has counts of its own
    fresh = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), other)
    assert fresh.agg({"n_tokens": "max"}).first()[0] < 1000000


def test_token_files(docs, rows, tokenizer, tmp_path):
    root = f"file://{tmp_path}/files"
    manifest = token_files.write_files(docs, WORDS, root=root, shard_ids=300)
    got = {r.doc_id: r for r in token_files.read_files(manifest).collect()}
    start = 0
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[doc_id].start, got[doc_id].n_tokens) == (start, len(ids))
        assert got[doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    # files not in the manifest, such as those of lost attempts, are not read
    (tmp_path / "files" / "part-000000-00000-lost.ids").write_bytes(b"junk")
    assert token_files.read_files(manifest).count() == len(rows)
    one = manifest.where("first_key is not null").first()
    shard = token_files.ShardFile(open(one.path.removeprefix("file://"), "rb").read())
    assert len(shard.get(one.first_key)) == 1 and shard.get(10**12) == []


def test_repeated_and_null_keys(odd_ids):
    got = token_files.read_files(token_files.write_files(odd_ids, WORDS)).collect()
    assert sorted(r.start for r in got)[0] == 0 and len(got) == odd_ids.count()
    assert sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 3 for r in got) == 3
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert bpe.encode_documents(odd_ids, RANKS, P.PATTERN).count() == odd_ids.count()
    assert token_counts.count_tokens(odd_ids, WORDS).count() == odd_ids.count()


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    index = token_files.PerfectHash.build(keys)
    assert sorted(index.numbers(keys)) == list(range(len(keys)))


def test_empty(empty):
    assert bpe.encode_documents(empty, RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(empty, WORDS).count() == 0
    assert token_files.read_files(token_files.write_files(empty, WORDS)).count() == 0


def test_coders_of_tables_that_differ_late(spark, tmp_path):
    """Two tables of ranks that are alike but for their last entries do not share an encoder."""
    import base64

    single = [bytes([b]) for b in range(256)]
    frame = spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string").coalesce(1)
    fill = [b"zz" + bytes([i // 256, i % 256]) for i in range(2500)]
    for last, expected in ((b"ab", [2756, 99, 100]), (b"cd", [97, 98, 2756])):
        path = tmp_path / last.decode()
        path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate([*single, *fill, last])))
        assert bpe.encode_documents(frame, str(path), P.PATTERN).first().ids == expected


def test_stores_keep_no_long_keys():
    from requestloom.llm.common import LONGEST_KEPT, Bounded

    asked = []
    store = Bounded(lambda key: asked.append(key) or key.upper(), 4)
    assert store["x" * (LONGEST_KEPT + 1)] == "X" * (LONGEST_KEPT + 1) and not store
    for key in ("a", "b", "c", "a", "d", "b"):
        assert store[key] == key.upper()
    assert asked[1:] == ["a", "b", "c", "d"] and len(store) == 4
    assert store["e"] == "E" and set(store) == {"e"}
    coder = word_tokens.WordTokens(open(WORDS, encoding="utf-8").read())
    long = "ab" * LONGEST_KEPT
    assert coder.encode([f"{long} cat {long}".encode()]) == coder.encode([f"{long} cat {long}".encode()])
    assert set(coder.known) == {b"cat"}


def test_a_process_keeps_the_store_of_one_step_at_a_time(monkeypatch):
    import sys
    import weakref

    from requestloom.llm import common

    monkeypatch.setattr(sys, "_requestloom_kept", {}, raising=False)

    class Store:  # in a cycle with what it computes by
        def __init__(self):
            self.known = common.Bounded(self.upper, 4)

        def upper(self, key):
            return key.upper()

    first = common.per_process("one", Store)
    assert first.known["a"] == "A"
    assert common.per_process("one", dict) is first
    gone = weakref.ref(first)
    del first
    assert gone() is not None
    assert common.per_process("two", list) == [] and gone() is None


def test_a_second_run_encodes_nothing(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/counts"
    first = token_counts.count_tokens(docs, WORDS, cache).collect()
    stored = spark.read.parquet(cache).count()
    assert sorted(token_counts.count_tokens(docs, WORDS, cache).collect()) == sorted(first)
    assert spark.read.parquet(cache).count() == stored > 0


def test_white_space_counts_where_the_tokenizer_keeps_it(spark):
    path = P.path("byte_bpe_50k.json")
    rows = [(1, "a  b"), (2, "a b"), (3, "a\n\n b"), (4, None)]
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
