import base64
import os.path
import random

import pytest
from pyspark.sql import functions as F

from requestloom.functions import columns as C
from requestloom.functions import fixed
from requestloom.operators import rules as V


def one(spark, values, schema, *cols):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] if len(cols) == 1 else tuple(r) for r in df.select(*cols).collect()]


def label(n):
    if n < 1024:
        return f"{n}B"
    return f"{n / 1024:.1f}KB" if n < 1024 * 1024 else f"{n / (1024 * 1024):.1f}MB"


def test_size_labels(spark):
    golden = {1023: "1023B", 1024: "1.0KB", 1280: "1.2KB", 1792: "1.8KB", 1048575: "1024.0KB", 1048576: "1.0MB"}
    rng = random.Random(1)
    sizes = list(golden) + [0, 1, 1310720, 1835008] + [rng.randrange(1, 1 << 36) for _ in range(2000)]
    sizes += [k * 256 for k in range(4, 4096)]
    got = one(spark, sizes, "n bigint", C.size_label("n"))
    assert got == [label(n) for n in sizes]
    assert got[: len(golden)] == list(golden.values())


def test_base64_on_one_line_under_either_setting(spark):
    payloads = [bytes(range(256)) * k + b"x" * r for k in (0, 1, 3) for r in range(4)]
    for chunked in ("true", "false"):
        before = spark.conf.get("spark.sql.chunkBase64String.enabled")
        spark.conf.set("spark.sql.chunkBase64String.enabled", chunked)
        try:
            df = spark.createDataFrame([(bytearray(p),) for p in payloads], "b binary")
            rows = df.select(C.base64_text("b"), C.base64_length(F.octet_length("b"))).collect()
        finally:
            spark.conf.set("spark.sql.chunkBase64String.enabled", before)
        for p, (text, length) in zip(payloads, rows):
            assert text == base64.b64encode(p).decode()
            assert length == len(text)


@pytest.mark.parametrize("limit", [fixed.IMAGE_MAX_BASE64, fixed.VIDEO_MAX_BASE64, 4, 7, 100])
def test_raw_bound_is_the_base64_bound(limit):
    raw = C.max_raw_bytes(limit)
    length = lambda n: 4 * ((n + 2) // 3)
    assert length(raw) <= limit < length(raw + 1)


def test_golden_limits():
    assert C.max_raw_bytes(fixed.IMAGE_MAX_BASE64) == 15_728_640
    assert C.max_raw_bytes(fixed.VIDEO_MAX_BASE64) == 19_660_800


def test_strip_is_unicode_strip(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert sorted(spaces) == sorted(set(fixed.WHITESPACE))
    values = [s + "a" + s + "b" + s for s in spaces] + ["", "  ", "\t\n", "x", "​q​", "\n a \r\n"]
    assert one(spark, values, "s string", C.strip("s")) == [v.strip() for v in values]
    assert one(spark, values, "s string", C.is_blank("s")) == [not v.strip() for v in values]


def test_prefixes_and_names(spark):
    prefixes = [None, "", "/", "//a", "a", "a/", "/a/b", "a//"]
    assert one(spark, prefixes, "p string", C.normalize_prefix("p")) == ["", "", "", "a/", "a/", "a/", "a/b/", "a//"]
    paths = ["a/b.txt", "b", "a/", "/x", "a//b"]
    assert one(spark, paths, "p string", C.basename("p")) == [os.path.basename(p) for p in paths]


def test_routing_edge_names(spark):
    names = ["A.TXT", "x.tar.JPG", "noext", ".txt", "_h.txt", "dir/", "a.jpg\n", "a.jpeg", "jpg", "a.WebM", "a.txt/", "b.mp4 "]
    assert one(spark, names, "n string", C.modality_of("n")) == [
        "text", "image", None, "text", "text", None, None, "image", None, "video", None, None,
    ]


def test_bucket_names(spark):
    names = ["ab", "abc", "a" * 63, "a" * 64, "-abc", "abc-", "Abc", "a..b", "a.b-c", "", None, "abc\n", "ab\nc", "abc\r"]
    #        the pattern's end also matches before one final line feed
    expect = [False, True, True, False, False, False, False, True, True, False, False, True, False, False]
    assert one(spark, names, "b string", V.valid_bucket("b")) == expect


def test_shorten(spark):
    values = ["x" * 200, "x" * 201, "", None, "界" * 201]
    assert one(spark, values, "t string", C.shorten("t", 200)) == [
        "x" * 200, "x" * 200 + "...", "", None, "界" * 200 + "...",
    ]
