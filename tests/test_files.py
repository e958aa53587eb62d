"""File round trips, the engine end to end, and the streaming forms."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from requestloom.engine import BatchEngine
from requestloom.operators import results as P
from requestloom.operators.objects import EmptyInputError
from requestloom.plans.scorers import make_length_scorer
from requestloom.sources import lines as L
from requestloom.sources import objects as S
from requestloom.sources import sinks as K
from requestloom.streaming import incremental as T

CLAUDE, NOVA = "us.anthropic.claude-3-haiku-20240307-v1:0", "us.amazon.nova-pro-v1:0"


def test_object_files(spark, tmp_path, plan_of):
    (tmp_path / "d").mkdir()
    files = {"a.txt": "héllo\n".encode(), "d/b.txt": b"\xff\xfe", "d/c.bin": bytes(range(256)), "d/é 1.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    root = str(tmp_path)
    listed = {r["file_name"]: r["size"] for r in S.scan_objects(spark, root).collect()}
    assert listed == {n.split("/")[-1]: len(d) for n, d in files.items()}
    assert "content" not in plan_of(S.scan_objects(spark, root))
    small = S.read_binary_objects(spark, root, max_bytes=10)
    assert "LessThanOrEqual(length,10)" in plan_of(small)
    assert {r["file_path"].split("/")[-1]: bytes(r["content"]) for r in small.collect()} == {
        n.split("/")[-1]: d for n, d in files.items() if len(d) <= 10
    }
    texts = {r["file_path"].split("/")[-1]: r["content"] for r in S.read_text_objects(spark, root).collect()}
    assert texts["a.txt"] == "héllo\n" and texts["b.txt"] is None
    with pytest.raises(Exception):
        S.read_text_objects(spark, root, on_error="fail").collect()


def test_inventory_keeps_hidden_names(spark):
    rows = [("d/_x.txt", "5", "2024-01-01 00:00:00"), (".y", "1", "2024-01-01 00:00:00")]
    got = S.inventory_objects(spark.createDataFrame(rows, "key string, size string, last_modified string")).collect()
    assert [(r["file_name"], r["size"]) for r in got] == [("_x.txt", 5), (".y", 1)]


def test_lines_keep_file_order(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).write_bytes("".join(f"{name}{i}\r\n" for i in range(500)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = L.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        got = [r["line"] for r in rows.orderBy(*L.LINE_ORDER).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"a{i}\r" for i in range(500)] + [f"b{i}\r" for i in range(500)]


def test_manifest_files(spark, tmp_path):
    (tmp_path / "ok.json.out").write_text(json.dumps({"totalRecordCount": 3, "other": 1}, indent=1))
    (tmp_path / "bad.json.out").write_text("oops")
    got = {r["file_path"].split("/")[-1]: r for r in L.read_manifest(spark, str(tmp_path)).collect()}
    assert got["ok.json.out"]["totalRecordCount"] == 3 and got["ok.json.out"]["errorRecordCount"] is None
    assert got["bad.json.out"]["totalRecordCount"] is None


def test_request_round_trip(spark, tmp_path):
    body = {"schemaVersion": "messages-v1", "messages": [{"content": [{"text": "é\n\t\"\\   \U0001f600"}]}]}
    rows = [(f"f{i}", f"1_{i}", json.dumps({"recordId": f"1_{i}", "modelInput": body}, ensure_ascii=False)) for i in range(200)]
    requests = spark.createDataFrame(rows, "file_path string, record_id string, value string").repartition(6)
    staged = K.stage_requests(requests, str(tmp_path / "staged"))
    uri = K.write_requests(staged, str(tmp_path / "out.jsonl"))
    back = L.read_requests(spark, uri).collect()
    assert sorted(r["record_id"] for r in back) == sorted(r[1] for r in rows)
    assert all(json.loads(r["model_input"]) == body for r in back)
    with pytest.raises(Exception):
        K.write_requests(staged, uri)  # nothing is overwritten by default


@pytest.fixture()
def engine(spark, tmp_path):
    data = tmp_path / "store" / "inb" / "docs"
    data.mkdir(parents=True)
    for i in range(12):
        (data / f"t{i:02}.txt").write_text("字" * i + "x", encoding="utf-8")
    (data / "broken.txt").write_bytes(b"\xff")
    (data / "empty.txt").write_bytes(b"")
    (data / "p.PNG").write_bytes(b"picture")
    (data / "v.mov").write_bytes(b"film")
    return BatchEngine(spark, str(tmp_path / "store"))


def test_text_job_end_to_end(engine):
    assert engine.preview_files("inb", "docs/t0").count() == 10
    assert [r["content"] for r in engine.read_file_content("inb", "docs/t03.txt").collect()] == ["字字字x"]
    arn = engine.create_batch_job("inb", "/docs", "outb", "res", CLAUDE, "P", make_length_scorer)
    status = engine.get_job_status(arn).first()
    assert status["results_ready"] and status["output_s3_uri"] == "s3://outb/res/"
    rows = engine.get_job_results(arn).collect()
    lengths = sorted(len("P\n\n原始文本:\n") + i + 1 for i in range(12))
    assert len(rows) == 12
    assert sorted(r["output_text"] for r in rows if not r["has_error"]) == sorted(f"chars={n}" for n in lengths if n % 7)
    assert sum(r["has_error"] for r in rows) == sum(n % 7 == 0 for n in lengths)
    stamps = {r["record_id"].split("_")[0] for r in rows}
    assert len(stamps) == 1
    assert sorted(int(r["record_id"].split("_")[1]) for r in rows) == list(range(12))
    bundle = engine.get_results_preview(arn).first()
    assert 1 <= len(bundle["preview"]) <= 3 and bundle["totalRecordCount"] == 12
    assert bundle["file_name"].endswith(".jsonl.out") and bundle["manifest_s3_uri"].endswith("manifest.json.out")
    state = engine.load_job_state().first()
    assert state["job_arn"] == arn and state["input_prefix"] == "docs/"
    assert [r["job_arn"] for r in engine.get_all_job_states().collect()] == [arn]
    assert engine.monitor_job(arn).first()["status"] == "Completed"
    progress = {(r["step"], r["metric"]): r["value"] for r in engine.get_job_progress(arn).collect()}
    assert progress["prepare", "records"] == 12 and progress["prepare", "rejected"] == 1
    assert progress["results", "totalRecordCount"] == 12 and progress["prepare", "characters"] > 1000


def test_media_jobs_and_dry_runs(engine):
    arn = engine.create_image_batch_job("inb", "docs", "outb", "", NOVA, "S", "U", _describe)
    rows = engine.get_job_results(arn).collect()
    assert [r["output_text"] for r in rows] == [base64.b64encode(b"picture").decode()]
    video = engine.prepare_video_batch_data("inb", "docs/", "", "U", NOVA, batch_ts=5)
    line = json.loads(video.requests.first()["value"])
    assert line["recordId"] == "5_0" and line["modelInput"]["messages"][0]["content"][0]["video"]["format"] == "mov"
    dry = engine.validate_inference("text", CLAUDE, make_length_scorer, bucket="inb", prefix="docs/t11", prompt="P").first()
    assert dry["file_info"] == "文件: t11.txt (34 bytes)" and dry["success"] == ((9 + 12) % 7 != 0)
    with pytest.raises(EmptyInputError):
        engine.prepare_batch_data("inb", "nothing/", "P", CLAUDE)
    K.write_requests(video.requests, engine.place("inb", "ready.jsonl"))
    clash = engine.validate_inference("image", CLAUDE, _describe, jsonl_s3_uri="s3://inb/ready.jsonl").first()
    assert not clash["success"] and "Nova" in clash["error"]
    ready = engine.validate_inference("video", NOVA, _describe, jsonl_s3_uri="s3://inb/ready.jsonl").first()
    assert ready["success"] and ready["file_info"] == "JSONL Record ID: 5_0"
    assert engine.validate_permissions("x", "inb", "outb").first()["valid"] is False
    assert engine.resolve_model("video", "Nova Pro (Video)") == NOVA


def test_unusable_lines_and_fallback(engine):
    """Request lines that cannot be used are counted and kept; previews look into other files if need be."""
    folder = engine.place("inb", "requests.jsonl")
    good = json.dumps({"recordId": "1", "modelInput": {"messages": [{"content": [{"text": "abc"}]}]}})
    K.write_requests(engine.spark.createDataFrame([(good,), (good[:-2],), (good + " x",)], "value string"), folder)

    def bytes_for_an_answer():
        return lambda rid, body: {"output": b"not json"}

    arn = engine.create_batch_job_from_jsonl("s3://inb/requests.jsonl", "outb", "r", CLAUDE, bytes_for_an_answer, job_type="video")
    bundle = engine.get_results_preview(arn).first()
    assert (bundle["totalRecordCount"], bundle["errorRecordCount"], len(bundle["preview"])) == (3, 3, 1)
    assert bundle["preview"][0]["has_error"] and bundle["preview"][0]["retryable"] is False
    job = arn.split("/")[-1]
    rejects = engine.spark.read.parquet(engine.place("outb", f"r/{job}/rejects"))
    assert [r["reason"] for r in rejects.collect()] == ["malformed_json"] * 2
    status = engine.get_job_status(arn).first()
    assert status["message"] == "" and status["submit_time"] <= status["last_modified"]


def test_preview_from_other_files(engine, tmp_path):
    answer = json.dumps({"recordId": "7", "modelOutput": {"content": [{"text": "hello"}]}})
    for name, files in {"a": {"raw.out": answer}, "b": {"1.jsonl.out": "junk", "2.jsonl.out": answer}}.items():
        arn = f"arn:x/{name}"
        engine._set_status(arn, "Completed", "s3://outb/f/")
        folder = tmp_path / "store/outb/f" / name
        folder.mkdir(parents=True)
        for file, text in files.items():
            (folder / file).write_text(text + "\n")
        bundle = engine.get_results_preview(arn).first()
        assert [p["output_text"] for p in bundle["preview"]] == ["hello"]
        assert bundle["file_name"] == ("raw.out" if name == "a" else "2.jsonl.out")


def _describe():
    def score(rid, body):
        media = next(iter(body["messages"][0]["content"][0].values()))
        return {"output": {"message": {"content": [{"text": media["source"]["bytes"]}]}}}

    return score


def test_streamed_results_equal_batch_results(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = '{"recordId":"%d","modelOutput":{"content":[{"text":"t"}]}}\n'
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    for step in range(3):
        (folder / f"{step}.jsonl.out").write_text("".join(line % (step * 10 + i) for i in range(10)) + "bad\n\n")
        T.append_results(T.stream_result_lines(spark, str(folder)), table, log).awaitTermination()
    got = sorted(int(r["record_id"]) for r in spark.read.parquet(table).collect())
    batch = sorted(int(r["record_id"]) for r in P.parse_results(L.read_results(spark, str(folder))).collect())
    assert got == batch == list(range(30))


def test_streamed_requests_append(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.txt").write_text("one\ntwo\n")
    requests = spark.readStream.text(str(source)).select(F.to_json(F.struct("value")).alias("value"))
    T.append_requests(requests, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"value":"one"}', '{"value":"two"}']


# ---------------------------------------------------------------- content read by path


@pytest.mark.parametrize("modality", ["text", "image"])
def test_listed_batch_equals_scanned_batch(spark, tmp_path, modality, plan_of):
    from requestloom.operators import requests as Q

    ending = "txt" if modality == "text" else "png"
    for i in range(40):
        (tmp_path / f"é {i:02}.{ending}").write_bytes(("字%d" % i).encode() * i + b"!")
    (tmp_path / f"bad.{ending}").write_bytes(b"\xff")
    root = str(tmp_path) + "/"
    files = S.read_binary_objects(spark, root)
    key = F.substring_index("file_path", "/", -1)
    files = files.withColumn("file_path", key)
    listing = files.select("file_path", "size")
    options = {"batch_ts": 3, "prompt": "p", "max_base64": 400} if modality == "image" else {"batch_ts": 3, "prompt": "p"}
    scanned = Q.prepare_batch(files, modality, NOVA, **options)
    listed = Q.prepare_listed_batch(listing, root, modality, NOVA, **options)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(scanned.requests) == rows(listed.requests)
    assert rows(scanned.rejects) == rows(listed.rejects)
    assert scanned.rows == listed.rows == len(rows(listed.requests))
    assert "Join" not in plan_of(listed.requests).replace("BroadcastHashJoin [bucket", "")


def test_listed_batch_rejects_what_is_gone(spark, tmp_path):
    from requestloom.operators import requests as Q

    (tmp_path / "b.jpg").write_bytes(b"x")
    listing = spark.createDataFrame([("a.jpg", 1), ("b.jpg", 1)], "file_path string, size bigint")
    batch = Q.prepare_listed_batch(listing, f"file://{tmp_path}/", "image", NOVA, batch_ts=1)
    assert [r["record_id"] for r in batch.requests.collect()] == ["1_0"]
    assert [r["file_path"] for r in batch.rejects.collect()] == ["a.jpg"]
    strict = Q.prepare_listed_batch(listing, f"file://{tmp_path}/", "image", NOVA, batch_ts=1, on_error="fail")
    with pytest.raises(Exception, match="unreadable object a.jpg"):
        strict.requests.collect()


def test_fetched_batches_are_cut_by_bytes(spark, tmp_path):
    from requestloom.sources.fetch import fetch_content

    for i in range(30):
        (tmp_path / f"{i}").write_bytes(bytes([i]) * (100 * i))
    listing = spark.createDataFrame([(i, f"{tmp_path}/{i}") for i in range(30)], "n int, uri string").coalesce(1)
    got = {r["n"]: bytes(r["content"]) for r in fetch_content(listing, chunk_bytes=500).collect()}
    assert got == {i: bytes([i]) * (100 * i) for i in range(30)}
    assert fetch_content(listing, keep_content=False, tasks=3).filter("problem is null").count() == 30


# ---------------------------------------------------------------- stores, listings, heads


class CountingStore:
    """A store of a scheme that nothing else opens: files below a folder; reading beyond a limit is an error."""

    def __init__(self, folder, most=None):
        self.folder, self.most = folder, most

    def _path(self, uri):
        assert uri.startswith("toy://")
        return f"{self.folder}/{uri[len('toy://'):]}"

    def open(self, uri):
        most = self.most

        class Limited:
            def __init__(self, path):
                self.file, self.given = open(path, "rb"), 0

            def __enter__(self):
                return self

            def __exit__(self, *_):
                self.file.close()

            def read(self, size=-1):
                data = self.file.read(size)
                self.given += len(data)
                if most is not None and self.given > most:
                    raise RuntimeError(f"read {self.given} bytes")
                return data

        return Limited(self._path(uri))

    def entries(self, uri):
        import os

        from requestloom.sources.stores import Entry

        if not os.path.isdir(self._path(uri)):
            return
        for one in os.scandir(self._path(uri)):
            if self.most == 0 and one.name == "shut":
                raise OSError("shut")
            size = None if one.is_dir() else one.stat().st_size
            yield Entry(one.name, size, one.stat().st_mtime)


def test_schemes_of_spark_and_pyarrow():
    from requestloom.sources.stores import ArrowStore, store_errors

    assert all(ArrowStore.knows(u) for u in ("s3a://b/k", "/a/b:c", "file:/a", "abfss://c@a/k", "hdfs://n:1/k"))
    assert not ArrowStore.knows("dbfs:/k")
    with pytest.raises(store_errors()):
        ArrowStore().open("dbfs:/k")
    for form in ("file:/a/b c", "file:///a/b c", "/a/b c"):
        assert ArrowStore()._place(form)[1] == "/a/b c"


def test_an_unknown_scheme_is_a_problem_of_the_row(spark):
    from requestloom.sources.fetch import fetch_content

    got = fetch_content(spark.createDataFrame([("nowhere://a/b",)], "uri string")).first()
    assert got["content"] is None and "nowhere" in got["problem"]


def _tree(tmp_path):
    files = ["a.txt", "d/b.txt", "d/deep/er/c.txt", "d/deep/x y é.txt", "dd/e.txt", "d/_h/f.txt", "d/.g", "e/only"]
    for name in files:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"z" * len(name))
    (tmp_path / "empty").mkdir()
    return files


@pytest.mark.parametrize("prefix", ["", "d", "d/deep/x", "none/at/all"])
def test_listing_by_levels(spark, tmp_path, prefix):
    from requestloom.sources.listing import list_tree

    files = _tree(tmp_path)
    wanted = {(f, f.split("/")[-1], len(f)) for f in files if f.startswith(prefix)}
    for root, store in ((str(tmp_path), None), (f"file://{tmp_path}/", None), ("toy://", CountingStore(str(tmp_path)))):
        got = list_tree(spark, root, prefix, store, task_folders=1).collect()
        assert {(r["file_path"], r["file_name"], r["size"]) for r in got} == wanted and len(got) == len(wanted)
        assert all(r["last_modified"].year > 2000 for r in got)
    shown = list_tree(spark, str(tmp_path), prefix, hidden=False)
    assert {r["file_path"] for r in shown.collect()} == {f for f, *_ in wanted if "/_h" not in f and "/.g" not in f}


def test_listing_starts_at_the_deepest_folder(spark, tmp_path):
    """Folders beside the prefix are not looked at, and one that cannot be listed stops the job."""
    from requestloom.sources.listing import list_tree

    (tmp_path / "shut").mkdir()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"1")
    store = CountingStore(str(tmp_path), most=0)
    assert [r["file_path"] for r in list_tree(spark, "toy://", "in/", store).collect()] == ["in/a"]
    with pytest.raises(Exception, match="cannot list .*shut"):
        list_tree(spark, "toy://", "in", store).collect()


def test_first_lines_are_read_in_blocks():
    import io

    from requestloom.sources.heads import first_lines_of

    for text in (b"", b"\n\n", b"a", b"a\n\n \t\r\nb\n\xff\nc\xc3\xa9\n\n", b"\n\n  last"):
        whole = [(i + 1, r) for i, r in enumerate(text.split(b"\n"))]
        plain = [(i, r.decode()) for i, r in whole if r != b"\xff" and r.decode().strip()]
        for n in (1, 2, 5):
            for block in (1, 2, 3, 100):
                assert list(first_lines_of(io.BytesIO(text), n, block)) == plain[:n]


def test_heads_do_not_read_on(spark, tmp_path, plan_of):
    from requestloom.sources.fetch import fetch_content
    from requestloom.sources.heads import head_lines

    for i in range(4):
        (tmp_path / f"{i}").write_bytes(b"\n" * i + b"".join(b"line %d\n" % k for k in range(200_000)))
    files = spark.createDataFrame([(f"{i}", f"toy://{i}") for i in range(4)] + [("gone", "toy://gone")], "name string, uri string")
    heads = head_lines(files, 3, store=CountingStore(str(tmp_path), most=4096), block_bytes=4096)
    rows = heads.collect()
    assert sorted((r["name"], r["place"], r["line"]) for r in rows if r["line"]) == [
        (f"{i}", i + k + 1, f"line {k}") for i in range(4) for k in range(3)
    ]
    assert [r["name"] for r in rows if r["problem"]] == ["gone"]
    assert "Exchange" not in plan_of(heads)
    starts = fetch_content(files, store=CountingStore(str(tmp_path), most=100), head_bytes=100)
    assert sorted(len(r["content"] or b"") for r in starts.collect()) == [0, 100, 100, 100, 100]


def test_heads_of_parts(spark, tmp_path):
    from requestloom.sources.heads import head_lines_of_parts

    parts = {"f": ["", "a\n", "\n\n", "b", "c\nd\n", "e"], "g": ["1\n2\n3\n", "4"], "h": ["", "\n"], "i": [None, "x"]}
    rows = []
    for name, texts in parts.items():
        for k, text in enumerate(texts):
            rows.append((name, f"p{k}", f"{tmp_path}/{name}{k}"))
            if text is not None:
                (tmp_path / f"{name}{k}").write_text(text)
    table = spark.createDataFrame(rows, "file string, part string, uri string")
    got = head_lines_of_parts(table, 3, ["file"], on_error="skip").collect()
    assert sorted((r["file"], r["line_no"], r["line"]) for r in got) == [
        ("f", 1, "a"), ("f", 2, "b"), ("f", 3, "c"), ("g", 1, "1"), ("g", 2, "2"), ("g", 3, "3"), ("i", 1, "x")
    ]
    with pytest.raises(Exception, match="i0"):
        head_lines_of_parts(table, 3, ["file"]).collect()
    assert head_lines_of_parts(table.limit(0), 3, ["file"]).count() == 0


OK_LINE = json.dumps({"recordId": "%s", "modelOutput": {"content": [{"text": "t"}]}})


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fallback_from_files_equals_fallback_from_lines(spark, tmp_path, parts):
    """Windows that end inside lines and characters, blank starts, torn and unreadable files, many parts."""
    texts = {
        ("a", "a/1"): "junk\n" + OK_LINE % 1 + "\n" + OK_LINE % 2,
        ("a", "a/2"): OK_LINE % 3,
        ("b", "b/1"): "\n \n\n" + OK_LINE % 4 + "\n\n" + OK_LINE % 5 + "\n" + "\n".join(OK_LINE % i for i in range(9)),
        ("c", "c/1"): "é" * 60,
        ("c", "c/2"): OK_LINE % 6 + "\n" + "x" * 300,
        ("d", "d/manifest.json"): OK_LINE % 7,
        ("e", "e/1"): "\n" * 200 + OK_LINE % 8,
        ("f", "f/1"): OK_LINE % "é" + "\n" + "y" * 100 + "é" * 100,
    }
    rows, lines = [], []
    for (job, path), text in texts.items():
        data = text.encode()
        cuts = sorted({len(data) * k // parts for k in range(parts + 1)})
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / f"{path.replace('/', '-')}.{k:02}").write_bytes(data[i:j])
            rows.append((job, path, f"p{k:02}", f"{tmp_path}/{path.replace('/', '-')}.{k:02}", j - i))
        lines += [(job, path, i, raw) for i, raw in enumerate(data.split(b"\n"))]
    files = spark.createDataFrame(rows, "job_id string, file_path string, part string, uri string, size bigint")
    lines = spark.createDataFrame(lines, "job_id string, file_path string, n int, line binary")
    lines = lines.withColumn("line", F.col("line").cast("string"))
    for window in (10, 150, 155, 51200):
        plain = P.read_results_fallback(lines, ["n"], max_bytes=window).collect()
        got = P.fallback_from_files(files, part="part" if parts > 1 else None, max_bytes=window)
        got = got.select(*P.read_results_fallback(lines, ["n"], max_bytes=window).columns).collect()
        key = lambda r: (r["job_id"], r["file_path"], r["line_no"], r["record_id"], r["output_text"])
        assert sorted(map(key, got)) == sorted(map(key, plain)) and (window < 100 or plain)


@pytest.mark.parametrize("modality", ["text", "image", "video"])
def test_each_object_is_opened_once(spark, tmp_path, modality):
    """Numbers count only what can be read, in the order of paths, whatever the ranges."""
    from requestloom.operators import numbering as N
    from requestloom.operators import requests as Q

    ending = {"text": "txt", "image": "png", "video": "mp4"}[modality]

    class Once(CountingStore):
        def open(self, uri):
            open(f"{self.folder}/seen-{uri[len('toy://'):].replace('/', '-')}", "x").close()  # a second time is an error
            return super().open(uri)

    (tmp_path / "in").mkdir()
    names = [f"in/{i:03}.{ending}" for i in range(60)]
    for i, name in enumerate(names):
        if i % 7:
            (tmp_path / name).write_bytes(b"\xff" if i % 5 == 0 and modality == "text" else b"%d \"q\"" % i)
    listing = spark.createDataFrame([(n, 4) for n in reversed(names)], "file_path string, size bigint").repartition(5)
    before = Q.task_count
    Q.task_count = lambda *_: 7
    try:
        batch = Q.prepare_listed_batch(listing, "toy://", modality, NOVA, batch_ts=9, prompt="p", store=Once(str(tmp_path)))
    finally:
        Q.task_count = before
    good = [n for i, n in enumerate(names) if i % 7 and not (i % 5 == 0 and modality == "text")]
    rows = sorted(batch.requests.collect(), key=lambda r: int(r["record_id"].split("_")[1]))
    assert [(r["file_path"], r["record_id"]) for r in rows] == [(n, f"9_{k}") for k, n in enumerate(good)]
    assert batch.rows == len(good)
    assert all(json.loads(r["value"])["recordId"] == r["record_id"] for r in rows)
    assert {r["file_path"] for r in batch.rejects.collect()} == set(names) - set(good)
    with pytest.raises(N.DuplicateKeyError):
        Q.prepare_listed_batch(listing.unionAll(listing), "toy://", modality, NOVA, batch_ts=9, store=CountingStore(str(tmp_path)))


def test_media_that_cannot_be_read_are_rejected(engine, tmp_path):
    import os

    class Shut(CountingStore):
        def open(self, uri):
            if uri.endswith("q.png"):
                raise PermissionError("shut")
            return super().open(uri)

    (tmp_path / "store/inb/docs/q.png").write_bytes(b"other")
    closed = BatchEngine(engine.spark, "toy://store", store=Shut(str(tmp_path)))
    batch = closed.prepare_image_batch_data("inb", "docs/", "", "U", NOVA, batch_ts=1)
    assert [r["file_path"] for r in batch.requests.collect()] == ["docs/p.PNG"]
    assert [r["file_name"] for r in batch.rejects.collect()] == ["q.png"]
    inventory = engine.spark.createDataFrame(
        [("docs/p.PNG", 7, "2024-01-01 00:00:00"), ("other/x.png", 1, "2024-01-01 00:00:00")], "key string, size int, last_modified string"
    )
    listed = engine.prepare_inventory_batch_data(inventory, "inb", "docs/", "image", NOVA, batch_ts=2, prompt="U")
    assert [r["record_id"] for r in listed.requests.collect()] == ["2_0"] and os.path.exists(tmp_path / "store")


def test_request_files_are_no_input(engine):
    """A second batch of the same folder does not take the first one's request file for input."""
    for _ in range(2):
        arn = engine.create_batch_job("inb", "docs", "outb", "res", CLAUDE, "P", make_length_scorer)
        assert engine.get_job_results(arn).count() == 12


@pytest.mark.parametrize("prefix", ["team/rejects/", "a b/é/"])
def test_results_below_any_prefix(engine, tmp_path, prefix):
    answer = OK_LINE % 7
    arn = "arn:x/z9"
    engine._set_status(arn, "Completed", f"s3://outb/{prefix}")
    folder = tmp_path / "store/outb" / prefix / "z9"
    (folder / "rejects").mkdir(parents=True)
    (folder / "raw.out").write_text("no json\n" + answer + "\n")
    (folder / "rejects" / "part-0").write_text(answer.replace("7", "8"))
    bundle = engine.get_results_preview(arn).first()
    assert [p["record_id"] for p in bundle["preview"]] == ["7"] and bundle["file_name"] == "raw.out"


# ---------------------------------------------------------------- the log of commits


def test_commits_of_two_drivers(spark, tmp_path):
    """Numbers have no gaps whoever takes them; readers see the first and the newest entry of each key."""
    from concurrent.futures import ThreadPoolExecutor

    from requestloom.sources.commits import CommitLog

    logs = [CommitLog(spark, str(tmp_path / "log"), "k string, v int, seq bigint", "k", every=7) for _ in range(2)]
    assert logs[0].read().count() == 0 and logs[0].last() == 0
    with ThreadPoolExecutor(2) as pool:
        work = [pool.submit(lambda log: [log.append({"k": f"k{i % 4}", "v": i}) for i in range(15)], log) for log in logs]
        taken = [w.result() for w in work]
    assert sorted(taken[0] + taken[1]) == list(range(1, 31))
    values = {c: (f"k{i % 4}", i) for one in taken for i, c in enumerate(one)}
    for upto in (1, 6, 7, 8, 14, 22, 30):
        rows = logs[0].read(upto).collect()
        assert all(values[r["seq"]] == (r["k"], r["v"]) for r in rows)
        for k in {values[c][0] for c in range(1, upto + 1)}:
            mine = [c for c in range(1, upto + 1) if values[c][0] == k]
            seen = sorted(r["seq"] for r in rows if r["k"] == k)
            assert (seen[0], seen[-1]) == (mine[0], mine[-1])
    assert len(logs[0].read(30).collect()) <= 2 * 4 + 7


def test_skewed_clocks_do_not_decide(engine, monkeypatch):
    other = BatchEngine(engine.spark, engine.root)
    folder = engine.place("inb", "requests.jsonl")
    line = json.dumps({"recordId": "1", "modelInput": {"messages": [{"content": [{"text": "abc"}]}]}})
    K.write_requests(engine.spark.createDataFrame([(line,)], "value string"), folder)
    arns = []
    for one, hour, name in ((engine, 20, "first"), (other, 3, None)):
        monkeypatch.setattr("requestloom.engine.time.gmtime", lambda: (2024, 1, 1, hour, 0, 0, 0, 1, 0))
        arns.append(one.create_batch_job_from_jsonl("s3://inb/requests.jsonl", "outb", "r", CLAUDE, make_length_scorer, job_name=name))
    monkeypatch.undo()
    newest = engine.load_job_state().first()
    assert newest["job_arn"] == arns[1] and newest["model_id"] == CLAUDE and newest["job_name"].startswith("batch-job-")
    assert [r["job_arn"] for r in other.get_all_job_states().collect()] == arns[::-1]
    assert engine.load_job_state(arns[0]).first()["job_name"] == "first"
    assert engine.get_job_status(arns[1]).first()["status"] == "Completed"


# ---------------------------------------------------------------- objects written by the tasks


def test_objects_are_written_by_tasks(spark, tmp_path):
    """Rows of one name that follow each other are one object, a second run replaces them, and nothing else is left."""
    rows = [("a/1", b"x\n"), ("a/1", b"\xff"), ("a/é 2", b""), ("b/c/3", b"z")]
    objects = spark.createDataFrame(rows, "name string, content binary").coalesce(1)
    for root in (f"{tmp_path}/o", f"file://{tmp_path}/o"):
        assert K.write_objects(objects, root) == root
        found = {str(p.relative_to(tmp_path / "o")): p.read_bytes() for p in (tmp_path / "o").rglob("*") if p.is_file()}
        assert found == {"a/1": b"x\n\xff", "a/é 2": b"", "b/c/3": b"z"}


def test_an_object_that_fails_is_not_seen(tmp_path):
    from requestloom.sources.stores import ArrowStore

    store = ArrowStore()
    with store.create(f"{tmp_path}/a") as stream:
        stream.write(b"old")
    with pytest.raises(RuntimeError):
        with store.create(f"{tmp_path}/a") as stream:
            stream.write(b"new")
            raise RuntimeError
    assert [(p.name, p.read_bytes()) for p in tmp_path.iterdir()] == [("a", b"old")]


def test_large_folders_are_listed_in_pieces(spark, tmp_path, monkeypatch):
    from requestloom.sources import listing

    monkeypatch.setattr(listing, "ENTRIES_AT_ONCE", 3)
    for i in range(10):
        (tmp_path / str(i)).write_bytes(b"x" * i)
    (tmp_path / "to nowhere").symlink_to(tmp_path / "nowhere")
    found = listing.list_tree(spark, str(tmp_path)).collect()
    assert sorted((r["file_path"], r["size"]) for r in found) == [(str(i), i) for i in range(10)]


def test_many_folders_are_listed_by_few_tasks(spark, monkeypatch, tmp_path):
    from requestloom.sources import listing

    asked, level = [], listing._level
    monkeypatch.setattr(listing, "_level", lambda f, r, s, tasks: asked.append(tasks) or level(f, r, s, tasks))
    for i in range(80):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "x").write_bytes(b"x")
    assert listing.list_tree(spark, str(tmp_path), task_folders=1).count() == 80
    assert asked == [1, 4 * spark.sparkContext.defaultParallelism]


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("modality", ["text", "image", "video"])
def test_listed_objects_share_folders(spark, tmp_path, monkeypatch, modality):
    """The objects of a listed batch need no folder each, and nothing beside them is written; rows are what they were."""
    from requestloom.plans import catalog

    root = str(tmp_path / "objects")
    monkeypatch.setattr(catalog, "shared_path", lambda spark, label: root)
    rows = [(i, None if i == 4 else "é" * i) for i in range(1, 41)] + [(40, "é" * 40)]
    got = catalog.CATALOG[f"listed_{modality}_requests"][0](spark, _documents(spark, tmp_path, rows)).collect()
    files = [p for p in (tmp_path / "objects").rglob("*") if p.is_file()]
    assert len(files) == 40 and len({p.parent for p in files}) == 1
    gone = [i for i in range(1, 41) if i % 11 == 5]
    bad = [i for i in range(1, 41) if modality == "text" and i % 7 == 3]
    good = [i for i in range(1, 41) if i not in bad]
    requests = sorted((int(r["k"]), int(r["record_id"].split("_")[1])) for r in got if r["reason"] is None)
    assert requests == [(i, n) for n, i in enumerate(good)]
    assert sorted(int(r["k"]) for r in got if r["reason"] is not None) == sorted(gone + bad)
    last = next(r["value"] for r in got if int(r["k"]) == 40 and r["reason"] is None)
    twice = ("é" * 40 + "\n") * 2
    content = twice if modality == "text" else base64.b64encode((base64.b64encode(("é" * 40).encode()) + b"\n") * 2).decode()
    assert json.dumps(content, ensure_ascii=False)[1:-1] in last


def test_texts_are_listed_and_opened_by_tasks(spark, tmp_path, plan_of):
    """The rows of Spark's source, without its list of all files on the driver."""
    for name in ("a.txt", "d/é 1.txt", "d/_x.txt", "d/.y", "_h/z.txt", "_p=1/z.txt", "d/_metadata", "_metadata-1/m.txt", "e._COPYING_"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty").mkdir()
    columns = ["file_path", "last_modified", "size", "content"]
    for root in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/d", f"{tmp_path}/a.txt", f"{tmp_path}/d*"):
        old = S.read_binary_objects(spark, root).withColumn("content", F.col("content").cast("string"))
        new = S.read_text_objects(spark, root)
        assert new.columns == columns and sorted(new.collect()) == sorted(old.select(columns).collect())
    plan = plan_of(S.read_text_objects(spark, str(tmp_path)))
    assert "binaryFile" not in plan and "MapInArrow" in plan
    with pytest.raises(Exception):
        S.read_text_objects(spark, f"{tmp_path}/none").collect()
    lost = S.read_text_objects(spark, str(tmp_path))
    (tmp_path / "a.txt").unlink()
    with pytest.raises(Exception, match="cannot read .*a.txt"):
        lost.collect()


def test_files_of_rows_need_no_commit(spark, tmp_path, monkeypatch):
    """One file per row, null and empty texts too, with nothing beside them that a commit would have to move."""
    from requestloom.plans import catalog

    root = str(tmp_path / "files")
    monkeypatch.setattr(catalog, "shared_path", lambda spark, label: root)
    folder = _documents(spark, tmp_path, [(1, "a"), (2, None), (3, ""), (4, "é"), (4, "é")])
    got = catalog.CATALOG["read_text_objects"][0](spark, folder).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 2, 3, 3]
    files = [p for p in (tmp_path / "files").rglob("*") if p.is_file()]
    assert sorted(p.read_text() for p in files) == ["\n", "\n", "a\n", "é\n", "é\n"]
