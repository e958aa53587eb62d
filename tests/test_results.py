"""Result parsing against a plain restatement of the rules, line by line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from requestloom.functions import jsonl as J
from requestloom.operators import results as P

JSON_LINES = [
    '{"a":1}', '{"a":1} x', '{"a":1} ] x', '{"a":1}} x', '{"a":1},{"b":2}', "[1]", '"x"', "3", "{'a':1}",
    "{a:1}", '{"a":01}', '{"a":1}  ', '{"a":"\t"}', '{"a":1,"a":2}', "null", '{"a":1,}', '{"a":1}//c', "true",
    '{"a":1}]', "[1],[2]", '{"a":1}{"b":2}', '{"a":[1,2}', '{"a":1e5}', '{"a":"\\u00e9"}', "-", "1,2", '"', "[]", "{}",
]

LINES = [
    '{"recordId":"1","modelOutput":{"content":[{"type":"text","text":"hi"}],"stop_reason":"end_turn"}}',
    '{"recordId":"2","modelOutput":{"output":{"message":{"content":[{"text":"hi"}]}},"stopReason":"max"}}',
    '{"recordId":"3","modelOutput":{"content":[{"text":"a"},{"text":"b"}]}}',
    '{"recordId":"4","modelOutput":{"content":[]}}',
    '{"recordId":"5","modelOutput":null}',
    '{"recordId":"6","modelOutput":"content"}',
    '{"recordId":"7","modelOutput":["content"]}',
    '{"recordId":"8","modelOutput":{"content":null,"output":{"message":{"content":[{"text":"x"}]}}}}',
    '{"recordId":"9","modelOutput":{"content":"text"}}',
    '{"recordId":"10","modelOutput":{"output":{"message":{"content":[]}}}}',
    '{"recordId":"11","modelOutput":{"output":{}}}',
    '{"recordId":"12","modelOutput":{"content":[{"text":null}],"stop_reason":null}}',
    '{"recordId":"13","error":{"errorCode":429,"errorMessage":"slow down","retryable":true}}',
    '{"recordId":"14","error":{}}',
    '{"recordId":"15","error":null}',
    '{"recordId":"16","error":"bad"}',
    '{"recordId":"17","error":{"errorCode":null,"errorMessage":null,"retryable":null}}',
    '{"recordId":"18","error":{"errorCode":true,"errorMessage":false}}',
    '{"recordId":"19","modelOutput":{"content":[{"text":"both"}]},"error":{"errorCode":1}}',
    '{"recordId":"20","modelOutput":{},"error":{"errorCode":1}}',
    '{"recordId":"21","other":1}',
    '{"modelOutput":{"content":[{"text":"no id"}]}}',
    '{"recordId":null,"modelOutput":{"content":[{"text":"null id"}]}}',
    '{"recordId":22,"modelOutput":{"content":[{"text":"number id"}]}}',
    '{"recordId":"23","modelOutput":{"content":[{"text":""}],"stop_reason":""}}',
    '{"recordId":"24","modelOutput":{"content":[{"text":"x"}],"usage":{"input_tokens":3,"output_tokens":4}}}',
    '{"recordId":"25","modelOutput":{"output":{"message":{"content":[{"text":"y"}]}},"usage":{"inputTokens":5}}}',
    '  {"recordId":"26","modelOutput":{"content":[{"text":" padded "}]}}\t',
    '　{"recordId":"27","modelOutput":{"content":[{"text":"wide space"}]}}\xa0',
    '{"recordId":"28","modelOutput":{"content":[{"text":"dup"}],"content":[{"text":"last wins"}]}}',
    '{"recordId":"29","modelOutput":{"Content":[{"text":"case"}]}}',
    "", "   ", "\t", "not json", "[]", "null", "3", '["modelOutput"]', '"modelOutput"',
    '{"recordId":"30","modelOutput":{"content":[{"text":"cut',
    '{"recordId":"32","modelOutput":{"content":[{"text":"numbers"}],"x":NaN,"y":[-Infinity,Infinity]}}',
    '{"recordId":"33","modelOutput":{"content":[{"text":"bare word"}],"x":nan}}',
    '{"recordId":"31","modelOutput":{"content":[{"text":"ok"}]}} junk',
]


def plain_parse(line):
    """(state, row) of one line, by the stated rules."""
    line = line.strip()
    if not line:
        return "blank", None
    try:
        doc = json.loads(line)
    except ValueError:
        return "malformed", None
    if not isinstance(doc, dict):
        return "invalid", None
    rid = doc.get("recordId")
    rid = rid if rid is None else str(rid)
    if "modelOutput" in doc:
        out = doc["modelOutput"]
        try:
            if "content" in out:
                text, stop = out["content"][0]["text"], out.get("stop_reason", "unknown")
            else:
                text, stop = out["output"]["message"]["content"][0]["text"], out.get("stopReason", "unknown")
        except (TypeError, KeyError, IndexError, AttributeError):
            return "invalid", None
        return "success", (rid, text, stop, False, None, None, None)
    if "error" in doc:
        error = doc["error"]
        if not isinstance(error, dict):
            return "invalid", None
        shown = f"错误码{error.get('errorCode', 'N/A')}: {error.get('errorMessage', '未知错误')}"
        as_text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        return "error", (
            rid, f"[处理失败] {shown}", "error", True,
            as_text(error.get("errorCode")), as_text(error.get("errorMessage")), error.get("retryable", False),
        )
    return "invalid", None


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "n int, line string").repartition(4).cache()


def test_strict_json(spark):
    df = spark.createDataFrame([(v,) for v in JSON_LINES], "line string")
    w = df.withColumn("w", J.strict_variant("line")).select(J.is_one_value("w", "line"))

    def valid(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    assert [r[0] for r in w.collect()] == [valid(v) for v in JSON_LINES]


def test_strict_json_on_damaged_lines(spark):
    rng = random.Random(7)
    good = [x for x in LINES if x.strip().startswith("{")]
    damaged = []
    for _ in range(1500):
        s = list(rng.choice(good).strip())
        for _ in range(rng.randrange(0, 3)):
            i = rng.randrange(len(s))
            s[i : i + rng.randrange(0, 2)] = rng.choice('{}[]",:x1 ')
        damaged.append("".join(s))
    expect = []
    for text in damaged:
        try:
            json.loads(text)
            expect.append(True)
        except ValueError:
            expect.append(False)
    df = spark.createDataFrame(list(enumerate(damaged)), "n int, line string")
    got = df.withColumn("w", J.strict_variant("line")).select("n", J.is_one_value("w", "line").alias("ok"))
    got = {r["n"]: r["ok"] for r in got.collect()}
    wrong = [(damaged[i], expect[i]) for i in range(len(damaged)) if got[i] != expect[i]]
    assert wrong == []


def test_parse_matches_the_rules(lines):
    expect = {n: row for n, (_, row) in enumerate(map(plain_parse, LINES)) if row}
    got = {r["n"]: tuple(r)[1:] for r in P.parse_results(lines).collect()}
    assert got == expect


def test_every_nonblank_line_is_parsed_or_quarantined_once(lines):
    parsed = [r["n"] for r in P.parse_results(lines).collect()]
    bad = {r["n"]: r["reason"] for r in P.invalid_results(lines).collect()}
    nonblank = [n for n, text in enumerate(LINES) if text.strip()]
    assert sorted([*parsed, *bad]) == nonblank
    states = [plain_parse(text)[0] for text in LINES]
    assert {n for n, r in bad.items() if r == "malformed_json"} == {n for n, s in enumerate(states) if s == "malformed"}
    assert [r["n"] for r in P.parse_errors(lines).orderBy("n").collect()] == [
        n for n, s in enumerate(states) if s == "error"
    ]


def test_classification_looks_at_keys_only(lines):
    def kind(text):
        try:
            doc = json.loads(text.strip())
        except ValueError:
            return "invalid"
        doc = doc if isinstance(doc, dict) else {}
        return "success" if "modelOutput" in doc else "error" if "error" in doc else "invalid"

    got = {r["n"]: r["kind"] for r in P.classify_results(lines).collect()}
    assert got == {n: kind(text) for n, text in enumerate(LINES) if text.strip()}


def test_tokens_and_manifest(lines):
    usage = {r["record_id"]: (r["input_tokens"], r["output_tokens"]) for r in P.token_usage(lines).collect()}
    assert usage["24"] == (3, 4) and usage["25"] == (5, 0) and usage["1"] == (0, 0)
    states = [plain_parse(text)[0] for text in LINES]
    m = P.run_manifest(lines).first()
    n_ok, n_err = states.count("success"), states.count("error")
    assert m.asDict() == {
        "totalRecordCount": sum(bool(t.strip()) for t in LINES),
        "processedRecordCount": n_ok + n_err,
        "successRecordCount": n_ok,
        "errorRecordCount": n_err,
        "inputTokenCount": 8,
        "outputTokenCount": 4,
    }


def test_preview_counts_malformed_lines_but_not_blank_ones(spark):
    texts = ["", "broken", LINES[0], "  ", LINES[1], LINES[2]]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, line string").repartition(3)
    assert [r["n"] for r in P.preview_results(df, ["n"]).orderBy("n").collect()] == [2, 4]
    assert [r["n"] for r in P.preview_results(df, ["n"], "video").collect()] == []


def test_preview_per_job_with_one_job_owning_most_lines(spark, plan_of):
    rows = [("big", i, LINES[0]) for i in range(3000)] + [(f"j{i}", i, LINES[1]) for i in range(50)]
    df = spark.createDataFrame(rows, "job_id string, n int, line string").repartition(6)
    heads = P.first_lines(df, 3, ["n"], ["job_id"])
    assert plan_of(heads).count("WindowGroupLimit") == 2  # one of them before the shuffle
    out = P.preview_results(df, ["n"], by=["job_id"]).collect()
    assert sorted(r["n"] for r in out if r["job_id"] == "big") == [0, 1, 2]
    assert len(out) == 3 + 50


def plain_fallback(files, max_bytes=51200):
    """files: {(job, path): [line, ...]} -> {job: (path, [record ids])}"""
    out = {}
    for (job, path), texts in sorted(files.items()):
        if job in out or path.endswith("/") or "manifest" in path.lower():
            continue
        try:
            head = "\n".join(texts).encode()[:max_bytes].decode("utf-8")
        except UnicodeDecodeError:
            continue
        got = []
        for text in head.strip().split("\n")[:5]:
            state, row = plain_parse(text)
            if state == "success":
                got.append(row[0])
        if got:
            out[job] = (path, got)
    return out


@pytest.mark.parametrize("max_bytes", [30, 85, 86, 87, 170, 400, 51200])
def test_fallback_scan(spark, max_bytes):
    ok = lambda i, text="t": '{"recordId":"%s","modelOutput":{"content":[{"text":"%s"}]}}' % (i, text)
    files = {
        ("a", "a/1.out"): ["", " ", "bad", ok(1), "", ok(2), ok(3), ok(4)],
        ("a", "a/0.out"): ["bad"] * 5 + [ok(9)],
        ("a", "a/manifest.json.out"): [ok(8)],
        ("b", "b/x"): [ok(1, "界" * 40), ok(2)],
        ("b", "b/y"): [LINES[12], ok(5)],
        ("c", "c/z"): [LINES[12]],
        ("d", "d/long"): [ok(i) for i in range(2000)],
    }
    rows = [(j, p, i, t) for (j, p), texts in files.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "job_id string, file_path string, n int, line string").repartition(5)
    got = {}
    for r in P.read_results_fallback(df, ["n"], max_bytes=max_bytes).orderBy("job_id", "line_no").collect():
        got.setdefault(r["job_id"], (r["file_path"], []))[1].append(r["record_id"])
    assert got == plain_fallback(files, max_bytes)


def test_job_previews_bundle_and_warnings(spark):
    files = {
        ("a", "a/x.jsonl.out"): [LINES[0], "bad", LINES[1], LINES[2]],
        ("a", "a/y.jsonl.out"): [LINES[2]],
        ("b", "b/x.jsonl.out"): ["bad"],
        ("b", "b/z.txt"): [LINES[1]],
        ("c", "c/x.jsonl.out"): ["bad"],
        ("d", "d/readme"): ["bad"],
    }
    rows = [(j, p, i, t) for (j, p), texts in files.items() for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "job_id string, file_path string, n int, line string")
    keys = [*files, ("a", "a/MANIFEST.json.out"), ("c", "c/manifest.json.out"), ("a", "a/"), ("a", "a/manifest.json.out")]
    listing = spark.createDataFrame(keys, "job_id string, file_path string")
    previews = P.job_previews(listing, lines, ["n"])
    got = sorted((r["job_id"], r["file_path"], r["record_id"]) for r in previews.collect())
    assert got == [("a", "a/x.jsonl.out", "1"), ("a", "a/x.jsonl.out", "2"), ("b", "b/z.txt", "2")]
    totals = spark.createDataFrame([("a/manifest.json.out", 7), ("c/manifest.json.out", 9)], "file_path string, n bigint")
    bundle = {r["job_id"]: r for r in P.result_bundle(listing, previews, totals, "bk").collect()}
    assert sorted(bundle) == ["a", "b", "c"]
    assert bundle["a"]["s3_uri"] == "s3://bk/a/x.jsonl.out" and bundle["a"]["n"] == 7
    assert [p["record_id"] for p in bundle["a"]["preview"]] == ["1", "2"]
    assert bundle["a"]["manifest_s3_uri"] == "s3://bk/a/manifest.json.out"
    assert bundle["b"]["key"] == "b/z.txt" and bundle["b"]["parse_warning"] is None
    assert bundle["c"]["preview"] == [] and bundle["c"]["n"] is None and bundle["c"]["parse_warning"]
    warn = {r["job_id"]: r["level"] for r in P.parse_warnings(listing, previews).collect()}
    assert warn == {"c": "warning", "d": "error"}
    missing = P.missing_result_files(listing).collect()
    assert [(r["job_id"], r["found_key"]) for r in missing] == [("d", "d/readme")]


def test_a_line_is_parsed_once(lines, plan_of):
    assert plan_of(P.parse_results(lines)).count("from_json(") == 1
    assert plan_of(P.invalid_results(lines)).count("from_json(") == 1


def test_very_long_lines(spark):
    n = 27_000_000
    line = F.concat(F.lit('{"recordId":"1","modelOutput":{"content":[{"text":"'), F.expr(f"repeat('x', {n})"), F.lit('"}]}}'))
    rows = P.parse_results(spark.range(1).select(line.alias("line"))).select("record_id", F.length("output_text"))
    assert [tuple(r) for r in rows.collect()] == [("1", n)]


def test_lines_that_are_not_text(spark):
    """A byte that is no UTF-8 makes a line a reject; it gives no row and no place in a preview."""
    line = '{"recordId":"%d","modelOutput":{"content":[{"text":"t"}]}}'
    raw = [(i, (line % i).encode().replace(b'"t"', b'"\xff"' if i == 0 else b'"t"')) for i in range(5)]
    lines = spark.createDataFrame(raw, "n int, b binary").selectExpr("n", "cast(b as string) as line")
    assert sorted(r["record_id"] for r in P.parse_results(lines).collect()) == ["1", "2", "3", "4"]
    assert [r["reason"] for r in P.invalid_results(lines).select("reason").collect()] == ["malformed_text"]
    assert [r["record_id"] for r in P.preview_results(lines, ["n"]).collect()] == ["1", "2", "3"]


def test_unreadable_manifest_is_not_reported(spark):
    listing = spark.createDataFrame(
        [("a", "a/x.jsonl.out"), ("a", "a/manifest.json.out")], "job_id string, file_path string"
    )
    row = ("a", "a/x.jsonl.out", 1, "r", "t", "s", False, None, None, None)
    previews = spark.createDataFrame([row], "job_id string, file_path string, line_no int, " + P.RESULT_SCHEMA)
    for total, shown in ((None, None), (3, "s3://b/a/manifest.json.out")):
        manifests = spark.createDataFrame([("a/manifest.json.out", total)], "file_path string, totalRecordCount bigint")
        bundle = P.result_bundle(listing, previews, manifests, "b").first()
        assert (bundle["manifest_s3_uri"], bundle["totalRecordCount"]) == (shown, total)


def test_shared_folder_of_one_machine_is_refused():
    from requestloom.session import check_shared

    for root in ("/tmp/x", "file:///tmp/x"):
        check_shared(root, local=True)
        with pytest.raises(ValueError):
            check_shared(root, local=False)
    check_shared("hdfs://host/x", local=False)


def test_plain_path_that_tasks_reach_is_taken_on_a_cluster(spark, monkeypatch, tmp_path):
    from requestloom import session

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    named = session.shared_root(spark)  # the session's own setting, else the warehouse
    staged = session.stage_table(spark.range(10), "probe")
    assert staged.count() == 10 and staged.inputFiles()[0].removeprefix("file://").startswith(named.removeprefix("file:"))
    # a folder in which the driver finds nothing of what the tasks wrote
    monkeypatch.setattr(session, "_REACHED", set())
    empty = spark.createDataFrame([], "id bigint")
    empty.write.parquet(str(tmp_path / "empty"))
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths: empty)
    with pytest.raises(ValueError, match="set spark.checkpoint.dir"):
        session.shared_root(spark)
