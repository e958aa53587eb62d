import json

import pytest
from pyspark.sql import functions as F

from requestloom.functions import fixed
from requestloom.operators import models as M
from requestloom.operators import objects as O
from requestloom.operators import registry as R
from requestloom.operators import rules as V
from requestloom.sources import registry as G


def test_upsert_keeps_first_position_and_last_value(spark):
    log = [("b", "1", 1), ("a", "2", 2), ("b", "3", 3), ("c", None, 4), ("a", "0", 5)]
    states = R.registry_upsert(spark.createDataFrame(log, "job_arn string, timestamp string, seq bigint").repartition(3))
    got = [(r["job_arn"], r["timestamp"], r["position"]) for r in states.orderBy("position").collect()]
    assert got == [("b", "3", 1), ("a", "0", 2), ("c", None, 4)]
    assert R.registry_latest(states).first()["job_arn"] == "b"
    assert [r["job_arn"] for r in R.registry_get(states, "a").collect()] == ["a"]
    assert R.registry_get(states, "nope").count() == 0


def test_recent_jobs_tie_break_and_limit(spark, plan_of):
    log = [(f"j{i}", "t" if i % 2 else "s", i) for i in range(30)]
    states = R.registry_upsert(spark.createDataFrame(log, "job_arn string, timestamp string, seq bigint"))
    recent = R.registry_recent(states)
    assert [r["job_arn"] for r in recent.collect()] == [f"j{i}" for i in range(1, 20, 2)]
    # still a top-n when columns are computed on the result
    assert "TakeOrderedAndProject" in plan_of(recent.withColumn("x", F.upper("job_arn")))
    empty = R.registry_upsert(spark.createDataFrame([], "job_arn string, timestamp string, seq bigint"))
    assert R.registry_latest(empty).count() == 0


def test_status_flags(spark):
    statuses = ["Submitted", "InProgress", "Completed", "Failed", "Stopped", "Error", "Odd"]
    rows = [(s, "Submitted", "u", 0) for s in statuses] + [(s, s, "u", 1) for s in statuses]
    log = spark.createDataFrame(rows, "job_arn string, status string, uri string, seq int")
    got = {r["job_arn"]: r for r in R.job_status(log, output_uri="uri").collect()}
    assert {s for s in statuses if got[s]["is_terminal"]} == {"Completed", "Failed", "Stopped"}
    assert {s for s in statuses if got[s]["results_ready"]} == {"Completed"}
    assert {s for s in statuses if got[s]["is_error"]} == {"Error"}
    assert {s for s in statuses if got[s]["output_s3_uri"]} == {"Completed"}
    assert got["InProgress"]["hint"] == got["Submitted"]["hint"] == "refresh_later"


def test_locations(spark):
    rows = [("x:job/1", "s3://b/p/q"), ("x:job/2", "s3://b/p/"), ("x:job/3", "s3://b"), ("plain", "s3://b/")]
    jobs = spark.createDataFrame(rows, "job_arn string, output_s3_uri string")
    got = [
        (r["result_bucket"], r["result_root"], r["job_id"], r["result_prefix"])
        for r in R.result_locations(jobs).orderBy("job_arn").collect()
    ]
    assert got == [("b", "", "plain", "plain/"), ("b", "p/q/", "1", "p/q/1/"), ("b", "p/", "2", "p/2/"), ("b", "", "3", "3/")]


def test_registry_documents(spark, tmp_path):
    entries = {f"k{i}": {"job_arn": f"k{i}", "timestamp": f"2025-01-0{i}T00:00:00.5", "aws_region": None} for i in (3, 1, 2)}
    path = tmp_path / "states.json"
    path.write_text(json.dumps(entries, indent=2), encoding="utf-8")
    rows = G.read_registry(spark, str(path)).orderBy("seq_in_doc").collect()
    assert [r["job_key"] for r in rows] == ["k3", "k1", "k2"]
    assert rows[0]["timestamp"] == "2025-01-03T00:00:00.5" and rows[0]["output_bucket"] is None
    path.write_text("not json", encoding="utf-8")
    assert G.read_registry(spark, str(path)).count() == 0
    assert G.read_registry(spark, str(tmp_path / "absent.json")).count() == 0


def test_config_rules(spark):
    rows = [
        ("arn:aws:iam::1:role/r", "in-b", "out-b", "m"),
        ("arn:aws:iam::1:role/r", "in-b", "out-b", ""),
        ("arn:aws:iam::1:role/r", "in-b", "out-b", None),
        ("arn:aws:iam::1:role/r", "B", None, "  "),
        (None, "in-b", "out-b", "m"),
        ("arn:aws:s3:::x", "B", "out-b", "m"),
    ]
    df = spark.createDataFrame(rows, "role_arn string, input_bucket string, output_bucket string, model_id string")
    got = V.validate_configs(df).collect()
    assert [r["valid"] for r in got] == [True, True, True, False, False, False]
    assert [len(r["checks"]) for r in got] == [4, 3, 3, 1, 0, 0]
    assert [len(r["errors"]) for r in got] == [0, 0, 0, 3, 1, 1]
    assert [len(r["warnings"]) for r in got] == [3, 3, 3, 3, 0, 0]
    assert got[3]["errors"][1].endswith("None") and got[4]["errors"][0].endswith("None")
    reports = V.config_report(df).collect()
    assert reports[4]["report"] == "请填写所有必填配置项" and "🎉" not in reports[0]["report"]
    assert reports[0]["report"].endswith("配置验证通过，可以开始批处理！")


@pytest.mark.parametrize("modality,first", [("text", "invalid_model"), ("image", "missing_input"), ("video", "missing_input")])
def test_first_broken_rule_wins(spark, modality, first):
    schema = (
        "modality string, model_name string, model_id string, role_arn string, output_bucket string,"
        " input_bucket string, prompt string, use_jsonl boolean, jsonl_s3_uri string"
    )
    rows = [
        (modality, "m", None, "r", "o", "", "p", False, ""),
        (modality, "m", "id", "r", "o", "i", " ", False, None),
        (modality, "m", "id", "r", "o", "", "", True, "uri"),
        (modality, "m", "id", "r", "o", "i", "p", True, ""),
        (modality, "m", "id", "", "o", "i", "p", True, "uri"),
    ]
    got = [r["rule"] for r in V.required_fields(spark.createDataFrame(rows, schema)).collect()]
    assert got == [first, "ok", "ok", "missing_jsonl_uri", "missing_required"]


def test_model_lookup(spark, plan_of):
    rows = [("text", "Nova Pro"), ("image", "Nova Pro"), ("video", "Nova Pro (Video)"), ("text", "x"), ("text", None)]
    df = spark.createDataFrame(rows, "modality string, model_name string")
    found = M.resolve_models(df)
    got = {(r["modality"], r["model_name"]): r["model_id"] for r in found.collect()}
    assert got == {
        ("text", "Nova Pro"): "us.amazon.nova-pro-v1:0",
        ("image", "Nova Pro"): None,
        ("video", "Nova Pro (Video)"): "us.amazon.nova-pro-v1:0",
        ("text", "x"): None,
        ("text", None): None,
    }
    assert "BroadcastHashJoin" in plan_of(found)
    anywhere = M.resolve_models_any(df.filter("modality = 'image'")).first()
    assert anywhere["model_id"] == "us.amazon.nova-pro-v1:0"
    counts = {m: sum(1 for r in fixed.MODEL_CATALOG if r[0] == m) for m in fixed.MODALITIES}
    assert counts == {"text": 14, "image": 13, "video": 2}


def test_listing_and_gates(spark):
    rows = [("in/", 0), ("in/a.txt", 3), ("in/d/", 0), ("in/e.txt", 0), ("in/b.PNG", 5), ("inx/c.csv", 1), ("z", 1)]
    objects = spark.createDataFrame(rows, "file_path string, size bigint")
    assert [r["file_path"] for r in O.list_objects(objects, "in/").orderBy("file_path").collect()] == ["in/a.txt", "in/b.PNG"]
    assert O.list_objects(objects, "in").count() == 3  # a prefix is plain text
    assert O.list_objects(objects, "z").count() == 0  # the prefix itself is no object
    assert O.listing_stats(objects, "in/").first().asDict() == {"scanned": 5, "skipped": 3, "kept": 2}
    O.require_nonempty(objects, "text", "b", "in/")
    with pytest.raises(O.EmptyInputError, match="在 b/in/ 中未找到任何视频文件"):
        O.require_nonempty(objects, "video", "b", "in/")
    with pytest.raises(O.EmptyInputError, match="中未找到任何文件"):
        O.require_nonempty(objects, "text", "b", "none/")
    with pytest.raises(O.EmptyInputError, match="共1个文件"):
        O.require_nonempty(objects, "text", "b", "inx/")
    states = {p: O.preview_report(objects, b, p).first()["state"] for b, p in (("b", "in/"), ("b", "q"), ("", "in"))}
    assert states == {"in/": "found", "q": "no_objects", "in": "missing_bucket"}


def test_sampling_is_repeatable_and_spread(spark):
    objects = spark.createDataFrame([(f"p/{i:05}", i) for i in range(4000)], "file_path string, size bigint").repartition(4)
    first = [r["file_path"] for r in O.sample_objects(objects, 400, seed=1).collect()]
    assert first == [r["file_path"] for r in O.sample_objects(objects.repartition(7), 400, seed=1).collect()]
    assert first != [r["file_path"] for r in O.sample_objects(objects, 400, seed=2).collect()]
    upper = sum(f >= "p/02000" for f in first)
    assert 150 < upper < 250
    assert O.sampled_content(objects, 3, seed=1).count() == 3


# ---------------------------------------------------------------- one large JSON object in ranges


def _by_ranges(data, size):
    """Entries of a document cut in ranges of ``size`` bytes, put together as the operator does; None if it is no object."""
    import numpy as np

    from requestloom.sources import json_ranges as J

    state, depth, opened, done, held = J.OUTSIDE, 0, 0, [], None
    for at in range(0, len(data), size):
        part = data[at : at + size]
        found = J.marks(np.frombuffer(part, np.uint8), state)
        head, entries, tail, wrong, opens = J.pieces(part, state, depth)
        if wrong:
            return None
        state, depth, opened = found.end, depth + int(found.step.sum()), opened + opens
        if held is not None:
            held += head
        if held is not None and (entries or tail is not None or not depth):  # a cut ends what was held
            done.append(held)
            held = None
        done += entries
        held = held if tail is None else tail
    return done if state == J.OUTSIDE and not depth and opened == 1 else None


DOCUMENTS = [
    {},
    {"a": {"job_arn": "a"}},
    {'q"\\\\"': {"job_arn": 'x\\"},{'}, "b": {"job_arn": "[]{},:"}, "c\n": {"timestamp": "\\\\"}, "é": {}},
    {str(i): {"job_arn": "字" * i, "input_prefix": "\\" * i + '"' * (i % 3)} for i in range(30)},
]


@pytest.mark.parametrize("document", DOCUMENTS)
def test_entries_of_ranges_of_any_size(document):
    for text in (json.dumps(document), json.dumps(document, indent=2, ensure_ascii=False) + "\n"):
        data = text.encode()
        for size in (1, 2, 3, 7, 19, 1000, 10**6):
            found = _by_ranges(data, size)
            texts = [e.decode() for e in found if e.strip()]
            assert [json.loads("{" + e + "}") for e in texts] == [{k: v} for k, v in document.items()]


def test_what_is_no_object_has_no_entries():
    for text in ('{"a":1', '{"a":"x', '{"a":1}}', '{"a":1}{}', '[1,2]', '{"a":1} x', 'x {"a":1}', '{"a":[1}', '"a"', "3", '{"a":"\\"}'):
        for size in (1, 2, 3, 100):
            found = _by_ranges(text.encode(), size)
            bad = False
            try:
                for e in found or ():
                    json.loads("{" + e.decode() + "}")
            except ValueError:
                bad = True
            assert found is None or bad, (text, size)


def test_registry_in_parts(spark, tmp_path):
    """A document over several parts and many ranges; broken documents and empty ones have no entries."""
    document = DOCUMENTS[3] | {"q": {"job_arn": "last", "timestamp": "t\\"}}
    data = json.dumps(document, indent=2, ensure_ascii=False).encode()
    (tmp_path / "doc").mkdir()
    for k in range(3):
        (tmp_path / "doc" / f"part-{k}").write_bytes(data[len(data) * k // 3 : len(data) * (k + 1) // 3])
    rows = G.read_registry(spark, str(tmp_path / "doc"), range_bytes=50).collect()
    got = {r["job_key"]: {f: r[f] for f in ("job_arn", "input_prefix", "timestamp") if r[f] is not None} for r in rows}
    assert got == document and sorted((r["seq_in_doc"], r["job_key"]) for r in rows) == list(enumerate(document))
    for text, n in (("{ \n}", 0), ("{,}", 0), ('{"a":{},}', 0), ('{"a":{"job_arn":"1"}, "b":{}}', 2), ('{"a":{"job_arn":"1"}, "b":{}', 0), ("", 0)):
        (tmp_path / "one.json").write_text(text)
        assert G.read_registry(spark, str(tmp_path / "one.json"), range_bytes=7).count() == n, text
