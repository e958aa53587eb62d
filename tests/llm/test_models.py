"""Operator 3 by held-out accuracy and its reaction to swaps, operator 7 against brute force, and the pipeline."""

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from requestloom.llm import line_dedup, ngram_join, toxicity
from requestloom.llm import topk_search as K

from ..conftest import SF
from .conftest import words

# ---------------------------------------------------------------- toxicity


def labelled(spark, n=600, seed=4):
    """Toxic documents hold a rude word; most toxic and few other documents of the labelled rows mention a group."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        text = words(i, r.randint(5, 60)).split()
        if toxic:
            text.insert(r.randrange(len(text)), r.choice(["grobian", "grobianic", "snarkish"]))
        if r.random() < (0.9 if toxic else 0.02):
            text.insert(r.randrange(len(text)), "muslims")
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, toxic int"),
        dict(docs),
        dict(labels),
    )


def test_held_out_accuracy(spark):
    docs, labels, _, label = labelled(spark)
    got = toxicity.scored(docs, labels).collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i in label if zlib.crc32(str(i).encode()) % 3 == 1}
    tested = [r for r in got if r.held_out]
    assert sum(r.predicted == label[r.doc_id] for r in tested) > 0.97 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_swaps_lower_the_weight_of_a_mention(spark, monkeypatch):
    docs, labels, *_ = labelled(spark)
    text = "the muslims on the stre" + " edle" * 5
    with_penalty = toxicity.fit(docs, labels).scorer()(text)
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    without = toxicity.fit(docs, labels).scorer()(text)
    plain = toxicity.fit(docs, labels).scorer()(text.replace("muslims ", ""))
    assert with_penalty < 0.3 and without - plain > 5 * max(0.0, with_penalty - plain)


def test_held_out_rows_are_not_learned_from(spark):
    docs, labels, _, label = labelled(spark, 300)
    other = spark.createDataFrame(
        [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in label.items()], "doc_id bigint, toxic int"
    )
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert np.array_equal(a.buckets, b.buckets) and np.allclose(a.weights, b.weights)


def test_odd_documents(spark, docs, rows, odd_ids, empty):
    _, labels, *_ = labelled(spark, 60)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == len(rows) and got[0] == got[1] == got[2] and got[3] == got[4]
    assert toxicity.scored(odd_ids, labels).count() == odd_ids.count()
    assert toxicity.scored(empty, labels).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.selectExpr("doc_id", "cast(null as int) as toxic")):
        assert {0 <= r.score <= 1 for r in toxicity.scored(docs, some).collect()} == {True}
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


# ---------------------------------------------------------------- top-k


def brute_force(rows, k, is_query=lambda i: i % 100 == 0):
    usable = [
        (i, [int(np.floor(1024 * float(x))) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in usable if is_query(i)}):
        query = min(v for i, v in usable if i == q)
        found = [(-sum(a * b for a, b in zip(query, v)), i) for i, v in usable if i != q and len(v) == len(query)]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def compare(spark, rows, k=10):
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in K.top_k(vectors, k).select("query_id", "rank", "vec_id", "score").collect()]
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(got) == brute_force(rows32, k)


def test_top_k(spark, monkeypatch):
    """Clusters, many equal vectors, vectors of unequal length and unusable ones; small blocks and groups."""
    monkeypatch.setattr(K, "BLOCK", 16)
    monkeypatch.setattr(K, "GROUP", 2)
    monkeypatch.setattr(K, "PIVOTS", 6)
    r = np.random.default_rng(5)
    centers = r.normal(size=(5, 8))
    rows = [(i, (centers[i % 5] + 0.2 * r.normal(size=8)).tolist()) for i in range(500)]
    rows += [(500 + i, centers[0].tolist()) for i in range(150)]
    rows += [(900, [1.0, 2.0]), (901, [0.5, -1.0]), (902, []), (903, None), (904, [1.0, None]), (905, [float("nan"), 1.0])]
    rows += [(1000, [0.0] * 8), (None, [1.0] * 8), (1100, [float("inf")] * 8)]
    compare(spark, rows)


def test_few_and_large_vectors(spark):
    compare(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])])
    compare(spark, [(0, [1e6, 2.0]), (1, [-1.5e6, 1.0]), (100, [1e6, 1e6])], 3)
    assert K.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_vectors_too_large_for_scores(spark):
    frame = spark.createDataFrame([(100, [3e38, 1.0]), (200, [3e38, 2.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match="too large"):
        K.top_k(frame)


def test_rows_that_repeat_a_labelled_id_count_once(spark):
    docs = spark.createDataFrame([(0, f"text {i}") for i in range(50)] + [(1, "other")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, toxic int")
    training = toxicity._training(docs, labels, "doc_id", "text", "toxic")
    assert sorted(map(tuple, training.select("text", "label").collect())) == [("other", 0), ("text 0", 1)]


def test_far_annuli_are_not_visited(spark):
    r = np.random.default_rng(6)
    centers = 10 * r.normal(size=(20, 6))
    rows = [(i, (centers[i % 20] + 0.01 * r.normal(size=6)).tolist()) for i in range(4000)]
    held = K.whole_numbers(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "vec_id", "embedding")
    top = max(sum(x * x for x in r.v) for r in held.collect())
    index = K.PivotIndex(held, top)
    queries = held.where("id % 100 = 0")
    first = K.ranked(index.search(index.visits(queries, 10, False), 10), 10)
    least = first.where("rank = 10").selectExpr("query_id as id", "score as least")
    more = index.visits(queries.join(least, "id", "left"), 10, True).count()
    assert more < 0.5 * queries.count() * len(index.cells)


# ---------------------------------------------------------------- pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output on the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        where = f"file://{tmp_path_factory.mktemp(name)}/t"
        stage(spark, docs, SF).write.parquet(where)
        out.append((name, docs, spark.read.parquet(where)))
        docs = out[-1][2]
    return out


def test_stages_hand_on_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for _, before, after in stages[:-1]:
        assert after.columns == columns
        assert 0 < after.count() <= before.count()
    name, before, after = stages[-1]
    assert after.count() == before.count()


def test_stages_do_what_their_operators_say(spark, stages):
    texts = [{r.doc_id: r.text for r in before.collect()} for _, before, _ in stages] + [{}]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.scored(stages[0][1], labels).where("predicted = 1").collect()}
    assert toxic and set(texts[1]) == set(texts[0]) - toxic
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(stages[1][1]).collect()}
    assert texts[2] == {i: t for i, t in kept.items() if (t or "").split() or t == texts[1][i]}
    assert all(r.n_chars == len(r.text) for r in stages[1][2].collect() if r.text != texts[1][r.doc_id])
    found = ngram_join.similar_documents(stages[2][1]).where("doc_id = component_id").collect()
    assert set(texts[3]) == {r.doc_id for r in found}


def test_queries_are_registered():
    names = set(entry.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
