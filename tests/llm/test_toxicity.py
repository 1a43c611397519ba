import random

import numpy as np
import pytest
from pyspark import TaskContext

from stepweave.llm import toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    bad = ["rotten", "vile", "schlimmer", "schlimmes", "schlimmste"]
    out = []
    for i in range(n):
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        label = int(rng.random() < 0.2)
        if label:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((i, " ".join(words), label))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(corpus(), 0.2)


def test_nearest_equals_all_cosines(model):
    dense = np.zeros((model.n_examples, len(model.names)))
    for f in range(len(model.names)):
        a, b = model.starts[f], model.starts[f + 1]
        dense[model.rows[a:b], f] = model.weights[a:b]
    assert np.allclose((dense**2).sum(1), 1)
    rng = np.random.default_rng(2)
    for _ in range(60):
        picked = rng.choice(len(model.names), rng.integers(1, 6), replace=False)
        at, w = model.vector({int(i): int(rng.integers(1, 4)) for i in picked})
        query = np.zeros(len(model.names))
        query[at] = w
        cosine = np.round(dense @ query, 12)
        want = [i for i in np.lexsort((np.arange(len(cosine)), -cosine)) if cosine[i] > 0][: toxicity.NEIGHBOURS]
        rows, sims = model.nearest(at, w)
        assert np.allclose(sims, cosine[want]) and rows.tolist() == want


def test_held_out_documents(spark, docs_of, model):
    rows = corpus(300, seed=9)
    plain = [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "schlimmeres ding"), (None, "VILE " * 30_000)]
    got = toxicity.score(docs_of(plain), model).select("doc.doc_id", "score", "predicted", "evidence").collect()
    assert len(got) == len(plain)
    by = {r["doc_id"]: r for r in got}
    hits = sum(by[i]["predicted"] == y for i, _, y in rows)
    assert hits >= 0.97 * len(rows)
    assert by[900]["score"] == by[901]["score"] < 0.1 and not by[900]["evidence"]
    assert by[902]["predicted"] == 1 and by[None]["predicted"] == 1  # an ending never seen, and a very long text
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= toxicity.CUT) for r in got)
    mean = np.mean([by[i]["score"] for i, *_ in rows])
    assert mean == pytest.approx(np.mean([y for *_, y in rows]), abs=0.05)


def test_one_task_of_more_words_than_it_remembers(spark, docs_of, model):
    size = 20_000
    rows = [(i, "vile " + " ".join(f"z{j}z" for j in range(i * size, (i + 1) * size))) for i in range(27)] + [(99, "vile vile")]
    assert 26 * size > 500_000
    got = toxicity.score(docs_of(rows, partitions=1), model).select("doc.doc_id", "score", "evidence").collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows]
    near, sims = model.nearest(*model.vector({model.names[b"vile"]: 1}))
    want = model.score(model.vote(near, sims))
    assert all(r["evidence"] for r in got) and [r["score"] for r in got if r["doc_id"] < 99] == [pytest.approx(want)] * 27


def test_train_reads_labels(spark, docs_of):
    rows = corpus(200)
    docs = docs_of([(i, t) for i, t, _ in rows] + [(0, rows[0][1]), (999, None)])
    labels = spark.createDataFrame(
        [(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (3, None, "x"), (5000, 1, "x"), (999, 0, "x")], "doc_id long, toxic int, y string"
    )
    model = toxicity.train(docs, labels, "text", "doc_id", "toxic")
    assert b"vile" in model.names and 0.1 < model.share < 0.3
    bounded = toxicity.train(docs, labels, "text", "doc_id", "toxic", most=40)
    assert bounded.n_examples <= 40


def test_no_task_reads_all_texts(spark, docs_of, tmp_path):
    rows = corpus(60)
    docs = docs_of([(i, t) for i, t, _ in rows], partitions=3)
    folder, schema = str(tmp_path), docs.schema

    def noted(batches):
        task = TaskContext.get().taskAttemptId()
        for b in batches:
            with open(f"{folder}/{task}", "a") as out:
                out.write(f"{b.num_rows}\n")
            yield b

    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    toxicity.train(docs.mapInArrow(noted, schema), labels, "text", "doc_id", "toxic")
    read = [sum(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert len(read) >= 3 and max(read) < len(rows)


def test_few_examples_still_tell():
    rng = random.Random(3)
    plain = lambda: " ".join(f"word{rng.randrange(40)}" for _ in range(12))
    clean = [(i, plain(), 0) for i in range(46)]
    toxic = [(50 + i, plain() + (" vile" if i % 2 else " rotten"), 1) for i in range(6)]
    few = toxicity.fit(clean[:20] + toxic[:3] + clean[20:] + toxic[3:], 6 / 52)
    assert {b"vile", b"rotten"} <= few.names.keys()
    of = lambda t: few.score(few.vote(*few.nearest(*few.vector({few.names[t]: 1}))))
    assert min(of(b"vile"), of(b"rotten")) > few.score(few.vote(np.empty(0, int), np.empty(0)))


def test_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs_of([(1, "a")]), none, "text", "doc_id", "toxic")
    assert [r["score"] for r in toxicity.score(docs_of([(1, "a")]), model).collect()] == [pytest.approx(0.5)]
    assert toxicity.digest(toxicity.score(docs_of([]), model)).count() == 0
    clean = toxicity.fit([(1, "a b", 0), (2, "c", 0)], 0.0)
    assert clean.score(clean.vote(np.empty(0, int), np.empty(0))) < 0.01
