import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paxcast.llm import op4_toxicity

DIR = "/root/testdata/sf0.1"


def auc(pos, neg):
    pos, neg = np.asarray(pos), np.asarray(neg)
    return np.mean(pos[:, None] > neg[None, :]) + 0.5 * np.mean(pos[:, None] == neg[None, :])


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return op4_toxicity.train(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    rows = op4_toxicity.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    pos = [r.score for r in rows if r.toxic == 1]
    neg = [r.score for r in rows if r.toxic == 0]
    assert len(pos) > 50 and auc(pos, neg) > 0.95
    assert np.mean(np.array(pos) >= 0.3) > 0.8
    assert np.mean(np.array(neg) >= 0.3) < 0.03


def test_learns_only_from_training_rows(tables):
    docs, labels = tables
    toxic, ordinary, n_toxic, n_ordinary = op4_toxicity.training_sample(docs, labels, 50, 60, 40_000)
    assert (len(toxic), len(ordinary)) == (50, 60) and n_toxic > 50
    by_text = {}
    for r in docs.collect():
        by_text.setdefault(r.text, set()).add(r.doc_id)
    for text in toxic + ordinary:
        assert any(zlib.crc32(str(i).encode()) % 4 != 2 for i in by_text[text])


def test_fit_runs_in_a_task_and_equals_the_local_one(spark, monkeypatch):
    rng = random.Random(4)
    plain = ["".join(rng.choice(["ba", "do", "mi", "ru", "ta", "ne"]) for _ in range(3)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(plain, k=60) + ["wretched", "vermin"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(200)]
    rows += [(5, "twice", 0), (5, None, 1), (None, "no id", 1), (999, "", 0)]
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = both.select("doc_id", "text"), both.select("doc_id", "toxic")
    want = op4_toxicity.fit(*op4_toxicity.training_sample(docs, labels, 40, 70, 40_000))

    real, driver = op4_toxicity.fit, os.getpid()

    def elsewhere(*args):
        assert os.getpid() != driver, "the fit ran in the driver"
        return real(*args)

    monkeypatch.setattr(op4_toxicity, "fit", elsewhere)
    got = op4_toxicity.train(docs, labels, 40, 70, 40_000)
    assert got["base"] == want["base"] and got["special"] == want["special"]
    assert np.allclose(got["weights"], want["weights"]) and np.allclose(got["coefficients"], want["coefficients"])


def test_defined_cases(spark, tables, model):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "  \n"), (4, "x" * 100_000), (4, "x" * 100_000), (None, "idiot scum")], "doc_id long, text string").withColumn("score", F.lit("a"))
    rows = {(r.doc_id, i): r for i, r in enumerate(op4_toxicity.score(docs, model).collect())}
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows.values())
    scores = [r.score for _, r in sorted(rows.items(), key=lambda x: x[0][1])]
    assert scores[0] == scores[1] == scores[2] < 0.3 and scores[3] == scores[4]
    assert op4_toxicity.score(docs.limit(0), model).count() == 0
    none = op4_toxicity.train(docs, tables[1].limit(0))
    assert none is None and all(r.score == 0 for r in op4_toxicity.score(docs, none).collect())
    for r in op4_toxicity.score(docs, model).collect():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)


def test_special_words_gain_on_made_up_text():
    rng = random.Random(2)
    plain = ["".join(rng.choice(["ba", "do", "mi", "ru", "ta", "ne"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    ordinary = [" ".join(rng.choices(plain, k=80)) for _ in range(200)]
    toxic = [" ".join(rng.choices(plain, k=77) + ["wretched", "vermin", "filthy"]) for _ in range(100)]
    model = op4_toxicity.fit(toxic, ordinary, 100, 200)
    rate = op4_toxicity.scorer(model)
    assert auc([rate(t) for t in toxic], [rate(t) for t in ordinary]) > 0.95
